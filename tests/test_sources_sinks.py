"""Readers, writers, streaming twins and model stages on small literal inputs."""

import bz2
import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from turnpike.operators import models
from turnpike.sources import archives, sinks
from turnpike.sources import tables as S
from turnpike.streaming import windows


def test_weather_files_by_header(spark, tmp_path):
    """Fields are found by name, whatever the order; missing values, traces of rain, repeated rows, files without some fields."""
    head = "station,valid,tmpf,dwpf,relh,drct,sknt,p01i,alti,mslp,vsby,gust,skyc1,skyc2,skyc3,skyl1,skyl2,skyl3,wxcodes\n"
    row = "X,2024-01-01 00:20,50,M,77.7,90,12,T,29.9,M,10,M,BKN,FEW,M,1200,300,M,M\n"
    (tmp_path / "a.csv").write_text(head + row + row)
    (tmp_path / "b.csv").write_text("wxcodes,vsby,valid,station,p01i\nRA,3,2024-01-01 00:50,Y,0.1\n")
    rows = {r.station: r for r in S.weather_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    x, y = rows["X"], rows["Y"]
    assert len(rows) == 2 and set(S.WEATHER_TEXT + S.WEATHER_NUMBERS) == set(x.asDict())
    assert (x.p01i, x.dwpf, x.relh, x.drct, x.sknt, x.vsby, x.skyc1, x.skyl1, x.skyc2, x.skyl2, x.skyc3, x.wxcodes) == (0.0, None, 77.7, 90.0, 12.0, 10.0, "BKN", 1200.0, "FEW", 300.0, None, None)
    assert (y.p01i, y.vsby, y.tmpf, y.wxcodes, str(y.valid)) == (0.1, 3.0, None, "RA", "2024-01-01 00:50:00")
    with pytest.raises(FileNotFoundError):
        S.weather_csv(spark, [])


def test_latin1_and_compressed_csv_skip_missing_years(spark, tmp_path):
    (tmp_path / "y1.csv").write_bytes("name,n\nZürich,1\n".encode("latin-1"))
    (tmp_path / "y2.csv.bz2").write_bytes(bz2.compress("name,n\nMálaga,2\n".encode("latin-1")))
    paths = [str(tmp_path / n) for n in ("y1.csv", "y2.csv.bz2", "y3.csv")]
    assert sorted(r.name for r in S.latin1_csv(spark, paths).collect()) == ["Málaga", "Zürich"]
    with pytest.raises(FileNotFoundError):
        S.latin1_csv(spark, [str(tmp_path / "none.csv")])


def test_date_prefixes(spark):
    f = spark.createDataFrame([("2024-01-02T03:04",), ("2024-01-02",), ("02/01/2024",), (None,)], "t string")
    assert [str(r[0]) for r in f.select(S.date_prefix("t")).collect()] == ["2024-01-02", "2024-01-02", "None", "None"]


def test_partitions_resume_and_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    made = []

    def make(key):
        made.append(key)
        return spark.range(3).withColumn("key", F.lit(key))

    assert sinks.run_missing(spark, path, "day", ["a", "b"], make) == ["a", "b"]
    assert sinks.run_missing(spark, path, "day", ["a", "b", "c"], make) == ["c"]
    assert made == ["a", "b", "c"] and spark.read.parquet(path).count() == 9
    sinks.write_parquet(spark.range(1).withColumn("key", F.lit("x")).withColumn("day", F.lit("a")), path, partition_by=["day"])
    assert spark.read.parquet(path).count() == 7


def test_csv_report_and_manifest(spark, tmp_path):
    f = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    sinks.write_csv(f, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sinks.markdown(f.orderBy("a")).splitlines()[2:] == ["| 1 | 2.5 |", "| 2 |  |"]
    with pytest.raises(ValueError, match="report"):
        sinks.markdown(f, most=1)
    text = sinks.report({"Rows": f.orderBy("a")}, title="Run", facts={"rows": 2})
    assert text.startswith("# Run\n\n* rows: 2\n\n## Rows\n\n| a | b |") and text.endswith("| 2 |  |\n")
    one = sinks.manifest(f, ["code"], {"x": 1})
    assert one == sinks.manifest(f.select("b", "a"), ["code"], {"x": 1})
    with pytest.raises(ValueError, match="same"):
        sinks.assert_comparable(one, dict(one))


def test_submission_checks(spark):
    template = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    p = spark.createDataFrame([(1, 2.5), (2, -1.0), (2, None), (9, 1.0)], "id long, v double")
    assert {r.issue: r.n for r in sinks.check_submission(template, p, id_col="id", value_col="v").collect()} == {"missing": 1, "extra": 1, "null": 1, "negative": 1, "repeated": 1}
    for wrong in (p, p.where("id = 1"), p.where("v >= 0")):
        with pytest.raises(ValueError, match="conform"):
            sinks.conform(template, wrong, id_col="id", value_col="v")
    fine = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, 0.2), (9, -4.0)], "id long, v double").where("id < 9")
    assert {r.id: r.v for r in sinks.conform(template, fine, id_col="id", value_col="v").collect()} == {1: 2, 2: 4, 3: 0}


def test_written_once_and_reused(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    path = str(tmp_path / "cache")
    assert [sinks.reuse(spark, path, make).count() for _ in range(2)] == [5, 5] and made == [1]
    template = spark.range(2)
    sinks.write_submission(template, template.withColumn("v", F.lit(1.5)), str(tmp_path / "sub"), id_col="id", value_col="v")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "sub")).collect()} == {(0, 2), (1, 2)}


def test_days_come_from_folders(spark, tmp_path):
    f = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "i int, day string")
    path = str(tmp_path / "days")
    sinks.write_parquet(f, path, partition_by=["day"])
    assert [(r.i, str(r.day)) for r in S.read_days(spark, path, "2024-01-02").orderBy("i").collect()] == [(2, "2024-01-02"), (3, "2024-01-03")]
    pruned = S.read_days(spark, path, "2024-01-02", "2024-01-02")
    assert pruned.count() == 1 and "PartitionFilters: [" in pruned._jdf.queryExecution().toString() and "isnotnull(day" in pruned._jdf.queryExecution().toString()
    assert sinks.finished(spark, path, "day") == {"2024-01-01", "2024-01-02", "2024-01-03"}


def test_points_of_two_schemas(spark):
    old = spark.createDataFrame([("a", "X", 10.0, -1), ("a", "X", 20.0, 300), ("a", "X", 86_400.0, 5), ("a", "X", 10.0, -1)], "hex string, airport string, ts double, alt int")
    new = spark.createDataFrame([("b", "X", 10.0, None, True, 90.0), ("b", "X", 20.0, 400.0, False, None)], "hex string, airport string, ts double, alt_raw double, is_ground boolean, track double")
    points = S.unify_points(old, new)
    assert points.columns == list(S.POINT_COLUMNS)
    got = [(r.hex, r.ts, r.is_ground, r.alt_baro, r.track) for r in S.points_of_day(points, "1970-01-01").orderBy("hex", "ts").collect()]
    assert got == [("a", 10.0, True, None, None), ("a", 20.0, False, 300.0, None), ("b", 10.0, True, None, 90.0), ("b", 20.0, False, 400.0, None)]


def test_text_records_attach_to_the_stand_before_them(spark):
    lines = ["1301 A early", "1300 1.5 2.5 90 gate jets A 12", "1301 E airline", "100 29 1", "1301 F cargo dlh aua", "1300 x 2 3 gate jets B", "", "1302 city", "1301 C", "1300 1 2"]
    f = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.name: (r.lat, r.heading, r.stand_type, r.aircraft_classes, r.width, r.operation, r.airlines) for r in S.records_of_text(f).collect()}
    assert got == {"A 12": (1.5, 90.0, "gate", "jets", "F", "cargo", "dlh aua"), "B": (None, 3.0, "gate", "jets", "", "", "")}


def test_runway_records_give_both_ends(spark):
    f = spark.createDataFrame([(0, "100 45.5 1 0 0.25 0 2 1 07C 50.1 8.1 120 0 1 1 1 0 25C 50.2 8.9 0 60 3 1 1 1"), (1, "100 45 1"), (2, "1300 1 2 3 4 5")], "line_no long, value string")
    got = sorted((r.runway, r.lat, r.lon, r.displaced_m, r.width_m, r.opposite) for r in S.runways_of_text(f).collect())
    assert got == [("07C", 50.1, 8.1, 120.0, 45.5, "25C"), ("25C", 50.2, 8.9, 0.0, 45.5, "07C")]


def test_traces_of_mixed_and_broken_json(spark):
    trace = '[[0, 1.5, 2.5, "ground", 3.5, null, 0, 1, {"flight": "AB", "n": [1, 2]}, "adsb_icao"], [9, 1.6, 2.6, 1200, null, 88.5, 0, 1, null, {"x": 1}], [12]]'
    f = spark.createDataFrame([(1, trace), (2, "nonsense"), (3, None)], "i int, j string")
    got = [tuple(r) for r in S.trace_points(f, "j", ["i"]).orderBy("at").collect()]
    assert got == [(1, 0, 0.0, 1.5, 2.5, None, True, 3.5, None, "adsb_icao"), (1, 1, 9.0, 1.6, 2.6, 1200.0, False, None, 88.5, None), (1, 2, 12.0, None, None, None, False, None, None, None)]


def test_streaming_bins_equal_the_batch_bins(spark, tmp_path):
    rows = [("A", "DEP", "R1", "2024-01-01 00:01:00", 1), ("A", "ARR", None, "2024-01-01 00:02:00", 1), ("A", "DEP", "R0", "2024-01-01 00:06:00", 2)]
    f = spark.createDataFrame(rows, "airport string, phase string, runway string, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    for name, make in (("bins", windows.config_bins), ("rolls", windows.rolling_counts), ("sess", windows.sessions)):
        q = make(stream).writeStream.outputMode("complete" if name != "sess" else "append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    got = [(r.airport, r.config, r.n_dep, r.n_arr) for r in spark.table("bins").orderBy("bin_start").collect()]
    assert got == [("A", "R1", 1, 1), ("A", "R0", 1, 0)]
    assert got == [(r.airport, r.config, r.n_dep, r.n_arr) for r in windows.config_bins(f).orderBy("bin_start").collect()]
    assert spark.table("rolls").agg(F.max("n")).first()[0] == 3


def test_model_stages(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else float(i % 3), str(i % 3), 5.0 * (i % 10)) for i in range(300)]
    f = spark.createDataFrame(rows, "key long, a double, b double, fold string, y double")
    out = models.month_folds(f, ["a", "b"], F.col("y"), fold="fold", folds=["0", "1", "2"], key="key", rounds=4, eta=0.6)
    joined = out.join(f, "key")
    assert out.count() == 300 and joined.agg(F.sqrt(F.avg((F.col("pred") - F.col("y")) ** 2))).first()[0] < 5
    c = models.fit_classifier(f, ["a", "b"], (F.col("y") > 20).cast("int"), rounds=3)
    p = models.predict(c, f, ["a", "b"], "p").agg(F.min("p"), F.max("p")).first()
    assert 0 <= p[0] < 0.5 < p[1] <= 1
    fixed = spark.createDataFrame([(100.0, -200.0), (8000.0, -200.0), (7200.0, 5.0)], "base double, r double").select(models.corrected(F.col("base"), F.col("r"))).collect()
    assert [r[0] for r in fixed] == [0.0, 8000.0, 7205.0]


def test_huber_loss_bears_outliers_and_stops_early(spark):
    rows = [(float(i % 5), 100.0 * (i % 5) + (1e6 if i % 97 == 0 else 0.0), i % 4 == 0) for i in range(1000)]
    f = spark.createDataFrame(rows, "a double, y double, valid boolean")
    error = {}
    for loss in ("huber", "squared"):
        model = models.boost(f, ["a"], F.col("y"), loss=loss, alpha=50.0, rounds=6, eta=0.5, bagging=1.0)
        error[loss] = model.predict(f.where("y < 1000"), "p").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert error["huber"] < 150 < error["squared"]
    noise = models.boost(f.withColumn("y", F.rand(1)), ["a"], F.col("y"), loss="squared", rounds=12, eta=1.0, valid=F.col("valid"), patience=2)
    assert len(noise.trees) < 12 and len(noise.curve) >= len(noise.trees)
    assert models.boost(f.where("false"), ["a"], F.col("y")).predict(f, "p").select("p").distinct().count() == 1


def test_month_driver_guards_against_leaks(spark):
    rows = [(i, "A" if i % 2 else "LIRF", f"o{i % 3}", f"s{i % 4}", "s", "r", float(i % 7), float(60 * (i % 9)), 100 + 30 * (i % 7), 10 * (i % 9) - 30, f"m{i % 4}") for i in range(400)]
    names = "mvt_id long, airport string, operator string, stand string, stand_group string, runway string, x double, sched_takeoff_offset double, taxi long, d long, ym string"
    f = spark.createDataFrame(rows, names).withColumn("aobt3_taxi", F.when(F.col("mvt_id") % 5 != 0, 1))
    frame, labels = f.drop("taxi", "d", "ym"), f.drop("x", "sched_takeoff_offset", "aobt3_taxi")
    new = frame.join(labels.where("ym = 'm3'").select("mvt_id"), "mvt_id", "left_semi")
    how = {"columns": ["x", "sched_takeoff_offset"], "rounds": 2, "depth": 3}
    out = models.fit_predict_months(frame, labels, ["m0", "m1", "m2"], new, valid_month="m2", holdout=["m3"], **how).out.collect()
    assert len(out) == 100 and all(r.pred is not None and 0 <= r.echo_prob <= 1 for r in out)
    assert all(r.use_prior == (r.mvt_id % 5 == 0 and r.mvt_id % 2 == 1) for r in out)
    with pytest.raises(ValueError, match="holdout"):
        models.fit_predict_months(frame, labels, ["m0", "m3"], new, valid_month="m0", holdout=["m3"], **how)
    with pytest.raises(ValueError, match="overlap"):
        models.fit_predict_months(frame, labels, ["m0", "m3"], new, valid_month="m0", **how)
    with pytest.raises(ValueError, match="missing"):
        models.fit_predict_months(frame, labels, ["m0", "m9"], new, valid_month="m0", **how)


def test_group_encodings_out_of_fold(spark):
    rows = [(1, "A", "o", "s", "m1", 0), (2, "A", "o", "s", "m2", 100), (3, "A", "p", None, "m2", 20_000), (4, "A", "o", "s", "m3", None), (5, "B", "o", "s", "m1", 0)]
    f = spark.createDataFrame(rows, "mvt_id long, airport string, operator string, stand string, ym string, d long")
    got = {r.mvt_id: r for r in models.with_group_encodings(f.drop("d"), f, fold="ym").collect()}
    assert (got[1].op_n, got[1].op_echo_rate) == (1, 0.0) and got[1].op_mean_d == pytest.approx((100 + 30 * (100 + 10_800) / 2) / 31)
    assert (got[2].op_n, got[2].op_echo_rate, got[2].op_mean_d) == (1, 1.0, 0.0)
    assert (got[3].op_n, got[3].stand_n, got[3].stand_echo_rate) == (0, 0, 1.0)
    # A row whose own fold knows nothing gets what all others say of its group; an airport without other rows nothing.
    assert got[4].op_n == 2 and got[4].op_echo_rate == pytest.approx((1 + 30 / 3) / 32)
    assert got[5].op_echo_rate is None and got[5].op_n == 0
    full = {r.mvt_id: r for r in models.with_group_encodings(f.drop("d"), f).collect()}
    assert full[5].op_echo_rate == 1.0 and full[1].op_n == 2 and full[3].stand_mean_d == pytest.approx((0 + 100 + 10_800) / 3)


def archive(path, members):
    """A tar of traces; a member that is no dictionary is written as it is."""
    with tarfile.open(path, "w") as tar:
        for name, content in members.items():
            data = gzip.compress(json.dumps(content).encode()) if isinstance(content, dict) else content
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_split_archives_replicas_and_broken_members(spark, tmp_path):
    points = [[0, 1.0, 1.0, "ground", 3.0, None, 0, 0, {"a": 1}, "x"], [5, 1.5, 1.5, 900], [9, 50.0, 50.0, 1]]
    good = {"a/trace_full_abc.json": {"icao": "ABC", "r": "D-X", "timestamp": 100.0, "trace": points}, "readme.txt": b"no trace", "a/trace_full_def.json": {"trace": []}}
    archive(tmp_path / "good.tar", good)
    archive(tmp_path / "bad.tar", good | {"a/trace_full_bad.json": b"\x1f\x8bbroken"})
    whole = (tmp_path / "good.tar").read_bytes()
    (tmp_path / "p1").write_bytes(whole[:1000])
    (tmp_path / "p2").write_bytes(whole[1000:])
    (tmp_path / "cut.tar").write_bytes(whole[:600])
    split, bad, cut = [str(tmp_path / "p1"), str(tmp_path / "p2")], [str(tmp_path / "bad.tar")], [str(tmp_path / "cut.tar")]
    traces = archives.trace_archives(spark, [("2024-01-01", split), ("2024-01-02", bad)], tolerant=True).collect()
    assert sorted((r.day, r.hex, r.reg, r.base, r.error is None) for r in traces) == [("2024-01-01", "abc", "D-X", 100.0, True), ("2024-01-01", "def", None, 0.0, True), ("2024-01-02", "abc", "D-X", 100.0, True), ("2024-01-02", "bad", None, None, False), ("2024-01-02", "def", None, 0.0, True)]
    boxes = spark.createDataFrame([("B", 2, 0.0, 2.0, 0.0, 2.0), ("A", 1, 1.2, 2.0, 1.2, 2.0)], "box string, box_order int, lat_min double, lat_max double, lon_min double, lon_max double")
    days = {"2024-01-01": [cut, split], "2024-01-02": [bad, cut]}
    out, manifest = str(tmp_path / "points"), str(tmp_path / "manifest")
    assert archives.ingest_days(spark, days, boxes, out, manifest) == ["2024-01-01", "2024-01-02"]
    assert archives.ingest_days(spark, days, boxes, out, manifest) == []
    got = [(str(r.day), r.hex, r.ts, r.is_ground, r.alt_raw, r.gs, r.src, r.airport) for r in S.read_days(spark, out).orderBy("day", "ts").collect()]
    assert got[:2] == [("2024-01-01", "abc", 100.0, True, None, 3.0, "x", "B"), ("2024-01-01", "abc", 105.0, False, 900.0, None, None, "A")] and len(got) == 4
    assert sorted((r.day, r.replica, r.traces, r.broken) for r in spark.read.json(manifest).collect()) == [("2024-01-01", 1, 2, 0), ("2024-01-02", 0, 3, 1)]


def test_transfers_are_whole_and_happen_once(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    assert archives.transfer(spark, str(tmp_path / "a"), str(tmp_path / "b")) and (tmp_path / "b").read_text() == "one"
    (tmp_path / "a").write_text("two")
    assert not archives.transfer(spark, str(tmp_path / "a"), str(tmp_path / "b")) and (tmp_path / "b").read_text() == "one"
    assert archives.transfer(spark, str(tmp_path / "a"), str(tmp_path / "b"), again=True) and (tmp_path / "b").read_text() == "two"
