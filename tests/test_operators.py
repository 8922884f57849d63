"""Edge frames and brute force for the ordered, joined and fitted operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnpike.functions import exprs as X
from turnpike.operators import blend, encode, evaluate, features, joins, temporal, tracks

S = 1_000_000


def test_clip_keeps_null_and_ignores_null_bounds(spark):
    f = spark.createDataFrame([(None, 1), (5, None), (5, 3), (-2, 3)], "x int, hi int")
    assert [r[0] for r in f.select(X.clip("x", 0, F.col("hi"))).collect()] == [None, 5, 3, 0]


def quantile_brute(values, q, nearest):
    v, at = sorted(x for x in values if x is not None), None
    if not v:
        return None
    at = q * (len(v) - 1)
    if nearest:
        return v[math.floor(at + 0.5)]
    low = math.floor(at)
    return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])


@pytest.mark.parametrize("accuracy", [40, 10_000])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_against_brute_force(spark, method, accuracy):
    """With a low accuracy the groups are bracketed; ties, nulls, a null group, a group without values."""
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.random(), float(rng.randrange(5))])) for g in ("a", "b", None) for _ in range(700)] + [("c", 1.0), ("d", None), ("e", 2.0), ("e", 1.0)]
    qs = [0.0, 0.01, 0.2, 0.5, 0.9, 0.99, 1.0]
    got = evaluate.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, by=["g"], method=method, accuracy=accuracy).collect()
    assert {r.g for r in got} == {"a", "b", "c", "e", None}
    for r in got:
        values = [v for g, v in rows if g == r.g]
        assert r.n == sum(v is not None for v in values)
        assert r.q == pytest.approx([quantile_brute(values, q, method == "nearest") for q in qs])
    assert evaluate.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_quantiles_when_rough_ones_differ_from_run_to_run(spark, monkeypatch):
    """Partial rough quantiles merge in the order in which they arrive; here every evaluation draws wider brackets of its own."""
    rough, noise = evaluate.F.percentile_approx, F.pmod(F.expr("reflect('java.lang.System', 'nanoTime')").cast("long"), F.lit(97))
    wider = lambda v, ends, accuracy: F.array(*[rough(v, ends, accuracy)[i] + (noise if i % 2 else -noise) for i in range(6)])
    rows = [(g, float(i)) for g in "abcdefgh" for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(evaluate.F, "percentile_approx", wider)
    got = evaluate.quantiles(frame, "v", [0.25, 0.5, 0.75], by=["g"], accuracy=40).collect()
    assert sorted((r.g, r.n, *r.q) for r in got) == [(g, 500, 124.75, 249.5, 374.25) for g in "abcdefgh"]


@pytest.mark.parametrize("shift", [-60.0, 60.0])
def test_quantiles_outside_their_brackets(spark, monkeypatch, shift):
    """Rough quantiles have no hard bound; one that is off costs time and no value."""
    rough = evaluate.F.percentile_approx
    monkeypatch.setattr(evaluate.F, "percentile_approx", lambda v, ends, accuracy: F.array(*[rough(v, ends, accuracy)[i] + shift for i in range(6)]))
    frame = spark.createDataFrame([(float(i // 2),) for i in range(1000)], "v double")
    row = evaluate.quantiles(frame, "v", [0.25, 0.5, 0.75], accuracy=100).first()
    assert (row.n, row.q) == (1000, [quantile_brute([float(i // 2) for i in range(1000)], q, False) for q in (0.25, 0.5, 0.75)])


def test_null_counts_as_a_value(spark):
    f = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert f.agg(X.distinct_with_null("x")).first()[0] == 2
    assert f.where("x is not null").agg(X.distinct_with_null("x")).first()[0] == 1


def test_guarded_ratio_horizontal_mean_bands(spark):
    f = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 4.0)], "a double, b double")
    rows = f.select(X.guarded_ratio("a", "b"), X.mean_of("a", "b"), X.bands("a", [2.0], ["low", "high"])).collect()
    assert [tuple(r) for r in rows] == [(None, 0.5, "low"), (1.5, 2.5, "high"), (None, 4.0, None)]


@pytest.mark.parametrize(("text", "key", "base"), [("Stand 07a", "7A", "7"), ("gateB 012", "B12", "B12"), ("S10", "S10", "S10"), ("RAMP F06", "F6", "F6"), ("202-(C)", "202", "202"), ("apron 115b", "115B", "115"), ("pos_G10L", "G10L", "G10"), ("7X", "7X", "7X"), ("GATE-5", "5", "5"), (None, None, None), ("", "", "")])
def test_stand_key(spark, text, key, base):
    row = spark.createDataFrame([(text,)], "x string").select(X.stand_key("x").alias("k")).withColumn("b", X.variant_base("k")).first()
    assert (row.k, row.b) == (key, base)


def test_nan_is_unknown(spark):
    f = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in f.select(X.nan_to_null("x")).collect()] == [None, 1.0, None]


def test_rolling_window_is_half_open(spark):
    rows = [("A", 0), ("A", 1800 * S), ("A", 1800 * S - 1), ("B", 5)]
    f = temporal.rolling_counts(spark.createDataFrame(rows, "k string, t long"), by=["k"], time="t", windows={"n": (-1800, 0), "m": (0, 1800)}, block=600)
    assert {(r.k, r.t): (r.n, r.m) for r in f.collect()} == {("A", 0): (1, 2), ("A", 1800 * S - 1): (2, 1), ("A", 1800 * S): (2, 0), ("B", 5): (1, 0)}


@pytest.mark.parametrize("block", [1, 7, 86_400])
def test_rolling_counts_over_block_borders(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", None]), rng.choice([rng.randrange(40) * S, None]), rng.random() < 0.5) for i in range(80)]
    f = temporal.rolling_counts(spark.createDataFrame(rows, "i int, k string, t long, c boolean"), by=["k"], time="t", windows={"n": (-5, 3), "p": (-9, 0)}, counted=F.col("c"), block=block)
    near = lambda k, t, lo, hi: 0 if t is None else sum(1 for _, k2, t2, c in rows if k2 == k and t2 is not None and c and t + lo * S < t2 <= t + hi * S)
    assert {r.i: (r.n, r.p) for r in f.collect()} == {i: (near(k, t, -5, 3), near(k, t, -9, 0)) for i, k, t, _ in rows}


def asof_brute(left, right, forward):
    out = {}
    for i, key, t in left:
        options = [(r, n) for n, k, r in right if k == key and k is not None and t is not None and r is not None and (r >= t if forward else r <= t)]
        out[i] = (min(options) if forward else max(options))[1] if options else None
    return out


@pytest.mark.parametrize("block", [3, 1000])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_against_brute_force(spark, forward, block):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([*range(20), None])) for i in range(60)]
    right = [(100 + i, rng.choice(["a", "b", None]), rng.choice([*range(20), None])) for i in range(40)]
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long")
    got = joins.asof(a, b, by=["k"], left_time="t", right_time="rt", right_id="rid", columns=["rid"], forward=forward, block=block)
    assert {r.id: r.rid for r in got.collect()} == asof_brute(left, right, forward)


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_asof_lookups_share_a_pass(spark, block):
    rng = random.Random(8)
    left = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([*range(40), None])) for i in range(80)]
    right = [(100 + i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([*range(40), None])) for i in range(50)]
    a, b = spark.createDataFrame(left, "id long, k string, e string, t long"), spark.createDataFrame(right, "rid long, k string, e string, rt long")
    lookups = {"any": ("backward", None), "next": ("forward", None), "typed": ("backward", "e"), "typed_next": ("forward", "e")}
    got = joins.asof_many(a, b, by=["k"], left_time="t", right_time="rt", right_id="rid", columns=["rid", "e"], lookups=lookups, block=block)
    found = {r.id: {n: r[n] and r[n].rid for n in lookups} for r in got.collect()}
    assert len(found) == len(left)
    for forward, name in ((False, "any"), (True, "next")):
        assert {i: f[name] for i, f in found.items()} == asof_brute([(i, k, t) for i, k, _, t in left], [(n, k, r) for n, k, _, r in right], forward)
    for forward, name in ((False, "typed"), (True, "typed_next")):
        both = lambda k, e: None if k is None or e is None else k + e
        assert {i: f[name] for i, f in found.items()} == asof_brute([(i, both(k, e), t) for i, k, e, t in left], [(n, both(k, e), r) for n, k, e, r in right], forward)


@pytest.mark.parametrize("block", [60, 300, 86_400])
def test_saturation_over_block_borders(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", None]), rng.choice(["r", None]), rng.randrange(3000) * S + rng.randrange(3)) for i in range(150)]
    got = temporal.saturation(spark.createDataFrame(rows, "i long, k string, r string, t long"), by=["k", "r"], time="t", tie="i", block=block)
    expected = {}
    for key in {(k, r) for _, k, r, _ in rows}:
        before, run = None, 0
        for t, i in sorted((t, i) for i, k, r, t in rows if (k, r) == key):
            gap = None if before is None else (t - before) // S
            run = 0 if gap is None or gap >= 120 else run + 1
            before, expected[i] = t, (gap, run)
    assert {r.i: (r.prev_gap, r.sat_run) for r in got.collect()} == expected and max(r for _, r in expected.values()) > 5


def test_asof_with_empty_sides(spark):
    a = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")
    b = spark.createDataFrame([], "rid long, k string, rt long")
    how = {"by": ["k"], "left_time": "t", "right_time": "rt", "right_id": "rid", "columns": ["rid"]}
    assert joins.asof(a, b, **how).first().rid is None
    assert joins.asof(a.where("false"), b, **how).count() == 0


def test_band_join_ends(spark):
    a = spark.createDataFrame([(1, "x", 1000)], "i long, k string, t long")
    b = spark.createDataFrame([(n, "x", t) for n, t in enumerate([819, 820, 1000, 1179, 1180])], "j long, k_r string, u long")
    got = joins.band(a, b, by=["k"], left_time="t", right_time="u", reach=180)
    assert sorted(r.u for r in got.collect()) == [820, 1000, 1179]


@pytest.mark.parametrize("walk", [0, 12, 1000])
def test_greedy_matching_equals_a_sequential_pass(spark, walk):
    rng = random.Random(5)
    pairs = [(x, y, rng.randrange(4)) for x in range(9) for y in range(20, 29) if rng.random() < 0.5]
    used, expected = set(), set()
    for x, y, c in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if x not in used and y not in used:
            used |= {x, y}
            expected.add((x, y, c))
    f = spark.createDataFrame(pairs, "l long, r long, c long")
    assert {tuple(r) for r in joins.greedy_one_to_one(f, left="l", right="r", cost=["c"], walk=walk).collect()} == expected
    assert joins.greedy_one_to_one(f.where("false"), left="l", right="r", cost=["c"], walk=walk).count() == 0


def test_backoff_takes_the_finest_known_level(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "g string, h int")
    fine = spark.createDataFrame([("a", 1, 10.0)], "g string, h int, v double")
    coarse = spark.createDataFrame([("a", 20.0)], "g string, v double")
    got = joins.backoff(rows, [(["g", "h"], fine), (["g"], coarse)], "v", 0.0).collect()
    assert {(r.g, r.h): r.v for r in got} == {("a", 1): 10.0, ("a", 2): 20.0, ("b", 1): 0.0, (None, 1): 0.0}


BINS = "airport string, bin long, dep_rwy_config string"


def test_segments_start_after_a_day_without_bins(spark):
    day = 288
    rows = [("A", 0, "R1"), ("A", 1, "R1"), ("A", 2, "R2"), ("A", 3 + day, "R2"), ("A", 4 + day, "R2")]
    f = temporal.change_segments(spark.createDataFrame(rows, BINS))
    assert {r.bin: r.mins_since_cfg_change for r in f.collect()} == {0: 0, 1: 5, 2: 0, 3 + day: 0, 4 + day: 5}


def test_gap_of_exactly_a_day_goes_on(spark):
    f = temporal.change_segments(spark.createDataFrame([("A", 0, "R1"), ("A", 288, "R1")], BINS))
    assert {r.bin: r.mins_since_cfg_change for r in f.collect()} == {0: 0, 288: 1440}


def test_configuration_of_unknown_runways(spark):
    rows = [("A", "DEP", None, 0), ("A", "DEP", "R2", S), ("A", "DEP", "R1", 2 * S), ("B", "DEP", None, 0), ("B", "ARR", "R1", 0)]
    f = temporal.config_bins(spark.createDataFrame(rows, "airport string, phase string, runway string, t_us long"))
    got = {r.airport: (r.dep_rwy_config, r.n_active_dep_rwy, r.arr_rwy_config, r.n_active_arr_rwy) for r in f.collect()}
    assert got == {"A": ("R1+R2", 3, "?", 0), "B": ("", 1, "R1", 1)}


def queue_brute(rows):
    out = {}
    for i, k, s, e, a in rows:
        if a is None or k is None:
            out[i] = None
            continue
        out[i] = sum(1 for _, k2, s2, e2, _ in rows if k2 == k and s2 is not None and e2 is not None and e2 > s2 and s2 < a and e2 > a)
    return out


def test_queue_against_brute_force_and_shift_invariance(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), *(t if rng.random() > 0.1 else None for t in (rng.randrange(30), rng.randrange(30), rng.randrange(30)))) for i in range(120)]
    schema = "mvt_id long, k string, s long, e long, a long"
    got = temporal.queue(spark.createDataFrame(rows, schema), anchor="a", start="s", end="e", by=["k"], prefix="q", recent=0)
    expected = queue_brute(rows)
    assert {r.mvt_id: r.q_ahead for r in got.collect()} == expected
    cut_up = temporal.queue(spark.createDataFrame([(i, k, *(None if t is None else t * S for t in ts)) for i, k, *ts in rows], schema), anchor="a", start="s", end="e", by=["k"], prefix="q", recent=5, block=4)
    recent = {i: None if a is None or k is None else sum(1 for _, k2, s2, e2, _ in rows if k2 == k and s2 is not None and e2 is not None and e2 > s2 and a - 5 <= s2 < a) for i, k, _, _, a in rows}
    assert {r.mvt_id: (r.q_ahead, r.q_recent) for r in cut_up.collect()} == {i: (expected[i], recent[i]) for i in expected}
    shift = [(i, k, *(None if t is None else t + 1000 for t in ts)) for i, k, *ts in rows]
    moved = temporal.queue(spark.createDataFrame(shift, schema), anchor="a", start="s", end="e", by=["k"], prefix="q")
    assert {r.mvt_id: r.q_ahead for r in moved.collect()} == expected


def test_surface_runs_treat_nan_as_fast(spark):
    rows = [("x", 0, 5.0), ("x", 60, 10.0), ("x", 100, 80.0), ("x", 200, float("nan")), ("x", 300, 3.0), ("x", 3000, 1.0)]
    f = temporal.surface_runs(spark.createDataFrame(rows, "k string, t long, v double"), by=["k"], time="t", speed="v")
    assert sorted((r.first_t, r.last_t, r.takes_off) for r in f.collect()) == [(0, 60, True), (300, 300, False), (3000, 3000, False)]


def test_pushback_rules(spark):
    """Dwell takes the next point's time, a lone last point its own; appear, pass and censored; unknown distances."""
    rows = [("dwell", 0, 0.0, 10.0), ("dwell", 60, 0.0, 20.0), ("dwell", 120, 5.0, 30.0), ("dwell", 180, 0.0, 500.0), ("last", 0, 9.0, 400.0), ("last", 50, 1.0, 99.0)]
    rows += [("appear", 0, 3.0, 99.9), ("appear", 30, 9.0, 300.0), ("pass", 0, 3.0, 100.0), ("pass", 30, 9.0, 50.0), ("pass", 60, 9.0, 40.0), ("none", 0, 0.0, 100.0), ("unknown", 0, 0.0, None)]
    f = spark.createDataFrame(rows, "k string, t long, v double, m double").withColumn("takes_off", F.lit(True))
    f = temporal.run_points(f, by=["k"], time="t", speed="v").drop("takes_off", "run")
    got = {r.k: (r.tier, r.pushback_t, r.pb_gap_s, r.pb_dist_m, r.pb_speed) for r in temporal.pushback(f, by=["k"], time="t", speed="v", distance="m").collect()}
    assert got == {
        "dwell": ("dwell", 120, 60, 20.0, 0.0), "last": ("dwell", 50, None, 99.0, 1.0), "appear": ("appear", 0, 30, 99.9, 3.0), "pass": ("pass", 30, 30, 50.0, 9.0),
        "none": (None, None, None, None, None), "unknown": (None, None, None, None, None),
    }


@pytest.mark.parametrize("whole", [True, False])
def test_nearest_one_to_one_against_brute_force(spark, whole):
    """Dense ties, times on block borders, right rows in several lists, unknown times."""
    rng = random.Random(3)
    draw = (lambda: float(rng.randrange(300))) if whole else (lambda: rng.random() * 300)
    left = [(rng.choice("ab"), i, draw(), rng.randrange(3)) for i in range(150)] + [("a", 900, None, 1), (None, 901, 5.0, 1)]
    right = [(rng.choice("ab"), f"h{rng.randrange(9)}", i, draw()) for i in range(120)]
    several = [(*r, x) for r in right for x in rng.sample(range(3), rng.randrange(1, 4))]
    pairs = [(abs(r[3] - t), i, r[1], r[2], k) for k, i, t, x in left if t is not None for r in several if r[0] == k and r[4] == x and t - 7 <= r[3] < t + 7]
    expected, used = set(), set()
    for _, i, h, n, k in sorted(pairs):
        if ("l", i) not in used and (h, n) not in used:
            used |= {("l", i), (h, n)}
            expected.add((k, i, h, n))
    a, b = spark.createDataFrame(left, "k string, i long, t double, x int"), spark.createDataFrame(several, "k string, h string, n int, u double, x int")
    got = joins.nearest_one_to_one(a, b, by=["k"], left_time="t", right_time="u", left_id="i", right_id=["h", "n"], reach=7, among=["x"], reaches=4).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_pushbacks_prefer_the_smallest_aircraft(spark):
    rows = [("A", h, t, v + (h / 100 if t == 0 else 0)) for h in range(40) for t, v in ((0, 0.0), (60, 10.0), (90, 100.0))]
    points = spark.createDataFrame(rows, "airport string, hex long, ts long, gs double").selectExpr("airport", "date '2024-01-01' as day", "hex", "ts", "gs", "47.4d as lat", "8.5d as lon")
    m = spark.createDataFrame([(i, "DEP", "A", "1", 60_000_000, "2024-01-01") for i in range(3)], "mvt_id long, phase string, airport string, stand string, t_us long, ts string")
    stands = spark.createDataFrame([("A", "STAND-1", 47.4, 8.5)], "airport string, stand_name string, lat double, lon double")
    got = tracks.detect_pushbacks(m, points, stands).collect()
    assert {r.mvt_id: r.first_speed for r in got} == {0: 0.0, 1: 0.01, 2: 0.02}


def test_coverage_needs_twenty_aircraft(spark):
    rows = [("A", "d", i, 10.0) for i in range(20)] + [("B", "d", i, 10.0 if i < 19 else 40.0) for i in range(20)] + [("B", "d", 99, float("nan"))]
    got = tracks.coverage(spark.createDataFrame(rows, "airport string, day string, hex int, gs double")).collect()
    assert {r.airport: r.day_coverage for r in got} == {"A": True, "B": False}


def test_last_dwell(spark):
    rows = [("x", 0, 0.0), ("x", 200, 1.0), ("x", 300, 9.0), ("x", 310, 0.0), ("x", 400, 0.0), ("y", 0, 9.0)]
    f = temporal.last_dwell(spark.createDataFrame(rows, "k string, t long, v double"), by=["k"], time="t", speed="v")
    assert {r.k: r.dwell_end for r in f.collect()} == {"x": 200, "y": None}


def test_out_of_fold_never_sees_its_fold(spark):
    rows = [("p", "g", "1", 1.0), ("p", "g", "1", 1.0), ("p", "g", "2", 0.0), ("p", "h", "2", 0.0), ("q", "k", "1", 1.0)]
    f = encode.out_of_fold(spark.createDataFrame(rows, "p string, g string, m string, y double"), group=["g"], parent=["p"], fold="m", target=F.col("y"))
    got = {(r.g, r.m): (r.n, r.enc) for r in f.collect()}
    assert got[("g", "1")] == (1, pytest.approx(0.0))
    assert got[("g", "2")] == (2, pytest.approx((2 + 30 * 1.0) / 32))
    assert got[("h", "2")] == (0, pytest.approx(1.0))
    assert got[("k", "1")] == (0, None)


def test_category_codes_and_leak_guard(spark):
    f = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    v = encode.category_codes(f, "c")
    got = encode.encode(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), v, "c", "n").collect()
    assert {r.c: r.n for r in got} == {"a": 0, "b": 1, "z": -1, None: -1}
    with pytest.raises(ValueError, match="overlap"):
        encode.assert_no_leak(f, f, ["c"])


def test_positions_count_over_chunks(spark):
    f = spark.createDataFrame([(3.0, 0), (1.0, 1), (2.0, 2), (2.5, 3), (9.0, 4)], "v double, i int")
    got = evaluate.positions(f, ["v", "i"], chunk=F.floor("v")).collect()
    assert {r.i: r.pos for r in got} == {1: 0, 2: 1, 3: 2, 0: 3, 4: 4} and {r.total for r in got} == {5}


def test_bootstrap_is_reproducible_and_sided(spark):
    rows = [(f"c{i:02d}", 100.0 + i, 81.0 + i, 10) for i in range(30)]
    c = spark.createDataFrame(rows, "cluster string, b double, t double, n long")
    one, two = (evaluate.cluster_bootstrap(c, base="b", treatment="t", n="n", draws=100).first() for _ in range(2))
    assert one == two and one.point < 0 and one.low <= one.point <= one.high and one.p_worse == 0


def test_fixed_effects_and_weights(spark):
    rows = [(g, float(x), 10.0 * g + 3.0 * x) for g in (1, 2) for x in range(200)]
    f = blend.fixed_effects(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y")
    assert all(abs(r.slope - 3) < 0.05 for r in f.collect())
    w = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "r double, d double").agg(blend.ls_weight(F.col("r"), F.col("d"))).first()[0]
    assert w == pytest.approx(0.5)


def test_nnls_pair_and_general_agree_on_the_border(spark):
    rows = [(float(i), float(i % 3), 2.0 * i - 0.5 * (i % 3)) for i in range(1, 40)]
    f = spark.createDataFrame(rows, "a double, b double, y double")
    pair = f.agg(*[c.alias(n) for c, n in zip(blend.nnls_pair(F.col("a"), F.col("b"), F.col("y")), "uv", strict=True)]).first()
    general = blend.nnls(f, ["a", "b"], "y")
    assert pair.u == pytest.approx(general["a"], abs=1e-6) and pair.v == pytest.approx(general["b"], abs=1e-6) == 0.0


def test_reconstruct_uses_the_model_where_the_prior_is_missing(spark):
    f = spark.createDataFrame([(0.0, 10.0, None, 99.0), (0.0, 10.0, 7.0, 99.0), (1.0, -5.0, 7.0, 99.0)], "p double, o double, q double, m double")
    got = f.select(blend.reconstruct(F.col("p"), F.col("o"), F.col("q"), F.col("m"), 50.0)).collect()
    assert [r[0] for r in got] == [50.0, 7.0, 0.0]


def test_blinding_hides_departures_only(spark):
    f = features.blind(spark.createDataFrame([("DEP", 1, 2), ("ARR", 1, 2)], "phase string, block_us long, taxi long"))
    assert [tuple(r) for r in f.collect()] == [("DEP", None, None), ("ARR", 1, 2)]


def test_flight_category_of_unknown_values(spark):
    f = spark.createDataFrame([(None, None), (400.0, None), (None, 2.0), (3000.0, 9.0), (2999.0, 9.0), (9999.0, 5.0), (9999.0, 4.9), (1000.0, 9.0), (500.0, 9.0), (9999.0, 1.0)], "c double, v double")
    assert [r[0] for r in f.select(features.flight_category(F.col("c"), F.col("v"))).collect()] == ["VFR", "LIFR", "IFR", "VFR", "MVFR", "VFR", "MVFR", "MVFR", "IFR", "IFR"]


def test_planar_distance_of_a_degree(spark):
    east, north = X.planar_metres(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(east, north).first()
    assert math.isclose(row[0], 111_320.0) and math.isclose(row[1], 110_540.0)


def test_links_and_bounds(spark):
    """Own type before any, bounds of the successor, tiers, equal times, departures without a stand."""
    minute = 60 * S
    rows = [(1, "ARR", "A", "s", "x", 0, 0), (2, "ARR", "A", "s", "y", 0, 60 * minute), (3, "ARR", "A", "s", "x", 0, 300 * minute), (4, "ARR", "A", "q", "x", 0, 88 * minute), (9, "ARR", "A", None, "x", 0, 0)]
    rows += [(10, "DEP", "A", "s", "x", 100 * minute, None), (11, "DEP", "A", "s", "z", 100 * minute, None), (12, "DEP", "A", "s", "z", 312 * minute, None), (13, "DEP", "A", "q", "x", 100 * minute, None)]
    rows += [(14, "DEP", "A", "q", "z", 99 * minute, None), (15, "DEP", "A", None, "x", 100 * minute, None), (16, "DEP", "A", "s", "w", 305 * minute, None), (17, "DEP", "A", "t", "x", 100 * minute, None)]
    m = spark.createDataFrame([(*r, 0, "w") for r in rows], "mvt_id long, phase string, airport string, stand string, actype string, t_us long, block_us long, sched_us long, wake string")
    got = {r.mvt_id: r for r in features.stand_links(m).collect()}
    pick = lambda i: (got[i].inbound_mvt_id, got[i].type_match, got[i].has_next, got[i].bound_binding, got[i].L_sec, got[i].U_sec, got[i].ground_time_sec, got[i].link_confidence)
    assert set(got) == {10, 11, 12, 13, 14, 16, 17}
    assert pick(10) == (1, True, True, False, 0, 6000, 5280, "high") and pick(11) == (2, False, True, False, 0, 2400, 1680, "med")
    assert pick(12) == (3, False, True, True, 720, 720, 0, "low") and pick(13) == (4, True, True, True, 720, 720, 0, "med")
    assert pick(14) == (None, False, True, True, 660, None, None, "none") and pick(17) == (None, False, False, None, 0, None, None, "none")
    assert pick(16)[:6] == (2, False, True, True, 300, 14_700) and got[16].interval_sec == 14_400


def test_weather_of_an_hour(spark):
    rows = [("X", "2024-01-01 00:20:00", 30.0, 20.0, 9.0, 0.0, "BKN", "FEW", "OVC", 2500.0, 100.0, 900.0, None), ("X", "2024-01-01 00:50:00", 30.0, None, 9.0, None, "FEW", None, None, 100.0, None, None, "-SN BR")]
    f = spark.createDataFrame(rows, "station string, valid string, tmpf double, dwpf double, vsby double, p01i double, skyc1 string, skyc2 string, skyc3 string, skyl1 double, skyl2 double, skyl3 double, wxcodes string")
    f = f.withColumn("valid", F.to_timestamp("valid")).withColumns({c: F.lit(None).cast("double") for c in ("drct", "sknt", "gust")})
    first, both = features.weather_hours(f.where("skyc3 is not null")).first(), features.weather_hours(f).first()
    assert (first.ceiling_ft, first.flight_category, first.below_freezing, first.deicing_risk, first.wx_snow) == (900.0, "IFR", True, False, False)
    assert first.temp_dewpoint_spread_c == pytest.approx(10 / 1.8)
    assert (both.ceiling_ft, both.flight_category, both.deicing_risk, both.wx_obscuration, both.temp_dewpoint_spread_c) == (None, "VFR", True, True, None)


def test_stand_positions_prefer_exact_keys(spark):
    stands = spark.createDataFrame([("A", "115L", 1.0, 1.0), ("A", "115R", 3.0, 3.0), ("A", "7", 9.0, 9.0), ("A", "7A", 5.0, 5.0)], "airport string, stand_name string, lat double, lon double")
    positions = features.stand_positions(stands)
    assert {r.key: r.lat for r in positions.collect()} == {"115L": 1.0, "115R": 3.0, "115": 2.0, "7": 9.0, "7A": 5.0}
    m = spark.createDataFrame([(1, "A", "Gate 115"), (2, "A", "115C"), (3, "A", "007"), (4, "B", "7"), (5, "A", None)], "mvt_id long, airport string, stand string")
    assert {r.mvt_id: r.stand_lat for r in features.with_stand_position(m, positions).collect()} == {1: 2.0, 2: 2.0, 3: 9.0, 4: None, 5: None}


def test_adoption_needs_every_month(spark):
    rows = [(f"c{i % 20}", "jan" if i % 2 else "jul", 100.0, 0.0, 5.0 if i % 2 else -5.0, 50.0, i < 380) for i in range(400)]
    f = spark.createDataFrame(rows, "c string, month string, base double, truth double, bump double, good double, kept boolean")
    how = {"cluster": ["c"], "base": "base", "truth": "truth", "month": "month", "trimmed": F.col("kept"), "draws": 50}
    assert evaluate.adoption(f.withColumn("t", F.col("good")), treatment="t", **how).first().adopt
    mixed = evaluate.adoption(f.withColumn("t", F.when(F.col("month") == "jan", 101).otherwise(50)), treatment="t", **how).first()
    assert mixed.delta < 0 and mixed.worst_month > 0 and not mixed.adopt


def test_blend_weights_and_quality(spark):
    rows = [("A", "dwell", 100.0, 200.0, 210.0, 60.0, 9.0, 30.0)] * 300 + [("B", "appear", 100.0, 150.0, 160.0, 80.0, 9.0, 30.0)] * 50 + [("LIRF", "dwell", 100.0, 900.0, 900.0, 1.0, 1.0, 1.0), ("A", "pass", 100.0, 900.0, 900.0, 1.0, 1.0, 1.0), ("A", None, 100.0, 1.0, None, None, None, None)]
    f = spark.createDataFrame(rows, "airport string, tier string, pred double, taxi double, track_taxi double, pb_dist_m double, pb_speed double, pb_gap_s double")
    b = blend.PushbackBlend.fit(f)
    got = {(r.airport, r.tier): r.blend for r in b.apply(f).collect()}
    assert got == pytest.approx({("A", "dwell"): 200.0, ("B", "appear"): 150.0, ("LIRF", "dwell"): 100.0, ("A", "pass"): 100.0, ("A", None): 100.0})
    assert {(r.airport, r.q) for r in f.select("airport", blend.detection_quality().alias("q")).distinct().collect()} >= {("A", "good"), ("B", "poor"), ("LIRF", "good")}
    moved = {(r.airport, r.tier): r.blend for r in b.shifted({"A": 50.0}).apply(f).collect()}
    assert moved["A", "dwell"] == pytest.approx(150.0) and moved["B", "appear"] == pytest.approx(150.0)
