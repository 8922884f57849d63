"""Readers: tables of a folder, the movements relation, splits, CSV, JSON and text records, variant schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters of the query reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def movements(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the role of movements: one row per event, clocks in microseconds, some runways and stands unknown."""
    e = table(spark, folder, "events")
    arrival = F.col("event_type").isin("view", "signup")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    taxi_us = F.floor(F.col("value") * 20_000_000).cast("bigint")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    block = F.when(arrival, t + taxi_us).otherwise(t - taxi_us)
    sched = block - (k - 30) * 20_000_000
    i = F.col("event_id")
    minutes = lambda of, unless: F.when(i % unless != 0, sched + i % of * 60_000_000)
    return e.select(
        i.alias("mvt_id"),
        F.when(arrival, "ARR").otherwise("DEP").alias("phase"),
        F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("airport"),
        F.concat(F.lit("A"), ((F.col("user_id") + i) % 12).cast("string")).alias("ades"),
        F.when(i % 50 != 0, F.concat(F.lit("R"), (i % 3).cast("string"))).alias("runway"),
        F.when(i % 97 != 0, F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("stand"),
        F.concat(F.lit("T"), (i % 4).cast("string")).alias("actype"),
        F.when(i % 5 != 0, F.concat(F.lit("W"), (i % 2).cast("string"))).alias("wake"),
        F.when(i % 29 != 0, F.concat(F.lit("O"), (F.col("user_id") % 7).cast("string"))).alias("operator"),
        t.alias("t_us"),
        block.alias("block_us"),
        sched.alias("sched_us"),
        minutes(7, 41).alias("eobt_us"),
        minutes(5, 43).alias("iobt_us"),
        minutes(11, 53).alias("lobt_us"),
        F.when(~arrival & (i % 67 != 0), block + (i % 9 - 4) * 30_000_000).alias("aobt_us"),
        F.floor(F.col("value") * 20).cast("bigint").alias("taxi"),
        ((k - 30) * 20).alias("d"),
        "value",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def split_by_month(frame: DataFrame, split: str, ts: str, holdout: Sequence[str]) -> DataFrame:
    """All rows, those outside the holdout months, or those inside; the month key is ``ym``."""
    frame = frame.withColumn("ym", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM"))
    if split == "all":
        return frame
    inside = F.col("ym").isin(*holdout)
    return frame.where(inside if split == "holdout" else ~inside)


# The fields of a weather observation, in no order that files have to keep.
WEATHER_TEXT = ("station", "valid", "skyc1", "skyc2", "skyc3", "wxcodes")
WEATHER_NUMBERS = ("tmpf", "dwpf", "relh", "drct", "sknt", "gust", "vsby", "skyl1", "skyl2", "skyl3", "p01i")


def by_header(spark: SparkSession, paths: Sequence[str], fields: Sequence[str], **options) -> DataFrame:
    """CSV files as text columns, each found under its own name in its own file's header; absent ones are null.

    Files with one header are read together, so the number of scans is that of different headers.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    reader = spark.read.options(header=True, **options)
    for path in paths:
        groups.setdefault(tuple(reader.csv(path).columns), []).append(path)
    if not groups:
        raise FileNotFoundError("there are no files to read")
    frames = []
    for header, files in groups.items():
        frame = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(files)
        frames.append(frame.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in fields]))
    return reduce(DataFrame.unionByName, frames)


def weather_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several weather files as one, fields by name, numbers typed, one row per station and time (the first in the order of all columns).

    An ``M`` is missing, and a trace of rain (``T``) is none.
    """
    raw = by_header(spark, paths, WEATHER_TEXT + WEATHER_NUMBERS, nullValue="M")
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in WEATHER_NUMBERS}
    numbers["p01i"] = F.when(F.col("p01i") == "T", F.lit(0.0)).otherwise(numbers["p01i"])
    typed = raw.withColumns(numbers).withColumn("valid", F.to_timestamp("valid", "yyyy-MM-dd HH:mm"))
    everything = F.struct(*[c for c in typed.columns if c not in ("station", "valid")])
    kept = typed.groupBy("station", "valid").agg(F.min(everything).alias("r"))
    return kept.select("station", "valid", "r.*")


def latin1_csv(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Latin-1 CSV, compressed or not by the file's ending; those of the paths that exist, an error if none does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            found.append(path)
    if not found:
        raise FileNotFoundError("none of the files exists")
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(found)


def date_prefix(x: str):
    """Dates and timestamps written as text -> date, by the first ten characters; null if they are none."""
    return F.expr(f"try_to_date(substring({x}, 1, 10), 'yyyy-MM-dd')")


#: Columns of a track point.
POINT_COLUMNS = {
    "hex": "string", "reg": "string", "ts": "double", "lat": "double", "lon": "double", "gs": "double", "alt_baro": "double", "is_ground": "boolean", "airport": "string",
    "track": "double", "src": "string",
}
#: Altitude that the old schema writes for a point on the ground.
OLD_GROUND = -1


def unify_points(*variants: DataFrame) -> DataFrame:
    """Track points of the old schema (``alt``, ``OLD_GROUND`` on the ground) and the new (``alt_raw`` and ``is_ground``) as one frame.

    Barometric altitude is null on the ground; columns that a schema lacks are null.
    """
    frames = []
    for frame in variants:
        if "alt" in frame.columns:
            ground, altitude = F.col("alt") == OLD_GROUND, F.col("alt")
        else:
            ground, altitude = F.col("is_ground"), F.col("alt_raw")
        frame = frame.withColumns({"is_ground": ground, "alt_baro": F.when(~F.coalesce(ground, F.lit(False)), altitude)})
        given = [c for c in frame.columns if c not in (*POINT_COLUMNS, "alt", "alt_raw")]
        columns = [(F.col(c) if c in frame.columns else F.lit(None)).cast(kind).alias(c) for c, kind in POINT_COLUMNS.items()]
        frames.append(frame.select(*columns, *given))
    return reduce(DataFrame.unionByName, frames)


def points_of_day(points: DataFrame, day: str) -> DataFrame:
    """Unified points that lie on the UTC ``day``, one per airport, aircraft and time (the least in the order of all columns)."""
    own = points.where(F.to_date(F.timestamp_seconds("ts")) == F.lit(day).cast("date"))
    rest = [c for c in own.columns if c not in ("airport", "hex", "ts")]
    return own.groupBy("airport", "hex", "ts").agg(F.min(F.struct(*rest)).alias("r")).select("airport", "hex", "ts", "r.*").select(*points.columns)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table in ``day=`` folders with the day from the path; a range of days prunes the folders that are listed and read."""
    frame = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("date"))
    if first is not None:
        frame = frame.where(F.col("day") >= F.lit(first).cast("date"))
    return frame if last is None else frame.where(F.col("day") <= F.lit(last).cast("date"))


def trace_points(frame: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """JSON arrays of mixed elements -> a row per point, addressed by position; short arrays give nulls.

    A point is [offset, lat, lon, altitude or "ground", speed, track, ...]; place 9 names the source if it is a text.
    Other places, objects among them, are left alone.
    """
    parsed = frame.withColumn("_points", F.from_json(json_col, "array<array<string>>"))
    rows = parsed.select(*keys, F.posexplode("_points").alias("at", "p"))

    def number(place: int):
        return F.expr(f"try_cast(try_element_at(p, {place + 1}) as double)")

    ground = F.coalesce(F.try_element_at("p", F.lit(4)) == "ground", F.lit(False))
    source = F.try_element_at("p", F.lit(10))
    return rows.select(
        *keys, "at", number(0).alias("dt"), number(1).alias("lat"), number(2).alias("lon"), F.when(~ground, number(3)).alias("alt_raw"), ground.alias("is_ground"),
        number(4).alias("gs"), number(5).alias("track"), F.when(~F.substring(source, 1, 1).isin("{", "["), source).alias("src"),
    )


#: Boxes that may be broadcast.
MOST_BOXES = 100_000
#: Degrees of a side of the grid that points and boxes meet on.
GRID = 0.5


def box_assign(points: DataFrame, boxes: DataFrame, lat: str, lon: str, id_col: str, *, grid: float = GRID) -> DataFrame:
    """Each point with the first box (by ``box_order``) that holds it; points outside all boxes go.

    Points and boxes meet on the cells of a grid, an equi-join; boxes are a small dimension (a handful per airport),
    broadcast while their checked number allows it.
    """
    cells = boxes
    for axis in ("lat", "lon"):
        cells = cells.withColumn(f"_{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}_min") / grid), F.floor(F.col(f"{axis}_max") / grid))))
    if boxes.count() <= MOST_BOXES:
        cells = F.broadcast(cells)
    placed = points.select(id_col, lat, lon, F.floor(F.col(lat) / grid).alias("_lat"), F.floor(F.col(lon) / grid).alias("_lon"))
    inside = F.col(lat).between(F.col("lat_min"), F.col("lat_max")) & F.col(lon).between(F.col("lon_min"), F.col("lon_max"))
    return placed.join(cells, ["_lat", "_lon"]).where(inside).groupBy(id_col).agg(F.min_by("box", "box_order").alias("box"))


def _tokens(lines: DataFrame, line: str, number: str, codes: Sequence[str]) -> DataFrame:
    frame = lines.select(F.col(number).alias("no"), F.split(F.trim(F.col(line)), r"\s+").alias("t"))
    return frame.withColumn("code", F.element_at("t", 1)).withColumn("n", F.size("t")).where(F.col("code").isin(*codes))


def _rest(tokens: str, after: int):
    return F.array_join(F.slice(tokens, after + 1, F.greatest(F.size(tokens) - after, F.lit(0))), " ")


def records_of_text(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """Stands of a text format whose first token is a code: 1300 is a stand, and the last 1301 after it adds its attributes.

    Lines are one file in the order of ``number``; the stand of a 1301 is the last 1300 before it, carried by a
    running ``last`` within blocks of lines and over blocks, so a long file isn't one task's. Lines with too few tokens
    are no records; a stand without attributes has empty ones.
    """
    frame = _tokens(lines, line, number, ("1300", "1301")).where((F.col("code") == "1300") & (F.col("n") >= 6) | (F.col("code") == "1301") & (F.col("n") >= 3))
    frame = frame.withColumn("block", F.floor(F.col("no") / 10_000)).withColumn("own", F.when(F.col("code") == "1300", F.col("no")))
    last_of = frame.groupBy("block").agg(F.max("own").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last_of.select(F.col("block").alias("b"), before.alias("before"))
    inside = F.last("own", ignorenulls=True).over(Window.partitionBy("block").orderBy("no"))
    frame = frame.withColumn("inside", inside).join(carried, F.col("block") == F.col("b")).withColumn("stand_no", F.coalesce("inside", "before"))
    t = F.col("t")
    stands = frame.where("code = '1300'").select(
        "stand_no", F.expr("try_cast(t[1] as double)").alias("lat"), F.expr("try_cast(t[2] as double)").alias("lon"), F.expr("try_cast(t[3] as double)").alias("heading"),
        t[4].alias("stand_type"), t[5].alias("aircraft_classes"), _rest("t", 6).alias("name"),
    )
    more = frame.where("code = '1301'").groupBy("stand_no").agg(F.max_by(F.struct(t[1].alias("width"), t[2].alias("operation"), _rest("t", 3).alias("airlines")), "no").alias("m"))
    joined = stands.join(more, "stand_no", "left")
    return joined.select(*stands.columns, *[F.coalesce(F.col(f"m.{c}"), F.lit("")).alias(c) for c in ("width", "operation", "airlines")])


def runways_of_text(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """Both ends of each runway record (code 100) of the same format: a row per end, naming the opposite one."""
    frame = _tokens(lines, line, number, ("100",)).where("n >= 21")
    t = F.col("t")

    def end(own: int, other: int):
        number_at = lambda i: F.expr(f"try_cast(t[{i}] as double)")
        return F.struct(
            t[own].alias("runway"), number_at(own + 1).alias("lat"), number_at(own + 2).alias("lon"), number_at(own + 3).alias("displaced_m"), number_at(1).alias("width_m"), t[other].alias("opposite")
        )

    return frame.select("no", F.explode(F.array(end(8, 17), end(17, 8))).alias("e")).select("no", "e.*")
