"""Track archives: days of gzipped JSON traces in tar files that may be split in parts and kept in several replicas; transfers of files."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnpike.sources import sinks
from turnpike.sources.tables import box_assign, trace_points

#: Traces that a batch holds at most; a trace is an aircraft's day.
_BATCH = 64
#: Part of the names of members that are traces.
MEMBER = "trace_full_"


class _Chained(io.RawIOBase):
    """The parts of a split file as one stream; only a part at a time is open."""

    def __init__(self, paths: Sequence[str]):
        self.left, self.now = list(paths), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.now is not None or self.left:
            if self.now is None:
                from pyarrow import fs

                system, path = fs.FileSystem.from_uri(self.left[0]) if "://" in self.left[0] else (fs.LocalFileSystem(), self.left[0])
                self.now = system.open_input_stream(path, compression=None)
                self.left = self.left[1:]
            data = self.now.read(len(into))
            if data:
                into[: len(data)] = data
                return len(data)
            self.now.close()
            self.now = None
        return 0


def _members(parts: Sequence[str], tolerant: bool) -> Iterator[tuple]:
    """``(hex, reg, base, trace, error)`` of every trace member; an unreadable one raises, or is a row with an error."""
    with tarfile.open(fileobj=io.BufferedReader(_Chained(parts), 1 << 20), mode="r|") as tar:
        for member in tar:
            if not member.isfile() or MEMBER not in member.name:
                continue
            name = member.name.rsplit(MEMBER, 1)[1].split(".")[0]
            try:
                data = tar.extractfile(member).read()
                found = json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                yield str(found.get("icao", name)).lower(), found.get("r"), float(found.get("timestamp", 0.0)), json.dumps(found.get("trace") or []), None
            except (OSError, EOFError, zlib.error, ValueError) as error:
                if not tolerant:
                    raise
                yield name.lower(), None, None, None, f"{type(error).__name__}: {error}"


def trace_archives(spark: SparkSession, archives: Iterable[tuple[str, Sequence[str]]], *, tolerant: bool = False) -> DataFrame:
    """``archives`` of (day, paths of the parts in order) -> ``(day, hex, reg, base, trace, error)``, a row per trace.

    An archive is a stream and one task's; days are read in parallel, each in memory of one member and one batch. Paths
    are local or URIs that Arrow opens. A broken stream raises; a broken member too, unless ``tolerant``.
    """
    listed = spark.createDataFrame([(str(day), list(parts)) for day, parts in archives], "day string, parts array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["day", "hex", "reg", "base", "trace", "error"], [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
        for batch in batches:
            for day, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for row in _members(parts, tolerant):
                    held.append((day, *row))
                    if len(held) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    # A task per archive, whatever the defaults.
    return listed.repartitionByRange(max(1, listed.count()), "day").mapInArrow(run, "day string, hex string, reg string, base double, trace string, error string")


def points_in_boxes(traces: DataFrame, boxes: DataFrame) -> DataFrame:
    """The points of traces that lie in a box, the first by ``box_order``, with its name as ``airport`` and times in epoch seconds.

    ``boxes(box, box_order, lat_min, lat_max, lon_min, lon_max)``. Points are of the new schema.
    """
    rows = trace_points(traces.where(F.col("error").isNull()), "trace", ["day", "hex", "reg", "base"]).withColumn("id", F.struct("day", "hex", "base", "at"))
    airport = box_assign(rows, boxes, "lat", "lon", "id").withColumnRenamed("box", "airport")
    return rows.join(airport, "id").select("day", "hex", "reg", (F.col("base") + F.col("dt")).alias("ts"), "lat", "lon", "alt_raw", "is_ground", "gs", "track", "src", "airport")


def ingest_days(spark: SparkSession, days: dict[str, Sequence[Sequence[str]]], boxes: DataFrame, path: str, manifest: str) -> list[str]:
    """Write the points of each day that isn't there yet to ``day=`` folders; returns the days that were made.

    Each day has replicas, lists of parts, which are tried in order; if all are broken the first is read again and its
    broken members are left out. A row of the manifest says which replica was read, and how many traces and broken members.
    """
    made = []
    for day, replicas in days.items():
        if day in sinks.finished(spark, path, "day"):
            continue
        tries = [(i, parts, False) for i, parts in enumerate(replicas)] + [(0, replicas[0], True)]
        for number, (replica, parts, tolerant) in enumerate(tries):
            try:
                traces = trace_archives(spark, [(day, parts)], tolerant=tolerant)
                sinks.write_parquet(points_in_boxes(traces, boxes), path, partition_by=["day"])
            except Exception:  # a broken replica shows as a failed job
                if number == len(tries) - 1:
                    raise
                continue
            counts = traces.agg(F.count(F.lit(1)).alias("traces"), F.count("error").alias("broken"))
            counts.select(F.lit(day).alias("day"), F.lit(replica).alias("replica"), "traces", "broken").write.mode("append").json(manifest)
            made.append(day)
            break
    return made


def transfer(spark: SparkSession, source: str, target: str, *, again: bool = False) -> bool:
    """Copy a file between any two file systems that Hadoop knows (local, HTTP to read, object stores); False if it is there already.

    The target appears whole: it is written under another name and renamed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    one, two = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    there = two.getFileSystem(conf)
    if there.exists(two) and not again:
        return False
    part = jvm.org.apache.hadoop.fs.Path(f"{target}.part")
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, there, part, False, True, conf):
        raise OSError(f"{source} couldn't be copied")
    there.delete(two, False)
    if not there.rename(part, two):
        raise OSError(f"{target} couldn't be written")
    return True
