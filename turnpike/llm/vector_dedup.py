"""Embedding near-duplicates by Euclidean p-stable hashing, followed by exact cosine checks.

For unit vectors a cosine of c is a distance of sqrt(2 - 2c). Each table floors a few Gaussian projections,
shifted at random, by a common width; vectors within the distance share a table's bucket with a known
probability, so the number of tables follows from the recall that is asked for (0.999 for a pair right at the
threshold by default, and more for closer pairs).

Equal vectors of a label form one class first. A bucket is searched by blocks of matrix products in double
precision. A pair that meets in several tables is counted in the first of them only, which both vectors'
bucket numbers tell, so no pair ever leaves a bucket: each gives link counts per class and a spanning forest.
A bucket above the block size is dealt out as pairs of blocks, so that no task holds a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._components import Forest, components
from turnpike.llm._store import cut

#: Projections of a table, width of their cells in units of the distance, and the recall of a pair at the threshold.
PROJECTIONS, WIDTH, RECALL = 8, 4.0, 0.999
#: Vectors of a bucket above which it is dealt out in pairs of blocks.
BLOCK = 8_192
_SEED = 20_240_101


def meeting_probability(width: float) -> float:
    """That two points at distance 1 fall into one cell of this width (Datar et al., 2004)."""
    return erf(width / sqrt(2)) - 2 / (sqrt(2 * pi) * width) * (1 - exp(-width * width / 2))


def tables_for(recall: float, projections: int, width: float) -> int:
    return max(1, ceil(log(1 - recall) / log(1 - meeting_probability(width) ** projections)))


class Hashing:
    """Bucket numbers of unit vectors; a function of the parameters alone."""

    def __init__(self, dim: int, threshold: float, tables: int, projections: int, width: float):
        rng = np.random.default_rng(_SEED)
        self.shape = (tables, projections)
        cell = width * sqrt(max(1e-12, 2 - 2 * threshold))
        self.axes = rng.standard_normal((dim, tables * projections)) / cell
        self.shift = rng.random(tables * projections)
        self.mix = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """``(n, tables)`` of int32."""
        cells = np.floor(units @ self.axes + self.shift).astype(np.int64).reshape(-1, *self.shape)
        with np.errstate(over="ignore"):
            mixed = (cells * self.mix).sum(axis=2)
        return ((mixed ^ (mixed >> 32)) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision and safe against overflow; powers of two scale without rounding."""
    values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True))[1])
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.93,
    recall: float = RECALL,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Rows link if their labels are equal and not null and the cosine is at least ``threshold``. ``n_links`` counts the
    other rows linked directly, copies included; ``component_id`` is the smallest id reachable, the own id included;
    ``kept`` if that is the own id. Null, empty and zero vectors and those with null or non-finite components link
    with nothing, nor do vectors of different length. Rows with a null id link like others but are never a
    component's id and never kept. Repeated rows are copies of each other. An empty table gives no rows.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = sound & F.exists("v", lambda x: x != 0)
    # Adding 0 makes one value of -0.0 and 0.0, so equal vectors have equal keys.
    plain = F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: (x + F.lit(0).cast(element)).cast(element)))
    rows = base.select("id", "label", plain.alias("v")).withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("label", "v")), 256)))
    rows = cut(rows.select("id", "label", "v", F.when(F.col("v").isNotNull(), F.col("key")).alias("key")))
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"))
    n = rows.count()
    # Numbers are given once and kept with the classes, so no two share one. Vectors are wide, and each is hashed
    # many times next: more files than their number alone would give.
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), 16 * n)
    found = cut(_search(classes, threshold, tables_for(recall, projections, width), projections, width, block))
    others = found.where(F.col("root").isNull()).groupBy("class").agg(F.sum("n").alias("others"))
    roots = components(found.where(F.col("root").isNotNull()).select(F.col("class").alias("a"), F.col("root").alias("b")), n)
    grouped = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("root", "class"))
    lowest = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    told = grouped.join(lowest, "group").join(others, "class", "left").select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    joined = rows.select("id", "key").join(told, "key", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


_PLACE = ["label", "dim", "table", "bucket"]


def _scatter(classes: DataFrame, threshold: float, tables: int, projections: int, width: float, whole: bool) -> DataFrame:
    """A row for each class and table; ``whole``: with the vector and the buckets in earlier tables."""
    v_type = classes.schema["v"].dataType.simpleString()
    schema = "label string, dim int, table int, bucket int" + f", class bigint, n bigint, earlier array<int>, v {v_type}" * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashing] = {}
        for batch in batches:
            vectors = batch.column(0)
            lengths = np.diff(vectors.offsets.to_numpy())
            starts = vectors.offsets.to_numpy()[:-1]
            flat = vectors.values.to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.nonzero(lengths == dim)[0]
                for lo in range(0, len(at), 2_000):
                    some = at[lo : lo + 2_000]
                    taken = batch.take(pa.array(some))
                    units = _units(flat[starts[some][:, None] + np.arange(dim)].astype(np.float64))
                    buckets = made.setdefault(dim, Hashing(dim, threshold, tables, projections, width)).buckets(units)
                    for t in range(tables):
                        columns = [taken.column(1), pa.array(np.full(len(some), dim, np.int32)), pa.array(np.full(len(some), t, np.int32)), pa.array(np.ascontiguousarray(buckets[:, t]))]
                        names = [*_PLACE]
                        if whole:
                            before = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * t, t, dtype=np.int32) if t else np.zeros(len(some) + 1, np.int32)), pa.array(np.ascontiguousarray(buckets[:, :t]).ravel()))
                            columns += [taken.column(2), taken.column(3), before, taken.column(0)]
                            names += ["class", "n", "earlier", "v"]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("v", "label", "class", "n").mapInArrow(run, schema)


def _bucket(table: pa.Table, i: int, j: int, threshold: float) -> tuple[list, list, list]:
    """Rows ``(class, root, n)`` of one bucket or pair of blocks: link counts (root None) and forest edges (n 0)."""
    size = table.num_rows
    cls, own, copies = table["class"].to_numpy(), table["own"].to_numpy(), table["n"].to_numpy()
    units = _units(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(size, -1))
    earlier = table["earlier"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
    first, second = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
    links, forest = np.zeros(size, dtype=np.int64), Forest(size)
    step = max(1, 2_000_000 // max(1, len(second)))
    for at in range(0, len(first), step):
        a = first[at : at + step]
        x, y = np.nonzero(units[a] @ units[second].T >= threshold)
        x, y = a[x], second[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 200_000):
            p, q = x[k : k + 200_000], y[k : k + 200_000]
            new = ~(earlier[p] == earlier[q]).any(axis=1)
            p, q = p[new], q[new]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            if len(p):
                forest.link(p, q)
    a, b = forest.stars(cls)
    some = np.nonzero(links)[0]
    return cls[some].tolist() + a.tolist(), [None] * len(some) + b.tolist(), links[some].tolist() + [0] * len(a)


def _search(classes: DataFrame, threshold: float, tables: int, projections: int, width: float, block: int) -> DataFrame:
    """``(class, root, n)``: link counts to other classes by table (root null), and edges of spanning forests."""
    how = (threshold, tables, projections, width)
    large = cut(_scatter(classes, *how, whole=False).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block))
    met = _scatter(classes, *how, whole=True)
    if large.isEmpty():
        met = met.withColumn("own", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        # A large bucket is dealt out as pairs of blocks, a vector to each pair that its block is in.
        met = met.join(large, _PLACE, "left").withColumn("parts", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
        met = met.withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    keys = [*_PLACE, "i", "j"]
    met = met.select(*keys, "own", "class", "n", "earlier", "v")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finish(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            """Search all buckets of a sorted table but, unless ``last``, its final one, which is handed back."""
            size = table.num_rows
            new = np.zeros(size, dtype=bool)
            new[0] = True
            for k in keys:
                codes = table[k].combine_chunks()
                codes = codes.dictionary_encode().indices.to_numpy() if pa.types.is_string(codes.type) else codes.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], size)
            out: list = [[], [], []]
            whole = len(starts) if last else len(starts) - 1
            for s, e in zip(starts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                if e - s > 1:
                    part = table.slice(s, e - s)
                    for to, more in zip(out, _bucket(part, part["i"][0].as_py(), part["j"][0].as_py(), threshold), strict=True):
                        to += more
            return out, None if last else table.slice(int(starts[-1]))

        def emit(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["class", "root", "n"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                out, held = finish(table if held is None else pa.concat_tables([held, table]), False)
                yield emit(out)
        if held is not None:
            yield emit(finish(held, True)[0])

    return met.mapInArrow(run, "class bigint, root bigint, n bigint")
