"""SimHash near-duplicates: 64-bit fingerprints joined within a Hamming radius by vantage-point trees.

Equal fingerprints become one class first (partial aggregation). The classes are then partitioned by a
shallow vantage-point tree over the whole table: every level has one vantage point, every node the median
distance as its radius, taken from distance histograms that Spark aggregates (a bounded number of counts reaches the
driver, never fingerprints). A class lives in one leaf, and visits those leaves across a boundary that the
triangle inequality can't rule out. Every leaf is searched by a local vantage-point recursion. Only a
spanning forest leaves a leaf, so rows stay linear in the classes whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._components import Forest, components
from turnpike.llm._memory import released
from turnpike.llm._store import cut

#: Levels of the tree with radii of their own for each node; nodes below share those of their ancestor there, level by
#: level, so at most 2**TOP * 65 counts a level reach the driver, and as many radii a level the workers.
TOP = 10
#: Fingerprints that aren't alone, up to which the table of their keys is broadcast.
BROADCAST_KEYS = 500_000
#: Leaves up to which the table of oversized ones is broadcast.
BROADCAST_LEAVES = 100_000
#: Classes that one leaf of the distributed tree should hold.
LEAF = 32_768
#: Rows (classes and visitors) of a leaf above which it is cut into blocks that are compared pairwise.
BLOCK = 131_072
#: Sets up to this size are compared outright by the local recursion.
SMALL = 384
_PIECE = 65_536


def fingerprint(data: bytes, *, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, XXH64 of word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < shingle:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(t), seed) for t in zip(*(words[i:] for i in range(shingle)), strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[at : at + _PIECE]), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long. Null and wordless texts have fingerprint zero."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py() or b"", shingle=shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(released(run), f"id {id_type}, fp bigint")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(level: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"vantage point", level))


def _ancestor(node: np.ndarray, level: int) -> np.ndarray:
    """The node, or the one above it that radii are kept for."""
    return node >> max(0, level - TOP)


def _route(fp: np.ndarray, radii: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of each fingerprint: (row, leaf, visits). Home points cross outwards only, so a pair meets once."""
    row = np.arange(len(fp))
    node = np.zeros(len(fp), dtype=np.int64)
    visits = np.zeros(len(fp), dtype=bool)
    for level, radius in enumerate(radii):
        d = _distance(fp, _vantage(level))[row].astype(np.int16)
        r = radius[_ancestor(node, level)]
        inside = np.where(visits, d <= r + reach, d <= r)
        outside = np.where(visits, d > r - reach, d > r)
        crossing = ~visits & inside & (d > r - reach)
        row = np.concatenate([row[inside], row[outside], row[crossing]])
        node = np.concatenate([node[inside] * 2, node[outside] * 2 + 1, node[crossing] * 2 + 1])
        visits = np.concatenate([visits[inside], visits[outside], np.ones(int(crossing.sum()), dtype=bool)])
    return row, node, visits


def _tree(classes: DataFrame, levels: int) -> list[np.ndarray]:
    """Radii by level and node (``TOP`` bounds the nodes): medians of distance histograms, aggregated by Spark."""
    radii: list[np.ndarray] = []
    for level in range(levels):
        nodes = 1 << min(level, TOP)

        def count(batches: Iterator[pa.RecordBatch], radii=tuple(radii), level=level, nodes=nodes) -> Iterator[pa.RecordBatch]:
            bins = np.zeros((nodes, 65), dtype=np.int64)
            for batch in batches:
                fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                node = np.zeros(len(fp), dtype=np.int64)
                for up, radius in enumerate(radii):
                    node = node * 2 + (_distance(fp, _vantage(up)) > radius[_ancestor(node, up)])
                np.add.at(bins, (_ancestor(node, level), _distance(fp, _vantage(level))), 1)
            node, d = np.nonzero(bins)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(d), pa.array(bins[node, d])], ["node", "d", "n"])

        rows = classes.select("fp").mapInArrow(released(count), "node bigint, d bigint, n bigint").groupBy("node", "d").agg(F.sum("n").alias("n")).collect()
        bins = np.zeros((nodes, 65), dtype=np.int64)
        for x in rows:
            bins[x["node"], x["d"]] = x["n"]
        under = bins.cumsum(axis=1)
        radii.append(np.abs(2 * under - under[:, -1:]).argmin(axis=1).astype(np.int16))
    return radii


def _outright(forest: Forest, fp: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int, same: bool) -> None:
    step = max(1, 1_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        x, y = np.nonzero(_distance(fp[a[at : at + step], None], fp[None, b]) <= reach)
        if same:
            x, y = x[x + at < y], y[x + at < y]
        if len(x):
            forest.link(a[at + x], b[y])


def local_links(fp: np.ndarray, home: np.ndarray, other: np.ndarray | None, reach: int, forest: Forest) -> None:
    """Link all pairs within ``home`` (other None) or between ``home`` and ``other`` that differ in <= reach bits."""
    todo = [(home, other)]
    while todo:
        a, b = todo.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        if b is None and len(a) <= SMALL or b is not None and len(a) * len(b) <= SMALL * SMALL:
            _outright(forest, fp, a, a if b is None else b, reach, b is None)
            continue
        vantage = fp[a[len(a) // 2]]
        da = _distance(fp[a], vantage)
        db = None if b is None else _distance(fp[b], vantage)
        radius = int(np.median(da))
        if radius >= int(da.max()) and b is None:
            radius = max(0, radius - 1)
        near_a, far_a = da <= radius, da > radius
        if db is None:
            if not far_a.any() or not near_a.any():
                _outright(forest, fp, a, a, reach, True)
                continue
            todo += [(a[near_a], None), (a[far_a], None), (a[near_a & (da + reach > radius)], a[far_a & (da <= radius + reach)])]
            continue
        near_b, far_b = db <= radius, db > radius
        parts = [
            (a[near_a], b[near_b]),
            (a[far_a], b[far_b]),
            (a[near_a & (da + reach > radius)], b[far_b & (db <= radius + reach)]),
            (a[far_a & (da <= radius + reach)], b[near_b & (db + reach > radius)]),
        ]
        if sum(len(x) * len(y) for x, y in parts) >= 0.9 * len(a) * len(b):
            _outright(forest, fp, a, b, reach, False)
        else:
            todo += parts


def link_classes(classes: DataFrame, *, reach: int = 3, leaf: int = LEAF, block: int = BLOCK, tables: int = 1) -> DataFrame:
    """``classes(fp, rep)``, distinct fingerprints and their smallest ids -> spanning edges ``(a, b)`` of ids.

    With several ``tables`` a column ``table`` tells whose fingerprint it is; only those of one table link. Their
    fingerprints are alike in distribution, so the trees share vantage points and radii.
    """
    table = F.col("table") if tables > 1 else F.lit(0)
    n = -(-classes.count() // tables)
    levels = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    radii = _tree(classes, levels)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rep = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, node, visits = _route(fp.view(np.uint64), radii, reach)
            node += batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[row] << levels
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp[row]), pa.array(rep[row]), pa.array(visits)], ["leaf", "fp", "rep", "visits"])

    routed = classes.select("fp", "rep", table.alias("table")).mapInArrow(released(route), "leaf bigint, fp bigint, rep bigint, visits boolean")
    # Blocks of an oversized leaf are compared pairwise: a row goes to every pair that its block is in.
    large = cut(routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"))
    found = large.count()
    if found:
        routed = routed.join(F.broadcast(large) if found <= BROADCAST_LEAVES else large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        routed = routed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        routed = routed.select("leaf", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "fp", "rep", "visits")
    else:
        routed = routed.select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "fp", "rep", "visits")

    def search(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        rep, own, visits = table["rep"].to_numpy(), table["own"].to_numpy(), table["visits"].to_numpy()
        forest, at = Forest(len(fp)), np.arange(len(fp))
        if i == j:
            local_links(fp, at[~visits], None, reach, forest)
            local_links(fp, at[~visits], at[visits], reach, forest)
        else:
            first, second = own == i, own == j
            local_links(fp, at[first & ~visits], at[second], reach, forest)
            local_links(fp, at[first & visits], at[second & ~visits], reach, forest)
        a, b = forest.stars(rep)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return routed.groupBy("leaf", "i", "j").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 3, leaf: int = LEAF) -> DataFrame:
    """``id, fingerprint, component_id`` for every row; the component is the smallest id reachable over links.

    Null, empty and wordless texts share fingerprint zero. Rows with a null id keep their fingerprint and get
    the component of the other rows like them, null if there are none. Repeated rows give repeated rows; an
    empty table gives none. Ids have to be integers. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).withColumn("id", F.col("id").cast("long")))
    return prints.join(_class_components(prints, reach, leaf), "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _class_components(prints: DataFrame, reach: int, leaf: int) -> DataFrame:
    """``prints(id, fp)`` -> ``(fp, component_id)`` for the fingerprints of rows with an id."""
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")).where(F.col("rep").isNotNull()), prints.count())
    # A class can have an edge in each leaf that it lives in or visits; most have none.
    roots = components(link_classes(classes, reach=reach, leaf=leaf), classes.count())
    return classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def _first_rows(docs: DataFrame, rows: DataFrame, group: list[str], id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` that comes first in each group of ``rows(id, digest, *group)``: the smallest id, nulls last.

    Rows are told apart by id and digest of the text, null-safely, so that unlike rows of one id are rows of their own.
    """
    counted = rows.groupBy("id", "digest", *group).agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", F.col("digest").isNull().alias("none"), "digest", "n")).alias("e"))
    first = cut(first.select(F.col("e.id").alias("__tp_id"), F.col("e.digest").alias("__tp_digest"), F.col("e.n").alias("__tp_n")), rows.count())
    named = docs.withColumn("__tp_key", F.md5(text_col))
    joined = named.join(first, named[id_col].cast("long").eqNullSafe(F.col("__tp_id")) & named["__tp_key"].eqNullSafe(F.col("__tp_digest")))
    # Of repeated rows the least in all columns stays, whatever their order; a partial minimum bears many.
    single = joined.where("__tp_n = 1").select(*docs.columns)
    repeated = joined.where("__tp_n > 1").groupBy("__tp_id", "__tp_digest").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("__tp_row"))
    return single.unionByName(repeated.select("__tp_row.*"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 3, leaf: int = LEAF) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their group: the smallest id of each component.

    Rows with a null id go unless no other row is like them; of those with equal fingerprints one stays. Repeated
    rows count once, and rows of one id with unlike texts are judged each for itself.
    """
    named = docs.select(id_col, text_col, F.md5(text_col).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py() or b"", shingle=shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["id", "digest", "fp"])

    named = named.select(F.col(id_col).cast("long"), "digest", F.col(text_col).cast("binary"))
    prints = cut(named.mapInArrow(released(run), "id bigint, digest string, fp bigint"))
    found = prints.join(_class_components(prints, reach, leaf), "fp", "left")
    return _first_rows(docs, found.withColumn("alone", F.when(F.col("component_id").isNull(), F.col("fp"))), ["component_id", "alone"], id_col, text_col)


#: Words of a shingle and the share of shared shingles that make two texts near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a text, their bits and the bits in which those of a candidate pair may differ. At 0.8 one fingerprint of a
#: pair is that near with a chance of 0.125, one of all with 0.994; unlike texts are with 1e-8 a fingerprint.
PRINTS, BITS, NEAR = 38, 40, 3
#: Bits of 64 in which a wider fingerprint of a candidate pair may differ. A pair at 0.8 is expected to differ in 9.7, with a deviation of 2.9.
WIDE = 22
#: Texts, and shingles of theirs, in a block of the texts under one key; blocks are compared pairwise.
BLOCK_TEXTS, BLOCK_SHINGLES = 1_500, 1_000_000
#: Cells of the matrix that a comparison lays out at a time.
_CELLS = 4_000_000
#: Parts that the pairs of one text are dealt into.
SALTS = 64
#: Bits of a filter a key, and in all at most: a full one passes more rows, which an exact join drops.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26


def _shingles(data: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, as in ``fingerprint``."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)), strict=False)
    return np.unique(np.frombuffer(b"".join([digest(join(g), 42) for g in grams]), dtype=">u8").astype(np.uint64))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches: the sets of a full one would stay in the memory of a reused worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _node(hashes: np.ndarray) -> int:
    """Digest of a shingle set."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), 1), "big", signed=True)


def _filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter of two probes over ``keys(key)``. Spark aggregates its words, of which a bounded number reaches the driver."""
    size = min(MOST_FILTER_BITS, 1 << max(6, (FILTER_BITS * keys.count()).bit_length()))
    probes = [k.bitwiseAND(F.lit(size - 1)) for k in (F.col("key"), F.shiftrightunsigned("key", 32))]
    bits = keys.select(F.explode(F.array(*probes)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow()
    found = np.zeros(size >> 6, dtype=np.uint64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return found


def _passes(found: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys a filter holds; a few of those that it was not built from are among them."""
    key, last = key.astype(np.int64).view(np.uint64), np.uint64(64 * len(found) - 1)
    bits = [found[(k & last) >> np.uint64(6)] >> (k & np.uint64(63)) for k in (key, key >> np.uint64(32))]
    return (bits[0] & bits[1] & np.uint64(1)).astype(bool)


#: Words of random bits that a shingle gives to the fingerprints.
_WORDS = -(-PRINTS * BITS // 64)
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, _WORDS, dtype=np.uint64)


def _sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """Digest, wide fingerprint and fingerprints of a shingle set; an empty one has none."""
    if not len(hashes):
        return 0, 0, []
    total = np.zeros(64 * (1 + _WORDS), dtype=np.int64)
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255, None]
        # The finaliser of SplitMix64 makes independent words of a hash.
        words = part ^ _SEEDS
        words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        words = (words ^ (words >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words = np.concatenate([part, words ^ (words >> np.uint64(31))], axis=1)
        bits = np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    bits = total * 2 > len(hashes)
    fp = int.from_bytes(np.packbits(bits[:64]).tobytes(), "big", signed=True)
    prints = np.zeros((PRINTS, 64), dtype=bool)
    prints[:, 64 - BITS :] = bits[64 : 64 + PRINTS * BITS].reshape(PRINTS, BITS)
    prints = np.packbits(prints, axis=1).view(">u8").astype(np.int64).ravel().tolist()
    return _node(hashes), fp, prints


def _near_groups(classes: DataFrame, *, reach: int = NEAR, leaf: int = 2 * LEAF, broadcast: int = BROADCAST_KEYS) -> DataFrame:
    """``classes(node, fp, prints)`` -> ``(node, fp, key, salt)`` for each fingerprint that isn't alone: the key is that of its component.

    Components are those of one table's fingerprints that differ in ``reach`` bits or fewer, found by vantage-point trees.
    Table and fingerprint are one long, which keeps the shuffles and the folder small; most are alone and go at once.
    """
    classes = cut(classes)
    rows = classes.select("node", "fp", F.posexplode("prints").alias("table", "print"))
    rows = rows.select("node", "fp", F.shiftleft(F.col("table").cast("long"), BITS).bitwiseOR(F.col("print")).alias("code"))
    several = F.when(F.count(F.lit(1)) > 1, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    held = cut(rows.groupBy("code").agg(several.alias("several")).select(F.col("code").bitwiseOR(F.col("several")).alias("held")))
    code = F.col("held").bitwiseAND(F.lit((1 << 62) - 1))
    points = held.select(code.bitwiseAND(F.lit((1 << BITS) - 1)).alias("fp"), code.alias("rep"), F.shiftright(code, BITS).cast("int").alias("table"))
    roots = components(link_classes(points, reach=reach, leaf=leaf, tables=PRINTS))
    own = held.where(F.col("held") >= F.lit(1 << 62)).select(code.alias("code")).unionByName(roots.select(F.col("root").alias("code"))).distinct()
    own = own.join(roots.select(F.col("node").alias("code")), "code", "left_anti").select("code", F.col("code").alias("key"))
    keys = cut(own.unionByName(roots.select(F.col("node").alias("code"), F.col("root").alias("key"))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)).cast("int"))
    if keys.count() <= broadcast:
        return rows.join(F.broadcast(keys), "code").select("node", "fp", "key", "salt")
    # A fingerprint may be that of many texts, so it is dealt under salts.
    dealt = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rows.join(dealt, ["code", "salt"]).select("node", "fp", "key", "salt")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs(a, b)`` those whose ``sets(node, s)`` have the similarity. A hub ``a`` meets its partners in parts."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = pairs.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").join(hubs, ["a", "part"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= F.lit(similarity)).select("a", "b")


def _overlaps(flat: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the ``first`` with the ``second`` sets, which lie end to end in ``flat``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    values, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle of one text alone is in no intersection.
    wanted = counts > 1
    place = np.cumsum(wanted) - 1
    shared = wanted[column]
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n_columns = int(wanted.sum())
    total, width = np.zeros((len(first), len(second)), dtype=np.float32), max(1, _CELLS // max(1, len(sizes)))
    for at in range(0, n_columns, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        cells = np.zeros((len(sizes), min(width, n_columns - at)), dtype=np.float32)
        cells[row[lo:hi], column[lo:hi] - at] = 1
        total += cells[first] @ cells[second].T
    return total


def _links_in_blocks(left: DataFrame, sets: DataFrame, similarity: float, wide: int, block_texts: int) -> DataFrame:
    """``left(key, node, fp, root)`` -> edges ``(a, b)`` that join the roots of similar texts under one key.

    Texts of a key are dealt out as pairs of blocks and each block pair is compared outright on the exact sets; only a
    spanning forest of roots leaves it, so no group yields its pairs as rows.
    """
    # Sizes decide which keys are left to compare and how they are dealt; only then do the sets come along.
    measured = left.join(sets.select("node", F.size("s").alias("words")), "node")
    several = measured.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).where("low < high")
    parts = F.greatest(F.ceil(F.col("n") / F.lit(block_texts)), F.ceil(F.col("words") / F.lit(BLOCK_SHINGLES))).cast("int")
    # A key may hold a third of all texts, so it is dealt under salts before its blocks are.
    dealt = several.select("key", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    rows = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)).cast("int")).join(dealt, ["key", "salt"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "root", "fp", "node")
    rows = rows.join(sets.select("node", "s"), "node").drop("node")

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, root, fp = table["own"].to_numpy(), table["root"].to_numpy(), table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        lists = table["s"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ids, place = np.unique(root, return_inverse=True)
        forest = Forest(len(ids))
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(ids) > 1 and len(first) and len(second):
            shared = _overlaps(lists.flatten().to_numpy(), sizes, first, second)
            for k, a in enumerate(first.tolist()):
                near = (place[second] != place[a]) & (_distance(fp[second], fp[a]) <= wide)
                alike = near & (shared[k].astype(np.float64) / (sizes[a] + sizes[second] - shared[k]) >= similarity)
                if alike.any():
                    forest.link(place[second[alike]], np.full(int(alike.sum()), place[a]))
        a, b = forest.stars(ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def similar_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, similarity: float = SIMILARITY, wide: int = WIDE, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``classes(node, fp, prints)`` -> links ``(a, b)`` of nodes, each checked on the sets that ``sets_of(nodes)`` gives.

    Candidates are the texts of one component of a table's fingerprints, its key. Every key is led by its smallest text.
    First every text meets two leaders: the smallest, and the one of most of its keys. Keys whose texts this leaves in
    different components are then compared whole, in pairs of blocks; texts of one component needn't meet again.
    """
    rows = _near_groups(classes)
    low = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("low")).where("n > 1")
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    shared = cut(rows.join(low, ["key", "salt"]).select("key", "node", "fp", F.col("low.node").alias("low"), F.col("low.fp").alias("low_fp")))
    sets = cut(sets_of(shared.select("node").distinct()))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("low_fp"))) <= wide
    led = shared.where((F.col("node") != F.col("low")) & near).groupBy("node", "low").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.array_distinct(F.array(F.min("low"), F.max_by("low", F.struct("n", -F.col("low")))))
    stars = led.groupBy("node").agg(chosen.alias("leaders")).select(F.explode("leaders").alias("a"), F.col("node").alias("b"))
    links = cut(_similar(stars, sets, similarity))
    left = cut(shared.join(components(links), "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root")))
    return links.unionByName(cut(_links_in_blocks(left, sets, similarity, wide, block_texts)))


def keep_dissimilar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their group: links are pairs of texts that share at least
    ``similarity`` of the word shingles that either has (Jaccard).

    A candidate pair has one of ``PRINTS`` SimHash fingerprints within ``NEAR`` bits, found by vantage-point trees, or is
    joined by a chain of such, and a wider one within ``WIDE`` bits; each is checked on the exact sets. Texts without words
    are one group. Rows with a null id go unless no other row is like them; rows of one id with unlike texts are judged each
    for itself.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [_sketch(_shingles(x.as_py() or b"", shingle)) for x in batch.column(2)]
            node, fp, prints = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "node", "fp", "prints"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t"))
    prints = cut(named.mapInArrow(released(sketch), "id bigint, digest string, node bigint, fp bigint, prints array<bigint>"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        one = prints.groupBy("node").agg(F.min(F.struct("digest", F.col("id").isNull().alias("no"), "id")).alias("e")).join(nodes, "node")
        wanted = cut(one.select("node", F.xxhash64("e.digest", "e.id").alias("key")))
        found = _filter(wanted)

        # Sets are made where the texts lie, of those that the filter passes; no text is shuffled.
        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                texts = batch.column(1).filter(pa.array(_passes(found, batch.column(0).to_numpy(zero_copy_only=False))))
                sets = [_shingles(x.as_py() or b"", shingle) for x in texts]
                columns = [pa.array(map(_node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "s"])

        sets = named.select(F.xxhash64("digest", "id").alias("key"), "t").mapInArrow(released(shingles), "node bigint, s array<bigint>")
        return sets.dropDuplicates(["node"]).join(wanted, "node", "left_semi")

    classes = prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("prints").alias("prints")).where(F.size("prints") > 0)
    roots = components(similar_links(classes, sets_of, similarity=similarity))
    rows = prints.select("id", "digest", "node").join(roots, "node", "left").select("id", "digest", F.coalesce("root", "node").alias("group"))
    return _first_rows(docs, rows, ["group"], id_col, text_col)
