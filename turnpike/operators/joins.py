"""Joins beyond equality: as-of, backoff, bands, boxes, one-to-one matching."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.operators.store import cut


#: Microseconds of a time block: with what is carried over its border, it bounds the rows that a task holds of one key.
BLOCK = 28 * 86_400_000_000


def _all_known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def asof_many(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    right_id: str,
    columns: Sequence[str],
    lookups: dict[str, tuple[str, str | None]],
    block: int = BLOCK,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add to each left row a struct of the right ``columns`` for every lookup ``name: (direction, extra key)``.

    ``backward`` takes the right row nearest in time at or before the left one, ``forward`` at or after it, among those
    with equal keys and, if it is named, an equal extra key. Of right rows at one time the largest id wins backward and
    the smallest forward. A null key, time or extra key matches nothing; such left rows come back with nulls.

    Both sides are united in one exchange by key and time block, and ordered windows carry the right rows, so the cost is
    a few sorts and no join. What a block needs from outside comes in as rows of its own: the last right row of each
    extra key before the block and the first one after it. So no task holds a whole key, nor one the rows without a key.
    Which blocks have left rows is read from ``source``, the same rows with ``by`` and the time, where ``left`` is costly.
    """
    names, extra = [f"_k{i}" for i in range(len(by))], next((x for _, x in lookups.values() if x), None)
    if any(x not in (None, extra) for _, x in lookups.values()):
        raise ValueError("lookups share one extra key")
    payload, row = F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c) for c in left.columns])
    types = {"_p": right.select(payload.alias("x")).schema["x"].dataType, "_row": left.select(row.alias("x")).schema["x"].dataType}
    usable = _all_known([*by, left_time])

    def keyed(frame: DataFrame, time: str) -> list[Column]:
        on = F.col(extra) if extra else F.lit(None).cast("string")
        return [*[F.col(k).alias(n) for k, n in zip(by, names, strict=True)], on.alias("_x"), F.col(time).alias("_t"), F.floor(F.col(time) / block).alias("_b")]

    # Left rows that match nothing go along under a null key, dealt by their hash.
    ours = left.select(*keyed(left, left_time), row.alias("_row"), F.coalesce(usable, F.lit(False)).alias("_ok"))
    dealt = F.when(F.col("_ok"), F.col("_b")).otherwise(F.pmod(F.xxhash64("_row"), F.lit(4096)))
    ours = ours.select(*[F.when(F.col("_ok"), F.col(n)).alias(n) for n in names], "_x", "_t", dealt.alias("_b"), "_row")
    theirs = right.where(_all_known([*by, right_time])).select(*keyed(right, right_time), F.col(right_id).cast("bigint").alias("_id"), payload.alias("_p"))

    def lay(frame: DataFrame, side: int, back: Column | None, ahead: Column | None, own: bool = False) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        return frame.select(
            *names, "_x", "_t", "_b", F.lit(side).alias("_side"), none("bigint").alias("_id") if own else F.col("_id"),
            (none(types["_p"]) if back is None else back).alias("_back"), (none(types["_p"]) if ahead is None else ahead).alias("_ahead"), (F.col("_row") if own else none(types["_row"])).alias("_row"),
        )

    # Which blocks of a key have left rows, so that nothing is carried beyond them.
    blocks = (left if source is None else source).where(usable).select(*keyed(left, left_time))
    span = blocks.groupBy(*names).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    at, edge = F.struct("_t", "_id"), F.struct("_t", "_id", "_p")
    edges = theirs.groupBy(*names, "_x", "_b").agg(F.max_by(edge, at).alias("_last"), F.min_by(edge, at).alias("_first")).join(span, names)
    near = Window.partitionBy(*names, "_x").orderBy("_b")
    edges = edges.withColumn("_later", F.coalesce(F.lead("_b").over(near), F.col("_hi"))).withColumn("_earlier", F.coalesce(F.lag("_b").over(near), F.col("_lo")))
    reach = {True: (F.greatest(F.col("_b") + 1, F.col("_lo")), F.least("_later", "_hi")), False: (F.greatest("_earlier", "_lo"), F.least(F.col("_b") - 1, F.col("_hi")))}
    carried = [F.struct(F.lit(back).alias("back"), lo.alias("lo"), hi.alias("hi"), F.col("_last" if back else "_first").alias("e")) for back, (lo, hi) in reach.items()]
    if all(direction != "forward" for direction, _ in lookups.values()):
        carried = carried[:1]
    spread = edges.select(*names, "_x", F.explode(F.array(*carried)).alias("_c")).where("_c.lo <= _c.hi")
    spread = spread.select(*names, "_x", F.explode(F.sequence("_c.lo", "_c.hi")).alias("_b"), "_c.e.*", F.col("_c.back").alias("_is_back"))
    frames = [lay(ours, 1, None, None, own=True), lay(theirs, 0, F.col("_p"), F.col("_p")), lay(spread, 0, F.when(F.col("_is_back"), F.col("_p")), F.when(~F.col("_is_back"), F.col("_p")))]
    out = reduce(DataFrame.unionByName, frames)
    # Lookups without the extra key come first: their partitioning serves the others too.
    for name, (direction, x) in sorted(lookups.items(), key=lambda item: item[1][1] is not None):
        ahead = direction == "forward"
        order = [F.col("_t").desc(), F.col("_side"), F.col("_id").desc()] if ahead else [F.col("_t"), F.col("_side"), F.col("_id")]
        window = Window.partitionBy(*names, "_b", *(["_x"] if x else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_ahead" if ahead else "_back", ignorenulls=True).over(window)
        out = out.withColumn(f"_f_{name}", F.when(F.col("_x").isNotNull(), found) if x else found)
    return out.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_f_{n}").alias(n) for n in lookups])


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    right_id: str,
    columns: Sequence[str],
    forward: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Add to each left row the ``columns`` of the right row nearest in time at or before it (``forward``: at or after); see ``asof_many``."""
    how = {"_found": ("forward" if forward else "backward", None)}
    out = asof_many(left, right, by=by, left_time=left_time, right_time=right_time, right_id=right_id, columns=columns, lookups=how, block=block)
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"_found.{c}").alias(c) for c in columns])


def backoff(rows: DataFrame, levels: Sequence[tuple[Sequence[str], DataFrame]], value: str, default: Column | float | None = None) -> DataFrame:
    """First known value of the levels, finest first: one broadcast left join per level and a coalesce.

    The level tables are groups of a training set, small against the rows; Spark broadcasts those under its limit
    and shuffles others.
    """
    out, found = rows, []
    for i, (keys, table) in enumerate(levels):
        side = table.select(*[F.col(k).alias(f"_b{i}_{k}") for k in keys], F.col(value).alias(f"_b{i}"))
        on = [F.col(k) == F.col(f"_b{i}_{k}") for k in keys]
        out = out.join(side, reduce(lambda a, b: a & b, on), "left")
        found.append(F.col(f"_b{i}"))
    if default is not None:
        found.append(default if isinstance(default, Column) else F.lit(default))
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce(*found).alias(value))


def band(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, reach: int) -> DataFrame:
    """Pairs of one key with right time in [left time - reach, left time + reach).

    Times are cut into buckets of ``reach``; a right row can only meet the left rows of its bucket and the two beside
    it, so an equi-join on key and bucket with a residual range does it. Column names of the sides must not clash.
    """
    a = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(left_time) / reach) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_bucket_r", F.floor(F.col(right_time) / reach))
    on = [F.col(x) == F.col(y) for x, y in [k if isinstance(k, tuple) else (k, f"{k}_r") for k in by]]
    on += [F.col("_bucket") == F.col("_bucket_r"), F.col(right_time) >= F.col(left_time) - reach, F.col(right_time) < F.col(left_time) + reach]
    return a.join(b, reduce(lambda x, y: x & y, on)).drop("_bucket", "_bucket_r")


#: Pairs that one task may walk through; more are thinned out by rounds first.
GREEDY_PAIRS = 200_000


def _greedy_walk(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The greedy pass itself, over pairs sorted by ``_o``: one task, which remembers the ids that are taken."""
    columns = [c for c in pairs.columns if c != "_o"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used_l, used_r = set(), set()
        for batch in batches:
            taken = []
            for k, (x, y) in enumerate(zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)):
                if x not in used_l and y not in used_r:
                    used_l.add(x)
                    used_r.add(y)
                    taken.append(k)
            yield batch.select(columns).take(pa.array(taken, pa.int64()))

    return pairs.repartition(1).sortWithinPartitions("_o").mapInArrow(run, pairs.select(*columns).schema)


def greedy_one_to_one(pairs: DataFrame, *, left: str, right: str, cost: Sequence[str], walk: int = GREEDY_PAIRS) -> DataFrame:
    """The pairs that a greedy pass over ascending cost would take, each side once.

    With a strict order (cost, then both ids) mutual-best rounds give the same: pairs that are the best of both their ends
    are taken, their ends removed. Every round is two partial minimums and joins, and thins the pairs out; when ``walk``
    or fewer are left, one task walks through them, so that a chain of pairs doesn't cost a round each. Results are cut
    from the lineage in the shared checkpoint folder.
    """
    order = F.struct(*[F.col(c) for c in cost], F.col(left), F.col(right))
    remaining = cut(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_o", order))
    taken: list[DataFrame] = []
    while (n := remaining.count()) > walk:
        best_l = remaining.groupBy(left).agg(F.min("_o").alias("_bl"))
        best_r = remaining.groupBy(right).agg(F.min("_o").alias("_br"))
        mutual = remaining.join(best_l, left).join(best_r, right).where((F.col("_o") == F.col("_bl")) & (F.col("_o") == F.col("_br")))
        mutual = cut(mutual.select(*pairs.columns).dropDuplicates([left, right]))
        taken.append(mutual)
        remaining = cut(remaining.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"))
    if n:
        taken.append(cut(_greedy_walk(remaining, left, right)))
    return reduce(DataFrame.unionByName, taken) if taken else pairs.limit(0)


#: Reaches in a time block of ``nearest_one_to_one`` at first; at least four.
REACHES = 16


def _nearest_walk(lists: np.ndarray, t: np.ndarray, side: np.ndarray, rank: np.ndarray, lo: float, hi: float, reach: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The pairs that the greedy pass surely takes in the block [lo, hi), as row numbers, and which rows stay undecided.

    A row is a left (0) or right (1) one in a list; rows of one side and rank are one and the same. Rows of one list, time
    and side are a slot; the cheapest pair left is the first of two neighbouring slots. A pair is sure if nothing beyond the
    block and nothing unsure is as near to either of the two; else both slots become unsure and stay where they are.
    """
    order = np.lexsort((rank, side, t, lists))
    c, x, w = lists[order], t[order], side[order]
    starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (w[1:] != w[:-1])])
    n, at, end = len(starts), starts.tolist(), [*starts[1:].tolist(), len(order)]
    row, ids, where, when, which = order.tolist(), rank[order].tolist(), c[starts].tolist(), x[starts].tolist(), w[starts].tolist()
    before = [i - 1 if i and where[i - 1] == where[i] else -1 for i in range(n)]
    after = [i + 1 if i + 1 < n and where[i + 1] == where[i] else -1 for i in range(n)]
    lists_of: dict[int, list[int]] = defaultdict(list)
    for k, of in zip(rank[side == 1].tolist(), lists[side == 1].tolist(), strict=True):
        lists_of[k].append(of)
    gone, unsure = (set(), set()), (set(), set())
    unsure_at = (defaultdict(list), defaultdict(list))
    heap: list[tuple[float, int, int, int, int]] = []

    def push(i: int, j: int) -> None:
        i, j = (i, j) if which[i] == 0 else (j, i)
        if when[j] >= when[i] - reach and when[j] < when[i] + reach:
            # The first that may be gone is a lower bound; it is put right when it comes up.
            heapq.heappush(heap, (abs(when[j] - when[i]), ids[min(at[i], end[i] - 1)], ids[min(at[j], end[j] - 1)], i, j))

    def settle(i: int) -> bool:
        """Move a slot on to its first row that is left; an empty one goes."""
        while at[i] < end[i] and ids[at[i]] in gone[which[i]]:
            at[i] += 1
        if at[i] < end[i]:
            return True
        p, q = before[i], after[i]
        if p >= 0:
            after[p] = q
        if q >= 0:
            before[q] = p
        before[i] = after[i] = -2
        if p >= 0 and q >= 0 and which[p] != which[q]:
            push(p, q)
        return False

    def near(times: list[float], to: float, most: float) -> bool:
        k = bisect_left(times, to - most)
        return k < len(times) and times[k] <= to + most

    for i in np.flatnonzero((c[starts][1:] == c[starts][:-1]) & (w[starts][1:] != w[starts][:-1])).tolist():
        push(i, i + 1)
    taken = []
    while heap:
        off, a, b, i, j = heapq.heappop(heap)
        if after[i] != j and after[j] != i:
            continue
        alive_i, alive_j = settle(i), settle(j)
        if not (alive_i and alive_j):
            continue
        d, r = ids[at[i]], ids[at[j]]
        if (d, r) != (a, b):
            push(i, j)
            continue
        first, last = min(when[i], when[j]), max(when[i], when[j])
        doubtful = first - lo < off or hi - last <= off or d in unsure[0] or r in unsure[1] or near(unsure_at[1][where[i]], when[i], off)
        if doubtful or any(near(unsure_at[0][of], when[j], off) for of in lists_of[r]):
            for k in (i, j):
                for e in ids[at[k] : end[k]]:
                    if e not in gone[which[k]] and e not in unsure[which[k]]:
                        unsure[which[k]].add(e)
                        for of in lists_of[e] if which[k] else [where[k]]:
                            insort(unsure_at[which[k]][of], when[k])
            continue
        taken.append((row[at[i]], row[at[j]]))
        gone[0].add(d)
        gone[1].add(r)
        alive_i, alive_j = settle(i), settle(j)
        if alive_i and alive_j:
            push(i, j)
    # What is left is decided if neither the border nor an unsure row that it could meet is within reach: a pair that is
    # still possible either became unsure itself or has an unsure one between its ends.
    left = np.array([k not in gone[s] for k, s in zip(rank.tolist(), side.tolist(), strict=True)], dtype=bool)
    open_ = (t - lo <= reach) | (hi - t <= reach)
    for s in (0, 1):
        for of, times in unsure_at[1 - s].items():
            here = np.flatnonzero(left & (side == s) & (lists == of))
            open_[here] |= np.searchsorted(times, t[here] + reach, "right") > np.searchsorted(times, t[here] - reach, "left")
    return taken, left & open_


def nearest_one_to_one(
    left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, left_id: str, right_id: Sequence[str], reach: float, among: Sequence[str] = (), reaches: int = REACHES
) -> DataFrame:
    """The pairs ``(by, left_id, right_id)`` that a greedy pass over ascending time between the two, then ``left_id``, then
    ``right_id`` would take, each side once; right times lie in [left time - reach, left time + reach).

    With ``among`` only rows with equal values there pair; a right row may come once for each value, ids are unique within
    ``by`` otherwise. No pair is ever written: a task walks through the rows of a key's time block, takes the pairs that
    hold whatever lies beyond its borders, and hands on the rows that depend on it. These meet again in blocks with other
    borders, twice as long every other round, until none is left. So rows stay linear in the two sides, whatever their density.
    """
    rid = [f"_r{i}" for i in range(len(right_id))]
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in among]) if among else F.lit("")
    l_known, r_known = _all_known([*by, left_time, left_id, *among]), _all_known([*by, right_time, *right_id, *among])
    ours = left.where(l_known).select(*by, value.alias("_list"), F.lit(0).alias("_side"), F.col(left_time).cast("double").alias("_t"), F.col(left_id).alias("_l"))
    theirs = right.where(r_known).select(*by, value.alias("_list"), F.lit(1).alias("_side"), F.col(right_time).cast("double").alias("_t"), *[F.col(c).alias(n) for c, n in zip(right_id, rid, strict=True)])
    remaining = ours.unionByName(theirs, allowMissingColumns=True)
    columns, schema = remaining.columns, remaining.withColumn("_pair", F.lit(True)).schema

    def step(length: float, start: float):
        def run(key, table):
            lo = float(key[-1].as_py()) * length + start
            table = table.select(columns).combine_chunks()
            side = table["_side"].to_numpy()
            codes = np.unique(table["_list"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
            rank = np.zeros(len(side), dtype=np.int64)
            for s, names in ((0, ["_l"]), (1, rid)):
                rows = np.flatnonzero(side == s)
                keys = list(zip(*[table[n].take(pa.array(rows)).to_pylist() for n in names], strict=True))
                number = {k: i for i, k in enumerate(sorted(set(keys)))}
                rank[rows] = [number[k] for k in keys]
            taken, still = _nearest_walk(codes, table["_t"].to_numpy(), side, rank, lo, lo + length, reach)
            firsts, seconds = (pa.array([p[s] for p in taken], pa.int64()) for s in (0, 1))
            a, b = table.take(firsts), table.take(seconds)
            pairs = pa.table({n: (b if n in rid else a)[n] for n in columns}).append_column("_pair", pa.array([True] * len(taken), pa.bool_()))
            rest = table.filter(pa.array(still))
            return pa.concat_tables([pairs, rest.append_column("_pair", pa.array([False] * rest.num_rows, pa.bool_()))])

        return run

    length, found = float(max(4, reaches) * reach), []
    for number in range(1_000_000):
        start = length / 2 if number % 2 else 0.0
        dealt = remaining.withColumn("_b", F.floor((F.col("_t") - start) / length))
        out = cut(dealt.groupBy(*by, "_b").applyInArrow(step(length, start), schema))
        found.append(out.where("_pair").select(*by, F.col("_l").alias(left_id), *[F.col(n).alias(c) for c, n in zip(right_id, rid, strict=True)]))
        remaining = out.where("not _pair").drop("_pair")
        if remaining.isEmpty():
            break
        length *= 1 + number % 2
    return reduce(DataFrame.unionByName, found)


def nearest(points: DataFrame, places: DataFrame, *, by: str, x: str, y: str, place_x: str, place_y: str, place: str, id_col: str) -> DataFrame:
    """Nearest place of the same key for each point, and the distance; a small dimension joined by key, then a minimum."""
    side = places.select(F.col(by).alias("_by"), F.col(place_x).alias("_px"), F.col(place_y).alias("_py"), F.col(place).alias("_place"))
    d = F.hypot(F.col(x) - F.col("_px"), F.col(y) - F.col("_py"))
    joined = points.join(side, F.col(by) == F.col("_by")).withColumn("_d", d)
    return joined.groupBy(id_col).agg(F.min("_d").alias("distance"), F.min_by("_place", F.struct("_d", "_place")).alias("place"))


def fallback_key(rows: DataFrame, dimension: DataFrame, *, exact: str, base: str, dim_exact: str, dim_base: str, value: str) -> DataFrame:
    """Value by the exact key, else the mean of the variants with the base key."""
    by_exact = dimension.groupBy(F.col(dim_exact).alias("_e")).agg(F.avg(value).alias("_ve"))
    by_base = dimension.groupBy(F.col(dim_base).alias("_b")).agg(F.avg(value).alias("_vb"))
    joined = rows.join(by_exact, F.col(exact) == F.col("_e"), "left").join(by_base, F.col(base) == F.col("_b"), "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.coalesce("_ve", "_vb").alias(value))
