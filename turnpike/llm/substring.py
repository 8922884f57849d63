"""Substring dedup by seed and extend over winnowed anchors.

Seeds: of the word k-grams of every window of ``length`` words the one with the smallest hash is its
anchor, the leftmost of equal ones. The choice depends on the window's words alone, so equal windows have
equal anchors at equal places, and only about 2 in 12 places are anchors. Documents are joined on anchor
hashes, which leaves the places that can be part of a repeat at all.

Extension: an occurrence of a shared anchor goes to its anchor's group with the words around it that its
windows reach. There it is extended to the left and to the right as far as occurrences in smaller documents
agree over ``length`` words in all: occurrences are grouped by the anchor with the nearest words on the left and
the rest on the right, for every share of the two sides, and each group knows its smallest document. So a
group's cost is linear in its occurrences, and no pair of documents is ever built. Windows around one anchor
overlap in it, so what an occurrence repeats is one span; spans of neighbouring anchors merge into maximal repeats.

An anchor of very many holders would gather too many occurrences in one task. Its windows are extended before
the exchange instead, as 128-bit hashes that are dealt by themselves; rows that a batch has already decided
bypass their key under a salt, so a hot window sends one row per batch at most. Both ways find the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnpike.llm._memory import released
from turnpike.llm._store import cut
from turnpike.llm._text import WordHashes, rolling_hash

#: Words of an anchor.
SEED_WORDS = 4
#: Salts for rows that are decided before the shuffle.
SALTS = 64
#: Salts for the copies of one document.
COPY_SALTS = 16
#: Holders of an anchor above which its windows are exchanged one by one; it bounds the rows that a group brings to a task.
HOT_HOLDERS = 1_000
#: Rows that are extended at a time.
_CHUNK = 150_000
_ROWS = 250_000
_PORTION = 1_500_000


def _anchors(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of every window of ``length`` words, and the hashes of all k-grams."""
    grams = rolling_hash(hashes, k, 1)
    width = length - k + 1
    places = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return places + np.arange(len(places)), grams


def _windows(hashes: np.ndarray, length: int) -> np.ndarray:
    return rolling_hash(hashes, length, 2)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _chunks(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([_signed(c[at : at + _ROWS]) if c.dtype == np.uint64 else pa.array(c[at : at + _ROWS]) for c in columns], names)


def _in_portions(each: Iterator[tuple], settle) -> Iterator[pa.RecordBatch]:
    """Settle the keys of many documents at once, some ``_PORTION`` keys at a time so that memory stays bounded."""
    found, owners, held = [], [], 0
    for keys, doc in each:
        found.append(keys)
        owners.append(np.full(len(keys), doc, dtype=np.int64))
        held += len(keys)
        if held >= _PORTION:
            yield from settle(found, owners)
            found, owners, held = [], [], 0
    if found:
        yield from settle(found, owners)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys, and for each sorted row whether it is the first with its first keys (the last key breaks ties)."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), dtype=bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[:-1]])
    return order, first


def _seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``(h, doc, state, holders)``, one row per document and anchor. State 0: the batch's only document with this anchor,
    1: the smallest of several, 2: another of several. The first row of an anchor knows its holders in the batch."""

    def settle(found: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(found), np.concatenate(owners)
        order, first = _first_of(h, doc)
        h, doc = h[order], doc[order]
        # Rows of one document under one id and anchor are a single holder.
        same = np.zeros(len(h), dtype=bool)
        same[1:] = ~first[1:] & (doc[1:] == doc[:-1])
        h, doc, first = h[~same], doc[~same], first[~same]
        starts = np.flatnonzero(first)
        holders = np.zeros(len(h), dtype=np.int32)
        holders[starts] = np.diff(np.append(starts, len(h)))
        state = np.where(holders == 1, 0, np.where(first, 1, 2)).astype(np.int8)
        yield from _chunks(["h", "doc", "state", "holders"], h, doc, state, holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = (text.as_py() or b"").split()
                    if doc is not None and len(words) >= length:
                        places, grams = _anchors(memory.of(words), length, k)
                        yield np.unique(grams[places]), doc

        yield from _in_portions(each(), settle)

    return docs.select(F.col("_id"), F.col("_text")).mapInArrow(released(run), "h bigint, doc bigint, state tinyint, holders int")


def _salt(decided):
    return F.when(decided, F.pmod(F.xxhash64("doc"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")


def _shared_seeds(docs: DataFrame, length: int, k: int, hot_holders: int) -> DataFrame:
    """``(doc, seeds, hot_seeds)``: the anchors of each document that another document has as well; hot ones have many holders."""
    rows = _seeds(docs, length, k).withColumn("salt", _salt(F.col("state") == 2))
    held = Window.partitionBy("h", "salt")
    several, holders = F.min("doc").over(held) < F.max("doc").over(held), F.sum("holders").over(held)
    shared = rows.withColumn("several", several).withColumn("all", holders).where((F.col("state") > 0) | F.col("several"))
    shared = cut(shared.select("h", "doc", "salt", ((F.col("salt") == 0) & (F.col("all") > hot_holders)).alias("many")))
    # Rows that their batch decided lie under salts; the hot anchors, which are few, go to all of those.
    hot = shared.where("many").select("h").distinct().select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS))).alias("salt"), F.lit(True).alias("hot"))
    told = shared.join(hot, ["h", "salt"], "left")
    return told.groupBy("doc").agg(F.collect_set(F.when(F.col("hot").isNull(), F.col("h"))).alias("seeds"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot_seeds"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Documents that have shared anchors and are no whole copies: id, text, the anchors, and those that are hot."""
    for batch in batches:
        for doc, text, seeds, hot, copy in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), batch.column(4).to_pylist(), strict=True):
            if seeds.is_valid and not copy:
                yield doc, text.as_py() or b"", *(x.values.to_numpy().view(np.uint64) for x in (seeds, hot))


def _print(text: bytes) -> int:
    """What tells texts of one id apart."""
    return xxhash.xxh32_intdigest(text)


def _mix(value: np.ndarray, more: np.ndarray, seed: int) -> np.ndarray:
    odd = np.uint64(xxhash.xxh64_intdigest(b"extension", seed) | 1)
    with np.errstate(over="ignore"):
        out = (value + more) * odd
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _sides(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the nearest 0, 1, 2, ... words of a side, a row per occurrence."""
    out = np.zeros((len(words), words.shape[1] + 1), dtype=np.uint64)
    for i in range(words.shape[1]):
        out[:, i + 1] = _mix(out[:, i], words[:, i], seed)
    return out


#: Kinds of rows in the exchange of anchors: an occurrence, a window of a hot anchor, one that its batch has decided.
_OCCURRENCE, _WINDOW, _DECIDED = 0, 1, 2


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end, up to ``ends`` in bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _occurrences(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``(h, doc, kind, print, low, high, around, places)``: what a document sends to the groups of its shared anchors.

    An occurrence: ``h`` is the anchor, ``around`` the hashes of the words on the left, nearest first, and on the right;
    ``low`` and ``high`` the fewest and the most words on the left that windows with this anchor have, beyond whose reach
    the words are zero; occurrences with the same words around share a row. A window of a hot anchor: ``h`` and ``around``
    are its hash. A batch sends the smallest document of a window only and the others as decided, under a salt.
    """
    reach = length - k
    names = ["h", "doc", "kind", "print", "low", "high", "around", "places"]

    def rows_of(doc: int, text: bytes, hashes: np.ndarray, places: np.ndarray, grams: np.ndarray, seeds: np.ndarray) -> list[np.ndarray] | None:
        at, first, counts = np.unique(places, return_index=True, return_counts=True)
        held = np.isin(grams[at], seeds)
        at, first, counts = at[held], first[held], counts[held]
        if not len(at):
            return None
        # Windows of one anchor start in a row: at first, first + 1, ...
        high, low = at - first, at - first - counts + 1
        padded = np.concatenate([np.zeros(reach, np.uint64), hashes, np.zeros(reach, np.uint64)])
        step = np.arange(reach)
        left, right = padded[at[:, None] + reach - 1 - step], padded[at[:, None] + reach + k + step]
        left[step >= high[:, None]] = 0
        right[step >= reach - low[:, None]] = 0
        around = np.concatenate([left, right], axis=1)
        h = grams[at]
        one = order = np.arange(len(at))
        ends = one + 1
        if len(np.unique(h)) < len(h):
            # Occurrences of one anchor may have the same words around.
            whole = _mix(_sides(around, 5)[:, -1], h + (low * 64 + high).astype(np.uint64), 6)
            _, one, of = np.unique(whole, return_index=True, return_inverse=True)
            order, ends = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))
        return [h[one], np.full(len(one), doc), np.full(len(one), _print(text), dtype=np.uint32), low[one], high[one], around[one], at[order].astype("<i4"), ends]

    def occurrences(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        parts = list(zip(*held, strict=True))
        h, doc, mark, low, high, around, places = (np.concatenate(p) for p in parts[:7])
        shift = np.cumsum([0] + [len(p) for p in parts[6][:-1]])
        ends = np.concatenate([e + n for e, n in zip(parts[7], shift, strict=True)])
        n, width = len(h), around.shape[1] * 8
        columns = [_signed(h), pa.array(doc), pa.array(np.full(n, _OCCURRENCE, np.int8)), pa.array(mark.view(np.int32)), pa.array(low.astype(np.int8)), pa.array(high.astype(np.int8))]
        return pa.RecordBatch.from_arrays([*columns, _binary(around, np.arange(1, n + 1) * width), _binary(places, ends * 4)], names)

    def windows(found: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both, doc = np.concatenate(found), np.concatenate(owners)
        order, first = _first_of(both[:, 0], both[:, 1], doc)
        both, doc = both[order], doc[order]
        # The rest of a run comes after a smaller document of this portion, or repeats its id.
        starts = np.flatnonzero(first)
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
        for rows, kind in ((first, _WINDOW), (doc > least, _DECIDED)):
            some, of = both[rows], doc[rows]
            for at in range(0, len(of), _ROWS):
                part, mine = some[at : at + _ROWS], of[at : at + _ROWS]
                n, none = len(mine), np.zeros(min(_ROWS, len(of) - at), np.int32)
                key = part[:, 0] if kind == _WINDOW else _mix(mine.astype(np.uint64), np.zeros(1, np.uint64), 7)
                around = _binary(part[:, 1 if kind == _WINDOW else 0], np.arange(1, n + 1) * 8)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(mine), pa.array(np.full(n, kind, np.int8)), pa.array(none), pa.array(none.astype(np.int8)), pa.array(none.astype(np.int8)), around, _binary(none, none)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held, size = WordHashes(), [], 0
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        n_found = 0
        for doc, text, seeds, hot in _texts(batches):
            words = text.split()
            if len(words) < length:
                continue
            hashes = memory.of(words)
            places, grams = _anchors(hashes, length, k)
            rows = rows_of(doc, text, hashes, places, grams, seeds) if len(seeds) else None
            if rows is not None:
                held.append(rows)
                size += len(rows[6])
            at = np.flatnonzero(np.isin(grams[places], hot)) if len(hot) else ()
            if len(at):
                found.append(np.stack([_windows(hashes, length)[at], rolling_hash(hashes, length, 3)[at]], axis=1))
                owners.append(np.full(len(at), doc, dtype=np.int64))
                n_found += len(at)
            if size >= 50_000:
                yield occurrences(held)
                held, size = [], 0
            if n_found >= _PORTION:
                yield from windows(found, owners)
                found, owners, n_found = [], [], 0
        if held:
            yield occurrences(held)
        if found:
            yield from windows(found, owners)

    return texts.mapInArrow(released(run), "h bigint, doc bigint, kind tinyint, print int, low tinyint, high tinyint, around binary, places binary")


def _values(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column that lie end to end, and the ends of its rows."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    values = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return values, (offsets[1:] - offsets[0]) // values.itemsize


def _extended(h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most words on the left, and on the right, over which each occurrence agrees with one in a smaller document,
    ``length`` words in all; -1 where none does. Whole groups of anchors only."""
    reach = around.shape[1] // 2
    seeds = [(_sides(around[:, :reach], s), _sides(around[:, reach:], s + 1), _mix(h, np.zeros(1, np.uint64), s)) for s in (11, 21)]
    left, right = np.full(len(h), -1, dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
    for n in range(reach + 1):
        rows = np.flatnonzero((low <= n) & (n <= high))
        if len(rows) < 2:
            continue
        one, two = (_mix(_mix(sides[rows, n], others[rows, reach - n], 31 + i), anchor[rows], 41 + i) for i, (sides, others, anchor) in enumerate(seeds))
        order, first = _first_of(one, two, doc[rows])
        rows = rows[order]
        starts = np.flatnonzero(first)
        least = np.repeat(doc[rows[starts]], np.diff(np.append(starts, len(rows))))
        again = rows[doc[rows] > least]
        left[again] = n
        right[again] = np.maximum(right[again], reach - n)
    return left, right


def _repeats(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``(doc, spans, repeats)``: for each document the spans ``(print, first, past)`` that its anchors are extended to, and the
    hashes of its windows around hot anchors that start in a smaller document too."""

    def extend(table: pa.Table) -> pa.RecordBatch:
        h, doc, low, high = (table[c].to_numpy() for c in ("h", "doc", "low", "high"))
        around, (at, ends) = _values(table["around"], "<u8")[0], _values(table["places"], "<i4")
        left, right = _extended(h.view(np.uint64), doc, low, high, around.reshape(len(h), -1))
        rows = np.flatnonzero(left >= 0)
        starts = np.concatenate([[0], ends[:-1]])
        counts = (ends - starts)[rows]
        row = np.repeat(rows, counts)
        place = at[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]].astype(np.int64)
        columns = [doc[row], table["print"].to_numpy()[row], (place - left[row]).astype(np.int32), (place + k + right[row]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(row), pa.int64())], ["doc", "print", "first", "past", "w"])

    def told(doc: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(doc), none, none, none, pa.array(w.view(np.int64))], ["doc", "print", "first", "past", "w"])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table["kind"].to_numpy()
        for which in np.unique(kind).tolist():
            some = table.filter(pa.array(kind == which)) if (kind != which).any() else table
            if which == _OCCURRENCE:
                yield extend(some)
                continue
            w, doc, other = some["h"].to_numpy().view(np.uint64), some["doc"].to_numpy(), _values(some["around"], "<u8")[0]
            if which == _DECIDED:
                yield told(doc, other)
                continue
            order, first = _first_of(w, other, doc)
            starts = np.flatnonzero(first)
            least = np.repeat(doc[order[starts]], np.diff(np.append(starts, len(order))))
            again = order[doc[order] > least]
            yield told(doc[again], w[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= _CHUNK:
                table = pa.concat_tables(held)
                h = table["h"].to_numpy()
                # The last group may go on in the next batch.
                done = int(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[-1])
                if done:
                    yield from settle(table.slice(0, done))
                held = [table.slice(done)]
                size = table.num_rows - done
        if held:
            yield from settle(pa.concat_tables(held))

    rows = _occurrences(texts, length, k)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(parts, "h").sortWithinPartitions("h")
    found = grouped.mapInArrow(released(run), "doc bigint, print int, first int, past int, w bigint")
    span = F.when(F.col("w").isNull(), F.struct("print", "first", "past"))
    return found.groupBy("doc").agg(F.collect_list(span).alias("spans"), F.collect_set("w").alias("repeats"))


def _covered(words: list[bytes], spans: np.ndarray, repeats: np.ndarray, memory: WordHashes, length: int) -> np.ndarray:
    """Which words lie in a span ``(first, past)`` or in a repeating window."""
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    if len(repeats):
        at = np.nonzero(np.isin(_windows(memory.of(words), length), repeats))[0]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(
    docs: DataFrame,
    *,
    length: int = 13,
    seed_words: int = SEED_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    with_spans: bool = False,
    hot_holders: int = HOT_HOLDERS,
) -> DataFrame:
    """Remove every word covered by a run of ``length`` words that also starts in a document with a smaller id.

    Returns ``id_col, n_words, n_removed, kept_sha256`` (kept words joined by one space), on demand also
    ``kept_text`` and ``spans array<array<int>>``, the maximal repeats as [first word, past the last]. Anchors of more than
    ``hot_holders`` documents are extended before the exchange, others in it; the result is the same.
    Null text has no words. A row with a null id neither removes nor loses anything. Rows with equal ids never
    remove each other's words. Windows are judged on the input. Other columns are not read; ids are integers.
    Texts are shuffled once, by id; both joins use that exchange. Whole copies of a smaller document are known
    from their SHA-256 and take no part in the search.
    """
    if not 0 < seed_words < length:
        raise ValueError("an anchor has to be shorter than a window")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    digest = docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("d")).where(F.col("d").isNotNull() & F.col("_id").isNotNull())
    first = digest.groupBy("d").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where(F.col("first") < F.col("last"))
    # A group of copies may hold a third of all rows: it meets its first row under several salts.
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPY_SALTS - 1).cast("bigint"))))
    salted = digest.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(COPY_SALTS)).cast("bigint"))
    # An id is a copy if all its rows with a text are.
    copies = salted.join(first, ["d", "salt"], "left").groupBy("_id").agg(F.min(F.coalesce(F.col("first") < F.col("_id"), F.lit(False))).alias("copy"))
    copies = cut(copies.where("copy").select(F.col("_id").alias("copy_id")), base.count())
    whole = base.join(copies, F.col("_id") == F.col("copy_id"), "left")
    seeds = _shared_seeds(whole.where(F.col("copy_id").isNull()), length, seed_words, hot_holders).withColumnRenamed("doc", "seed_id")
    texts = whole.join(seeds, F.col("_id") == F.col("seed_id"), "left").select("_id", "_text", "seeds", "hot_seeds", F.col("copy_id").isNotNull().alias("copy"))
    repeats = _repeats(texts, length, seed_words)
    final = whole.join(repeats, F.col("_id") == F.col("doc"), "left").select("_id", "_text", "spans", "repeats", F.col("copy_id").isNotNull().alias("copy"))
    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text + ["spans"] * with_spans
    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text + ", spans array<array<int>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            counts, removed, digests, texts, runs = [], [], [], [], []
            for text, some, repeats, copy in zip(batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                data = text.as_py() or b""
                words = data.split()
                kept, gone = words, np.zeros(len(words), dtype=bool)
                if len(words) >= length and (copy or some.is_valid):
                    if copy:
                        gone = np.ones(len(words), dtype=bool)
                    else:
                        of, first, past = (c.to_numpy() for c in some.values.flatten())
                        mine = of == np.uint32(_print(data)).view(np.int32)
                        gone = _covered(words, np.stack([first[mine], past[mine]], axis=1), repeats.values.to_numpy().view(np.uint64), memory, length)
                    kept = [word for word, out in zip(words, gone.tolist(), strict=True) if not out]
                joined = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode("utf-8"))
                if with_spans:
                    runs.append(np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).reshape(-1, 2).tolist())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(texts, pa.string())] * with_text + [pa.array(runs, pa.list_(pa.list_(pa.int32())))] * with_spans
            yield pa.RecordBatch.from_arrays(columns, names)

    return final.mapInArrow(released(run), schema)
