"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

The schedule is a sequence of slots, of equal token counts within a source and as many as its target needs. Slot ``i`` has the point frac(i * golden ratio),
in exact integer arithmetic, and belongs to the source in whose share of the cumulative weights the point
falls, so every prefix of the schedule is close to the targets. The slots of a source are ranked, and slot
``r`` takes the ``r``-th block of the source's shuffled token stream, starting over when it ends. Blocks of a
small source are smaller than the others', and its share of the slots is larger by as much. Words are counted
once and kept in the shared checkpoint folder.

Ranks and offsets are prefix sums in two levels (within a bucket, then over buckets), so that a source with
a third of all rows spreads over as many tasks as there are buckets. No text is moved to plan a mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.llm._store import cut

#: Words of a block of a large source, whatever the corpus: slots grow with the words of the mix.
BLOCK = 4096
#: Slots that the target of a smaller source comes in: its blocks are smaller, down to a word.
PARTS = 1024
#: Passes over a source that a mix may take.
PASSES = 2
#: frac(i * golden ratio) is (i * STEP mod CYCLE) / CYCLE; STEP is the odd number next to CYCLE / 1.618...
CYCLE = 1 << 31
STEP = 1327217885
_CHUNK = 16_384
_CELLS = 1024

#: Counts the words of a text, none for null.
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: float = PASSES) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``: ``share`` of all sizes, split by weights that repeat over
    the sources in order of code points (null last).

    No target exceeds ``passes`` times its source; the excess goes to the others by weight. Saturated sources are a
    prefix in the order of size per weight, and past it the level only falls, so running sums find the final level.
    Empty sources get zero.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    frame = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    frame = frame.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    frame = frame.withColumn("level", left / F.sum("weight").over(from_here))
    final = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    target = F.when(final.isNull() | (F.col("ratio") <= final), F.col("cap")).otherwise(F.col("weight") * final)
    return frame.withColumn("target", target).select("source", "source_size", "target")



def _streams(docs: DataFrame, buckets: int) -> DataFrame:
    """``(source, doc_id, size, copy, start)``: each source's documents shuffled and laid end to end.

    The shuffle is the order of MD5 over the id; its first digits give the bucket. ``copy`` tells rows apart that are alike.
    """
    frame = docs.withColumn("shuffle", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-mix"))))
    frame = frame.withColumn("bucket", F.floor(F.conv(F.substring("shuffle", 1, 4), 16, 10).cast("int") * buckets / 65536))
    sums = frame.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size")
    running = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frame = frame.withColumn("within", running).withColumn("copy", F.row_number().over(inside))
    joined = frame.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("source", "doc_id", "size", "bucket", "copy", (F.col("base") + F.col("within")).alias("start"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """``shares(source, low, high)``, ranges of [0, CYCLE) -> ``(slot, source, rank)``.

    Points find their source by a grid of cells and the exact range, an equi-join in either case.
    """
    points = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.pmod(F.col("id"), F.lit(CYCLE)) * F.lit(STEP) % F.lit(CYCLE)).alias("point"))
    cell = CYCLE // _CELLS
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    cells = shares.where(F.col("high") > F.col("low")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    owned = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    counts = owned.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = owned.withColumn("within", inside)
    joined = ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return joined.select("slot", "source", (F.col("base") + F.col("within")).cast("long").alias("rank"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    block: int = BLOCK,
    buckets: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of every document the mix takes: ``doc_id, source, size, source_size, target, taken, copy``.

    ``taken`` counts repeats and is at most twice ``size``. Null texts and texts without words have size 0 and
    give nothing; a null source is a source of its own, the last in order; null ids take part. Repeated rows are
    documents of their own. With no words at all every target is 0. The result is a function of the rows alone.
    """
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    sizes = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    every = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # Whole words from here on: sums are exact in any order, so reruns agree.
    shares = sizes.withColumn("goal", F.round("target").cast("long"))
    own = F.ceil(F.col("goal") / F.lit(PARTS))
    shares = shares.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), own)).cast("long"))
    # Slots are whole numbers, so their sums and the ranges of points come out alike in any order.
    shares = shares.withColumn("own", F.ceil(F.col("goal") / F.col("block")).cast("long"))
    shares = shares.withColumn("slots", F.sum("own").over(every)).withColumn("up_to", F.sum("own").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    shares = shares.withColumn("high", F.when(F.col("slots") > 0, F.floor(F.col("up_to") / F.col("slots") * F.lit(CYCLE))).otherwise(0).cast("long"))
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(in_order), F.lit(0)))
    shares = shares.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # One row per source from here on, computed once; the number of slots decides how many points are laid.
    shares = cut(shares)
    most = shares.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("n")).first()["n"]

    # Slots -> how often each block of a source is taken.
    slot_rows = schedule(shares.select("source", "low", "high", "slots", "blocks"), most)
    info = shares.select(F.col("source").alias("s"), "slots", "blocks")
    uses = slot_rows.join(info, F.col("source").eqNullSafe(F.col("s"))).where((F.col("slot") < F.col("slots")) & (F.col("rank") < PASSES * F.col("blocks")))
    uses = uses.groupBy("source", (F.col("rank") % F.col("blocks")).alias("number")).agg(F.count(F.lit(1)).alias("times"))

    # Documents -> pieces of blocks.
    own = shares.select(F.col("source").alias("s"), "source_size", "target", "block")
    placed = _streams(base, buckets).join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / F.col("block"))
    pieces = placed.withColumn("number", F.explode(F.sequence(first, last)))
    length = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("number") * F.col("block"))
    pieces = pieces.withColumn("length", length)
    used = uses.select(F.col("source").alias("s"), F.col("number").alias("k"), "times")
    joined = pieces.join(used, F.col("source").eqNullSafe(F.col("s")) & (F.col("number") == F.col("k")), "left")
    return joined.groupBy("source", "bucket", "copy", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("length") * F.col("times")), F.lit(0)).cast("long").alias("taken")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copy"
    )


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for every time that a document is taken.

    A document taken whole keeps its text; the one in which a source's last block ends gives the words up to
    there, joined by spaces, as a row of its own. Rows of which nothing is taken go. Repeated ids share what the
    mix takes of them.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = plan.groupBy("doc_id", "source").agg(F.sum("taken").alias("__tp_all"), F.sum("size").alias("__tp_size")).where(F.col("__tp_all") > 0)
    plan = plan.select(F.col("doc_id").alias("__tp_id"), F.col("source").alias("__tp_source"), "__tp_all", "__tp_size")
    same = docs[id_col].eqNullSafe(plan["__tp_id"]) & docs[source_col].cast("string").eqNullSafe(plan["__tp_source"])
    joined = docs.join(plan, same).withColumn("__tp_words", n_words(docs[text_col])).where(F.col("__tp_words") > 0)
    # A repeated id takes in proportion to its words.
    part = F.floor(F.col("__tp_all") * F.col("__tp_words") / F.col("__tp_size")).cast("long")
    whole, rest = F.floor(part / F.col("__tp_words")).cast("int"), (part % F.col("__tp_words")).cast("int")
    counts = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = joined.withColumn("__tp_cut", F.explode(counts))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORDS), F.lit(0))
    text = F.when(F.col("__tp_cut") > 0, F.array_join(F.slice(words, 1, F.col("__tp_cut")), " ")).otherwise(F.col(text_col))
    return rows.withColumn("__tp_text", text).select(*[F.col("__tp_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
