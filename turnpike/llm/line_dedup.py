"""Removal of lines that spread over many sites, by HyperLogLog sketches per line hash.

The spread of a line is its number of distinct sites. One aggregation builds a HyperLogLog sketch per line
hash out of the raw occurrences; sketches of a line merge on the map side, so a line of all documents brings
one row per task. Estimates well above the threshold are boilerplate, those well below aren't, and lines near
the threshold get exact distinct counts over (line, site) pairs. Those few lines then meet their occurrences:
under a broadcast while their checked number allows it, else in a salted join, so that no task holds a hot
line. Texts are shuffled once, for the rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnpike.llm._store import cut

#: Sites on which a line has to occur to be boilerplate.
MIN_SITES = 8
#: Base-2 logarithm of the registers of a sketch (relative error about 1.04 / sqrt(2**k), 2.3 % here).
SKETCH_K = 11
#: Estimates between these multiples of the threshold are counted exactly; ten standard errors and more.
NEAR = (0.75, 1.25)
#: Lines (some 50 bytes each) up to which a table of lines is broadcast.
BROADCAST_LINES = 200_000
#: Parts that the occurrences of one line are dealt into beyond that.
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """A 128-bit key of a line; null for a line without a word."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.unhex(F.md5(bare)))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``(id, print, at, line, site)``, a row per line with a word; ``print`` tells texts of one id apart.

    Hashes of sites stand for the sites: two differ unless all their hashes agree.
    """
    site = F.xxhash64(F.col(site_col).cast("string"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.when(F.col(site_col).isNotNull(), site).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("at", "l")
    )
    return rows.select("id", "print", "at", _key(F.col("l")).alias("line"), "site").where(F.col("line").isNotNull())


def _meet(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` joined with the columns of a materialised table of distinct ``lines``."""
    if lines.count() <= BROADCAST_LINES:
        return rows.join(F.broadcast(lines), "line")
    copies = lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "print", "at"), F.lit(SALTS)).cast("bigint")).join(copies, ["line", "salt"]).drop("salt")


def _sketched(rows: DataFrame, min_sites: int) -> DataFrame:
    """``(line, estimate, first_id)`` of the lines whose estimated spread comes near the threshold or above it."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_K))).alias("estimate")
    found = rows.where(F.col("site").isNotNull()).groupBy("line").agg(sketch, F.min("id").alias("first_id"))
    return cut(found.where(F.col("estimate") >= NEAR[0] * min_sites))


def _verdicts(rows: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the candidate lines, materialised, and ``(line, first_id, sites)`` of those that are boilerplate."""
    found = _occurrences(rows, id_col, text_col, site_col)
    candidates = _sketched(found, min_sites)
    is_near = F.col("estimate") <= NEAR[1] * min_sites
    held = cut(_meet(found, candidates.select("line", is_near.alias("near"))))
    pairs = held.where(F.col("near") & F.col("site").isNotNull()).select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    near = candidates.where(is_near).join(exact, "line").select("line", "first_id", "sites")
    clear = candidates.where(~is_near).select("line", "first_id", F.col("estimate").cast("long").alias("sites"))
    return held, cut(clear.unionByName(near))


def spread_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``(line, first_id, sites)``: keys of lines on at least ``min_sites`` distinct sites, and the smallest id that has each.

    ``sites`` is exact for lines near the threshold, else the estimate rounded. A null site is no site.
    """
    return _verdicts(docs, min_sites, id_col, text_col, site_col)[1]


def remove_spread_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, with boilerplate lines taken out of the text, plus ``_lines_removed long``.

    A line is compared without the white space around it. Boilerplate is a line on ``min_sites`` or more
    distinct sites; its copies go, but the document with the smallest id keeps it, so that no content is lost.
    Null texts stay null, wordless lines stay, rows with a null id keep their lines (they have no place in the
    order) though they count for the spread, rows with a null site lose boilerplate but don't count. Repeated
    rows are treated alike, and rows of one id with unlike texts each by its own lines. A document of
    boilerplate only becomes an empty text; no row is dropped.
    """
    held, spread = _verdicts(docs, min_sites, id_col, text_col, site_col)
    gone = _meet(held.where(F.col("id").isNotNull()), spread.select("line", "first_id")).where(~F.col("id").eqNullSafe(F.col("first_id")))
    # The places of the lines that go, in order; repeated rows name each place once.
    gone = gone.groupBy(F.col("id").alias("__tp_id"), F.col("print").alias("__tp_print")).agg(F.array_sort(F.collect_set("at")).alias("__tp_gone"))
    joined = docs.join(gone, (docs[id_col].cast("long") == gone["__tp_id"]) & (F.xxhash64(docs[text_col]) == gone["__tp_print"]), "left")
    lines, touched = _lines(docs[text_col]), F.col("__tp_gone").isNotNull()
    # Between two places that go lies one slice of lines that stay, which takes linear time however many go.
    edges = F.concat(F.array(F.lit(-1)), F.col("__tp_gone"), F.array(F.size("__tp_lines")))
    slices = F.transform(F.sequence(F.lit(1), F.size("__tp_gone") + 1), lambda j: F.slice("__tp_lines", F.get("__tp_edges", j - 1) + 2, F.get("__tp_edges", j) - F.get("__tp_edges", j - 1) - 1))
    rebuilt = F.array_join(F.flatten(slices), "\n")
    whole = joined.withColumn("__tp_lines", F.when(touched, lines)).withColumn("__tp_edges", F.when(touched, edges))
    return whole.select(
        *[F.when(touched, rebuilt).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.when(touched, F.size("__tp_gone")).otherwise(0).cast("long").alias("_lines_removed"),
    )
