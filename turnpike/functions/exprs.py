"""Column expressions with exact null, rounding and closure rules; the semantic traps of the library live here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_rows() -> Column:
    """Number of rows: an aggregate."""
    return F.count(F.lit(1))


def secs_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole seconds between two microsecond clocks, truncated towards zero."""
    return ((col(later) - col(earlier)) / MICROS).cast("bigint")


def clip(x: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounded ``x`` that keeps null (``greatest`` and ``least`` would skip it); a null bound doesn't bind."""
    x = col(x)
    out = x
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(x.isNotNull(), out)


def distinct_with_null(x: Column | str) -> Column:
    """Distinct values, null being one: an aggregate."""
    return F.count_distinct(col(x)) + F.coalesce(F.max(col(x).isNull().cast("int")), F.lit(0))


def extract_or(x: Column | str, pattern: str, default: str) -> Column:
    """First group of the pattern, or the default where nothing matches."""
    return F.coalesce(F.nullif(F.regexp_extract(col(x), pattern, 1), F.lit("")), F.lit(default))


def iso_weekday(ts: Column | str) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(col(ts)) + 1


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den where den is positive, else null."""
    return F.when(col(den) > 0, col(num) / col(den))


def nan_to_null(x: Column | str) -> Column:
    """NaN as unknown; other values stay."""
    return F.when(~F.isnan(col(x)), col(x))


def null_safe(predicate: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def mean_of(*xs: Column | str) -> Column:
    """Horizontal mean of the non-nulls."""
    cs = [col(x) for x in xs]
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0].cast("double"), F.lit(0.0)))
    return F.when(n > 0, total / n)


def bands(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open band [edge, next edge) that holds ``x``; one label more than edges; null stays null."""
    x = col(x)
    out = F.when(x < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(x < edge, F.lit(label))
    return F.when(x.isNotNull(), out.otherwise(F.lit(labels[-1])))


# Words before a stand's name, letters that tell variants of a stand apart, metres of a degree.
STAND_WORDS = "GATE|STAND|RAMP|PARKING|APRON|POS"
VARIANT_LETTERS = "LRABC"
METRES_EAST, METRES_NORTH = 111_320.0, 110_540.0


def stand_key(x: Column | str) -> Column:
    """Stand names in one spelling: upper case, no ``-(X)`` at the end, no leading word, no separators, no leading zeros of numbers."""
    bare = F.regexp_replace(F.upper(col(x).cast("string")), r"-\([A-Z]\)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"^({STAND_WORDS})\s*", ""), r"[\s_\-]", "")
    return F.regexp_replace(bare, r"(^|[A-Z])0+(\d)", "$1$2")


def variant_base(x: Column | str) -> Column:
    """A stand key without the letter of a variant after its number."""
    return F.regexp_replace(col(x), rf"(\d)[{VARIANT_LETTERS}]$", "$1")


def planar_metres(lat: Column | str, lon: Column | str, lat0: Column | str, lon0: Column | str) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at (lat0, lon0)."""
    east = (col(lon) - col(lon0)) * F.cos(F.radians(col(lat0))) * METRES_EAST
    return east, (col(lat) - col(lat0)) * METRES_NORTH


def equal_count_bin(position: Column, total: Column, bins: int) -> Column:
    """Bin of a row by its 0-based position among ``total`` rows; bins differ by one row at most."""
    return F.floor(position * bins / total).cast("int")


def hash_draw(*parts: Column, modulus: Column | int) -> Column:
    """A reproducible draw in [0, modulus) from the digest of the parts."""
    digest = F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % modulus
