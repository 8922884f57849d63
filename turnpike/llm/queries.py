"""The registered queries of this subpackage: thin calls of its operators on whole tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnpike.llm import byte_bpe, line_dedup, mixture, quality_gam, quality_rules, simhash, substring, toxicity, url_filter, vector_dedup

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


#: White space that is not part of a word, as DuckDB text.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: (verdict, host, path): fixed values of the query.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_BOUNDED = "regexp_matches(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({})([^a-z0-9]|$)')"
_RULE_ROWS = ", ".join(str(rule) for rule in URL_RULES)

OP5 = f"""
with rest as (
    select page_id, url, case when url is null or position('://' in url) = 0 then '' else
           regexp_extract(substr(url, position('://' in url) + 3), '^[^?#]*') end as rest
    from pages
),
parts as (
    select page_id, url, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           case when position('/' in rest) > 0 then substr(rest, position('/' in rest)) else '' end as path
    from rest
),
rules(verdict, host, path) as (values {_RULE_ROWS}),
best as (
    select p.page_id, p.url, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
           arg_max(r.verdict, length(r.host || r.path)) as verdict
    from parts p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    group by all
)
select page_id, host, path, rule,
       coalesce(verdict, case when {_BOUNDED.format("|".join(url_filter.STRICT))}
           or (({" + ".join(f"{_BOUNDED.format(t)}::int * {w}" for t, w in url_filter.SOFT.items())}) >= {url_filter.SOFT_LIMIT}
               and ({" + ".join(f"{_BOUNDED.format(t)}::int" for t in url_filter.SOFT)}) >= {url_filter.SOFT_LEAST})
           then 'block' else 'allow' end) as verdict
from best
"""

OP6 = f"""
with docs as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
           md5(coalesce(doc_id::varchar, 'null') || '-mix') as shuffle
    from documents
),
sized as (
    select source, sum(size)::bigint as source_size,
           [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint] as weight
    from docs group by source
),
capped as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from sized),
leveled as (
    select *, (sum(source_size) over () * 1.5::double
               - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level
    from capped
),
final as (select max(case when ratio > level then level end) as level from leveled),
goals as (
    select source, source_size, target, round(target)::bigint as goal
    from (select l.source, l.source_size, case when f.level is null or l.ratio <= f.level then l.cap else l.weight * f.level end as target
          from leveled l, final f)
),
blocks as (select *, greatest(1, least({mixture.BLOCK}, ceil(goal / {mixture.PARTS}.0::double)))::bigint as block from goals),
counted as (select *, ceil(goal::double / block)::bigint as own from blocks),
running as (
    select *, (sum(own) over (order by source is null, source rows unbounded preceding))::bigint as up_to, (sum(own) over ())::bigint as slots from counted
),
shares as (select *, case when slots > 0 then floor(up_to::double / slots * {mixture.CYCLE})::bigint else 0 end as high from running),
ranges as (
    select *, coalesce(lag(high) over (order by source is null, source), 0) as low, ceil(source_size::double / block)::bigint as blocks
    from shares
),
points as (select unnest(range((select coalesce(max(slots), 0) from ranges))) as i),
slots as (select i, (i % {mixture.CYCLE}) * {mixture.STEP} % {mixture.CYCLE} as point from points),
owned as (
    select r.source, s.i, r.slots, r.blocks, row_number() over (partition by r.source order by s.i) - 1 as rank
    from slots s join ranges r on s.point >= r.low and s.point < r.high
),
uses as (
    select source, rank % blocks as number, count(*) as times
    from owned where i < slots and rank < {mixture.PASSES} * blocks group by all
),
placed as (
    select d.doc_id, d.source, d.size, r.source_size, r.target, r.block,
           coalesce(sum(d.size) over (partition by d.source order by d.shuffle, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start,
           row_number() over (partition by d.source order by d.shuffle, d.doc_id, d.size) as place
    from docs d join ranges r on d.source is not distinct from r.source
),
pieces as (select *, unnest(range(start // block, (start + greatest(size, 1) - 1) // block + 1)) as number from placed)
select p.doc_id, p.size, p.source_size, p.target,
       coalesce(sum((least(p.start + p.size, (p.number + 1) * p.block) - greatest(p.start, p.number * p.block)) * u.times), 0)::bigint as taken
from pieces p left join uses u on p.source is not distinct from u.source and p.number = u.number
group by p.source, p.place, p.doc_id, p.size, p.source_size, p.target
"""

OP8 = f"""
with lines as (
    select doc_id, source, trim(line, {_SPACE}) as bare
    from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents)
),
spread as (select bare, min(doc_id) as first_id from lines where bare <> '' group by bare having count(distinct source) >= {line_dedup.MIN_SITES}),
split as (
    select d.doc_id, p.i as i, string_split(d.text, chr(10))[p.i] as line
    from documents d, lateral (select unnest(range(1, len(string_split(d.text, chr(10))) + 1)) as i) p
),
kept as (
    select s.doc_id, count(*) as n_lines, count(x.bare) as n_removed,
           string_agg(s.line, chr(10) order by s.i) filter (where x.bare is null) as text
    from split s left join spread x on trim(s.line, {_SPACE}) = x.bare and x.first_id <> s.doc_id
    group by s.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, _table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return toxicity.score(docs, lexicon).select("doc_id", _held_out(5, 0), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def _held_out(modulus: int, rest: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest).alias("held_out")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, _table(spark, sf_dir, "labels"), modulus=4, held_out=2)
    return quality_gam.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and a digest of the text that is left."""
    docs = _table(spark, sf_dir, "documents").withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    return line_dedup.remove_spread_lines(docs).select(
        "doc_id", "n_lines", F.col("_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_vector_dedup": op3_vector_dedup,
        "op4_quality_gam": op4_quality_gam,
        "op5_url_filter": op5_url_filter,
        "op6_mixture": op6_mixture,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash": op9_simhash,
        "op10_substring": op10_substring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": OP5,
        "op6_mixture": OP6,
        "op8_line_dedup": OP8,
    }
