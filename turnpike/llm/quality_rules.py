"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs their votes.

Every rule says good, bad or nothing about a document. The latent label is good or bad; each rule has two
unknown accuracies, one per label, and abstaining says nothing. Expectation-maximisation over the counts of
vote patterns of the whole corpus finds the accuracies and the share of good documents. There are at most
3 ** rules patterns, whatever the corpus, so the pattern counts are all that reaches the driver; the
posterior of each pattern goes back by a join with that bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._features import COUNTS, MEASURES, measure
from turnpike.llm._memory import released
from turnpike.llm._store import cut
from turnpike.llm._text import WordHashes


class Rule(NamedTuple):
    """Votes on one measure: bad beyond ``bad``, good within ``good``, else abstains. ``above``: large values are bad."""

    measure: str
    good: float
    bad: float
    above: bool = True

    def votes(self, values: np.ndarray) -> np.ndarray:
        x, good, bad = (values, self.good, self.bad) if self.above else (-values, -self.good, -self.bad)
        return np.where(x >= bad, -1, np.where(x <= good, 1, 0)).astype(np.int8)


#: The default rules.
RULES = (
    Rule("symbols", 0.05, 0.25),
    Rule("alnum", 0.93, 0.88, above=False),
    Rule("exclaims", 0.05, 0.3),
    Rule("upper", 0.15, 0.4),
    Rule("dup_lines", 0.1, 0.3),
    Rule("repeat_words", 0.15, 0.35),
    Rule("repeat_wide", 0.05, 0.25),
    Rule("distinct", 0.6, 0.35, above=False),
)


def patterns(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base counts, and the votes as one base-3 number (digit 0 bad, 1 abstains, 2 good)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    at = [MEASURES.index(rule.measure) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            both = [measure(x.as_py() or b"", memory) for x in batch.column(1)]
            counts = np.array([x[0] for x in both], dtype=np.int64).reshape(-1, len(COUNTS))
            values = np.array([x[1] for x in both], dtype=np.float64).reshape(-1, len(MEASURES))
            number = np.zeros(len(both), dtype=np.int64)
            for rule, i in zip(rules, at, strict=True):
                votes = np.where(counts[:, 0] > 0, rule.votes(values[:, i]), 0)
                number = number * 3 + votes + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T.copy()], pa.array(number)], [id_col, *COUNTS, "pattern"])

    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{c} bigint" for c in COUNTS), "pattern bigint"])
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(released(run), schema)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of good for each pattern (a row of -1, 0, 1), and the accuracies found.

    Counts of two pseudo-votes keep every accuracy inside (0, 1). The start, good votes and bad votes mostly
    right, decides which of the two labels is called good.
    """
    n_rules = votes.shape[1]
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    good_right, bad_right, share = np.full(n_rules, 0.95), np.full(n_rules, 0.4), 0.8
    weight = counts.astype(float)
    total = max(1.0, weight.sum())
    posterior = np.full(len(counts), share)
    for _ in range(rounds):
        good = np.log(share) + up @ np.log(good_right) + down @ np.log1p(-good_right)
        bad = np.log1p(-share) + down @ np.log(bad_right) + up @ np.log1p(-bad_right)
        posterior = 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))
        w, v = weight * posterior, weight * (1 - posterior)
        good_right = np.clip((w @ up + 1.9) / (w @ (up + down) + 2), 0.501, 1 - 1e-6)
        bad_right = np.clip((v @ down + 0.8) / (v @ (up + down) + 2), 1e-3, 1 - 1e-6)
        share = float(np.clip((w.sum() + 1.6) / (total + 2), 1e-6, 1 - 1e-6))
    return posterior, {"good_right": good_right, "bad_right": bad_right, "share": share}


def _digits(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.stack([numbers // 3 ** (n - 1 - i) % 3 - 1 for i in range(n)], axis=1)


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``COUNTS``, ``base_failed``, ``kept``, ``posterior`` for every row.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_percent`` of them repeated; those are not
    kept, the rest are if their posterior reaches ``threshold``. Null and empty texts have no words, no votes,
    and fail. Accuracies come from all texts that pass the base, repeated rows counted each time, so that the rules
    are weighed by the junk that is left; an empty table gives no rows. Other columns are not read. At most 3 ** rules pattern counts are collected.
    """
    rows = cut(patterns(docs, rules, id_col=id_col, text_col=text_col))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    found = rows.where(~failed).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    numbers = np.array([x["pattern"] for x in found], dtype=np.int64)
    posterior, _ = estimate(_digits(numbers, len(rules)), np.array([x["n"] for x in found], dtype=np.int64))
    table = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(numbers, posterior, strict=True)], "__tp_pattern bigint, posterior double")
    joined = rows.join(F.broadcast(table), F.col("pattern") == F.col("__tp_pattern"), "left")
    return joined.select(
        id_col,
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("posterior") >= threshold, F.lit(False))).alias("kept"),
        "posterior",
    )
