"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding decomposes compatibility forms (full-width, mathematical, circled letters, ligatures), lower-cases, drops
the marks that go on letters of any script (accents, strokes), maps homoglyphs and digit substitutions to the
letters they stand for, and turns everything else that isn't a letter into a space. Marks that a script needs
(Indic vowels, Arabic and Hebrew points) stay.
Terms are whole words or word beginnings. An exception phrase is a term with the word before or after it
that is known to be harmless; a match inside one doesn't count. The weights of the matches are summed and
normalised by length, and a logistic curve turns both into a score.

The lexicon is learned: document frequencies of words and word beginnings by label are counted by Spark over
a bounded sample of labelled rows, and all terms with strong log-odds are kept.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._memory import released
from turnpike.llm._store import cut
from turnpike.llm.quality_gam import training_labels

#: Labelled rows that the lexicon is learned from at most.
TRAIN_ROWS = 12_000
#: Letters of a word beginning.
PREFIXES = range(4, 9)
#: A term occurs in at least so many toxic documents, with at least this log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 3.0
#: Words that short texts are taken to have at least when the sum is normalised.
LEAST_WORDS = 20

# Look-alike characters and the letters they stand for, as pairs of strings of equal length.
HOMOGLYPHS = (
    ("абвгдеёзіјкмнорстухѕԁԛԝһ", "a6brдeeзijkmhopctyxsdqwh"),
    ("αβεικνορτυχγωζη", "abeikvoptuxywzn"),
    ("ıʟɡɑ", "ilga"),
)
# Digits and signs written for letters.
SUBSTITUTIONS = ("013457@$", "oieastas")
# Blocks of marks that combine with letters of any script, first and last code point.
FREE_MARKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
# First code points of runs of 26 letters that have no compatibility form (circled, squared, flags).
LETTER_RUNS = (0x1F150, 0x1F170, 0x1F1E6)


class _Fold(dict):
    """Code point -> folded character, filled on demand."""

    def __init__(self) -> None:
        super().__init__()
        for one, other in HOMOGLYPHS:
            self.update({ord(a): b if b.isascii() and b.isalpha() else a for a, b in zip(one, other, strict=True)})
        self.update({ord(a): b for a, b in zip(*SUBSTITUTIONS, strict=True)})

    def __missing__(self, point: int) -> str:
        char, run = chr(point), next((r for r in LETTER_RUNS if r <= point < r + 26), None)
        if run is not None:
            out = chr(ord("a") + point - run)
        elif any(first <= point <= last for first, last in FREE_MARKS):
            out = ""
        elif char.isalpha() or unicodedata.category(char) in ("Mn", "Mc"):
            out = char
        else:
            out = "" if point in (0x200B, 0x200C, 0x200D, 0xAD) else " "
        self[point] = out
        return out


_FOLD: dict | None = None


def fold(text: str) -> str:
    """Lower case, homoglyphs, digits and styled letters as letters, accents and zero-width characters dropped, the rest spaces."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _Fold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """Terms (``word`` whole, ``begin*`` a beginning) with weights, exception phrases, and the curve of the score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.5)

    def __post_init__(self) -> None:
        self._trie = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_trie": None}

    def trie(self):
        if self._trie is None:
            self._trie = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                key = " " + (term[:-1] if term.endswith("*") else term + " ")
                self._trie.add_word(key, (weight, len(key)))
            for phrase in self.exceptions:
                key = f" {phrase} "
                self._trie.add_word(key, (0.0, len(key)))
            self._trie.make_automaton()
        return self._trie

    def measure(self, text: str) -> tuple[float, float]:
        """Summed weight of the words that match (the strongest term of each word), and the sum per root of words."""
        if not self.terms:
            return 0.0, 0.0
        folded = " " + " ".join(fold(text).split()) + " "
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (weight, length) in self.trie().iter(folded):
            start = end - length + 1
            if weight:
                hits[start] = max(weight, hits.get(start, 0.0))
            else:
                spared.append((start, end))
        total = sum(_outside(hits, spared)) if spared else sum(hits.values())
        return total, total / np.sqrt(max(LEAST_WORDS, folded.count(" ") - 1))

    def score(self, total: float, dense: float) -> float:
        a, b, c = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(a + b * np.log1p(total) + c * dense, -30, 30))))


def _outside(hits: dict[int, float], spans: list[tuple[int, int]]) -> Iterator[float]:
    """Weights of the hits that start in none of the half-open spans: one sweep over both in order."""
    spans, at_span, reach = sorted(spans), 0, -1
    for at in sorted(hits):
        while at_span < len(spans) and spans[at_span][0] <= at:
            reach = max(reach, spans[at_span][1])
            at_span += 1
        if at >= reach:
            yield hits[at]


def _candidates(text: str) -> tuple[set[str], set[str]]:
    """Words and word beginnings of a text, and its pairs of neighbouring words."""
    words = fold(text).split()
    kinds = set(words)
    terms = {w for w in kinds if len(w) >= 3}
    terms.update(w[:k] + "*" for w in kinds for k in PREFIXES if len(w) > k)
    return terms, set(zip(words, words[1:], strict=False))


def _counted(known: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: documents of either label with the term; combined in each partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())],
                ["term", "toxic", "clean"],
            )
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[y > 0].update(_candidates(text.as_py() or "")[0])
                if len(counts[0]) > 400_000:
                    yield flush()
        yield flush()

    return known.mapInArrow(released(run), "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _exceptions(known: DataFrame, terms: Sequence[str]) -> list[str]:
    """Phrases of a term and a neighbour that occur in clean documents only, in two or more."""
    whole, begins = {t for t in terms if not t.endswith("*")}, {t[:-1] for t in terms if t.endswith("*")}

    def is_term(word: str) -> bool:
        return word in whole or any(word[:k] in begins for k in PREFIXES if len(word) > k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, labels = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = fold(text.as_py() or "").split()
                at = {i for i, w in enumerate(words) if is_term(w)}
                phrases = {" ".join(words[i : i + 2]) for j in at for i in (j - 1, j) if 0 <= i < len(words) - 1}
                found += phrases
                labels += [int(y > 0)] * len(phrases)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int64())], ["phrase", "y"])

    rows = known.mapInArrow(released(run), "phrase string, y bigint").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return sorted(x["phrase"] for x in rows.where("toxic = 0 and n >= 2").collect())


def _prune(rows: list[tuple[str, float, int]]) -> dict[str, float]:
    """Drop terms that a kept, shorter beginning of no less weight already covers."""
    kept: dict[str, float] = {}
    for term, odds, _ in sorted(rows, key=lambda r: (len(r[0].rstrip("*")), not r[0].endswith("*"), r[0])):
        stem = term.rstrip("*")
        if not any(kept.get(stem[:k] + "*", -1.0) >= odds - 0.5 for k in PREFIXES if k < len(stem) or (k == len(stem) and not term.endswith("*"))):
            kept[term] = odds
    return kept


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a little shrinkage, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), x[:, 1]])
    w, shrink = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + shrink + 1e-9 * np.eye(3), design.T @ (y - p) - shrink @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", modulus: int = 5, held_out: int = 0, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn terms, exceptions and curve from at most ``most`` labelled rows.

    That many ids are broadcast. Of these rows' words, those that occur in ``LEAST_DOCS`` toxic ones with the odds
    asked for, their neighbours, and two numbers per row are collected, so what is collected is bounded with the rows.
    Without toxic rows the lexicon is empty and every score is the smoothed share of toxic rows.
    """
    chosen = F.broadcast(training_labels(labels, label_col, id_col=id_col, modulus=modulus, held_out=held_out, most=most))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    known = cut(texts.join(chosen, F.col("doc") == F.col("label_id")).select("y", "t"))
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("toxic")).first()
    n, toxic = sizes["n"], int(sizes["toxic"])
    share = (toxic + 1) / (n + 2)
    if not toxic:
        return Lexicon({}, (), (float(np.log(share / (1 - share))), 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (n - toxic + 1))
    rows = _counted(known).withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    terms = _prune([(x["term"], x["odds"], x["toxic"]) for x in rows.collect()])
    lexicon = Lexicon(terms, tuple(_exceptions(known, list(terms))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [lexicon.measure(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([v[i] for v in values], pa.float64()) for i in range(2)]], ["y", "total", "dense"])

    found = sorted(tuple(r) for r in known.mapInArrow(released(measured), "y double, total double, dense double").collect())
    lexicon.curve = _curve(np.array([r[1:] for r in found]), np.array([r[0] for r in found]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, weight, density`` for every row; a map without shuffle over whole texts.

    Null and empty texts match nothing and get the score of no match. Repeated rows give repeated rows; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [lexicon.measure(t.as_py() or "") for t in batch.column(1)]
            p = np.array([lexicon.score(*v) for v in values], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *[pa.array([v[i] for v in values], pa.float64()) for i in range(2)]],
                [id_col, "score", "predicted", "weight", "density"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), f"`{id_col}` {id_type}, score double, predicted int, weight double, density double")
