"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Cyclic boosting visits the features in turn and fits a shallow tree
to the current gradient on that feature alone; the trees of a feature add up to one lookup table over its
bins. Pairs of features with the largest remaining gain get tables of their own by the same boosting. A score
is a sum of table entries: bin numbers by ``searchsorted`` over a batch, then one vectorised addition each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._features import MEASURES, measure
from turnpike.llm._memory import released
from turnpike.llm._text import WordHashes

#: Labelled rows that the model is fitted on at most, the first in the order of a hash of their id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 48, 10
ROUNDS, PAIR_ROUNDS, RATE = 160, 60, 0.12
PAIRS = 6
LEAST_LEAF = 8.0


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins by gain, and how many bins go left; (0, 0): none."""
    G, H, N = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(G):
        return 0.0, 0
    g_all, h_all = g.sum(), h.sum()
    gain = G**2 / (H + 1) + (g_all - G) ** 2 / (h_all - H + 1) - g_all**2 / (h_all + 1)
    gain[(N < LEAST_LEAF) | (n.sum() - N < LEAST_LEAF)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Step of a shallow tree for every bin of a feature."""
    gain, at = _split(g, h, n) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Step for every cell of a table: a cut of one axis, then a cut of the other on either side; and its gain."""
    best, step = 0.0, np.zeros_like(g)
    for turn in (False, True):
        G, H, N = (x.T if turn else x for x in (g, h, n))
        for at in range(1, G.shape[0]):
            out, gain = np.zeros_like(G), 0.0
            for part in (slice(None, at), slice(at, None)):
                a, b, c = G[part].sum(0), H[part].sum(0), N[part].sum(0)
                if c.sum() < LEAST_LEAF:
                    break
                more, cut_at = _split(a, b, c)
                values = np.full(len(a), a.sum() / (b.sum() + 1))
                if cut_at:
                    values[:cut_at], values[cut_at:] = a[:cut_at].sum() / (b[:cut_at].sum() + 1), a[cut_at:].sum() / (b[cut_at:].sum() + 1)
                out[part] = values
                gain += more + a.sum() ** 2 / (b.sum() + 1)
            else:
                if gain > best:
                    best, step = gain, out.T if turn else out
    return step, best - float(g.sum()) ** 2 / (float(h.sum()) + 1)


@dataclass
class Gam:
    """Lookup tables over bins."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit on features and 0/1 labels. Without rows of both labels the model is their smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Gam([], [], base)
    n_features = x.shape[1]
    model = Gam([_edges(x[:, i], BINS) for i in range(n_features)], [_edges(x[:, i], PAIR_BINS) for i in range(n_features)], base)
    bins = [np.searchsorted(model.edges[i], x[:, i], side="right") for i in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    counts = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for i, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[i])
            step = RATE * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), counts[i], 2)
            model.tables[i] += step
            total += step[b]
    pair_bins = [np.searchsorted(model.pair_edges[i], x[:, i], side="right") for i in range(n_features)]

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return pair_bins[i] * shape[1] + pair_bins[j], shape

    def sums(b: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return [np.bincount(b, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y)))]

    gains = sorted(((_pair_tree(*sums(*cells(i, j)))[1], i, j) for i in range(n_features) for j in range(i)), reverse=True)[:PAIRS]
    chosen = [(i, j, *cells(i, j), np.zeros(cells(i, j)[1])) for gain, i, j in gains if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for _, _, b, shape, table in chosen:
            step = RATE * _pair_tree(*sums(b, shape))[0]
            table += step
            total += step.ravel()[b]
    model.pairs = [(i, j, table) for i, j, _, _, table in chosen]
    return model


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            rows = [measure(x.as_py() or b"", memory)[1] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(released(run), f"id {id_type}, x array<double>")


def training_labels(labels: DataFrame, label_col: str, *, id_col: str = "doc_id", modulus: int, held_out: int, most: int) -> DataFrame:
    """``(label_id, y)``: labels outside the held-out rest of crc32(id) by ``modulus``, one per id (the smallest), at most ``most``.

    The bound takes the first in the order of a hash of the id, so it is a sample without regard to the label.
    Null ids and labels are left out.
    """
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (rest != held_out))
    rows = rows.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", modulus: int = 4, held_out: int = 2, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fit on at most ``most`` labelled rows; that many ids are broadcast and that many rows of measures collected."""
    chosen = F.broadcast(training_labels(labels, label_col, id_col=id_col, modulus=modulus, held_out=held_out, most=most))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    known = texts.join(chosen, F.col("doc") == F.col("label_id"))
    measured = _measured(known.select(F.struct(F.col("label_id").alias("i"), F.col("y")).alias("id"), "t"), "id", "t")
    rows = sorted(measured.select("id.i", "id.y", "x").toPandas().itertuples(index=False, name=None), key=lambda r: (r[0], tuple(r[2])))
    x = np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(MEASURES))
    return fit(x, np.array([r[1] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Gam, *, threshold: float = 0.7, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``id_col, score, predicted`` and the ``carry`` columns for every row; a map without shuffle.

    ``predicted`` is 1 if the score reaches ``threshold``. Null and wordless texts have all measures 0 and a score
    like any other. Repeated rows give repeated rows, an empty table none; columns that aren't carried are not read.
    """
    names = list(dict.fromkeys((id_col, *carry)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{score_col}` double, `{predicted_col}` int"
    texts = [F.col(f"`{c}`") for c in names] + [F.col(text_col).cast("binary").alias("__tp_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            x = np.array([measure(t.as_py() or b"", memory)[1] for t in batch.column(len(names))], dtype=np.float64).reshape(-1, len(MEASURES))
            p = model.score(x)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, score_col, predicted_col])

    return docs.select(*texts).mapInArrow(released(run), schema)


def accept(docs: DataFrame, model: Gam, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that the model accepts."""
    judged = score(docs, model, carry=tuple(docs.columns), score_col="__tp_score", predicted_col="__tp_predicted", **how)
    return judged.where("__tp_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
