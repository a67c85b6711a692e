"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes ``FEATURES`` numbers. Each is cut into bins at quantiles of the sample; shallow boosted trees,
fitted to one feature after the other in a cycle, add up to one lookup table per feature. The pairs of features
that explain most of what is left get two-dimensional tables in the same way. A score is a sum of table entries,
found by one binary search per feature, so scoring is a handful of vectorised additions.

Defined results: null and empty texts have all features 0 and are scored like any other. Repeated rows get equal
results, extra columns are ignored. Without labelled rows of both kinds the score is the share of good rows, or
0.5 when there is none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import bounded_sample, held_out, map_slices, trainable

THRESHOLD = 0.7
FEATURES = (
    "log_words", "mean_word_length", "long_words", "upper_share", "digit_share", "symbol_share", "pipe_share", "end_share",
    "comma_share", "mark_share", "distinct_words", "repeated_neighbours", "distinct_lines", "short_lines", "wide_share",
)


def text_features(text: str | None) -> list[float]:
    """The numbers of one text, of its whole length."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    upper = int(b[65:91].sum())
    letters = upper + int(b[97:123].sum())
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 15).mean()), upper / max(1, letters), b[48:58].sum() / size,
        (b[35:39].sum() + b[42] + b[60] + b[62]) / size, b[124] / n, b[46] / n, b[44] / n, (b[33] + b[63]) / n,
        len(set(words)) / n**0.75, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), (b[128:].sum()) / size,
    ]


@dataclass
class QualityModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    threshold: float = THRESHOLD

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaves(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """A tree over ordered bins, grown best first: the step of each bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = np.arange(a + 1, b)
            m = m[(h[m] - h[a] >= least) & (h[b] - h[m] >= least)]
            if len(m):
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, cycles: int = 60, pair_count: int = 6,
    pair_cycles: int = 30, rate: float = 0.2, leaves: int = 3, ridge: float = 1.0, least: float = 1.0, threshold: float = THRESHOLD,
) -> QualityModel:
    """Cyclic boosting of the lookup tables, then of the best pairs."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return QualityModel(base, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], threshold=threshold)
    count = x.shape[1]
    edges = [_edges(x[:, j], bins) for j in range(count)]
    index = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(count)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    prob = lambda: 1 / (1 + np.exp(-z))
    for _ in range(cycles):
        for j in range(count):
            p = prob()
            size = len(tables[j])
            step = rate * _leaves(np.bincount(index[j], y - p, size), np.bincount(index[j], p * (1 - p), size), leaves, ridge, least)
            tables[j] += step
            z += step[index[j]]
    coarse = [_edges(x[:, j], coarse_bins) for j in range(count)]
    cell = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(count)]
    wide = [len(c) + 1 for c in coarse]
    p = prob()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cell[i] * wide[j] + cell[j], values, wide[i] * wide[j]).reshape(wide[i], wide[j])

    def gain(i: int, j: int) -> float:
        g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
        return float((g**2 / (h + ridge)).sum() - (g.sum(0) ** 2 / (h.sum(0) + ridge)).sum() - (g.sum(1) ** 2 / (h.sum(1) + ridge)).sum())

    ranked = sorted(((gain(i, j), i, j) for i in range(count) for j in range(i + 1, count)), reverse=True)
    pairs = [(i, j) for _, i, j in ranked[:pair_count]]
    pair_tables = [np.zeros((wide[i], wide[j])) for i, j in pairs]
    for _ in range(pair_cycles):
        for k, (i, j) in enumerate(pairs):
            p = prob()
            g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
            # A shallow tree: the better of the two features cuts first, then each part is cut along the other.
            step = np.zeros_like(g)
            cut = _leaves(g.sum(1), h.sum(1), 2, ridge, least)
            for part in np.unique(cut):
                rows = cut == part
                step[rows] = _leaves(g[rows].sum(0), h[rows].sum(0), 2, ridge, least)[None, :]
            step *= rate
            pair_tables[k] += step
            z += step[cell[i], cell[j]]
    return QualityModel(base, edges, tables, pairs, coarse, pair_tables, threshold)


FEATURE_SCHEMA = "doc_id bigint, features array<double>"


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = [text_features(t) for t in part.column("text").to_pylist()]
            return pa.record_batch([part.column("doc_id"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "features"])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, FEATURE_SCHEMA)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, threshold: float = THRESHOLD, **options) -> QualityModel:
    """Fit on about ``per_class`` documents of each label (at most twice as many). Held-out labels are never read;
    of several labels of one document the greatest counts.

    The tables are fitted on a sample with more bad texts than the corpus has; the intercept is moved back to
    the true share afterwards, so that scores are probabilities.
    """
    known = labels.filter(trainable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = bounded_sample(known, "quality", "doc_id", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # The bound is put on the features, which are short, and not on the texts.
    got = features(rows).join(F.broadcast(picked), "doc_id").select("features", "quality").limit(8 * per_class).collect()
    got = sorted((tuple(r.features), r.quality) for r in got)
    x = np.array([f for f, _ in got]).reshape(-1, len(FEATURES))
    y = np.array([q for _, q in got], float)
    model = fit(x, y, threshold=threshold, **options)
    if len(shares) == 2 and 0 < y.sum() < len(y):
        model.intercept += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made: Sequence = [text_features(t) for t in part.column("text").to_pylist()]
            score = model.score(np.array(made, float).reshape(-1, len(FEATURES)))
            return pa.record_batch([
                part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= model.threshold).astype(np.int32)),
            ], ["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_slices(rows, "text", work, "doc_id bigint, held_out boolean, score double, predicted int")
