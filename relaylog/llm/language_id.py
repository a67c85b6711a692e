"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed subwords (2 to 4 characters with word ends); the language
is read off by a linear softmax, trained by stochastic gradient descent in numpy. As the model is linear after
the average, scoring needs the product of embeddings and weights only: one row of logits per subword bucket.

Confidence is calibrated on a fold of the training rows: one temperature, and a level of confidence under
which a text is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Repeated rows get
equal results, ties go to the first language in sorted order, extra columns are ignored. A table without labelled
rows gives a model without languages, which answers ``und`` and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import WordTable, bounded_sample, code_points, gram_hashes, held_out, keep_rows, map_slices, text_blocks, trainable

LETTER = regex.compile(r"\p{L}")
GRAMS = (2, 3, 4)
UNKNOWN = "und"
# Bounds of a model with very many languages: texts of the sample, numbers in the table.
SAMPLE, CELLS = 100_000, 1 << 24


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket x language: logits of a text that holds this subword alone
    temperature: float
    reject_below: float


def _buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of all words, and the word of each."""
    flat, word = code_points([w.lower() for w in words])
    found = [gram_hashes(flat, n) for n in GRAMS]
    bucket = np.concatenate([(h >> np.uint64(20)).astype(np.int64) % buckets for h, _ in found])
    owner = np.concatenate([word[start] for _, start in found])
    return bucket, owner


def word_rows(words: list[str], table: np.ndarray) -> np.ndarray:
    """For each word the sum of its subwords' logits and, last, their number."""
    width = table.shape[1]
    if not words:
        return np.zeros((0, width + 1))
    bucket, owner = _buckets(words, len(table))
    out = np.empty((len(words), width + 1))
    for j in range(width):
        out[:, j] = np.bincount(owner, table[bucket, j], len(words))
    out[:, width] = np.bincount(owner, minlength=len(words))
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def logits_of(texts: list[str | None], model: LanguageModel, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Logits per text, and which texts have a letter."""
    has_letter = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    split = [t.split() if ok else [] for t, ok in zip(texts, has_letter, strict=True)]
    ends = np.cumsum([len(s) for s in split])
    values = words.look_up([w for s in split for w in s])
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    sums = total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1), has_letter


def train(
    docs: DataFrame, per_language: int = 1000, max_chars: int = 20_000, buckets: int = 1 << 16, width: int = 16,
    epochs: int = 4, rate: float = 0.5, max_loss: float = 0.001, seed: int = 7,
) -> LanguageModel:
    """Fit on about ``per_language`` texts of each language (at most twice as many); of long ones the blocks of ``max_chars``.

    All languages are learned. Where there are so many that the sample would exceed ``SAMPLE`` texts or the table
    ``CELLS`` numbers, each gets fewer texts, and subwords share fewer buckets. Rows with a null language, and held-out
    rows, are never read. One fifth of the sample is the calibration fold.
    """
    rows = docs.filter(trainable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    known = max(1, rows.select("lang").distinct().count())
    per_language = max(1, min(per_language, SAMPLE // known))
    buckets = min(buckets, max(1 << 10, 1 << (CELLS // known).bit_length() - 1))
    sample = text_blocks(bounded_sample(rows, "lang", "doc_id", per_language), "text", max_chars).limit(4 * per_language * known)
    got = [(r.lang, r.text) for r in sample.collect() if LETTER.search(r.text)]
    languages = tuple(sorted({lang for lang, _ in got}))
    if not languages:
        return LanguageModel((), np.zeros((1, 1)), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    got.sort()
    order = rng.permutation(len(got))
    target = np.array([languages.index(got[i][0]) for i in order])
    bags = []
    for i in order:
        bucket, _ = _buckets(got[i][1].split(), buckets)
        index, count = np.unique(bucket, return_counts=True)
        bags.append((index, count / max(1, count.sum())))
    fold = np.arange(len(bags)) % 5 == 0 if len(bags) >= 50 else np.zeros(len(bags), bool)
    embed = rng.normal(0, 0.1, (buckets, width))
    weight = rng.normal(0, 0.1, (width, len(languages)))
    learn = np.flatnonzero(~fold)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            index, share = bags[i]
            mean = share @ embed[index]
            p = _softmax((mean @ weight)[None])[0]
            p[target[i]] -= 1
            back = weight @ p
            weight -= step * np.outer(mean, p)
            # Each subword holds a small share of the average; its own step is scaled up to match.
            embed[index] -= step * np.minimum(1.0, share * 50)[:, None] * back
    table = embed @ weight
    check = np.flatnonzero(fold) if fold.any() else learn
    logits = np.array([bags[i][1] @ table[bags[i][0]] for i in check])
    truth = target[check]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = _softmax(logits / temperature).max(axis=1)
    return LanguageModel(languages, table.astype(np.float32), temperature, float(min(0.5, np.quantile(sure, max_loss))))


def _predictor(model: LanguageModel):
    words = WordTable(lambda new: word_rows(new, model.table))

    def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: unknown) and calibrated confidence."""
        if not model.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        logits, has_letter = logits_of(texts, model, words)
        p = _softmax(logits / model.temperature)
        return np.where(has_letter, p.argmax(axis=1), -1), np.where(has_letter, p.max(axis=1), 0.0)

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model, predict = shared.value, _predictor(shared.value)
        names = np.array([*model.languages, UNKNOWN], object)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            number, score = predict(part.column("text").to_pylist())
            return pa.record_batch([
                part.column("doc_id"), part.column("held_out"), pa.array(names[number], pa.string()), pa.array(score, pa.float64()),
                pa.array((number >= 0) & (score >= model.reject_below)),
            ], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

        return step

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_slices(rows, "text", work, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows, with all their columns, whose language is told with enough confidence."""
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model, predict = shared.value, _predictor(shared.value)

        def keep(texts: list) -> np.ndarray:
            number, score = predict(texts)
            return (number >= 0) & (score >= model.reject_below)

        return keep

    return keep_rows(docs, "text", work)
