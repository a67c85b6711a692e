"""Toxic spans by a linear-chain conditional random field.

Every word of a text is a state, toxic or not. A word's own potential comes from hashed features (the word, its
beginnings and its end), neighbours are tied by a 2 x 2 table of transitions. Forward-backward gives the
marginal of every word; the marginals add up to the score of the document, and words over one half are reported
with their character offsets.

Training has document labels only, so the labelled tokens are made first: in toxic sample documents those words
are toxic that appear in several different contexts there and hardly ever in clean ones. Contexts (neighbouring
words) are counted rather than documents, because copies of one document must not count twice.

Long texts are cut into blocks of ``BLOCK`` words whose 2 x 2 transfer matrices are chained first. That is exact,
and every step is one numpy operation over all blocks of a slice.

Defined results: null and empty texts have no words and get the score of a text without toxic words. Repeated
rows get equal results, extra columns are ignored. Without labelled rows every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import MIX, WordTable, bounded_sample, code_points, gram_hashes, held_out, keep_rows, map_slices, trainable

BLOCK = 256
BUCKETS = 1 << 18
THRESHOLD = 0.3
PRESENT = 0.1
TRIM = ".,;:!?\"'()[]{}#*$%&|<>-_…«»"


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # log-odds by feature bucket
    bias: float
    transitions: np.ndarray  # 2 x 2 potentials, from row to column
    document: np.ndarray  # intercept and weights of the document score
    threshold: float = THRESHOLD


def bare(word: str) -> str:
    return word.strip(TRIM).lower()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, and the word of each: beginnings of 3 to 5 characters, the last 3, the whole."""
    bared = [bare(w) for w in words]
    flat, word = code_points(bared)
    bucket, owner = [], []
    for n in (4, 5, 6):
        h, start = gram_hashes(flat, n)
        first = flat[start] == 10
        bucket.append(h[first] + np.uint64(n))
        owner.append(word[start[first]])
    h, start = gram_hashes(flat, 4)
    last = flat[start + 3] == 10
    bucket.append(h[last] + np.uint64(99))
    owner.append(word[start[last]])
    # The whole word: a sum of its characters, each mixed with its place.
    place = np.arange(len(flat)) - np.flatnonzero(flat == 10)[np.minimum(word, len(words))]
    mixed = (flat + place.astype(np.uint64) * MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    ends = np.flatnonzero(flat == 10)
    whole = np.add.reduceat(mixed[:-1], ends[:-1]) if len(words) else np.zeros(0, np.uint64)
    bucket.append(whole * MIX)
    owner.append(np.arange(len(words)))
    return (np.concatenate(bucket) >> np.uint64(20)).astype(np.int64) % BUCKETS, np.concatenate(owner)


def word_scores(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    if not words:
        return np.zeros(0)
    bucket, owner = word_features(words)
    return np.bincount(owner, weights[bucket], len(words)) + bias


def _layout(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks per text, and the padded place of every word."""
    blocks = -(-lengths // block)
    pad_start = (np.cumsum(blocks) - blocks) * block
    word_start = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) + np.repeat(pad_start - word_start, lengths)
    return blocks, place


@dataclass
class Chain:
    """Marginals of all words, and what the gradient of the transitions needs."""

    marginal: np.ndarray
    pairs: np.ndarray | None = None


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = BLOCK, pairs: bool = False) -> Chain:
    """Exact marginals of state 1 in many chains at once; every chain starts after a word of state 0.

    Messages are kept as ratios of state 1 to state 0, so each step is a fraction of two linear terms.
    """
    (a00, a01), (a10, a11) = transitions
    if not len(scores):
        return Chain(np.zeros(0), np.zeros((2, 2)))
    blocks, place = _layout(lengths, block)
    count = int(blocks.sum())
    potential = np.ones(count * block)
    potential[place] = np.exp(np.clip(scores, -30, 30))
    inside = np.zeros(count * block, bool)
    inside[place] = True
    e = np.ascontiguousarray(potential.reshape(count, block).T)
    v = np.ascontiguousarray(inside.reshape(count, block).T)

    m00, m01, m10, m11 = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for t in range(block):
        n00, n01 = m00 * a00 + m01 * a10, (m00 * a01 + m01 * a11) * e[t]
        n10, n11 = m10 * a00 + m11 * a10, (m10 * a01 + m11 * a11) * e[t]
        scale = 1.0 / (n00 + n01 + n10 + n11)
        if v[t].all():
            m00, m01, m10, m11 = n00 * scale, n01 * scale, n10 * scale, n11 * scale
        else:
            m00, m01 = np.where(v[t], n00 * scale, m00), np.where(v[t], n01 * scale, m01)
            m10, m11 = np.where(v[t], n10 * scale, m10), np.where(v[t], n11 * scale, m11)

    first = np.cumsum(blocks) - blocks
    before, after = np.zeros(count), np.ones(count)
    for j in range(1, int(blocks.max())):
        at = first[blocks > j] + j
        r = before[at - 1]
        before[at] = (m01[at - 1] + r * m11[at - 1]) / (m00[at - 1] + r * m10[at - 1])
    for j in range(int(blocks.max()) - 1, 0, -1):
        at = first[blocks > j] + j
        b = after[at]
        after[at - 1] = (m10[at] + m11[at] * b) / (m00[at] + m01[at] * b)

    forward = np.empty((block, count))
    r = before
    for t in range(block):
        r = (a01 + r * a11) / (a00 + r * a10) * e[t]
        forward[t] = r
    odds = np.empty((block, count))
    expected = np.zeros((2, 2))
    b = after
    for t in range(block - 1, -1, -1):
        odds[t] = forward[t] * b
        eb = e[t] * b
        if pairs:
            r = forward[t - 1] if t else before
            joint = np.stack([np.full(count, a00), a01 * eb, r * a10, r * a11 * eb])
            joint = np.where(v[t], joint / joint.sum(axis=0), 0)
            expected += joint.sum(axis=1).reshape(2, 2)
        b = np.where(v[t], (a10 + a11 * eb) / (a00 + a01 * eb), b)
    flat = odds.T.reshape(-1)[place]
    return Chain(flat / (1 + flat), expected)


def document_features(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, log of 1 + expected number of toxic words, largest marginal. Marginals under PRESENT count as none."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    strong = np.where(marginal >= PRESENT, marginal, 0)
    expected = np.bincount(of, strong, len(lengths))
    largest = np.zeros(len(lengths))
    np.maximum.at(largest, of, strong)
    return np.stack([np.ones(len(lengths)), np.log1p(expected), largest], axis=1)


def toxic_words(tokens: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, least: int = 6, odds: float = 20.0) -> np.ndarray:
    """Which word numbers mark toxic texts: ``least`` different contexts there, and ``odds`` to one against clean ones."""
    padded = np.concatenate([[-1], tokens, [-1]])
    left, right = padded[:-2].copy(), padded[2:].copy()
    ends = np.cumsum(lengths)[lengths > 0]
    left[ends - lengths[lengths > 0]] = -1
    right[ends - 1] = -1
    where = np.repeat(toxic, lengths)
    size = int(tokens.max()) + 1
    seen = []
    for label in (0, 1):
        # The context as one mixed number; words of a text are few, so a clash only lowers a count by one.
        at = where == label
        mixed = (left[at].astype(np.uint64) * MIX) ^ (right[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        both = np.unique(np.stack([tokens[at].astype(np.uint64), mixed >> np.uint64(1)], axis=1), axis=0)
        seen.append(np.bincount(both[:, 0].astype(np.int64), minlength=size))
    share = max(1, seen[1].sum()) / max(1, seen[0].sum())
    return (seen[1] >= least) & (seen[1] >= odds * share * seen[0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def train(
    docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, clean_docs: int = 6000, max_chars: int = 20_000,
    rounds: int = 30, rate: float = 0.5, ridge: float = 1e-4, threshold: float = THRESHOLD,
) -> ToxicityModel:
    """Fit on about so many texts of each label (at most twice as many), of at most ``max_chars``, so that they fit the driver.

    All of them count for the labelling of words, ``2 * toxic_docs`` train the chain. Labels of held-out documents
    are never read; of several labels of one document the greatest counts.
    """
    known = labels.filter(trainable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(known, "toxic", "doc_id", {0: clean_docs, 1: toxic_docs})
    rows = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id")
    got = sorted({(r.text, r.toxic) for r in rows.limit(4 * (toxic_docs + clean_docs)).select("text", "toxic").collect()})
    if len({toxic for _, toxic in got}) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -30.0, np.array([[0.9, 0.1], [0.9, 0.1]]), np.array([-30.0, 0, 0]), threshold)
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(bare(w), len(number)) for w in t.split()], np.int32) for t, _ in got]
    names, toxic = list(number), np.array([y for _, y in got])
    marked = toxic_words(np.concatenate(coded), np.array([len(c) for c in coded]), toxic)
    marked &= np.array([bool(w) for w in names])
    rng = np.random.default_rng(7)
    clean = np.flatnonzero(toxic == 0)
    chosen = np.concatenate([np.flatnonzero(toxic == 1), rng.permutation(clean)[: max(2 * toxic_docs - int(toxic.sum()), toxic_docs)]])
    tokens, toxic = np.concatenate([coded[i] for i in chosen]), toxic[chosen]
    lengths = np.array([len(coded[i]) for i in chosen])
    # Only words of the chosen texts are trained; the features of all others would fill the driver's memory.
    used, tokens = np.unique(tokens, return_inverse=True)
    names, marked = [names[i] for i in used.tolist()], marked[used]
    del coded, got, number, used
    target = (marked[tokens] & np.repeat(toxic == 1, lengths)).astype(float)
    bucket, owner = word_features(names)

    previous = np.concatenate([[0.0], target[:-1]])
    previous[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    observed = np.array([[np.sum((previous == i) & (target == j)) for j in (0, 1)] for i in (0, 1)], float)
    rate_of_labels = np.clip(target.mean(), 1e-6, 0.5)
    # The bias is what an unseen word gets: the rate of toxic words, and it is not learned.
    weights, bias = np.zeros(BUCKETS), float(np.log(rate_of_labels / (1 - rate_of_labels)))
    log_a = np.log(np.array([[0.9, 0.1], [0.6, 0.4]]))
    scale = 1.0 / len(tokens) ** 0.5
    seen_w, seen_a = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        emission = np.bincount(owner, weights[bucket], len(names)) + bias
        chain = forward_backward(emission[tokens], lengths, np.exp(log_a), pairs=True)
        error = target - chain.marginal
        by_word = np.bincount(tokens, error, len(names))
        grad = np.bincount(bucket, by_word[owner], BUCKETS) * scale - ridge * weights
        seen_w += grad**2
        weights += rate * grad / np.sqrt(seen_w)
        grad_a = (observed - chain.pairs) * scale
        seen_a += grad_a**2
        log_a += 0.2 * grad_a / np.sqrt(seen_a)
        log_a -= log_a.max()
    # Feature buckets that no word of the sample has stay 0, so unknown words fall back on the bias.
    emission = np.bincount(owner, weights[bucket], len(names)) + bias
    chain = forward_backward(emission[tokens], lengths, np.exp(log_a))
    x = document_features(chain.marginal, lengths)
    return ToxicityModel(weights.astype(np.float32), bias, np.exp(log_a), _logistic(x, toxic.astype(float)), threshold)


def _scorer(model: ToxicityModel):
    table = WordTable(lambda new: word_scores(new, model.weights, model.bias))

    def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = [(t or "").split() for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        chain = forward_backward(table.look_up([w for s in split for w in s]), lengths, model.transitions)
        z = document_features(chain.marginal, lengths) @ model.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), chain.marginal, lengths

    return score


def spans_of(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of neighbouring words with a marginal over one half, as character offsets and largest marginal."""
    spans: list[dict] = []
    hot = marginal > 0.5
    place = 0
    joined = False
    for word, is_hot, p in zip(text.split(), hot, marginal, strict=True):
        place = text.index(word, place)
        if is_hot and joined:
            spans[-1]["stop"], spans[-1]["p"] = place + len(word), max(spans[-1]["p"], float(p))
        elif is_hot:
            spans.append({"start": place, "stop": place + len(word), "p": float(p)})
        joined = bool(is_hot)
        place += len(word)
    return spans


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row; spans are offsets in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def work():
        model, score = shared.value, _scorer(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text").to_pylist()
            scores, marginal, lengths = score(texts)
            ends = np.cumsum(lengths)
            high = np.flatnonzero(np.add.reduceat(np.append(marginal > 0.5, False), np.minimum(ends - lengths, len(marginal))) * (lengths > 0)) if len(lengths) else []
            spans: list[list] = [[] for _ in texts]
            for i in high:
                spans[i] = spans_of(texts[i], marginal[ends[i] - lengths[i] : ends[i]])
            return pa.record_batch([
                part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()),
                pa.array((scores >= model.threshold).astype(np.int32)), pa.array(spans, span),
            ], ["doc_id", "held_out", "score", "predicted", "spans"])

        return step

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    schema = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:int,stop:int,p:double>>"
    return map_slices(rows, "text", work, schema)


def keep_civil(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model, score = shared.value, _scorer(shared.value)
        return lambda texts: score(texts)[0] < model.threshold

    return keep_rows(docs, "text", work)
