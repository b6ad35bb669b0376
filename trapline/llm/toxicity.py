"""Toxic spans by a linear-chain conditional random field, and document scores.

Tokens are runs of letters and digits, lower-cased; a token's features are the
hashes of the word and of its first 3 to 6 bytes. Token labels for training come
from labelled documents: a feature marks toxic tokens if it stands in many toxic
documents of the sample and in next to no others (near copies, which have the
same least word hash, count as one document); a token of a toxic document
with a marking feature is a toxic token. The field has two states; it is fitted
by gradient steps on the exact conditional likelihood. Forward-backward gives
every token its marginal, tokens above one half make the spans, and a logistic
model over the two highest marginals and the expected number of toxic tokens
gives the document's score. Chains are runs of ``CHAIN`` tokens of one text.

The fit uses at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other labelled
documents of at most ``MAX_BYTES`` bytes, taken in the order of a hash; scoring
reads every text whole.

Defined cases: a null or wordless text has no spans and the score of no toxic
token; rows with a null label or id are not learned from; repeated labels count
once; without labelled documents of both kinds every score is 0; an empty table
gives no rows. Other columns are kept; columns named ``score`` or ``spans`` are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 800, 2400, 10_000
PREFIXES = (3, 4, 5, 6)
CHAIN = 64
#: a marking feature: groups of toxic documents it needs, and its lift over the others
MARK_DOCS, MARK_LIFT = 4, 30.0
MIN_DOCS = 5
STEPS, RATE, L2 = 40, 0.3, 1e-3


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    features: np.ndarray  # a row for each token


def tokens(raw: np.ndarray, off: np.ndarray) -> Tokens:
    lower = common.LOWER[raw]
    start, end, words = common.word_spans(lower, off, common.LETTERS)
    if not len(start):
        return Tokens(start, end, words, np.zeros((0, 1 + len(PREFIXES)), np.uint64))
    prefix = common.Prefix(common.BYTE_VALUES[lower])
    columns = [prefix.spans(start, end)]
    for n in PREFIXES:  # a prefix differs from the word of the same bytes; short words have none
        columns.append(np.where(end - start > n, prefix.spans(start, np.minimum(start + n, end)) ^ np.uint64(n), 0))
    return Tokens(start, end, words, np.stack(columns, axis=1))


class FeatureIndex:
    """Position of known features; a bitmap turns away nearly all others first."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.known & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, features: np.ndarray) -> np.ndarray:
        """Places of the features, -1 for unknown ones."""
        out = np.full(features.shape, -1, np.int64)
        if not len(self.known):
            return out
        at = np.nonzero(self.maybe[(features & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        wanted = features[at]
        place = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        out[at] = np.where(self.known[place] == wanted, place, -1)
        return out


def chains(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of at most CHAIN tokens; ``words`` are the texts' token offsets."""
    size = np.diff(words)
    count = -(-size // CHAIN)
    ends = np.cumsum(count)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    start = np.repeat(words[:-1], count) + nth * CHAIN
    return start, np.minimum(np.repeat(words[1:], count) - start, CHAIN)


def _logaddexp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, expected moves and log partition of each chain.

    ``emit`` (chains x CHAIN) is the toxic state's score, the other's is 0;
    ``move[s, t]`` is the score of going from state s to t.
    """
    n, steps = emit.shape
    alpha, beta = np.zeros((steps, 2, n)), np.zeros((steps, 2, n))
    alpha[0, 1] = emit[:, 0]
    for t in range(1, steps):
        for s in (0, 1):
            alpha[t, s] = _logaddexp(alpha[t - 1, 0] + move[0, s], alpha[t - 1, 1] + move[1, s])
        alpha[t, 1] += emit[:, t]
    inside = np.arange(steps)[:, None] < length[None, :]
    for t in range(steps - 2, -1, -1):
        to = beta[t + 1, 0], beta[t + 1, 1] + emit[:, t + 1]
        for s in (0, 1):
            beta[t, s] = np.where(inside[t + 1], _logaddexp(move[s, 0] + to[0], move[s, 1] + to[1]), 0.0)
    total = _logaddexp(beta[0, 0], alpha[0, 1] + beta[0, 1])
    marginal = np.where(inside, np.exp(alpha[:, 1] + beta[:, 1] - total), 0.0)
    moves = np.zeros((2, 2))
    for s in (0, 1):
        for t in (0, 1):
            arrive = beta[1:, t] + (emit.T[1:] if t else 0.0)
            moves[s, t] = np.where(inside[1:], np.exp(alpha[:-1, s] + move[s, t] + arrive - total), 0.0).sum()
    return marginal.T, moves, total


@dataclass
class Model:
    index: FeatureIndex
    weights: np.ndarray
    bias: float
    move: np.ndarray
    scale: np.ndarray  # of the document's logistic model
    always: float | None = None

    def emissions(self, place: np.ndarray) -> np.ndarray:
        return self.bias + np.where(place >= 0, self.weights[place], 0.0).sum(axis=1)

    def marginals(self, t: Tokens) -> np.ndarray:
        score = self.emissions(self.index.find(t.features))
        start, length = chains(t.words)
        emit = _blocks(score, start, length)
        marginal = forward_backward(emit, length, self.move)[0]
        return marginal[np.arange(CHAIN)[None, :] < length[:, None]]

    def score(self, summary: np.ndarray) -> np.ndarray:
        if self.always is not None:
            return np.full(len(summary), self.always)
        return 1 / (1 + np.exp(-(summary @ self.scale[1:] + self.scale[0])))


def _blocks(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.minimum(start[:, None] + np.arange(CHAIN)[None, :], max(0, len(values) - 1))
    return np.where(np.arange(CHAIN)[None, :] < length[:, None], values[at] if len(values) else 0.0, 0.0)


def summaries(marginal: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text: the two highest marginals, and the log of the expected number of toxic tokens."""
    out = np.zeros((len(words) - 1, 3))
    full = np.flatnonzero(np.diff(words))
    if not len(full):
        return out
    heads = words[:-1][full]
    row = np.repeat(np.arange(len(full)), np.diff(words)[full])
    top = np.maximum.reduceat(marginal, heads)
    first = np.flatnonzero(marginal == top[row])
    first = first[np.unique(row[first], return_index=True)[1]]
    rest = marginal.copy()
    rest[first] = 0.0
    # marginals below a tenth are background, however long the text
    out[full] = np.stack([top, np.maximum.reduceat(rest, heads), np.log1p(np.add.reduceat(np.where(marginal >= 0.1, marginal, 0.0), heads))], axis=1)
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a light ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge, w = 1e-4 * len(y), np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge
        w -= np.linalg.solve(hess, x.T @ (p - y) + w * ridge)
    return w


def _holders(inverse: np.ndarray, group: np.ndarray, features: int, keep: np.ndarray) -> np.ndarray:
    """In how many groups each feature stands, over the kept tokens."""
    groups = int(group.max(initial=0)) + 1
    pair = np.unique(inverse[keep].astype(np.int64) * groups + group[keep])
    return np.bincount(pair // groups, minlength=features)


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled documents (1: toxic)."""
    toxic = np.array(labels, bool)
    nothing = FeatureIndex(np.zeros(0, np.uint64))
    if toxic.all() or not toxic.any():
        return Model(nothing, np.zeros(1), 0.0, np.zeros((2, 2)), np.zeros(4), 0.0)
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    parts = [tokens(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in common.slices(off)]
    words = np.append(0, np.cumsum(np.concatenate([np.diff(t.words) for t in parts])))
    del raw

    def column_of(k: int) -> np.ndarray:
        return np.concatenate([t.features[:, k] for t in parts])

    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words))
    # groups of documents that each feature stands in, over both kinds
    group = np.full(len(texts), np.uint64(2**64 - 1))
    np.minimum.at(group, doc, column_of(0))
    group = np.unique(group, return_inverse=True)[1]
    groups = [len(np.unique(group[k])) for k in (toxic, ~toxic)]
    target, used = np.zeros(len(doc), bool), []
    for k in range(1 + len(PREFIXES)):  # a feature is of one column
        known, inverse = np.unique(column_of(k), return_inverse=True)
        inverse = inverse.astype(np.int32)
        in_toxic, in_clean = (_holders(inverse, group[doc], len(known), keep) for keep in (toxic[doc], ~toxic[doc]))
        lift = (in_toxic + 0.5) / (groups[0] + 1) / ((in_clean + 0.5) / (groups[1] + 1))
        real = known != 0
        marks = real & (in_toxic >= MARK_DOCS) & (lift >= MARK_LIFT)
        used.append(known[real & (in_toxic + in_clean >= MIN_DOCS) | marks])
        target |= marks[inverse]
    target &= toxic[doc]
    index = FeatureIndex(np.concatenate(used))
    # chains with a toxic token, and about as many others
    start, length = chains(words)
    hot = np.add.reduceat(target, start) > 0 if len(start) else np.zeros(0, bool)
    cold = np.flatnonzero(~hot)
    order = np.argsort(common.mix(cold.astype(np.uint64)))
    pick = np.concatenate([np.flatnonzero(hot), cold[order[: max(256, int(hot.sum()))]]])
    start, length = start[pick], length[pick]
    inside = np.arange(CHAIN)[None, :] < length[:, None]
    at = (start[:, None] + np.arange(CHAIN)[None, :])[inside]
    y = target[at].astype(float)
    features, y_blocks = index.find(np.stack([column_of(k)[at] for k in range(1 + len(PREFIXES))], axis=1)), np.zeros(inside.shape)
    y_blocks[inside] = y
    here = features >= 0
    moved = np.array([[((y_blocks[:, :-1] == s) & (y_blocks[:, 1:] == t) & inside[:, 1:]).sum() for t in (0, 1)] for s in (0, 1)], float)
    model = Model(index, np.zeros(max(1, len(index.known))), -3.0, np.zeros((2, 2)), np.zeros(4))
    first, second = (np.zeros(len(model.weights) + 5) for _ in range(2))
    for step in range(1, STEPS + 1):  # Adam on the conditional likelihood
        score = np.zeros(inside.shape)
        score[inside] = model.emissions(features)
        marginal, moves, _ = forward_backward(score, length, model.move)
        error = marginal[inside] - y
        scale = 1 / max(1.0, y.sum())
        grad = np.concatenate([
            np.bincount(features[here], weights=np.repeat(error[:, None], features.shape[1], axis=1)[here], minlength=len(model.weights)) * scale + L2 * model.weights,
            [error.sum() * scale], ((moves - moved) * scale).ravel(),
        ])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights -= change[:-5]
        model.bias -= change[-5]
        model.move -= change[-4:].reshape(2, 2)
    model.scale = _fit_logistic(np.concatenate([summaries(model.marginals(t), t.words) for t in parts]), toxic)
    del parts, doc, group, target
    common.give_back()
    return model


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample; ``labels`` has ``doc_id`` and ``toxic``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    picked = None
    for label, most in ((1, max_toxic), (0, max_clean)):
        some = known.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    rows = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # max_toxic + max_clean rows
    return [r["text"] for r in rows], [r["_label"] for r in rows]


def _score_slice(model: Model, raw: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
    found = tokens(raw, off)
    marginal = model.marginals(found)
    # neighbouring toxic tokens of one text are one span, in bytes of the text
    doc = np.repeat(np.arange(len(off) - 1), np.diff(found.words))
    hot = np.flatnonzero(marginal > 0.5) if model.always is None else np.zeros(0, np.int64)
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (np.diff(doc[hot]) > 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hot))[: len(head)] - 1
    owner = doc[hot[head]]
    base = off[owner]
    at = np.zeros(len(off), np.int32)
    np.cumsum(np.bincount(owner, minlength=len(off) - 1), out=at[1:])
    values = pa.StructArray.from_arrays(
        [pa.array((found.start[hot[head]] - base).astype(np.int64)), pa.array((found.end[hot[tail]] - base).astype(np.int64))], names=["start", "end"]
    )
    spans = pa.ListArray.from_arrays(pa.array(at), values)
    return {"score": pa.array(model.score(summaries(marginal, found.words))), "spans": spans}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and the offending ``spans`` as byte offsets of the text."""
    return common.add_columns(docs, lambda raw, off: _score_slice(model, raw, off), {"score": "double", "spans": "array<struct<start:long,end:long>>"})
