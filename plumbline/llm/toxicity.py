"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits; each is inside (T) or outside (O) a
toxic span.  Emissions are a log-odds per token, summed over hashed features
of the word (itself, its beginnings and endings, its shape) and of its two
neighbours; a 2 x 2 matrix holds the transitions.  Training maximises the
conditional likelihood of labelled tokens, with expectations from
forward-backward.  Scoring takes forward-backward marginals over the whole
text: their logits at the peak and their sum, through a small logistic
calibration, make the document score, and tokens whose marginal passes the
threshold give the offending offsets.

Where only documents are labelled, :func:`label_tokens` makes token labels: in
a toxic document a token is toxic if it, or a beginning of it, occurs in far
more toxic than clean training documents.

The forward-backward runs over a whole batch of texts at once: positions are
laid out in blocks of equal length, the two-state recursions of all blocks
advance together as products of 2 x 2 matrices, and a reset stands at each
text's start.  The result is exact for any length of text.

Fitting uses a bounded sample of labelled documents: ``max_docs`` of each
class, none of over ``max_text_chars`` characters, ``max_chars`` of text in
all, taken in hash order.  Scoring covers every document, of any length, in
one pass without a shuffle.

Defined cases: a null or empty text, or one without letters, has no tokens and
gets the calibration's value for an empty text.  Labels of a doc_id that
contradict each other count as toxic.  Null labels or ids are ignored.  With
no labelled document of either class every score is the share of toxic labels
(0 if there is none).  Repeated rows score alike.  Ids may be of any type.
Extra columns pass through the stage whatever their names; in :func:`tag` a
result column takes the place of a caller's of the same name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Held, free_worker, small_batches, table

_tokens = re.compile(r"[^\W_]+").findall
_spans = re.compile(r"[^\W_]+").finditer

BUCKETS = 1 << 17
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 5)
THRESHOLD = 0.3
CACHE_WORDS = 150_000


def word_features(word: str) -> list[int]:
    """Hashed features of a token; the last two are its codes as a left and a right neighbour."""
    w = word.lower()
    names = ["w" + w, *(f"p{n}{w[:n]}" for n in PREFIXES if len(w) > n), *(f"s{n}{w[-n:]}" for n in SUFFIXES if len(w) > n)]
    names.append("x" + ("A" if word.isupper() else "a") + ("9" if any(c.isdigit() for c in w) else "") + str(min(len(w) // 4, 5)))
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in (*names, "l" + w, "r" + w)]


def _blocks(e: np.ndarray, start: np.ndarray, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Odds and starts as (steps, blocks); the rest of the last block is resets."""
    n = len(e)
    width = max(1, min(width, n // 32 or 1))
    steps = -(-n // width)
    odds = np.ones(steps * width)
    odds[:n] = np.exp(np.clip(e, -30, 30))
    first = np.ones(steps * width, bool)
    first[:n] = start
    return odds.reshape(width, steps).T.copy(), first.reshape(width, steps).T.copy()


def marginals(e: np.ndarray, start: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of T per token, and the forward and backward log-ratios.

    ``e``: emission log-odds of T; ``start``: whether a token begins a text;
    ``a``: transition potentials, a[i, j] from state i to j (0 is O).
    """
    n = len(e)
    if n == 0:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    odds, first = _blocks(e, start)
    a00, a01, a10, a11 = a.ravel()
    forward = _scan(odds, first, a00, a01, a10, a11)
    # backward: y[t] is the ratio of what follows t; a text's last token has 1
    last = np.r_[start[1:], True]
    back_odds, back_first = _blocks(np.r_[0.0, e[:0:-1]], last[::-1])
    # same recursion on reversed tokens: the emission of t + 1 enters before the step
    backward = _scan_back(back_odds, back_first, a00, a01, a10, a11)
    f = forward.T.reshape(-1)[:n]
    b = backward.T.reshape(-1)[:n][::-1]
    return f + b, f, b


def _scan(odds, first, a00, a01, a10, a11):
    """log x[t] with x[t] = odds[t] * (a01 + a11 x[t-1]) / (a00 + a10 x[t-1]), x = odds at resets."""
    steps, width = odds.shape
    # each block as a map of x/1: matrix (p q; r s) acting on (x, 1)
    p, q, r, s = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(steps):
        o, f = odds[t], first[t]
        np_, nq = o * (a11 * p + a01 * r), o * (a11 * q + a01 * s)
        nr, ns = a10 * p + a00 * r, a10 * q + a00 * s
        scale = 1 / (np_ + nq + nr + ns)
        p, q, r, s = (np.where(f, z, v * scale) for v, z in ((np_, 0.0), (nq, o), (nr, 0.0), (ns, 1.0)))
    x = np.empty(width)
    at = 1.0
    for k in range(width):
        x[k] = at
        at = (p[k] * at + q[k]) / (r[k] * at + s[k])
    out = np.empty_like(odds)
    for t in range(steps):
        x = np.where(first[t], odds[t], odds[t] * (a01 + a11 * x) / (a00 + a10 * x))
        out[t] = x
    return np.log(out)


def _scan_back(odds, first, a00, a01, a10, a11):
    """log y[t] with y[t] = (a10 + a11 z) / (a00 + a01 z), z = odds of the token after t times its y; y = 1 at resets."""
    steps, width = odds.shape
    p, q, r, s = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(steps):
        o, f = odds[t], first[t]
        np_, nq = a11 * o * p + a10 * r, a11 * o * q + a10 * s
        nr, ns = a01 * o * p + a00 * r, a01 * o * q + a00 * s
        scale = 1 / (np_ + nq + nr + ns)
        p, q, r, s = (np.where(f, z, v * scale) for v, z in ((np_, 0.0), (nq, 1.0), (nr, 0.0), (ns, 1.0)))
    y = np.empty(width)
    at = 1.0
    for k in range(width):
        y[k] = at
        at = (p[k] * at + q[k]) / (r[k] * at + s[k])
    out = np.empty_like(odds)
    for t in range(steps):
        z = odds[t] * y
        y = np.where(first[t], 1.0, (a10 + a11 * z) / (a00 + a01 * z))
        out[t] = y
    return np.log(out)


class Vocabulary:
    """Token -> row of cached emissions (own, as left neighbour, as right neighbour)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, 3))

    def emissions(self, tokens: list[str], start: np.ndarray) -> np.ndarray:
        ids, w = self.ids, self.weights
        if len(ids) > CACHE_WORDS:
            self.reset()
            ids = self.ids
        new = [t for t in dict.fromkeys(tokens) if t not in ids]
        if new:
            at = len(ids)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i, t in enumerate(new, at):
                ids[t] = i
            features = [word_features(t) for t in new]
            flat = np.fromiter((x for f in features for x in f[:-2]), np.int64)
            sizes = np.fromiter((len(f) - 2 for f in features), np.int64, len(features))
            self.rows[at : at + len(new), 0] = np.add.reduceat(w[flat], np.r_[0, np.cumsum(sizes)[:-1]])
            self.rows[at : at + len(new), 1] = w[[f[-2] for f in features]]
            self.rows[at : at + len(new), 2] = w[[f[-1] for f in features]]
        rows = self.rows[np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))]
        e = rows[:, 0].copy()
        e[1:] += np.where(start[1:], 0, rows[:-1, 1])
        e[:-1] += np.where(start[1:], 0, rows[1:, 2])
        return e


@dataclass
class SpanTagger:
    """A trained field with its calibration."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray  # log potentials
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def logits(self, tokens: list[str], start: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        e = vocabulary.emissions(tokens, start) + self.bias
        return marginals(e, start, np.exp(self.transitions))[0]

    def pooled(self, logit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text: peak logit, log of the summed marginals, log of the length; rows as documents."""
        out = np.zeros((len(counts), 3))
        out[:, 0], out[:, 1] = -12, np.log(1e-4)
        some = np.flatnonzero(counts)
        if len(some):
            at = np.r_[0, np.cumsum(counts)[:-1]][some]
            out[some, 0] = np.clip(np.maximum.reduceat(logit, at), -12, 12)
            out[some, 1] = np.log(1e-4 + np.add.reduceat(1 / (1 + np.exp(-logit)), at))
        out[:, 2] = np.log1p(counts)
        return out

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + pooled @ self.calibration[1:], -40, 40)))


def _laid_out(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All tokens, number of tokens per text, and where texts start."""
    per = [_tokens(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, per), np.int64, len(per))
    tokens = [w for p in per for w in p]
    start = np.zeros(len(tokens), bool)
    at = np.r_[0, np.cumsum(counts)[:-1]][counts > 0]
    start[at] = True
    return tokens, counts, start


def label_tokens(texts: list[str | None], toxic: np.ndarray, least: int = 3, odds: float = 12.0) -> np.ndarray:
    """Token labels from document labels, in the order of :func:`_laid_out`.

    A token of a toxic document is toxic if its word, or one of its beginnings
    of four characters or more, is in at least ``least`` toxic documents and
    in a share of them ``odds`` times that of the clean ones.
    """
    marks = lambda w: {w, *(w[:n] + "*" for n in PREFIXES if n >= 4 and len(w) > n)}
    lower = lambda x: [t.lower() for t in _tokens(x)] if x else []
    toxic = np.asarray(toxic, bool)
    bad: Counter[str] = Counter()
    for text in (t for t, y in zip(texts, toxic, strict=True) if y):
        bad.update({m for w in set(lower(text)) for m in marks(w)})
    bad = Counter({m: c for m, c in bad.items() if c >= least})
    good: Counter[str] = Counter()
    for text in (t for t, y in zip(texts, toxic, strict=True) if not y):
        good.update({m for w in set(lower(text)) for m in marks(w) if m in bad})
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    hot = {m for m, c in bad.items() if c / n_bad >= odds * (good[m] + 1) / n_good}
    return np.fromiter((bool(y) and not hot.isdisjoint(marks(w)) for text, y in zip(texts, toxic, strict=True) for w in lower(text)), bool)


def _summed(size: int, at: np.ndarray, values, block: int = 1 << 18) -> np.ndarray:
    """``np.bincount(at, values, size)``, added up in the same order without copies of the whole; ``values`` takes a slice."""
    out = np.zeros(size)
    for i in range(0, len(at), block):
        part = slice(i, i + block)
        np.add.at(out, at[part], values(part))
    return out


def fit_tokens(texts: list[str | None], labels: np.ndarray, rounds: int = 30, rate: float = 0.3, l2: float = 3e-5) -> SpanTagger:
    """Maximise the conditional log-likelihood of token labels (in text order) by Adam."""
    # ids as texts come: the tokens themselves, some 60 bytes each, are not held
    words: dict[str, int] = {}
    found, sizes = array("i"), []
    for text in texts:
        own = _tokens(text) if text else []
        found.extend([words.setdefault(w, len(words)) for w in own])
        sizes.append(len(own))
    ids, counts = np.frombuffer(found, np.int32), np.array(sizes, np.int64)
    start = np.zeros(len(ids), bool)
    start[np.r_[0, np.cumsum(counts)[:-1]][counts > 0]] = True
    flat, owner, sides = array("i"), array("i"), array("i")
    for i, w in enumerate(words):
        f = word_features(w)
        flat.extend(f[:-2])
        owner.extend([i] * (len(f) - 2))
        sides.extend(f[-2:])
    n_words = len(words)
    del words
    flat, owner = np.frombuffer(flat, np.int32), np.frombuffer(owner, np.int32)
    left, right = np.array(sides, np.int32).reshape(-1, 2).T
    y = labels.astype(float)
    inner = ~start[1:]
    n = len(ids)
    theta = np.zeros(BUCKETS + 1 + 4)
    theta[BUCKETS] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][inner].astype(int), labels[1:][inner].astype(int)), 1)
    for k in range(1, rounds + 1):
        w, bias, log_a = theta[:BUCKETS], theta[BUCKETS], theta[BUCKETS + 1 :].reshape(2, 2)
        own = _summed(n_words, owner, lambda part: w[flat[part]])  # noqa: B023
        e = own[ids] + bias
        e[1:] += np.where(inner, w[left][ids[:-1]], 0)
        e[:-1] += np.where(inner, w[right][ids[1:]], 0)
        a = np.exp(log_a)
        logit, f, b = marginals(e, start, a)
        gap = y - 1 / (1 + np.exp(-logit))
        grad = np.zeros_like(theta)
        by_word = np.bincount(ids, gap, n_words)
        grad[:BUCKETS] = _summed(BUCKETS, flat, lambda part: by_word[owner[part]])  # noqa: B023
        grad[:BUCKETS] += np.bincount(left, np.bincount(ids[:-1], gap[1:] * inner, n_words), BUCKETS)
        grad[:BUCKETS] += np.bincount(right, np.bincount(ids[1:], gap[:-1] * inner, n_words), BUCKETS)
        grad[BUCKETS] = gap.sum()
        # expected pairs of neighbours from x[t], e[t+1] and y[t+1]
        x, z = np.exp(np.clip(f[:-1][inner], -30, 30)), np.exp(np.clip((e + b)[1:][inner], -30, 30))
        total = a[0, 0] + a[0, 1] * z
        total += a[1, 0] * x
        total += a[1, 1] * x * z
        # a state's row at a time: all four at once would be the largest arrays of the fit
        joint = (np.divide(row(), total).sum() for row in (lambda: a[0, 0], lambda: a[0, 1] * z, lambda: a[1, 0] * x, lambda: a[1, 1] * x * z))  # noqa: B023
        grad[BUCKETS + 1 :] = seen.ravel() - np.array(list(joint))
        del x, z, total, logit, f, b
        grad = grad / n * 50 - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return SpanTagger(theta[:BUCKETS].copy(), float(theta[BUCKETS]), theta[BUCKETS + 1 :].reshape(2, 2).copy())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept and weights by damped Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: np.ndarray) -> SpanTagger:
    """A tagger from labelled documents; the calibration comes from texts that the field didn't see."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return SpanTagger(np.zeros(BUCKETS), 0.0, np.zeros((2, 2)), constant=share)
    fold = np.arange(len(texts)) % 2
    pooled = np.zeros((len(texts), 3))
    if min(toxic[fold == 0].sum(), toxic[fold == 1].sum()) > 0:
        for k in (0, 1):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            half = fit_tokens([texts[i] for i in inside], label_tokens([texts[i] for i in inside], toxic[inside]))
            pooled[outside] = _pooled_of(half, [texts[i] for i in outside])
            free_worker()
    model = fit_tokens(texts, label_tokens(texts, toxic))
    if not pooled.any():
        pooled = _pooled_of(model, texts)
    model.calibration = _logistic(pooled, toxic.astype(float))
    return model


def _pooled_of(model: SpanTagger, texts: list[str | None]) -> np.ndarray:
    tokens, counts, start = _laid_out(texts)
    return model.pooled(model.logits(tokens, start, Vocabulary(model.weights)), counts)


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 2000, max_chars: int = 5_000_000, max_text_chars: int = 250_000) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels to fit on: up to ``max_docs`` of each class in hash order, ``max_chars`` characters in all."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    order = F.xxhash64("__id")
    some = known.where("__y = 1").orderBy(order, "__id").limit(max_docs).unionByName(known.where("__y = 0").orderBy(order, "__id").limit(max_docs))
    # at most 2 x max_docs rows of two numbers
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(some), "__id")
    joined = joined.groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    joined = joined.where(F.coalesce(F.length("__t"), F.lit(0)) <= max_text_chars)
    texts: list[str | None] = []
    toxic: list[int] = []
    size = 0
    for _, y, t in joined.orderBy(order, "__id").toLocalIterator():
        size += len(t or "")
        if size > max_chars:
            break
        texts.append(t)
        toxic.append(y)
    return texts, np.array(toxic, int)


def tag(docs: DataFrame, model: SpanTagger, text_col: str = "text", spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``__score`` and, if asked, ``__spans``: [start, end) offsets of toxic tokens with their marginals."""
    held = Held(docs)
    return held.back(_tagged(held.df, held[text_col], model, spans, threshold), "__score", *["__spans"] * spans)


def _tagged(docs: DataFrame, text_col: str, model: SpanTagger, spans: bool, threshold: float = 0.5) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    if spans:
        schema.add("__spans", T._parse_datatype_string("array<struct<start:bigint,end:bigint,p:double>>"))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = np.log(threshold / (1 - threshold))

    def run(batches):
        free_worker()
        field_, vocabulary = shared.value, Vocabulary(shared.value.weights)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores, found = [], []
            group: list[str | None] = []
            size = 0
            for i, t in enumerate(texts):
                group.append(t)
                size += len(t or "")
                if size < 1_000_000 and i + 1 < len(texts):
                    continue
                tokens, counts, start = _laid_out(group)
                logit = field_.logits(tokens, start, vocabulary)
                scores.append(field_.scores(field_.pooled(logit, counts)))
                if spans:
                    ends = np.cumsum(counts)
                    for text, a, b in zip(group, ends - counts, ends, strict=True):
                        hot = np.flatnonzero(logit[a:b] > limit)
                        offsets = [(m.start(), m.end()) for m in _spans(text)] if len(hot) else []
                        found.append([{"start": offsets[j][0], "end": offsets[j][1], "p": float(1 / (1 + np.exp(-logit[a + j])))} for j in hot])
                group, size = [], 0
            arrays = [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, kind)] if spans else arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame) -> SpanTagger:
    model = fit(*sample(docs, labels))
    free_worker()  # here it is the driver's process, which has other work to do
    return model


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tag(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("__spans").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    small_batches(spark)
    model, held = fitted(docs, table(spark, sf_dir, "labels")), Held(docs)
    return held.back(_tagged(held.df, held["text"], model, False).where(F.col("__score") < THRESHOLD))
