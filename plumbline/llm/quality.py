"""Quality classifier from weak labels.

Overlapping heuristic labellers vote +1 (good), -1 (poor) or 0 (abstain) on
each document.  The votes of all documents are counted by pattern, a table of
at most 3^labellers rows; expectation-maximisation on it estimates, for each
labeller, how often it votes what on good and on poor documents, and the share
of good ones.  The posterior of a pattern is then the soft label of every
document that shows it.  A logistic scorer over hashed features (words, their
shapes, coarse facts of the document) is fitted to the posteriors of a bounded
sample (``max_docs`` different documents in hash order, none over ``max_chars``
characters) and scores every whole text in one pass without a shuffle.

Labellers are SQL expressions, so counting votes stays in the JVM.

Defined cases: null or empty texts have no words; the labeller on length calls
them poor and the scorer uses the document facts alone.  Null ids and repeated
rows are scored like others, and train once.  Ids may be of any type.  An
empty table gives an empty result.  Extra columns pass through; a column
``__quality`` is replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ASCII_WS, Held, table

BUCKETS = 1 << 16
#: Documents scored below this go; the lean is towards keeping.
KEEP_FROM = 0.35
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "with", "der", "die", "das", "und", "von", "zu", "mit", "le", "la", "les", "de", "des", "et", "est", "el", "los", "que", "y", "en", "un")


def _vote(poor: Column, good: Column) -> Column:
    return F.when(poor, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with what the labellers look at, under ``__f_``; each fact is computed once a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.filter(F.split(text, f"[{ASCII_WS}]+"), lambda w: w != "")
    counted = docs.withColumns(
        {
            "__f_words": F.size(words),
            "__f_kinds": F.size(F.array_distinct(words)),
            "__f_chars": F.length(text),
            "__f_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")),
            "__f_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
            "__f_symbols": count(r"[#$%&*|<>{}\[\]\\^~_=+@]"),
            "__f_repeats": count(r"(?<!\S)(\S+)\s(?=\1(?!\S))"),
            "__f_bare": count(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)"),
            "__f_ends": count(r"[.!?,;:](?!\S)"),
            "__f_loud": count(r"[^\p{L}\p{N}\s]{2}(?!\S)"),
            "__f_stops": count(rf"(?<!\S)({'|'.join(STOP_WORDS)})(?!\S)"),
        }
    )
    return counted


def labellers() -> dict[str, Column]:
    """Name -> vote of each heuristic, over the columns of :func:`facts`."""
    f = lambda name: F.col(f"__f_{name}")
    n, enough = f("words"), f("words") >= 20
    per_word = lambda name: f(name) / F.greatest(n, F.lit(1))
    symbols, shouting = f("symbols") / F.greatest(f("chars"), F.lit(1)), f("upper") / F.greatest(f("letters"), F.lit(1))
    repeats, variety, bare, ends, loud, stops, mean = (per_word(x) for x in ("repeats", "kinds", "bare", "ends", "loud", "stops", "letters"))
    return {
        "symbols": _vote(symbols > 0.08, symbols < 0.02),
        "shouting": _vote(shouting > 0.5, shouting < 0.25),
        "repetition": _vote(repeats > 0.15, enough & (repeats < 0.04)),
        "variety": _vote(enough & (variety < 0.12), enough & (variety > 0.2)),
        "bare_marks": _vote(bare > 0.15, bare < 0.03),
        "sentence_ends": _vote(enough & ((ends < 0.005) | (ends > 0.6)), enough & (ends >= 0.02) & (ends <= 0.4)),
        "loud_ends": _vote(loud > 0.3, loud < 0.05),
        "stop_words": _vote(enough & (stops < 0.02), enough & (stops > 0.06) & (stops < 0.6)),
        "word_length": _vote((mean < 2) | (mean > 14), (mean >= 3) & (mean <= 10)),
        "length": _vote(n < 5, n >= 40),
    }


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__v``, the votes in order."""
    return facts(docs, text_col).select(*docs.columns, F.array(*[v.cast("int") for v in labellers().values()]).alias("__v"))


@dataclass
class LabelModel:
    """P(vote | class, vote cast) per labeller and P(good); an abstention says nothing."""

    tables: np.ndarray  # [labeller, class (poor, good), vote + 1], 1 for abstentions
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns."""
        if not len(patterns):
            return np.zeros(0)
        at = np.arange(len(self.tables))[None, :]
        logs = np.log(self.tables)
        poor = logs[at, 0, patterns + 1].sum(1) + np.log(1 - self.prior)
        good = logs[at, 1, patterns + 1].sum(1) + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(poor - good, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Expected share of right votes among votes cast, per labeller."""
        p = np.array([1 - self.prior, self.prior])
        return p[0] * self.tables[:, 0, 0] + p[1] * self.tables[:, 1, 2]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 0.1) -> LabelModel:
    """Fit to the counts of vote patterns; at the start any vote for poor makes a document poor."""
    n = patterns.shape[1]
    total = counts.sum()
    good = np.where((patterns < 0).any(1), 0.1, np.where((patterns > 0).any(1), 0.9, 0.5))
    model = LabelModel(np.ones((n, 2, 3)), 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        tables = np.stack([[[weight[c][patterns[:, j] == v].sum() for v in (-1, 0, 1)] for c in (0, 1)] for j in range(n)]) + smooth
        tables /= tables[:, :, ::2].sum(2, keepdims=True)
        tables[:, :, 1] = 1
        model = LabelModel(tables, float(np.clip((weight[1].sum() + smooth) / (total + 2 * smooth), 0.01, 0.99)))
        after = model.posterior(patterns)
        if np.abs(after - good).max(initial=0) < 1e-6:
            break
        good = after
    return model


def label_model(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """EM over the vote patterns of all documents; at most 3^10 counts come to the driver."""
    rows = votes(docs.select(text_col), text_col).groupBy(F.col("__v").alias("v")).count().collect()
    rows.sort(key=lambda r: r.v)
    if not rows:
        return LabelModel(np.ones((len(labellers()), 2, 3)), 0.5)
    return expectation_maximisation(np.array([r.v for r in rows]), np.array([r["count"] for r in rows], float))


_split = re.compile("[^ \t-\r]+").findall


def _shape(word: str) -> str:
    """Character classes of a word, runs collapsed."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def _token_buckets(word: str) -> tuple[int, int]:
    return _bucket("w" + word.lower()), _bucket("s" + _shape(word))


def _document_buckets(words: list[str]) -> list[int]:
    n = len(words)
    size = min(12, n.bit_length())
    distinct = len(set(words)) / n if n else 0.0
    mean = sum(map(len, words)) / n if n else 0.0
    repeats = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
    return [_bucket(x) for x in (f"n{size}", f"d{size}:{int(distinct * 8)}", f"m{min(20, int(mean))}", f"r{min(8, int(repeats * 20))}")]


FACT_VALUE = 1.5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): each token's two features have 1 / tokens, document facts ``FACT_VALUE`` each."""
    words = _split(text) if text else []
    own = _document_buckets(words)
    b, c = np.unique(np.array([x for w in words for x in _token_buckets(w)], np.int64), return_counts=True)
    return np.r_[np.array(own), b].astype(np.int64), np.r_[np.full(len(own), FACT_VALUE), c / max(1, len(words))]


class _TokenWeights(dict):
    """Token -> sum of its features' weights, made when first asked for, bounded."""

    def __init__(self, weights: np.ndarray, limit: int = 500_000):
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        a, b = _token_buckets(word)
        self[word] = w = float(self.weights[a] + self.weights[b])
        return w


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scoring(self):
        """A function of texts to scores, as :func:`features` and a dot product would give."""
        token, weights, bias = _TokenWeights(self.weights), self.weights, self.bias

        def score(texts: list[str | None]) -> np.ndarray:
            z = np.empty(len(texts))
            for i, t in enumerate(texts):
                words = _split(t) if t else []
                z[i] = bias + FACT_VALUE * weights[_document_buckets(words)].sum()
                if words:
                    z[i] += sum(map(token.__getitem__, words)) / len(words)
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def fit_scorer(texts: list[str | None], soft: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by Adam over all rows."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(texts):
        return Scorer(w, bias)
    made = [*map(features, texts)]
    cols = np.concatenate([b for b, _ in made])
    vals = np.concatenate([v for _, v in made])
    rows = np.repeat(np.arange(len(made)), [len(b) for b, _ in made])
    theta, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(1, rounds + 1):
        z = theta[-1] + np.bincount(rows, theta[cols] * vals, len(made))
        gap = soft - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.r_[np.bincount(cols, gap[rows] * vals, BUCKETS), gap.sum()] / len(made) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * (0.98**k)
    return Scorer(theta[:-1], float(theta[-1]))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_chars: int = 60_000) -> tuple[list[str], np.ndarray]:
    """Texts and votes of up to ``max_docs`` different (id, text) rows in hash order, none of over ``max_chars`` characters.

    Rows are told by two hashes, equal ones are one before any limit or
    collection, and the labellers look at the rows taken only.
    """
    row = [F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text_col).alias("g")]
    short = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= max_chars)
    some = short.select(*row).distinct().orderBy("h", "g").limit(max_docs)  # two numbers a row
    texts = short.select(*row, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(some), ["h", "g"], "left_semi")
    chosen = votes(texts.groupBy("h", "g").agg(F.min("t").alias("t")), "t").orderBy("h", "g").collect()
    return [r.t for r in chosen], np.array([r["__v"] for r in chosen], int).reshape(len(chosen), len(labellers()))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_chars: int = 60_000) -> tuple[Scorer, LabelModel]:
    """The scorer, and the label model behind its soft labels."""
    model = label_model(docs, text_col)
    texts, cast = sample(docs, id_col, text_col, max_docs, max_chars)
    return fit_scorer(texts, model.posterior(cast)), model


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__quality``, 0 to 1."""
    held = Held(docs)
    return held.back(_scored(held.df, held[text_col], scorer), "__quality")


def _scored(docs: DataFrame, text_col: str, scorer: Scorer) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("__quality", T.DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        scoring = shared.value.scoring()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scoring(batch.column(at).to_pylist()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, _ = train(docs)
    return score(docs, scorer).select("doc_id", F.col("__quality").alias("score"), (F.col("__quality") >= KEEP_FROM).alias("keep"))
