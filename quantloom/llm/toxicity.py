"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over the set of a text's words is fitted in numpy from confirmed toxic documents and
unlabelled ones. The risk is the class-prior-corrected estimate
``p R+(P) + max(0, R-(U) - p R-(P))`` with logistic loss; where the corrected part falls below zero it
no longer pulls, which keeps the estimate from going negative by overfitting. Steps shrink, and the
weights of the second half of all steps are averaged.

Features are words, runs of letters (any byte of a non-ASCII character counts as one) with ASCII case
folded, and the words' character sequences, hashed to ``BUCKETS``; those that tell the two sets apart
significantly are used. Training is bounded: about ``POSITIVE`` confirmed toxic documents and
``UNLABELLED`` others, whole texts, chosen by a hash of the id; the class prior is the share of toxic
rows among all labelled training rows.

Defined results: null and empty texts get the score of a text without words; a document that several
label rows mark is toxic if one of them says so, null labels are ignored; where there is nothing to learn
from, scores are 0; a very long text is scored whole; an empty table gives an empty result; equal scores have
no order among them. Only the id and text columns are read (and the label in training), so others may have any
name; repeated rows get equal scores, rows with a null id are scored and not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, remainder, table, tidy
from .tokens import mix, slices, token_hashes

BUCKETS = 1 << 22
#: Bytes of a character feature: so many letters, or a word's first letters and what is before it.
GRAM = 5
POSITIVE, UNLABELLED = 2000, 6000
#: A feature is used if so many of the positive documents have it, and if its share among them is so many
#: standard errors from its share among the unlabelled ones.
LEAST, Z = 5, 5.0
STEPS, RATE, DECAY = 600, 0.1, 1e-4
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(texts: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each distinct feature of each text; ``keep``: only features it marks."""
    raw = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    letter = _LETTER[raw]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    word, start = token_hashes(raw, letter)
    shape = np.where(letter, raw, np.uint8(0)).astype(np.uint64)
    gram = np.zeros(len(raw), np.uint64)
    whole = np.ones(len(raw), bool)
    for back in range(GRAM):
        gram[back:] |= shape[: len(raw) - back] << np.uint64(8 * back)
        if back < GRAM - 1:
            whole[back:] &= letter[: len(raw) - back]
    whole[: GRAM - 1] = False
    last = np.flatnonzero(whole)
    place, feature = np.concatenate([start, last]), np.concatenate([word, mix(gram[last])]) & np.uint64(BUCKETS - 1)
    feature = feature.astype(np.int64)
    if keep is not None:
        chosen = np.flatnonzero(keep[feature])
        place, feature = place[chosen], feature[chosen]
    pair = np.unique((np.searchsorted(ends, place, "right") << 32) | feature)
    return pair >> 32, pair & 0xFFFFFFFF


class Model:
    """score = sigmoid(bias + sum of the weights of a text's distinct words)."""

    def __init__(self, bias: float, used: np.ndarray, weights: np.ndarray):
        self.bias, self.sparse = bias, (used, weights)
        self._dense = self._keep = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None, "_keep": None}

    @property
    def weights(self) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(BUCKETS, np.float32)
            self._dense[self.sparse[0]] = self.sparse[1]
            self._keep = self._dense != 0
        return self._dense

    def _kept(self) -> np.ndarray:
        return self.weights != 0 if self._keep is None else self._keep

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, feature = features(texts, self._kept())
        total = np.bincount(owner, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def screened(seen: np.ndarray, base: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Which features tell positive documents from unlabelled ones, by the documents that have them."""
    rate = (base + seen + 1) / (n_unlabelled + n_positive + 2)
    z = (seen / n_positive - rate) / np.sqrt(rate * (1 - rate) / n_positive)
    return (seen >= min(LEAST, max(1, n_positive // 4))) & (np.abs(z) >= Z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sparse:
    """0/1 rows by the places of their ones, and what the risk needs of them."""

    def __init__(self, docs: list[np.ndarray], width: int):
        self.row, self.n, self.width = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs), width
        self.place = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)

    def margin(self, w: np.ndarray) -> np.ndarray:
        return w[-1] + np.bincount(self.row, w[self.place], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        """Gradient by weights and bias of a sum whose gradient by margins is ``g``."""
        return np.append(np.bincount(self.place, g[self.row], self.width), g.sum())


def risk(w: np.ndarray, p: Sparse, u: Sparse, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk ``prior R+(P) + max(0, R-(U) - prior R-(P))`` with logistic loss, and its gradient: what
    the corrected part has of it vanishes where that part is negative."""
    zp, zu = p.margin(w), u.margin(w)
    value, grad = prior * np.logaddexp(0, -zp).mean(), prior * p.back((sigmoid(zp) - 1) / p.n)
    corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if corrected >= 0:
        value += corrected
        grad += u.back(sigmoid(zu) / u.n) - prior * p.back(sigmoid(zp) / p.n)
    return float(value), grad


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], used: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk over all rows by Adam; rows hold places in ``used``.

    In the end the bias is set so that the unlabelled documents' mean score is the class prior.
    """
    p, u = Sparse(positive, len(used)), Sparse(unlabelled, len(used))
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, power = np.zeros_like(w), np.zeros_like(w)
    average = np.zeros_like(w)
    for step in range(1, STEPS + 1):
        _, grad = risk(w, p, u, prior)
        grad[:-1] += DECAY * w[:-1]
        mean, power = 0.9 * mean + 0.1 * grad, 0.999 * power + 0.001 * grad**2
        w = w - RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
        average += w * (2 * step > STEPS) / (STEPS // 2)
    bare = u.margin(np.append(average[:-1], 0.0))
    low, high = -60.0, 60.0
    for _ in range(60):
        bias = (low + high) / 2
        low, high = (bias, high) if sigmoid(bare + bias).mean() < prior else (low, bias)
    return Model(bias, used, average[:-1])


def _chance(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("toxicity sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def train(docs: DataFrame, labels: DataFrame, usable: str, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Learn from the rows for which the SQL condition ``usable`` holds; None if no toxic row is known."""
    spark = docs.sparkSession
    bounded_batches(spark)
    told = labels.where(usable).where(F.col(label).isNotNull()).groupBy(F.col(key)).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n, n_toxic = told.agg(F.count("*"), F.sum("toxic")).first()
    n_docs = docs.where(usable).count()
    if not n or not n_toxic or not n_docs:
        return None
    #: About POSITIVE ids, whatever the input's size: bounded, so it may be broadcast.
    confirmed = told.where((F.col("toxic") == 1) & (_chance(key) < POSITIVE / n_toxic)).select(F.col(key).alias("confirmed"))
    rows = docs.where(usable).where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(confirmed), F.col("id") == F.col("confirmed"), "left")
    rows = rows.select("text", F.col("confirmed").isNotNull().alias("p"), (_chance("id") < UNLABELLED / n_docs).alias("u")).where("p or u")

    rows = materialize(rows)
    n_p, n_u = rows.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    if not n_p or not n_u:
        return None

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                owner, feature = features(texts[a:b])
                found, place = np.unique(feature, return_inverse=True)
                counts = [pa.array(np.bincount(place, x[a:b][owner], len(found)).astype(np.int64)) for x in (p, u)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *counts], ["feature", "p", "u"])

    seen = rows.mapInArrow(tidy(tally), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= 1)
    seen = seen.where(F.col("p") >= min(LEAST, max(1, n_p // 4))).toPandas()
    used = np.sort(seen["feature"].to_numpy(np.int64)[screened(seen["p"].to_numpy(), seen["u"].to_numpy(), n_p, n_u)])
    shared = spark.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(BUCKETS, bool)
        keep[shared.value] = True
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                owner, feature = features(texts[a:b], keep)
                stops = np.searchsorted(owner, np.arange(b - a + 1))
                words = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(np.searchsorted(shared.value, feature).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), words], ["p", "u", "words"])

    got = rows.mapInArrow(tidy(run), "p boolean, u boolean, words array<int>").toPandas()
    positive, unlabelled = [got.loc[got[c], "words"].tolist() for c in ("p", "u")]
    return fit(positive, unlabelled, used, min(max(n_toxic / n, 1e-4), 0.999))


def scorer(spark: SparkSession, model: Model | None):
    """A column function: text -> score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        if shared.value:
            all_texts = [(t or "").encode() for t in texts.to_pylist()]
            for a, b in slices(all_texts):
                out[a:b] = shared.value.scores(all_texts[a:b])
        return pa.array(out)

    return score


USABLE = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; a quarter of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels"), USABLE))
    scored = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
