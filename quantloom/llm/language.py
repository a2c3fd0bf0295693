"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of orders 0 to 3, with counts from training text. A byte
costs the exact code length of an arithmetic coder: escape probabilities of method C, symbols of longer
contexts excluded in shorter ones, 8 bits' alphabet at order -1, statistics frozen after training. The
language that codes a text in the fewest bits is predicted. Code lengths of all byte quadruples met in
training are tabulated for all languages at once; others are worked out when they turn up.

Training is bounded: about ``SAMPLE`` whole documents of each language, chosen by a hash of the id.

Defined results: null texts and texts without a letter are ``und`` with score 0, as all texts are where
nothing could be learned; equal code lengths go to the first language in alphabetical order; a very long
text is coded whole, in windows; an empty table gives an empty result. Only the id, text and (in training)
lang columns are read, so others may have any name; repeated rows give repeated results, null ids are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, portions, remainder, table, tidy

ORDER = 3
SAMPLE = 400
LEAD = b"\n" * ORDER
#: Positions that are scored at once.
WINDOW = 1 << 17
SLOT_BITS = 20
MIX = np.uint32(2654435761)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its three predecessors as one number, and where each text's start.

    Each text begins after three line feeds; positions of those have meaningless numbers.
    """
    raw = np.frombuffer(LEAD + LEAD.join(texts), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lens + ORDER) - lens
    own = raw.astype(np.uint32)
    out = own.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= own[:-back] << np.uint32(8 * back)
    return out, begin


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) of all byte quadruples."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                own = [t.encode() for t, k in zip(texts, langs, strict=True) if k == name and t]
                if not own:
                    continue
                all_grams, begin = grams(own)
                keep = np.ones(len(all_grams), bool)
                for back in range(1, ORDER + 1):
                    keep[begin - back] = False
                found, n = np.unique(all_grams[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    got = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(tidy(run), "lang string, gram long, n long")
    return got.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The context trees of all languages, with columns by language."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang_no: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.grams, self.counts, self.contexts, self.totals, self.kinds = {}, {}, {}, {}, {}
        for k in range(ORDER + 1):
            own = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            self.grams[k], place = np.unique(own, return_inverse=True)
            table_ = np.zeros((len(self.grams[k]), len(langs)))
            np.add.at(table_, (place, lang_no), n)
            self.counts[k] = table_
            self.contexts[k], place = np.unique(self.grams[k] >> np.uint64(8), return_inverse=True)
            self.totals[k], self.kinds[k] = (np.zeros((len(self.contexts[k]), len(langs))) for _ in range(2))
            np.add.at(self.totals[k], place, table_)
            np.add.at(self.kinds[k], place, table_ > 0)
        #: What is left of a context's suffix once the context's own symbols are excluded.
        self.left, self.left_kinds = {}, {}
        for k in range(1, ORDER + 1):
            longer, shorter = self.grams[k], self.grams[k - 1]
            inner = self.counts[k - 1][np.searchsorted(shorter, longer & np.uint64((1 << 8 * k) - 1))] * (self.counts[k] > 0)
            gone = np.zeros_like(self.totals[k])
            np.add.at(gone, np.searchsorted(self.contexts[k], longer >> np.uint64(8)), inner)
            suffix = np.searchsorted(self.contexts[k - 1], self.contexts[k] & np.uint64((1 << 8 * (k - 1)) - 1))
            self.left[k], self.left_kinds[k] = self.totals[k - 1][suffix] - gone, self.kinds[k - 1][suffix] - self.kinds[k]

    @staticmethod
    def _find(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Rows of the wanted keys; zeros for keys that aren't there."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return rows[at] * (keys[at] == wanted)[:, None]

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each quadruple's last byte after the three others, by language."""
        gram = gram.astype(np.uint64)
        out = np.zeros((len(gram), len(self.langs)))
        done, begun = np.zeros(out.shape, bool), np.zeros(out.shape, bool)
        n_left = kinds_left = np.zeros(out.shape)
        for k in range(ORDER, -1, -1):
            own, context = gram & np.uint64((1 << 8 * (k + 1)) - 1), (gram >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
            total, kinds = self._find(self.contexts[k], self.totals[k], context), self._find(self.contexts[k], self.kinds[k], context)
            n, t = np.where(begun, n_left, total), np.where(begun, kinds_left, kinds)
            count = self._find(self.grams[k], self.counts[k], own)
            live = ~done & (total > 0)
            hit = live & (count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(hit, np.log2((n + t) / count), 0) + np.where(live & ~hit & (t > 0), np.log2((n + t) / t), 0)
            begun |= live
            done |= hit
            if k:
                n_left, kinds_left = self._find(self.contexts[k], self.left[k], context), self._find(self.contexts[k], self.left_kinds[k], context)
        return out + np.where(done, 0, np.log2(np.maximum(256 - self.kinds[0][0], 1)))


class Scorer:
    """Code lengths of whole texts, through a table of the quadruples met in training."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.known = trees.grams[ORDER].astype(np.uint32)
        self.bits = np.vstack([trees.bits(self.known), np.zeros((1, len(trees.langs)))]).astype(np.float32)
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)
        self.slot[self._slots(self.known)] = np.arange(len(self.known), dtype=np.int32)

    @staticmethod
    def _slots(gram: np.ndarray) -> np.ndarray:
        return (gram * MIX) >> np.uint32(32 - SLOT_BITS)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text, by language."""
        gram, begin = grams(texts)
        silent = np.zeros(len(gram), bool)
        for back in range(1, ORDER + 1):
            silent[begin - back] = True
        out = np.zeros((len(texts), len(self.trees.langs)))
        owner_at = begin - ORDER
        for a in range(0, len(gram), WINDOW):
            own, quiet = gram[a : a + WINDOW], silent[a : a + WINDOW]
            at = self.slot[self._slots(own)]
            missed = np.flatnonzero((self.known[at] != own) & ~quiet)
            at[quiet] = len(self.known)
            bits = self.bits[at]
            if len(missed):
                rare, place = np.unique(own[missed], return_inverse=True)
                where = np.minimum(np.searchsorted(self.known, rare), len(self.known) - 1)
                met = self.known[where] == rare
                rows = np.empty((len(rare), bits.shape[1]), np.float32)
                rows[met] = self.bits[where[met]]
                rows[~met] = self.trees.bits(rare[~met])
                bits[missed] = rows[place]
            first, last = np.searchsorted(owner_at, a, "right") - 1, np.searchsorted(owner_at, a + len(own), "left")
            cuts = np.maximum(owner_at[first:last] - a, 0)
            out[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> ContextTrees | None:
    """Learn from rows that aren't held out and have a language; None if there are none."""
    rows = docs.where(~held_out & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = count_grams(rows.where(chance < share[F.col(lang)]), text, lang).toPandas()
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    number = {name: i for i, name in enumerate(langs)}
    return ContextTrees(langs, got["gram"].to_numpy(np.uint64), got["lang"].map(number).to_numpy(np.int64), got["n"].to_numpy(np.float64))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict_languages(docs: DataFrame, trees: ContextTrees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the language of the shortest code, and its share of the posterior."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in portions(batches):
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            spoken = [i for i, t in enumerate(texts) if scorer and t and has_letter(t)]
            for a in range(0, len(spoken), 64):
                own = spoken[a : a + 64]
                bits = scorer.lengths([texts[i].encode() for i in own])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
                for i, b, s in zip(own, best.tolist(), share.tolist(), strict=True):
                    names[i], scores[i] = shared.value.langs[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, lang_pred string, score double")
    return got.withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document; a third of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    trees = train(docs, F.coalesce(held, F.lit(True)))
    return predict_languages(docs, trees).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
