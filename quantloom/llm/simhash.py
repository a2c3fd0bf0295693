"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's three-word shingles.
Equal fingerprints are one node. Two fingerprints that differ in at most two bits agree on one of three
segments, and outside it on one of three subsegments, so each node goes to nine groups, each a masked bit
pattern that all its members share: these patterns are the top of the index, and where it is cut into
partitions. Below it the fingerprints are in order of Gray rank; runs of neighbours become index nodes that
hold the bits on which the run agrees, less those that nodes above them hold. A search starts at each
fingerprint's root, adds up differences on its way down and leaves out whole runs beyond the limit. All
links come from this search, whatever a group's size. A group is handed on as stars round its smallest
members, not as all its pairs; a pattern with very many members is cut into blocks that meet two by two.

Defined results: a null or empty text has fingerprint zero, which is linked like any other; repeated rows
are rows of the same fingerprint; a null id is no component's name unless its component has no other (then
null); very long texts are hashed whole; an empty table gives an empty result. Only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bounded_batches, materialize, meeting_cells, portions, table, tidy
from .components import components, local_roots

SHINGLE, SEED, LIMIT = 3, 42, 2
FAN = 16
#: Fingerprints that are searched for at once.
QUERIES = 1 << 14
#: Ids of removed or kept documents up to this many are broadcast (16 bytes each, or so); more are shuffled.
BROADCAST_IDS = 1_000_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every three-word shingle, repeats included."""
    words = text.lower().split()
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < SHINGLE:
        return [digest(b" ".join(words))] if words else []
    return list(map(digest, map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Majority bits of each text's shingle hashes; zero without any."""
    each = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    out = np.zeros(len(each), np.uint64)
    sizes = np.array([len(h) for h in each], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.concatenate([each[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    blocks = -(-sizes[full] // 255)  # of at most 255 hashes, so that counts fit into bytes
    first = np.cumsum(blocks) - blocks
    cuts = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        major = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (major << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers."""
    out = [fingerprints([(t or "").encode() for t in part.column(0).to_pylist()]) for part in portions([pa.RecordBatch.from_arrays([texts], ["text"])], 0)]
    return pa.array(np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fingerprints as signed 64-bit numbers."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fp = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, fp long")


def masks(limit: int = LIMIT) -> list[int]:
    """Bit masks (nine for two bits), one of which covers only equal bits of two fingerprints within the limit."""
    out, parts = [], limit + 1
    cut = lambda bits: [bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts)]
    for segment in cut(list(range(64))):
        for inner in cut([b for b in range(64) if b not in segment]):
            out.append(sum(1 << b for b in (*segment, *inner)))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a code stands in the reflected Gray sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(step))
    return x


class GrayIndex:
    """Hierarchical index over fingerprints in order of (group, Gray rank).

    The lowest nodes are the fingerprints; ``FAN`` neighbours of a group are a node of the next level, up to
    one root for each group. A node keeps those bits on which all that is below it agrees and which no node
    above it has, so that differences add up on the way down."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, self.levels = fp, []
        value, shared = fp, np.full(len(fp), ~np.uint64(0))
        while True:
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(starts, len(group)))
            if not len(group) or sizes.max() == 1:
                self.levels.append((value, shared, np.arange(len(value)), np.zeros(len(value), np.int64)))
                break
            nth = np.arange(len(group)) - np.repeat(starts, sizes)
            cuts = np.flatnonzero(nth % FAN == 0)
            width = np.diff(np.append(cuts, len(group)))
            differ = np.bitwise_or.reduceat(value ^ np.repeat(value[cuts], width), cuts)
            up = np.bitwise_and.reduceat(shared, cuts) & ~differ
            self.levels.append((value, shared & ~np.repeat(up, width), cuts, width))
            value, shared, group = value[cuts], up, group[cuts]
        #: From the roots down: value, bits, and where a node's children are in the next level, and how many.
        self.levels.reverse()
        self.levels = [(v, bits, *(self.levels[i + 1][2:] if i + 1 < len(self.levels) else (None, None))) for i, (v, bits, _, _) in enumerate(self.levels)]
        #: Past the last fingerprint below each node.
        last, self.lasts = np.arange(1, len(fp) + 1), []
        for _, _, first, width in self.levels[::-1]:
            last = last if first is None else last[first + width - 1]
            self.lasts.insert(0, last)

    def links(self, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs of a group that differ in at most ``limit`` bits, the smaller place first."""
        if not len(self.fp):
            return
        root_of = np.searchsorted(self.lasts[0], np.arange(len(self.fp)), "right")
        for begin in range(0, len(self.fp), QUERIES):
            q = np.arange(begin, min(begin + QUERIES, len(self.fp)))
            node, gap = root_of[q], np.zeros(len(q), np.int64)
            for (value, bits, first, width), last in zip(self.levels, self.lasts, strict=True):
                gap = gap + np.bitwise_count((self.fp[q] ^ value[node]) & bits[node])
                keep = (gap <= limit) & (last[node] > q + 1)
                q, node, gap = q[keep], node[keep], gap[keep]
                if first is not None:
                    size = width[node]
                    child = np.repeat(first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    q, gap, node = np.repeat(q, size), np.repeat(gap, size), child
            yield q, node


def linked(group: np.ndarray, fp: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller connected fingerprint) over all groups; in order of group and Gray rank."""
    found = [np.zeros((2, 0), np.int64)]
    for a, b in GrayIndex(group, fp).links(limit):
        node, root = local_roots(fp[a].view(np.int64), fp[b].view(np.int64))
        found.append(np.stack([node, root])[:, node != root])
    node, root = local_roots(*np.concatenate(found, axis=1))
    return node[node != root], root[node != root]


def link_fingerprints(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges that connect all fingerprints ``fp`` within the limit of each other.

    A masked pattern with very many fingerprints is cut into blocks that meet two by two."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(limit)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask_no", "pattern"))
    sizes = materialize(keyed.groupBy("mask_no", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A pattern that only one fingerprint has links nothing: most go before anything is dealt.
    keyed = keyed.join(sizes.select("mask_no", "pattern"), ["mask_no", "pattern"], "left_semi")
    keyed = meeting_cells(keyed, ["mask_no", "pattern"], ["fp"], sizes, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        fp, no, pattern, cell = (rows.column(c).to_numpy() for c in ("fp", "mask_no", "pattern", "cell"))
        fp, pattern = fp.view(np.uint64), pattern.view(np.uint64)
        order = np.lexsort((gray_rank(fp ^ pattern), cell, pattern, no))
        fp, no, pattern, cell = fp[order], no[order], pattern[order], cell[order]
        new = np.concatenate([[True], (no[1:] != no[:-1]) | (pattern[1:] != pattern[:-1]) | (cell[1:] != cell[:-1])])
        a, b = linked(np.cumsum(new), fp, limit)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return keyed.repartition("mask_no", "pattern", "cell").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, fp, component): fingerprint, and the smallest key of those reachable by links."""
    return _grouped(docs, key, text, limit).select(F.col("key").alias(key), "fp", F.col("name").alias("component"))


def _grouped(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, fp, root, name): of each row its fingerprint, its component's smallest fingerprint and key."""
    prints = materialize(fingerprint_documents(docs, key, text))
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")))
    found = materialize(components(link_fingerprints(nodes, limit)))
    rooted = nodes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left")
    rooted = materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("name")))
    # Written first, so that these joins are of plain shuffles, and hot components and fingerprints can be split.
    of_node = materialize(rooted.select("fp", "root").join(named, "root"))
    return prints.join(of_node, "fp")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest key, null keys last.

    Rows are told apart by key and fingerprint, so that texts that share a key, or have none, are judged each
    by its own. Rows that agree in both are one document: one of them stays, whichever.
    """
    groups = materialize(_grouped(docs, key, text, limit).select("key", "fp", "root"))
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("fp").alias("fp"))
    kept = groups.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.key").alias("__key"), F.col("first.fp").alias("__print"))
    kept = materialize(kept)
    n_rows, n_kept = groups.count(), kept.count()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_IDS else df
    if groups.select("key").distinct().count() == n_rows and groups.where("key is null").isEmpty():  # the key tells rows apart
        if n_rows - n_kept <= n_kept:
            gone = groups.select("key").join(kept, F.col("key") == F.col("__key"), "left_anti").withColumnRenamed("key", "__gone")
            return docs.join(small(gone, n_rows - n_kept), docs[key] == F.col("__gone"), "left_anti")
        return docs.join(small(kept, n_kept), docs[key] == F.col("__key"), "left_semi")
    own = docs.withColumn("__fp", fingerprint(F.col(text)))
    own = own.join(small(kept, n_kept), own[key].eqNullSafe(F.col("__key")) & (F.col("__fp") == F.col("__print")), "left_semi")
    return own.dropDuplicates([key, "__fp"]).drop("__fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
