"""Line dedup by an exact set-similarity join.

A line is the set of its tokens (runs of bytes other than ASCII white space, A-Z lower-cased). A line goes
if an earlier one, by (id, line number), has a Jaccard similarity of ``JACCARD`` or more; lines without
tokens stay. Tokens are put in order of rarity; lines with J >= t share one of their first
n - ceil(t n) + 1 tokens, so lines meet by those prefixes. Pairs that meet are thinned out by length, by
the token's positions, and by a 64-bit parity map of the sets (which can't differ in more bits than the
sets do in tokens), and what is left is verified on the whole sets of 64-bit token hashes.

Rarity comes from counts of all tokens of all texts in a table of fixed size (``BUCKETS``). Any order that
all lines share gives exact results, and frequent tokens stand out in it whatever the input's size, so it
needn't grow. A prefix hands on, for each line, the earlier partners that look most similar; lines that none
of these settles get more from the tokens that have more, and in the last round all of theirs, so nothing is
capped. Whole sets are read once, for the lines that may have a partner at all, and again for such lines that
only a later round compares: texts are asked by marks of the lines in a table that grows with their number,
or, beyond what may be broadcast, by a shuffled join. Equal lines of one batch of documents are settled there
and then, whatever their number. A prefix token that very many lines share is cut into blocks that meet two
by two. Between the stages lines travel in packed columns, a row for each batch, or for each batch and range
of tokens.

Equal lines are told by 64 bits of a sum of token hashes, the 64-bit parity map and the number of tokens.

Defined results: null and empty texts have one empty line; rows with a null id come first in the order; rows
that share an id (or have none) are documents of their own, in order of a hash of their texts, and only those
that share the text too are one document, which is judged once; equal lines within a text are repeats as in
any other; very long texts and lines are taken whole; an empty table gives an empty result. Only the id and
text columns are read, so others may have any name. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PORTION, bounded_batches, materialize, partitions, portions, table, tidy
from .tokens import mix, slices, token_hashes

JACCARD = 0.8
BUCKETS = 1 << 20
#: Partners that a prefix hands on for a line in each round; groups beyond WIDE are searched by blocks.
ROUNDS, WIDE, BLOCK = (4, None), 512, 256
PAIRS = 1 << 18
#: Pairs that are held before they are thinned out or handed on, prefix tokens of a part that are searched at once, and
#: those that a task collects before it deals them out to the parts, so that rows don't grow as portions times parts.
HELD, PART, DEALT = 1 << 20, 1 << 17, 1 << 19
#: Bits of the marks of each line or token that is asked for, the fewest if there are many, and of all marks at most:
#: more aren't broadcast.
MARK_BITS, FEWEST_BITS, MOST_MARKS = 16, 4, 1 << 25
#: Removed lines up to this many are broadcast (16 bytes each); more are shuffled.
BROADCAST_LINES = 1_000_000
#: Pairs up to this many are broadcast (16 bytes for each line).
BROADCAST_PAIRS = 200_000
#: Ids that repeat up to this many are broadcast (8 bytes each).
BROADCAST_REPEATS = 1_000_000
#: Lines that meet at one token in one cell, and the share of a portion's prefix tokens that makes one heavy.
CROWD, HEAVY = 20_000, 1 / 2048
NO_ID = -(1 << 63)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
_FOLDS, _TOKENS = _FOLD.tobytes(), _TOKEN.tobytes()


def folded_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the tokens."""
    return token_hashes(np.frombuffer(raw.translate(_FOLDS), np.uint8), np.frombuffer(raw.translate(_TOKENS), bool))


def lines_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, where the lines end, and each one's text and number."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    feeds = np.flatnonzero(raw == 10)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    owner = np.searchsorted(ends, feeds)
    first = np.searchsorted(owner, np.arange(len(texts)))
    return raw, feeds, owner, np.arange(len(feeds)) - first[owner]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, one after the other."""
    return b"".join(c.tobytes() for c in columns)


def unpack(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    size = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, size, at))
        at += size * np.dtype(k).itemsize
    return out


#: Widths that integers are packed in; none for zeros.
WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def pack_narrow(*columns: np.ndarray) -> bytes:
    """Signed columns of equal length, each in the narrowest width that holds it, after length and widths."""
    codes = [next(i for i, w in enumerate(WIDTHS) if c.min() >= np.iinfo(w).min and c.max() <= np.iinfo(w).max) if c.any() else len(WIDTHS) for c in columns]
    own = [c.astype(WIDTHS[i]).tobytes() for c, i in zip(columns, codes, strict=True) if i < len(WIDTHS)]
    return len(columns[0]).to_bytes(4, "little") + bytes(codes) + b"".join(own)


def unpack_narrow(raw: bytes, n: int) -> list[np.ndarray]:
    size, at, out = int.from_bytes(raw[:4], "little"), 4 + n, []
    for code in raw[4 : 4 + n]:
        if code == len(WIDTHS):
            out.append(np.zeros(size, np.int64))
            continue
        out.append(np.frombuffer(raw, WIDTHS[code], size, at).astype(np.int64))
        at += size * np.dtype(WIDTHS[code]).itemsize
    return out


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def sets_of(h: np.ndarray, line: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by line, the rarest first; where each line with tokens starts, sizes, lines."""
    if rank is None:
        order = np.lexsort((h, line))
    else:
        place = rank[bucket(h)].astype(np.uint64)
        if len(line) and line[-1] >= 1 << 20:
            order = np.lexsort((h, place, line))
        else:
            key = (line.astype(np.uint64) << np.uint64(44)) | (place << np.uint64(24)) | (h >> np.uint64(40))
            order = np.argsort(key)
            sorted_key, sorted_h = key[order], h[order]
            if np.any((sorted_key[1:] == sorted_key[:-1]) & (sorted_h[1:] != sorted_h[:-1])):
                order = np.lexsort((h, place, line))
    h, line = h[order], line[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[keep], line[keep]
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return h, start, np.diff(np.append(start, len(line))), line[start]


def need(n: np.ndarray, t: float) -> np.ndarray:
    """The least overlap that a set of n tokens can have with one it matches."""
    return np.ceil(n * t - 1e-9).astype(np.int64)


#: A table of fixed size is summed up in so many slices.
SLICES = 64


def summed(rows: DataFrame, size: int, kind: str, fill, add, close=lambda total: total) -> np.ndarray:
    """A table of ``size`` numbers: each task fills one with its batches, and tables are added slice by slice.

    ``close`` makes a full table smaller. What reaches the driver is one table, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(size, kind), False
        for batch in batches:
            if batch.num_rows:
                fill(total, batch)
                met = True
        if met:
            own = [(i, part.tobytes()) for i, part in enumerate(close(total).reshape(SLICES, -1)) if part.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([raw for _, raw in own], pa.binary())], ["part", "numbers"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(raw, kind)
                held[part] = add(held[part], new) if part in held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "numbers"])

    shape = "part int, numbers binary"
    out = close(np.zeros(size, kind)).reshape(SLICES, -1)
    for r in rows.mapInArrow(tidy(run), shape).repartition("part").mapInArrow(tidy(together), shape).collect():  # one table
        out[r["part"]] = np.frombuffer(bytes(r["numbers"]), kind)
    return out.ravel()


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two tables of counts that doesn't wrap round."""
    c = a + b
    return np.where(c < a, np.uint32(0xFFFFFFFF), c)


def count_tokens(docs: DataFrame, text: str) -> np.ndarray:
    """Tokens of all texts by hash bucket."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        texts = [t or b"" for t in batch.column(0).to_pylist()]
        for a, b in slices(texts, PORTION):
            total += np.bincount(bucket(folded_hashes(b"\n".join(texts[a:b]))[0]), minlength=BUCKETS).astype(np.uint32)

    return summed(docs.select(text), BUCKETS, "<u4", fill, _saturating)


#: 64-bit columns of a portion's lines. To them belong, in narrow integers, differences of documents, what tells
#: documents of one id apart, line numbers, sizes, and whether an equal line comes earlier in the portion.
LINE = ("<u8", "<u8")
PREFIX = ("<u4",)
#: Columns of the prefix tokens of a part, and of those that are in narrow integers: the first document, differences
#: of documents, ``sub``, line numbers, sizes, positions, whether the line doesn't ask for partners, and cells.
OUTRIGHT, SMALL = {"token": "<u4", "sig": "<u8", "parity": "<u8"}, ("docs", "sub", "line", "n", "pos", "mute", "cell")
DEAL = "part int, doc long, " + ", ".join(f"{c} binary" for c in (*OUTRIGHT, *SMALL))


def pack_lines(doc, sub, line, sig, parity, n, again) -> bytes:
    wide = pack(sig, parity)
    return len(wide).to_bytes(4, "little") + wide + pack_narrow(np.diff(doc, prepend=np.int64(0)), sub, line, n, again)


def unpack_lines(raw: bytes) -> list[np.ndarray]:
    """doc, sub, line, sig, parity, n, again"""
    size = int.from_bytes(raw[:4], "little")
    doc, sub, line, n, again = unpack_narrow(raw[4 + size :], 5)
    return [np.cumsum(doc), sub, line, *unpack(raw[4 : 4 + size], LINE), n, again]


def prefix_sizes(n: np.ndarray, again: np.ndarray, t: float) -> np.ndarray:
    return np.where(again != 0, 0, n - need(n, t) + 1)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def keyed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All columns, and what tells documents apart: ``__doc``, the id, and ``__sub``, zero or, for ids that
    aren't one row's own, a hash of the text."""
    one = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    repeats = materialize(docs.groupBy(one.alias("__repeated")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("__repeated") == NO_ID)).select("__repeated"))
    n, told = repeats.count(), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = docs.withColumn("__doc", one)
    if n > BROADCAST_REPEATS:
        return docs.withColumn("__sub", told)
    if not n:
        return docs.withColumn("__sub", F.lit(0).cast("long"))
    met = docs.join(F.broadcast(repeats), F.col("__doc") == F.col("__repeated"), "left")
    return met.withColumn("__sub", F.when(F.col("__repeated").isNotNull(), told).otherwise(F.lit(0).cast("long"))).drop("__repeated")


def line_rows(docs: DataFrame, rank, t: float) -> DataFrame:
    """(lines, prefixes, heavy): the packed lines with tokens of each portion of the rows (doc, text, sub), the
    prefix tokens that go with them, and those tokens that many of them have, with counts.

    ``again`` marks lines with an earlier equal line in the portion; others have prefixes, 32 bits of each
    token: a chance equality only makes a pair more to verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, subs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            raw, feeds, owner, number = lines_in([x or b"" for x in batch.column(1).to_pylist()])
            h, start = folded_hashes(raw.tobytes())
            h, start, n, line = sets_of(h, np.searchsorted(feeds, start), rank.value)
            if not len(start):
                continue
            sig, parity = np.add.reduceat(mix(h), start), np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), start)
            doc, sub, no = ids[owner[line]], subs[owner[line]], number[line]
            order = np.lexsort((no, sub, doc, n, parity, sig))
            begin = np.flatnonzero(np.concatenate([[True], differ(order, sig, parity, n)]))
            lead = order[np.repeat(begin, np.diff(np.append(begin, len(order))))]
            again = np.zeros(len(sig), np.int64)
            again[order] = (doc[order] != doc[lead]) | (sub[order] != sub[lead]) | (no[order] != no[lead])
            tokens = (h[spans(start, prefix_sizes(n, again, t))] >> np.uint64(32)).astype("<u4")
            kinds, counts = np.unique(tokens, return_counts=True)
            many = counts >= max(16, HEAVY * len(tokens))
            columns = [pack_lines(doc, sub, no, sig, parity, n, again), tokens.tobytes(), pack(kinds[many].astype("<u4"), counts[many].astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["lines", "prefixes", "heavy"])

    return docs.mapInArrow(tidy(run), "lines binary, prefixes binary, heavy binary")


def differ(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first in the order isn't equal to the one before in all the columns."""
    out = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        own = c[order]
        out |= own[1:] != own[:-1]
    return out


def crowds(rows: DataFrame) -> tuple[dict[int, int], int]:
    """Prefix tokens that very many lines have, with how many blocks to cut those into; and how many tokens all are.

    Heavy tokens are counted portion by portion, so that few of all tokens are looked at, and no more than the
    reciprocal of ``HEAVY`` can pass in any portion; counts only deal work, they decide nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                token, n = unpack(raw, ("<u4", "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    total = rows.agg(F.coalesce(F.sum(F.length("prefixes")), F.lit(0))).first()[0] // 4
    share = max(CROWD, total // (16 * partitions(rows.sparkSession)))
    found = rows.select("heavy").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > share)
    return {r["token"]: -(-r["n"] // share) for r in found.collect()}, total  # no more than sixteen for each partition


def line_marks(doc: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two marks of each line; documents of one id have the same."""
    h = mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(37) & np.uint64(size - 1)).astype(np.int64)


def is_marked(bits: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether the lines are marked; about one in a hundred others may be too, one in seven if there are very many."""
    a, b = line_marks(doc, line, len(bits))
    return bits[a] & bits[b]


def token_marks(token: np.ndarray, size: int) -> np.ndarray:
    return (mix(token.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def marked(rows: DataFrame, n: int, number) -> np.ndarray | None:
    """Bits of all marks ``number(batch, size)`` of the ``n`` rows, packed; None if they are too many."""
    size = max(1 << 16, 1 << (MARK_BITS * n).bit_length())
    if size > MOST_MARKS:  # a fuller table lets more others pass, but all texts aren't shuffled yet
        if not 0 < FEWEST_BITS * n <= MOST_MARKS:
            return None
        size = MOST_MARKS

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[number(batch, size)] = 1

    return summed(rows, size, "u1", fill, np.bitwise_or, np.packbits)


def marked_lines(rows: DataFrame) -> np.ndarray | None:
    """Marks of the lines that the rows begin with: doc, line."""
    rows = rows.select("doc", "line")
    return marked(rows, rows.count(), lambda b, size: np.concatenate(line_marks(b.column(0).to_numpy(), b.column(1).to_numpy(), size)))


def older(doc, sub, line, a, b) -> np.ndarray:
    """Whether row a comes before row b."""
    return (doc[a] < doc[b]) | ((doc[a] == doc[b]) & ((sub[a] < sub[b]) | ((sub[a] == sub[b]) & (line[a] < line[b]))))


def partners(token, doc, sub, line, parity, n, pos, probe, t: float, first: int | None):
    """(row, earlier row) for rows that share a token and may match, in blocks; last (None, how many partners each
    row has, whether it is in any pair).

    Rows are in order of token, then size. ``first``: how many of the partners to give, those with the closest parity
    maps. No more than ``HELD`` pairs and ``first`` for each row are held at once, whatever the rows have in common.
    """
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(starts, len(token)))
    group = np.repeat(np.arange(len(starts)), sizes)
    share = t / (1 + t)
    total, fit = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    found: list[tuple] = []
    held = 0

    def fits(a, b):
        least = np.ceil((n[a] + n[b]) * share - 1e-9)
        ok = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
        a, b = a[ok], b[ok]
        gap = np.bitwise_count(parity[a] ^ parity[b])
        ok = gap.astype(np.float64) <= (n[a] + n[b]) * (1 - t) / (1 + t) + 1e-9
        a, b, gap = a[ok], b[ok], gap[ok]
        swap = older(doc, sub, line, a, b)
        late, early = np.where(swap, b, a), np.where(swap, a, b)
        ok = probe[late] & older(doc, sub, line, early, late)
        late, early, gap = late[ok], early[ok], gap[ok]
        fit[late] = fit[early] = True
        return late, early, gap

    def closest():
        """Of the pairs found so far those to give, by row."""
        late, early, gap = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((line[early], sub[early], doc[early], gap, late))
        late, early, gap = late[order], early[order], gap[order]
        if first is not None:
            begin = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]])) if len(late) else np.zeros(0, np.int64)
            keep = np.arange(len(late)) - np.repeat(begin, np.diff(np.append(begin, len(late)))) < first
            late, early, gap = late[keep], early[keep], gap[keep]
        return late, early, gap

    def chunks():
        key = group * (1 << 32) + n
        reach = np.searchsorted(key, group * (1 << 32) + np.floor(n / t + 1e-9).astype(np.int64), "right")
        count = np.where(sizes[group] <= WIDE, reach - np.arange(len(token)) - 1, 0)
        ahead = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(token):
            to = min(len(token), max(at + 1, int(np.searchsorted(ahead, ahead[at] + PAIRS))))
            c = count[at:to]
            a = np.repeat(np.arange(at, to), c)
            yield fits(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c))
            at = to
        for s, size in zip(starts[sizes > WIDE], sizes[sizes > WIDE], strict=True):
            by_age = s + np.lexsort((line[s : s + size], sub[s : s + size], doc[s : s + size]))
            open_ = probe[by_age].copy()
            for low in range(0, size, BLOCK):
                old = by_age[low : low + BLOCK]
                young = np.flatnonzero(open_[low:]) + low
                if not len(young):
                    break
                for a0 in range(0, len(young), PAIRS // BLOCK):
                    own = young[a0 : a0 + PAIRS // BLOCK]
                    a, b = np.repeat(by_age[own], len(old)), np.tile(old, len(own))
                    ok = older(doc, sub, line, b, a) & (np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * t - 1e-9)
                    yield fits(a[ok], b[ok])
                if first is not None:
                    open_ &= total[by_age] <= first

    for pairs in chunks():
        if not len(pairs[0]):
            continue
        low = int(pairs[0].min())
        own = np.bincount(pairs[0] - low)
        total[low : low + len(own)] += own
        found.append(pairs)
        held += len(pairs[0])
        if held >= HELD:
            late, early, gap = closest()
            found, held = ([(late, early, gap)], 0) if first is not None else ([], 0)
            if first is None:
                yield late, early
    late, early, _ = closest()
    if len(late):
        yield late, early
    yield None, total, fit


MET = "doc long, sub long, line int, sig long, par long, other long, opar long, token long"
NAMES = [c.split()[0] for c in MET.split(", ")]


def pieces_of(column: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A column cut into binary values, integers in the narrowest width that holds all of them; none for zeros."""
    if column.dtype.kind == "i" and not column.any():
        column, cuts = np.zeros(0, "<i1"), np.zeros(len(cuts), np.int64)
    elif column.dtype.kind == "i":
        column = column.astype(next(w for w in WIDTHS if column.min() >= np.iinfo(w).min and column.max() <= np.iinfo(w).max))
    ends = (np.append(cuts, len(column)) * column.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(column))])


def deal(rows: DataFrame, t: float, ranges: int, crowded: dict[int, int], tokens=None, asked=None) -> DataFrame:
    """The prefix tokens dealt to parts, with the columns DEAL: a row for each part and ``DEALT`` tokens of a task."""
    crowd_token = np.array(sorted(crowded), np.uint32)
    crowd_blocks = np.array([crowded[k] for k in sorted(crowded)], np.int64)

    def cells(token, sig):
        """Rows to take, and the cell of each: a token that isn't crowded has one."""
        if not len(crowd_token):
            return np.arange(len(token)), np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(crowd_token, token), len(crowd_token) - 1)
        blocks = np.where(crowd_token[at] == token, crowd_blocks[at], 1)
        row, other = np.repeat(np.arange(len(token)), blocks), spans(np.zeros(len(token), np.int64), blocks)
        own = (sig[row] % blocks[row].astype(np.uint64)).astype(np.int64)
        return row, np.minimum(own, other) * blocks[row] + np.maximum(own, other)

    def together(held: list) -> Iterator[pa.RecordBatch]:
        lines, met = zip(*held, strict=True)
        base = np.cumsum([0, *(len(x[0]) for x in lines)])
        doc, sub, line, sig, parity, n, mute = (np.concatenate(c) for c in zip(*lines, strict=True))
        own = np.concatenate([x[1] + b for x, b in zip(met, base, strict=False)])
        token, pos, part, cell = (np.concatenate([x[i] for x in met]) for i in (0, 2, 3, 4))
        held.clear()
        del lines, met
        order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
        own, part = own[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        docs = np.diff(doc[own], prepend=np.int64(0))
        docs[cuts] = 0
        columns = {"part": pa.array(part[cuts]), "doc": pa.array(doc[own[cuts]]), "docs": pieces_of(docs, cuts)}
        for name, column in (("sig", sig), ("parity", parity), ("sub", sub), ("line", line), ("n", n), ("mute", mute)):
            columns[name] = pieces_of(column[own], cuts)
        for name, column in (("token", token), ("pos", pos), ("cell", cell)):
            columns[name] = pieces_of(column[order], cuts)
        names = [c.split()[0] for c in DEAL.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.unpackbits(tokens.value).view(bool) if tokens else None
        ask = np.unpackbits(asked.value).view(bool) if asked else None
        held, size = [], 0
        for batch in batches:
            for lines, prefixes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc, sub, line, sig, parity, n, more = unpack_lines(lines)
                (token,) = unpack(prefixes, PREFIX)
                p = prefix_sizes(n, more, t)
                own, pos = np.repeat(np.arange(len(n)), p), spans(np.zeros(len(n), np.int64), p)
                mute = np.zeros(len(n), np.int64) if ask is None else 1 - is_marked(ask, doc, line).astype(np.int64)
                if use is not None:
                    chosen = np.flatnonzero(use[token_marks(token, len(use))])
                    token, own, pos = token[chosen], own[chosen], pos[chosen]
                row, cell = cells(token, sig[own])
                token, own, pos = token[row], own[row], pos[row]
                part = (((token.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64) + cell).astype(np.int32)
                held.append(((doc, sub, line, sig, parity, n, mute), (token, own.astype(np.int32), pos.astype(np.int32), part, cell.astype(np.int32))))
                size += len(token)
                if size >= DEALT:
                    yield from together(held)
                    size = 0
        if held:
            yield from together(held)

    return rows.select("lines", "prefixes").mapInArrow(tidy(run), DEAL)


def dealt_columns(packed: list) -> list[np.ndarray]:
    """token, sig, parity, doc, line, sub, n, pos, mute and cell of the rows of a part, each as in DEAL without its part."""
    first, *raws = zip(*packed, strict=True)
    got = dict(zip((*OUTRIGHT, *SMALL), raws, strict=True))
    sizes = [len(raw) // 4 for raw in got["token"]]
    small = {w.itemsize: w for w in map(np.dtype, WIDTHS)}

    def narrow(name: str) -> list[np.ndarray]:
        return [np.frombuffer(raw, small[len(raw) // n]) if raw else np.zeros(n, np.int8) for raw, n in zip(got[name], sizes, strict=True)]

    out = {name: np.concatenate([np.frombuffer(raw, kind) for raw in got[name]]) for name, kind in OUTRIGHT.items()}
    out |= {name: np.concatenate(narrow(name)).astype(np.int64) for name in SMALL[1:]}
    out["doc"] = np.concatenate([np.cumsum(x, dtype=np.int64) + at for x, at in zip(narrow("docs"), first, strict=True)])
    return [out[c] for c in ("token", "sig", "parity", "doc", "line", "sub", "n", "pos", "mute", "cell")]


def meet(rows: DataFrame, t: float, first: int | None, crowded: dict[int, int], total: int, tokens=None, asked=None, again: bool = True) -> DataFrame:
    """What lines meet by shared prefix tokens, with the columns MET: (sig, par) is a line, (other, opar) an
    earlier partner of it. Rows without a partner tell of lines that were compared and may match, or, with a
    token, that there are more partners of the line at it than ``first``. ``total``: how many prefix tokens there are.

    ``tokens`` and ``asked``: broadcast marks of the tokens to use and of the lines to find partners for, if not
    all. ``again``: whether to tell of equal lines.
    """
    ranges = max(256, 4 * partitions(rows.sparkSession), total // PART)

    def told(columns: dict) -> pa.RecordBatch:
        size = len(columns["doc"])
        kinds = {"line": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(size, pa.int64()) for c in NAMES], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Part by part: a task's parts are one after the other, and only one of them is unpacked."""
        held, now = [], None
        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # packed: as in DEAL
                if part != now:
                    if held:
                        yield from search(held)
                    held, now = [], part
                held.append(packed)
        if held:
            yield from search(held)

    def search(packed: list) -> Iterator[pa.RecordBatch]:
        columns = dealt_columns(packed)
        packed.clear()
        if columns[9].any():  # cells of crowded tokens are tokens of their own
            columns[0] = columns[0].astype(np.uint64) | columns[9].astype(np.uint64) << np.uint64(32)

        def shared(order):
            """Of rows in order of tokens those that share theirs."""
            if not len(order):
                return order
            same = columns[0][order[1:]] == columns[0][order[:-1]]
            return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]

        def by(high, low):
            """Rows in order of two numbers of 32 bits, or of any."""
            return np.argsort((high.astype(np.uint64) << np.uint64(32)) | low, kind="stable") if high.dtype.itemsize == 4 else np.lexsort((low, high))

        token, sig, parity, doc, line, sub, n, pos, _, _ = columns
        order = shared(by(token, sig >> np.uint64(32)))
        # Equal lines meet at every token: the oldest stands for all, the others are told of once.
        equal = ~differ(order, token, sig, parity, n)
        run_of = np.cumsum(np.concatenate([[True], ~equal])) if len(order) else np.zeros(0, np.int64)
        many = np.flatnonzero(np.concatenate([[False], equal]) | np.concatenate([equal, [False]])) if len(order) else np.zeros(0, np.int64)
        own = order[many]
        by_age = np.lexsort((line[own], sub[own], doc[own], run_of[many]))
        own, runs = own[by_age], run_of[many][by_age]
        first_of = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
        oldest = own[np.repeat(first_of, np.diff(np.append(first_of, len(runs))))]
        keep = np.ones(len(token), bool)
        keep[own[own != oldest]] = False
        same_place = (doc[own] == doc[oldest]) & (sub[own] == sub[oldest]) & (line[own] == line[oldest])
        repeats = own[(pos[own] == 0) & ~same_place] if again else own[:0]
        if len(repeats):
            s, p = sig[repeats].view(np.int64), parity[repeats].view(np.int64)
            yield told({"doc": doc[repeats], "sub": sub[repeats], "line": line[repeats], "sig": s, "par": p, "other": s, "opar": p})
        order = order[keep[order]]
        order = shared(order[by(token[order], n[order].astype(np.uint64))])
        token, sig, parity, doc, line, sub, n, pos, mute, _ = (c[order] for c in columns)
        del columns
        if not len(token):
            return
        place = lambda at: {"doc": doc[at], "sub": sub[at], "line": line[at], "sig": sig[at].view(np.int64), "par": parity[at].view(np.int64)}
        for late, early, *fit in partners(token, doc, sub, line, parity, n, pos, mute == 0, t, first):
            if late is None:
                total, fit = early, np.flatnonzero(fit[0])
                break
            # The same partner by several tokens counts once.
            order = np.lexsort((parity[early], sig[early], line[late], sub[late], doc[late]))
            late, early = late[order], early[order]
            keep = np.ones(len(late), bool)
            keep[1:] = differ(late, doc, sub, line) | differ(early, sig, parity)
            late, early = late[keep], early[keep]
            yield told(place(late) | {"other": sig[early].view(np.int64), "opar": parity[early].view(np.int64)})
        if not len(fit):
            return
        open_ = np.flatnonzero(total > first) if first is not None else fit[:0]
        yield told(place(open_) | {"token": token[open_].astype(np.int64) & 0xFFFFFFFF})
        # One row for each line that fits any other, with no partner.
        order = fit[np.lexsort((line[fit], sub[fit], doc[fit]))]
        yield told(place(order[np.concatenate([[True], differ(order, doc, sub, line)])]))

    got = deal(rows, t, ranges, crowded, tokens, asked).repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), MET)
    return got.distinct()


MAPS = [f"map{i}" for i in range(4)]
SETS = "s long, p long, n int, " + ", ".join(f"{m} long" for m in MAPS) + ", tokens array<long>"


def token_sets(involved: DataFrame, docs: DataFrame) -> DataFrame:
    """Sizes, 256-bit parity maps and token hashes of the lines (doc, sub, line); some others may be among
    them, and a set twice."""
    spark = docs.sparkSession
    marks = marked_lines(involved)
    shared = spark.sparkContext.broadcast(marks)
    if marks is None:  # then texts are shuffled to what is asked of them
        asked = involved.groupBy("doc", "sub").agg(F.collect_set("line").alias("lines"))
        docs = docs.join(asked, ["doc", "sub"]).select("doc", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool) if shared.value is not None else None
        for batch in portions(batches):
            raw, feeds, owner, number = lines_in([x or b"" for x in batch.column(1).to_pylist()])
            if wanted is not None:
                own = np.flatnonzero(is_marked(wanted, batch.column(0).to_numpy()[owner], number))
            else:
                lists = batch.column(2)
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                own = np.sort(np.searchsorted(owner, row) + lists.flatten().to_numpy())
            if not len(own):
                continue
            begin = np.concatenate([[0], feeds[:-1] + 1])[own]
            raw = raw[spans(begin, feeds[own] + 1 - begin)]
            h, start = folded_hashes(raw.tobytes())
            h, start, n, _ = sets_of(h, np.searchsorted(np.flatnonzero(raw == 10), start), None)
            if not len(start):
                continue
            sig, parity = np.add.reduceat(mix(h), start), np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), start)
            bit, part = np.uint64(1) << (h >> np.uint64(56) & np.uint64(63)), h >> np.uint64(62)
            maps = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), start) for i in range(4)]
            order = np.lexsort((n, parity, sig))
            first = order[np.concatenate([[True], differ(order, sig, parity, n)])]
            at = h[spans(start[first], n[first])]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n[first])]).astype(np.int32))
            columns = [sig[first], parity[first], *(m[first] for m in maps)]
            columns = [pa.array(c.view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(n[first].astype(np.int32)), *columns[2:], pa.ListArray.from_arrays(offsets, pa.array(at.view(np.int64)))], [c.split()[0] for c in SETS.split(", ")])

    return docs.mapInArrow(tidy(run), SETS)


def with_sets(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (sig, par, other, opar), each with columns of both sets, named by ``_a`` and ``_b``.

    Many lines may have the same partner: partners are joined first, as the next shuffle leaves adaptive
    execution free to split them."""
    for keys, tag in ((["other", "opar"], "b"), (["sig", "par"], "a")):
        pairs = pairs.join(sets.select(F.col("s").alias(keys[0]), F.col("p").alias(keys[1]), *[F.col(c).alias(f"{c}_{tag}") for c in columns]), keys)
    return pairs


PAIR = ["sig", "par", "other", "opar"]


def close_pairs(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """PAIR and gap: the pairs whose 256-bit parity maps allow a match; gap is how much they differ."""
    both = with_sets(pairs, sets, ["n", *MAPS])
    gap = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MAPS), F.lit(0))
    bound = (F.col("n_a") + F.col("n_b")) * ((1 - t) / (1 + t)) + 1e-9
    return both.select(*PAIR, gap.alias("gap"), bound.alias("bound")).where("gap <= bound").select(*PAIR, "gap").distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Of the pairs those whose whole token sets are similar enough."""
    if (n := pairs.count()) <= BROADCAST_PAIRS:  # then only sets that are asked for need be shuffled
        ends = F.explode(F.array(F.struct(F.col("sig").alias("s"), F.col("par").alias("p")), F.struct(F.col("other").alias("s"), F.col("opar").alias("p"))))
        sets = sets.join(F.broadcast(pairs.select(ends.alias("e")).select("e.s", "e.p").distinct()), ["s", "p"], "left_semi")
    if not n:
        return pairs.select(*PAIR)
    met = with_sets(pairs.select(*PAIR), sets, ["n", "tokens"])
    least = (F.col("n_a") + F.col("n_b")) * (t / (1 + t)) - 1e-9
    return met.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= least).select(*PAIR)


def repeated_lines(docs: DataFrame, jaccard: float = JACCARD) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, text, sub): (doc, sub, n_lines), lines with tokens of all documents that have any, and
    (doc, sub, line) of all removed lines."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = count_tokens(docs, "text")
    place = np.empty(BUCKETS, np.uint32)
    place[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    rank = spark.sparkContext.broadcast(place)
    rows = materialize(line_rows(docs, rank, jaccard))
    crowded, total = crowds(rows)
    at, line = ["doc", "sub", "line"], ["sig", "par"]
    removed, held, sets, open_ = [], [], None, None
    for first in ROUNDS:
        asked = tokens = None
        if open_ is not None:
            if open_.isEmpty():
                break
            own, used = marked_lines(open_), open_.select("token").distinct()
            asked = None if own is None else spark.sparkContext.broadcast(own)
            use = marked(used, used.count(), lambda b, size: token_marks(b.column(0).to_numpy(), size))
            tokens = None if use is None else spark.sparkContext.broadcast(use)
        met = materialize(meet(rows, jaccard, first, crowded, total, tokens, asked, again=sets is None))
        involved = met.where("other is null and token is null")
        pairs = met.where("other is not null and (sig <> other or par <> opar)")
        if sets is None:
            sets = token_sets(involved.select(*at), docs).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(sets)
            removed.append(met.where("sig = other and par = opar").select(*at).distinct())
        else:
            pairs = pairs.join(open_.select(*at).distinct(), at, "left_semi")
            # In groups searched by blocks a line closes before all are compared: its partners may be new here.
            new = materialize(involved.join(sets.select(F.col("s").alias("sig"), F.col("p").alias("par")), line, "left_anti").select(*at))
            if not new.isEmpty():
                held.append(token_sets(new, docs).persist(StorageLevel.MEMORY_AND_DISK))
                sets = sets.unionByName(held[-1])
        near = materialize(close_pairs(pairs.select(*PAIR).distinct(), sets, jaccard))
        # The closest partner settles most lines; the others' partners are verified after it.
        best = near.groupBy(*line).agg(F.min_by(F.struct("other", "opar"), F.struct("gap", "other", "opar")).alias("best"))
        best = materialize(best.select(*line, "best.other", "best.opar"))
        settled = materialize(verified(best, sets, jaccard).select(*line).distinct())
        rest = materialize(near.select(*PAIR).join(settled, line, "left_anti").join(best, PAIR, "left_anti"))
        settled = materialize(settled.unionByName(verified(rest, sets, jaccard).select(*line).distinct()))
        removed.append(pairs.join(settled, line, "left_semi").select(*at).distinct())
        open_ = materialize(met.where("token is not null").join(settled, line, "left_anti").select(*at, "token"))
    for sets in held:
        sets.unpersist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                doc, sub = unpack_lines(raw)[:2]
                begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(sub[begin]), pa.array(np.diff(np.append(begin, len(doc))))], ["doc", "sub", "n"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                doc, sub, line, _, _, _, again = unpack_lines(raw)
                own = again != 0
                yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(sub[own]), pa.array(line[own].astype(np.int32))], at)

    gone = rows.select("lines").mapInArrow(tidy(repeats), "doc long, sub long, line int")
    for more in removed:
        gone = gone.unionByName(more)
    lines = rows.select("lines").mapInArrow(tidy(count), "doc long, sub long, n long").groupBy("doc", "sub").agg(F.sum("n").alias("n_lines"))
    return lines, materialize(gone.distinct())


def _texts(keyed: DataFrame, text: str) -> DataFrame:
    return keyed.select(F.col("__doc").alias("doc"), F.col(text).cast("binary").alias("text"), F.col("__sub").alias("sub"))


def without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers."""
    lines = F.split(text, "\n", -1)
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their texts' removed lines left out; all rows and columns stay."""
    keyed = keyed_rows(docs, key, text)
    gone = repeated_lines(_texts(keyed, text))[1]
    few = gone.count() <= BROADCAST_LINES
    gone = gone.groupBy("doc", "sub").agg(F.sort_array(F.collect_list("line")).alias("__removed"))
    gone = gone.withColumnsRenamed({"doc": "__gone_doc", "sub": "__gone_sub"})
    met = keyed.join(F.broadcast(gone) if few else gone, (F.col("__doc") == F.col("__gone_doc")) & (F.col("__sub") == F.col("__gone_sub")), "left")
    return met.select(*[without(F.col(c), F.col("__removed")).alias(c) if c == text else F.col(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how many lines have tokens and which line numbers are removed."""
    keyed = keyed_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    counts, gone = repeated_lines(_texts(keyed, "text"))
    gone = gone.groupBy("doc", "sub").agg(F.count("*").alias("n_removed"), F.sort_array(F.collect_list("line")).alias("removed"))
    ids = keyed.select("doc_id", F.col("__doc").alias("doc"), F.col("__sub").alias("sub"))
    out = ids.join(counts.join(gone, ["doc", "sub"], "left"), ["doc", "sub"], "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.array_join(F.coalesce("removed", F.array().cast("array<int>")), ",").alias("removed_lines"))
