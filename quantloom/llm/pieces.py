"""SentencePiece encoding with byte offsets, and decoding.

The source text is normalised by longest-prefix matches in the model's compiled character map (a
double-array trie) and its user-defined symbols; every normalised byte remembers the source byte it came
from, so each piece is projected to a span of original bytes. There is one way for all models: what no entry
of the map can start with is copied in bulk (all of it, where the map is empty). Normalised text is cut where
no piece of the vocabulary can reach across, and each distinct stretch is segmented once, by the library, and
kept in a bounded pool; documents are then put together from pooled stretches with array operations.

Defined results: a null text counts as empty; an empty text has no pieces and decodes to the empty
string; a very long text is encoded whole. Only the id and text columns are read, so other columns may have any
name; repeated rows give repeated results, an empty table gives an empty one, null ids are passed on.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL, bounded_batches, portions, table, tidy
from .tokens import slices

SPACE = "▁"
_MARK = SPACE.encode()
#: Distinct stretches that a worker keeps before it starts its pool anew.
POOL = 100_000


class CharMap:
    """Longest-prefix rewriting by a compiled character map; empty: every character stays itself."""

    def __init__(self, blob: bytes):
        self.units, self.strings = None, b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.strings = blob[4 + n :]

    def starts(self) -> np.ndarray:
        """Which bytes an entry can start with."""
        out = np.zeros(256, bool)
        if self.units is not None:
            at = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
            out[[b for b in range(1, 256) if at ^ b < len(self.units) and self.units[at ^ b] & 0x800000FF == b]] = True
        return out

    def longest(self, key: bytes, start: int) -> tuple[int, bytes] | None:
        """(matched bytes, replacement) of the longest entry that is a prefix of key[start:]."""
        if self.units is None:
            return None
        units, found = self.units, None
        at = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for i in range(start, len(key)):
            at ^= key[i]
            unit = units[at]
            if unit & 0x800000FF != key[i]:
                break
            at ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - start, units[at] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class PieceCodec:
    """Encodes and decodes as the model says. Offsets are bytes of the original UTF-8 text."""

    def __init__(self, model: str | bytes):
        """``model``: a model file's path, or its content."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        content = model
        if isinstance(model, str):
            with open(model, "rb") as f:
                content = f.read()
        model = pb.ModelProto()
        model.ParseFromString(content)
        spec = model.normalizer_spec
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        kinds = pb.ModelProto.SentencePiece
        self.user = sorted((p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.starts = self.map.starts()
        self.starts[[u[0] for u in self.user]] = True
        self.pieces = [p.piece for p in model.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.unknown_surface = model.trainer_spec.unk_surface
        #: Bytes of normalised text that a piece stands for; an unknown's are taken from the stretch.
        self.width = np.array([1 if i in self.byte_of else len(p.encode()) for i, p in enumerate(self.pieces)], np.int32)
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        feed = any("\n" in p for p in self.pieces)
        suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.cut = None if crosses or feed or suffix or not self.escape else re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
        model.normalizer_spec.Clear()
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._empty_pool()

    def _empty_pool(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.begin, self.decoded = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    # -- normalisation -----------------------------------------------------------------------------

    def _rewritten(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text's bytes after the character map, and where each came from."""
        todo = np.flatnonzero(self.starts[raw] & (raw & 0xC0 != 0x80))
        if not len(todo):
            return raw, np.arange(len(raw))
        text, parts, origins, at = raw.tobytes(), [], [], 0
        for start in todo.tolist():
            if start < at:
                continue
            hit = next(((len(u), u) for u in self.user if text.startswith(u, start)), None) or self.map.longest(text, start)
            if hit is None:
                continue
            parts += [text[at:start], hit[1]]
            origins += [np.arange(at, start), np.full(len(hit[1]), start)]
            at = start + hit[0]
        return np.frombuffer(b"".join([*parts, text[at:]]), np.uint8), np.concatenate([*origins, np.arange(at, len(text))])

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the source byte it came from."""
        source = np.frombuffer(text.encode(), np.uint8)
        raw, origin = self._rewritten(source)
        space = raw == 32
        if self.trim:  # no spaces at the beginning, and one of a run
            solid = np.flatnonzero(~space)
            keep = ~space
            keep[1:] |= ~space[:-1]
            keep[: solid[0] if len(solid) else len(raw)] = False
            raw, origin, space = raw[keep], origin[keep], space[keep]
        if not len(raw):
            return "", np.array([len(source)], np.int64)
        mark = _MARK if self.escape else b" "
        if self.escape:
            size = np.where(space, len(mark), 1)
            first = (np.cumsum(size) - size)[space]
            raw, origin = np.repeat(raw, size), np.repeat(origin, size)
            for i, b in enumerate(mark):
                raw[first + i] = b
        lead = mark if self.prefix else b""
        out, align = lead + raw.tobytes(), np.concatenate([np.full(len(lead), origin[0]), origin, [len(source)]])
        size = len(out)
        while self.trim and out.endswith(mark, 0, size):  # marks of the text itself too
            size -= len(mark)
        return out[:size].decode(), align[: size + 1]

    # -- segmentation ------------------------------------------------------------------------------

    def _pool(self, stretches: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the stretches in the pool, which learns those that it hasn't met."""
        if len(self.number) > POOL:
            self._empty_pool()
        new = list(dict.fromkeys(s for own in stretches for s in own if s not in self.number))
        if new:
            got = self.segmenter.encode(new, num_threads=1)
            base = len(self.number)
            self.number.update(zip(new, range(base, base + len(new)), strict=True))
            flat = np.fromiter((i for ids in got for i in ids), np.int32)
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
            self.flat, self.begin = np.concatenate([self.flat, flat]), np.concatenate([self.begin, self.begin[-1] + ends])
            self.decoded += [self._surface(ids) for ids in got]
        number = self.number
        return [np.fromiter(map(number.__getitem__, own), np.int64, len(own)) for own in stretches]

    def _surface(self, ids: list[int]) -> str:
        """Text of ids, white space marks as spaces; the bytes of a run of byte pieces are UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_bytes_text(run))
                run = bytearray()
            if i == self.unknown:
                out.append(self.unknown_surface)
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + (_bytes_text(run) if run else "")

    def _leading(self, ids) -> int:
        """How many spaces that a text's decoding begins with go: the prefix, or, if extra white space is removed, one of
        each piece up to the first that has more."""
        gone = 0
        if not (self.prefix or self.trim):
            return 0
        for i in ids:
            if i in self.control:
                continue
            if i in self.byte_of or i == self.unknown or not self.pieces[i].startswith(SPACE):
                break
            gone += 1
            if not self.trim or self.pieces[i] != SPACE:
                break
        return gone

    def decode(self, ids: list[int]) -> str:
        return self._surface(ids)[self._leading(ids) :]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """ids of all texts, where each text's ids end, begins and ends of source spans, decoded texts."""
        normal = [self.normalize(t) for t in texts]
        pooled = self._pool([(self.cut.findall(n) if self.cut else [n]) if n else [] for n, _ in normal])
        ids, begins, ends, decoded = [], [], [], []
        for (plain, align), own in zip(normal, pooled, strict=True):
            size = self.begin[own + 1] - self.begin[own]
            total = int(size.sum())
            before = np.cumsum(size) - size
            flat = self.flat[np.repeat(self.begin[own] - before, size) + np.arange(total)]
            edge = np.concatenate([[0], np.cumsum(self.width[flat], dtype=np.int64)])
            if edge[-1] != len(align) - 1:
                edge = self._edges(flat, plain, len(align) - 1)
            ids.append(flat)
            begins.append(align[edge[:-1]].astype(np.int32))
            ends.append(align[edge[1:]].astype(np.int32))
            text = "".join(map(self.decoded.__getitem__, own.tolist()))
            decoded.append(text[self._leading(flat) :])
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.cumsum([len(x) for x in ids], dtype=np.int64), np.concatenate([*begins, np.zeros(0, np.int32)]), np.concatenate([*ends, np.zeros(0, np.int32)]), decoded

    def _edges(self, flat: np.ndarray, normal: str, total: int) -> np.ndarray:
        """Piece edges of a text with unknown pieces, whose widths the vocabulary doesn't tell."""
        got = self.segmenter.encode(normal, out_type="immutable_proto").pieces
        edge = np.cumsum([0, *(len(p.surface.encode()) for p in got)])
        if [p.id for p in got] != flat.tolist() or edge[-1] != total:
            raise RuntimeError("pieces don't cover their text")
        return edge


def _bytes_text(run: bytearray) -> str:
    """A byte that isn't part of a whole UTF-8 character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each model and worker."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, begins, ends, decoded): piece ids, their source byte spans, the decoded text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, to in slices(texts):
                part = batch.slice(at, to - at)
                ids, stops, begins, ends, decoded = own.encode_batch(texts[at:to])
                offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(decoded, pa.string())], ["key", "ids", "begins", "ends", "decoded"])

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return got.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of an encoding."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("bytes_covered"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Digests of every document's encoding and decoding."""
    return digests(encode_documents(table(spark, sf_dir, "documents"), model_path))
