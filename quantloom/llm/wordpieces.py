"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node carries a failure link (where matching goes on once the longest
match so far is popped) and the number of tokens popped on the way, so that greedy longest-match
counting reads each character once and builds no piece.

Defined results: words are stretches without white space; a word that greedy matching can't cover
counts as one unknown token; null and empty texts have no words; a very long text or word is counted whole. Only the id and text columns are read;
repeated rows give repeated results, an empty table an empty one, null ids are passed on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL, bounded_batches, portions, table, tidy

UNKNOWN = 1 << 32
#: Distinct words that a worker remembers before it starts anew.
MEMORY = 400_000


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that start words, and pieces that continue them, from a piece model or a ``##`` word list."""
    if path.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        return [p[1:] for p in plain if p[0] == "▁" and "▁" not in p[1:] and p[1:]], [p for p in plain if "▁" not in p]
    with open(path, encoding="utf-8") as f:
        plain = [x.rstrip("\n") for x in f]
    return [p for p in plain if p and not p.startswith("##")], [p[2:] for p in plain if p.startswith("##") and p[2:]]


class Automaton(dict):
    """word -> tokens of its greedy longest-match segmentation, or UNKNOWN + 1; remembers words."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str]):
        super().__init__()
        self.next: list[dict[str, int]] = [{}, {}]  # 0: where words start, 1: where they go on
        token = [False, False]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    at = self.next[at][c]
                token[at] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = deque([0, 1])
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                todo.append(to)
                if token[to]:
                    self.fail[to], self.popped[to] = 1, 1
                    continue
                back, popped = self.fail[at], self.popped[at]
                while back >= 0 and c not in self.next[back]:
                    popped += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[to], self.popped[to] = self.next[back][c], popped

    def __missing__(self, word: str) -> int:
        self[word] = got = self.count(word)
        return got

    def count(self, word: str) -> int:
        next_, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := next_[at].get(c)) is None:
                if fail[at] < 0:
                    return UNKNOWN + 1
                n += popped[at]
                at = fail[at]
            at = to
        while at > 1:
            if fail[at] < 0:
                return UNKNOWN + 1
            n += popped[at]
            at = fail[at]
        return n


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton for each vocabulary and worker."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) of each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(vocab_path)
        for batch in portions(batches):
            if len(known) > MEMORY:
                known.clear()
            words, sums = [], []
            for t in batch.column(1).to_pylist():
                own = t.split() if t else []
                words.append(len(own))
                sums.append(sum(map(known.__getitem__, own)))
            columns = [pa.array(words, pa.int64()), pa.array([s % UNKNOWN for s in sums], pa.int64()), pa.array([s // UNKNOWN for s in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_tokens", "n_unknown"])

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, n_words long, n_tokens long, n_unknown long")
    return got.withColumnRenamed("key", key)


VOCABULARY = MODEL


def op1_token_counts(spark: SparkSession, sf_dir: str, vocab_path: str = VOCABULARY) -> DataFrame:
    """Token counts of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"), vocab_path)
