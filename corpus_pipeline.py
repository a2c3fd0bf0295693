"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before it
kept, written and read again. All but the last return the columns they were given.

Rows are told apart by id and text, never by id alone, so the stages agree on odd rows:

- null ids, and ids that differing texts share: each text is judged on its own by every stage; near-duplicate
  removal keeps a row without an id only if its group has no row with one;
- rows that repeat both id and text are one document: line dedup judges it once, near-duplicate removal keeps
  one of them;
- null and empty texts (those that line dedup has emptied too) are scored like texts without words, have no
  lines to lose, are one group of near-duplicates of which one row stays, contain no benchmark item, and have
  no tokens; a null text stays null until it is encoded;
- very long texts go through whole; an empty table gives an empty result with the same columns;
- extra columns are carried along and returned, whatever their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, contamination, lines, pieces, simhash, toxicity

#: Bits in which the fingerprints of near-duplicates may differ: one more than op4's contract has, as near copies
#: whose edits move a few more shingles are to go too; fingerprints of other texts are some thirty bits apart.
NEAR = 3
#: No SQL states these stages: a trained classifier, a set-similarity join and a byte-pair encoder.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier is trained as for op7."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), toxicity.USABLE)
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one; n_chars follows the text."""
    left = lines.drop_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return left
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return left.withColumn("n_chars", size)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.one_of_each(docs, limit=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = contamination.contaminated(docs.select(row.alias("row"), "text"), common.table(spark, sf_dir, "benchmark"), "row")
    leaks = common.materialize(found.select(F.col("row").alias("__leak")).distinct())
    few = leaks.count() <= contamination.BROADCAST_CANDIDATES
    return docs.join(F.broadcast(leaks) if few else leaks, row.eqNullSafe(F.col("__leak")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their byte spans for every document."""
    return pieces.encode_documents(docs, common.MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each materialized before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
