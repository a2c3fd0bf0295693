"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. An item must be contained to
``CONTAINMENT`` of its distinct shingles. Items are partitioned by size: powers of two, so that a partition
has one upper size u. An item's signature is the u - ceil(0.8 u) + 1 least hashes of its shingles; the largest
of them over a partition is that partition's threshold. A document's signature for a partition is all of its
shingle hashes up to the threshold (a MinHash sketch in proportion to the document's size, so that a short
item in a very long document is no less visible), and only that is searched. By the pigeonhole principle a
document that contains an item shares a hash of the item's signature, so the search loses nothing; documents
smaller than what they must contain are left out by size. Candidates are verified by counting the distinct
shingles themselves.

All partitions and shingle widths are searched in one pass over the texts. Candidates' texts are read again
for verification: by a broadcast list where there are at most ``BROADCAST_CANDIDATES``, else by a shuffled join.

Defined results: an item of fewer than five words is one shingle of that many words; items without words
match nothing; null texts have no words; a null id is an id like any other; rows of one id are one text
each, and their shingles are counted together; repeated items give a row for each id, items that share an id
are one item with all their shingles; items with a null id are left out; very long texts are taken whole; an
empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHINGLE, CONTAINMENT = 5, 0.8
WORD = r"[\p{L}\p{N}]+"
#: Item shingles up to this many are broadcast (32 bytes each, or so); more are shuffled.
BROADCAST_SHINGLES = 200_000
#: Ids of candidates up to this many are broadcast (16 bytes each, or so); more are shuffled.
BROADCAST_CANDIDATES = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def joined(array: Column, at: Column, n: int) -> Column:
    """The n words from ``at`` on, joined by spaces."""
    return F.concat_ws(" ", *[F.get(array, at + i) for i in range(n)])


def hashed(array: Column, at: Column, n: int) -> Column:
    """Hash of a shingle by the hashes of its words."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(n)])


def item_shingles(items: DataFrame, key: str, text: str, containment: float) -> DataFrame:
    """(item, width, shingle, print, n_item, needed, partition, sketched) of the items' distinct shingles."""
    w = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width")))
    rows = w.select("item", "width", "w", at.alias("at"))
    wide = lambda f: F.coalesce(*[F.when(F.col("width") == n, f(F.col("w"), F.col("at"), n)) for n in range(1, SHINGLE + 1)])
    hashes = lambda a, i, n: F.xxhash64(*[F.xxhash64(F.get(a, i + k)) for k in range(n)])
    distinct = rows.select("item", "width", wide(joined).alias("shingle"), wide(hashes).alias("print")).distinct()
    sizes = distinct.groupBy("item").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_set("print")).alias("least"))
    partition = F.floor(F.log2("n_item")).cast("int")
    upper = F.pow(F.lit(2.0), partition + 1) - 1  # the largest size of the item's partition
    depth = (upper - F.ceil(upper * containment - 1e-9) + 1).cast("int")
    sizes = sizes.select("item", "n_item", partition.alias("partition"), F.ceil(F.col("n_item") * containment - 1e-9).cast("long").alias("needed"), F.slice("least", F.lit(1), depth).alias("sketch"))
    return distinct.join(sizes, "item").withColumn("sketched", F.array_contains("sketch", F.col("print"))).drop("sketch")


def signatures(texts: DataFrame, thresholds: dict[int, int]) -> DataFrame:
    """(doc, n_doc, width, print): the texts' shingle hashes up to the threshold of each width.

    A text is cut into words once for all widths. The signatures for the partitions of one width are nested:
    what is up to a smaller threshold is up to the largest one, which is what is given."""
    own = texts.select("doc", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))
    least = min(thresholds)
    own = own.where(F.size("w") >= least).select("doc", F.size("w").alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("at"))
    kinds = []
    for width, threshold in sorted(thresholds.items()):
        print_ = F.when(F.col("at") + width <= F.col("n"), hashed(F.col("w"), F.col("at"), width))
        kinds.append(F.struct(F.lit(width).alias("width"), print_.alias("print"), F.lit(threshold).alias("most")))
    own = own.select("doc", "n", (kinds[0] if len(kinds) == 1 else F.explode(F.array(*kinds))).alias("own")).where("own.print <= own.most")
    return own.select("doc", (F.col("n") - F.col("own.width") + 1).alias("n_doc"), "own.width", "own.print")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(key, item_key, n_shared, n_item, containment) of all items contained in documents."""
    shingles = materialize(item_shingles(items, item_key, item_text, containment))
    #: One row for each width and size partition: a few dozen.
    found = shingles.groupBy("width", "partition").agg(F.count("*").alias("n"), F.max(F.when(F.col("sketched"), F.col("print"))).alias("threshold")).collect()
    small = sum(r["n"] for r in found) <= BROADCAST_SHINGLES
    send = F.broadcast if small else (lambda df: df)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, n_shared long, n_item long, containment double")
    thresholds = {width: max(r["threshold"] for r in found if r["width"] == width) for width in {r["width"] for r in found}}
    sketch = shingles.where("sketched").select("print", "item", "needed", "width")
    met = signatures(texts, thresholds).join(send(sketch), ["width", "print"]).where("n_doc >= needed")
    pairs = materialize(met.select("doc", "item").distinct())
    suspect = pairs.select(F.col("doc").alias("own")).distinct()
    few = suspect.count() <= BROADCAST_CANDIDATES
    suspects = texts.join(F.broadcast(suspect) if few else suspect, F.col("doc").eqNullSafe(F.col("own")), "left_semi").select("doc", words(F.col("t")).alias("w"))
    hits = None
    for width in sorted(thresholds):
        own = suspects.where(F.size("w") >= width).select("doc", "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("at"))
        own = own.select("doc", joined(F.col("w"), F.col("at"), width).alias("shingle"))
        told = send(shingles.where(f"width = {width}").select("shingle", "item", "n_item", "needed"))
        part = own.join(told, "shingle")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.distinct().groupBy("doc", "item", "n_item", "needed").agg(F.count("*").alias("n_shared")).where("n_shared >= needed")
    pairs = pairs.select(F.col("doc").alias("own"), F.col("item").alias("own_item"))
    hits = hits.join(pairs, F.col("doc").eqNullSafe(F.col("own")) & (F.col("item") == F.col("own_item")), "left_semi")
    return hits.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items contained in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw2 AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS width FROM iw WHERE len(w) > 0
), ish AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, i + 1, i + width), ' ') AS shingle
  FROM (SELECT item_id, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM iw2)
), n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id
), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL
), widths AS (SELECT DISTINCT width FROM ish
), dsh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + width), ' ') AS shingle, width
  FROM (SELECT doc_id, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM dw, widths WHERE len(w) >= width)
), hits AS (
  SELECT doc_id, ish.item_id AS item_id, count(*) AS n_shared FROM dsh JOIN ish ON dsh.shingle = ish.shingle AND dsh.width = ish.width
  GROUP BY doc_id, ish.item_id
)
SELECT doc_id, hits.item_id AS item_id, n_shared, n_item, n_shared / n_item AS containment
FROM hits JOIN n ON hits.item_id = n.item_id WHERE n_shared >= ceil(n_item * {CONTAINMENT} - 1e-9)
"""
