"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors within cosine c of each other are within eps = sqrt(2 - 2c). They are projected on leading
principal dimensions, put in the lexicographic order of grid cells eps wide, and cut into intervals of
that sequence. Only intervals whose bounding boxes come within eps meet; two intervals are joined by
halving them again and again, skipping halves that are provably distant, and comparing what is left in
double precision. Only the principal dimensions are fitted on a bounded sample (``FIT`` vectors): they
decide how much is skipped, never what is found.

Intervals hold vectors of ``INTERVAL`` bytes in the type that they came in: the more vectors travel together,
the fewer pairs of intervals carry them, and the recursion does the skipping within. Boxes meet by the cells
of the first dimension, in a join that adaptive execution splits where a label has very many boxes in a cell;
pairs of intervals are dealt evenly. What a task holds is two intervals, whatever the label's size; a label without structure in
its principal dimensions is compared pair by pair, as for any exact join.

Equal vectors of a label are one node with a multiplicity. An interval pair hands on each node's number
of links and stars round smallest connected nodes, not its pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null
label or id, link with nothing and are components of their own; vectors of different lengths don't link;
repeated rows are equal vectors; an empty table gives an empty result. Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table, tidy
from .components import components, local_roots

COSINE = 0.93
#: Principal dimensions kept, those that make cells, bytes of an interval's vectors, vectors compared at once.
DIMENSIONS, CELLS, INTERVAL, LEAF = 8, 4, 1 << 20, 128
FIT = 4096
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one without over- or underflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def principal(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each vector length, its leading principal dimensions as columns."""
    out = {}
    for d in {len(v) for v in sample}:
        rows = unit(np.stack([v for v in sample if len(v) == d]))
        centred = rows - rows.mean(axis=0)
        out[d] = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :DIMENSIONS]
    return out


def axes(fitted: dict[int, np.ndarray], d: int) -> np.ndarray:
    """Lengths that the sample didn't have are projected on their first coordinates."""
    return fitted[d] if d in fitted else np.eye(d)[:, :DIMENSIONS]


def gap(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance of two bounding boxes."""
    apart = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((apart * apart).sum())


def join_intervals(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of unit vectors of a and b at ``cosine`` or more; pa_ and pb are projections."""
    reach = 2 - 2 * cosine + SLACK
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        x, y = pa_[i:j], pb[k:m]
        if gap(x.min(0), x.max(0), y.min(0), y.max(0)) > reach:
            continue
        if j - i > LEAF or m - k > LEAF:
            if j - i >= m - k:
                half = (i + j) // 2
                todo += [(i, half, k, m), (half, j, k, m)]
            else:
                half = (k + m) // 2
                todo += [(i, j, k, half), (i, j, half, m)]
            continue
        p, q = np.nonzero(a[i:j] @ b[k:m].T >= cosine)
        found_a.append(p + i)
        found_b.append(q + k)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_vectors(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component): other vectors of the label linked with, smallest key reachable."""
    spark = rows.sparkSession
    bounded_batches(spark)
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    good = F.col("k").isNotNull() & F.col("l").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).cast("array<float>" if "float" in rows.schema[vector].dataType.simpleString() else "array<double>").alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    usable = F.coalesce(good, F.lit(False))
    nodes = materialize(rows.where(usable).groupBy("l", "v").agg(F.min("k").alias("node"), F.count("*").alias("copies")))
    n = nodes.count()
    chance = F.pmod(F.xxhash64("node", F.lit("principal dimensions")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = nodes.where(chance < FIT / max(n, 1)).select("v").toPandas()["v"].tolist()
    fitted = spark.sparkContext.broadcast(principal([np.asarray(v) for v in sample]))
    width = float(np.sqrt(2 - 2 * cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, CELLS), np.int64)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                flat = lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)
                got = np.floor(unit(flat) @ axes(fitted.value, d)[:, :CELLS] / width)
                cells[own, : got.shape[1]] = got
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), *(pa.array(cells[:, c]) for c in range(CELLS))], ["l", "v", "node", "copies", "d", *(f"c{c}" for c in range(CELLS))])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    placed = nodes.mapInArrow(tidy(place), f"l {kinds['l']}, v {kind}, node long, copies long, d int, " + ", ".join(f"c{c} long" for c in range(CELLS)))
    order = ["l", "d", *(f"c{c}" for c in range(CELLS)), "node"]
    wide = 4 if kind == "array<float>" else 8
    typical = nodes.agg(F.coalesce(F.avg(F.size("v")), F.lit(1.0))).first()[0]
    placed = placed.repartitionByRange(max(1, -(-n * int(wide * typical + 1) // (8 * INTERVAL))), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Intervals of one label and vector length: a row each."""
        from pyspark import TaskContext

        serial, held, name = TaskContext.get().partitionId() << 32, [], None

        def out() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            label_, d = name
            vectors = np.concatenate([h[0] for h in held])
            shadow = unit(vectors) @ axes(fitted.value, d)
            node, copies = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            lo, hi = shadow.min(axis=0), shadow.max(axis=0)
            own = [[serial], [label_], [d], [lo.tolist()], [hi.tolist()], [node.tolist()], [copies.tolist()], [vectors.astype(f"<f{wide}").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, [pa.int64(), label_type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()], strict=True)], ["serial", "l", "d", "lo", "hi", "nodes", "copies", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label_type = batch.column(0).type
            labels, sizes = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            at = 0
            while at < batch.num_rows:
                room = max(LEAF, INTERVAL // (wide * sizes[at])) - sum(len(h[1]) for h in held)
                if held and (name != (labels[at], sizes[at]) or room <= 0):
                    yield out()
                    held = []
                    continue
                name = (labels[at], sizes[at])
                to = at + 1
                while to < batch.num_rows and to - at < room and (labels[to], sizes[to]) == name:
                    to += 1
                part = batch.slice(at, to - at)
                held.append((part.column(1).flatten().to_numpy().reshape(to - at, name[1]), part.column(2).to_numpy(), part.column(3).to_numpy()))
                at = to
        if held:
            yield out()

    intervals = materialize(placed.mapInArrow(tidy(cut), f"serial long, l {kinds['l']}, d int, lo array<double>, hi array<double>, nodes array<long>, copies array<long>, vectors binary"))
    # Intervals meet through the cells of the first dimension, a neighbouring cell included.
    cell = lambda c, by: F.floor(F.col(c)[0] / F.lit(width)) + by
    boxes = materialize(intervals.select("serial", "l", "d", "lo", "hi"))
    left = boxes.select(F.col("serial").alias("a"), "l", "d", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell("lo", 0), cell("hi", 0))).alias("c"))
    right = boxes.select(F.col("serial").alias("b"), "l", "d", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("c"))
    apart = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    near = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) <= 2 - 2 * cosine + SLACK
    cells = ["l", "d", "c"]
    pairs = left.join(right, cells).where(F.col("a") <= F.col("b")).where(near).select("a", "b").distinct()
    side = lambda s: intervals.select(F.col("serial").alias(s), F.col("d").alias(f"d_{s}"), F.col("nodes").alias(f"nodes_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("vectors").alias(f"vectors_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "d_a", "nodes_a", "copies_a", "vectors_a", "nodes_b", "copies_b", "vectors_b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, d, nodes_a, copies_a, raw_a, nodes_b, copies_b, raw_b = (c[r].as_py() for c in batch.columns)
                x, y = (unit(np.frombuffer(raw, f"<f{wide}").reshape(-1, d)) for raw in (raw_a, raw_b))
                turn = axes(fitted.value, d)
                p, q = join_intervals(x, y, x @ turn, y @ turn, cosine)
                if a == b:
                    p, q = p[p < q], q[p < q]
                if not len(p):
                    continue
                nodes_a, copies_a, nodes_b, copies_b = map(np.asarray, (nodes_a, copies_a, nodes_b, copies_b))
                root = dict(zip(*(z.tolist() for z in local_roots(nodes_a[p], nodes_b[q])), strict=True))
                for own, other, nodes_, copies in ((p, q, nodes_a, copies_b), (q, p, nodes_b, copies_a)):
                    links = np.bincount(own, copies[other], len(nodes_)).astype(np.int64)
                    has = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes_[has]), pa.array(links[has]), pa.array([root[i] for i in nodes_[has].tolist()], pa.int64())], ["node", "links", "root"])

    told = materialize(met.mapInArrow(tidy(join), "node long, links long, root long").groupBy("node", "root").agg(F.sum("links").alias("links")))
    summed = told.groupBy("node").agg(F.sum("links").alias("links"))
    if told.isEmpty():  # then there is nothing to connect
        nodes = nodes.withColumns({"links": F.lit(0).cast("long"), "component": F.col("node")})
    else:
        nodes = nodes.join(summed.join(components(told, "node", "root"), "node", "left"), "node", "left")
    nodes = materialize(nodes.select("l", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    linked = rows.where(usable).join(nodes, ["l", "v"]).select("k", "n_links", "component")
    alone = rows.where(~usable).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("k", key)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label."""
    got = near_vectors(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
