"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one, where cosine >= c is distance <= sqrt(2 - 2c). Pivots, one for every
``PER_PIVOT`` vectors of the largest label, cut the space into cells, a vector's home being its nearest pivot's.
A vector is also sent, as a guest, to every cell of higher number that the triangle inequality and the bisecting
plane of the two pivots leave within reach; so of two linked vectors with different homes one is a guest at the
other's, every pair meets once, and cells need nothing from each other. Labels part the cells further, as only
vectors of equal label compare.

Equal vectors are one row with a count before the join. A cell of more than ``BLOCK`` rows is dealt as pairs
of blocks, so a task holds two blocks at most. A block pair returns link counts and the links that connect
what is linked, never all its pairs. Rows are told apart by a key of their own, so vec_ids may repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _support as S
from .components import components

#: Rows of a block, and vectors of one label for which there is one pivot.
BLOCK = 2048
PER_PIVOT = 500
#: Bytes of the pivots, which every task holds; beyond them cells grow with the table and are dealt in blocks.
PIVOT_BYTES = 32 << 20
#: Added to distances in pruning: sqrt(2 - 2c) is off by about 2e-8 where c is near 1.
SLACK = 1e-7


def unit_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, vec: the unit vector's doubles as bytes; null where a vector can't link with anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, group in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vec = None
                if value and group is not None and None not in value:
                    v = np.array(value, "<f8")
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        v = v / top
                        vec = (v / math.sqrt(float(v @ v)) + 0.0).tobytes()
                out.append(vec)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    cols = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in cols.schema}
    return cols.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f8") for v in column.to_pylist()])


def _cells(rows: DataFrame, reach: float, pivots) -> DataFrame:
    """label, dim, cell, home, rid, vec, n: every vector at home and as a guest."""
    near = reach + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column(2).to_pylist()])
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                p = pivots.value.get(int(dim))
                step = len(which) if p is None else max(1, (1 << 22) // len(p))
                for part in (batch.take(pa.array(which[i : i + step])) for i in range(0, len(which), step)):
                    if p is None:
                        row = np.arange(part.num_rows)
                        cell, home = np.zeros(len(row), int), np.ones(len(row), bool)
                    else:
                        x = _matrix(part.column(2))
                        d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
                        own = d.argmin(axis=1)
                        mine = d[np.arange(len(x)), own][:, None]
                        between = np.sqrt(np.maximum(0, 2 - 2 * (p[own] @ p.T)))
                        go = (d**2 - mine**2 <= 2 * (between + SLACK) * near) & (d - mine <= 2 * near)
                        go &= np.arange(len(p)) >= own[:, None]
                        row, cell = np.nonzero(go)
                        home = cell == own[row]
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home), part.column(1).take(at), part.column(2).take(at), part.column(3).take(at)],
                        ["label", "dim", "cell", "home", "rid", "vec", "n"],
                    )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("label", "rid", "vec", "n").mapInArrow(run, f"label {kind}, dim int, cell int, home boolean, rid bigint, vec binary, n bigint")


def _block_pair(least: float):
    def run(table: pa.Table) -> pa.Table:
        x, rid = _matrix(table.column("vec").combine_chunks()), table.column("rid").to_numpy()
        n, home, block = table.column("n").to_numpy(), table.column("home").to_numpy(), table.column("block").to_numpy()
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        near, counts = np.zeros((len(x), len(x)), bool), np.zeros(len(x), np.int64)
        for k in range(0, len(x), 512):
            hit = x[k : k + 512] @ x.T >= least
            hit[np.arange(hit.shape[0]), np.arange(k, k + hit.shape[0])] = False
            hit &= home[k : k + 512, None] | home[None, :]  # two guests meet elsewhere
            near[k : k + 512] = hit
            counts[k : k + 512] = (hit & (block[k : k + 512, None] != block[None, :]) if cross else hit) @ n
        label, fresh = np.full(len(x), -1), np.ones(len(x), bool)
        for i in np.flatnonzero(near.any(axis=1)):
            if fresh[i]:
                front = np.zeros(len(x), bool)
                front[i] = True
                while front.any():
                    label[front] = i
                    fresh &= ~front
                    front = near[front].any(axis=0) & fresh
        joined = np.flatnonzero((label >= 0) & (label != np.arange(len(x))))
        counted = np.flatnonzero(counts > 0)
        a = np.concatenate([rid[counted], rid[joined]])
        b = np.concatenate([rid[counted], rid[label[joined]]])
        return pa.table({"a": a, "b": b, "links": np.concatenate([counts[counted], np.zeros(len(joined), np.int64)])})

    return run


def distinct_vectors(units: DataFrame) -> DataFrame:
    """label, vec, least (vec_id), n, rid: a row for each different vector of a label that can link."""
    reps = units.filter("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return S.cut(reps.withColumn("rid", F.monotonically_increasing_id()), "distinct-vectors")


def cells(reps: DataFrame, least: float, per_pivot: int = PER_PIVOT) -> DataFrame:
    """The rows of ``reps`` in their cells, at home and as guests, written."""
    spark = reps.sparkSession
    most = reps.groupBy("label", F.length("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
    wanted = max(1, min(-(-(most.n or 0) // per_pivot), PIVOT_BYTES // (most["size"] or 8)))
    pivots: dict[int, list[np.ndarray]] = {}
    for r in reps.select("vec", F.xxhash64("vec").alias("o")).orderBy("o").limit(wanted).collect():  # PIVOT_BYTES at most
        pivots.setdefault(len(r.vec) // 8, []).append(np.frombuffer(bytes(r.vec), "<f8"))
    shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})
    return S.cut(_cells(reps, math.sqrt(max(0.0, 2 - 2 * least)), shared), "cells")


def near_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    A vector that is null, empty, zero or has null or non-finite components, or whose label is null, links with
    nothing and is its own component; vectors of different dimension don't compare. Repeated rows are vectors of
    their own that link with each other, and so are rows that share a vec_id: sharing it links nothing. A row
    with a null vec_id links and is counted like any other, but never names a component and is never kept.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    S.bounded_batches(spark)
    units = S.cut(unit_vectors(vectors, vec_id, embedding, label), "units")
    reps = distinct_vectors(units)
    rows = cells(reps, least, per_pivot)

    blocks = rows.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m"))
    dealt = rows.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("label", "dim", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "rid", "vec", "n")
    found = S.cut(dealt.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_block_pair(least), "a bigint, b bigint, links bigint"), "vector-links")
    S.discard(rows)

    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rid")
    group = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rid")
    known = reps.join(links, "rid", "left").join(group, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    first = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    known = S.salted_join(known, first, ["component"], reps.count(), ["rid"], "m")
    known = S.cut(known.select("label", "vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id"), "known-vectors")
    able = units.filter("vec is not null")
    out = S.salted_join(able, known, ["label", "vec"], able.count(), ["vec_id"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(units.filter("vec is null").select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id").alias("component_id")))
    kept = (F.col("vec_id") == F.col("component_id")) & F.col("vec_id").isNotNull()
    return out.select("vec_id", "n_links", "component_id", F.coalesce(kept, F.lit(False)).alias("kept"))
