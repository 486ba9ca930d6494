"""Near-duplicates among embeddings: hyperplane sign hashing, exact cosines, connected components.

Vectors that are equal bit by bit form one class; classes are hashed. Several tables each give a class a code
of the signs of its products with random hyperplanes. Code length follows the number of classes, so that a
code has about `BUCKET` of them; the number of tables follows from the length, so that a pair with cosine at
the threshold shares a code in some table with probability 1 - `MISS` (closer pairs more surely). Longer codes
need more tables, so buckets are as large as their comparison stays cheap beside moving the vectors.

Classes that share a code are compared exactly, in double precision, as strips of a matrix product. A pair is
counted in the first table in which its codes agree, so counts need no list of pairs. Codes with more than
`BLOCK` classes are split into blocks, and every pair of blocks is a task of its own. Pairs that link are
reduced to a forest inside each task; its edges feed the connected components.

A table's entries carry their vectors, so `ROUND` tables are taken at a time, and their shuffle files go before
the next ones: the disk in use stays at a few copies of the vectors however many tables there are.

Null vectors, vectors with null or non-finite components and zero vectors link with nothing. Vectors of
different length never link. Null ids keep their rows. Repeated rows count as vectors that link. Columns
other than the id and the vector, also such with the names of results, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

THRESHOLD = 0.9
BUCKET = 512
BLOCK = 8192
#: Rows of a block that are compared at once.
STRIP = 512
MISS = 0.003
#: Tables of a round.
ROUND = 4
#: Codes of more than BLOCK classes, and classes of many vectors, that are broadcast.
HOT = 100_000


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a code and number of tables for n classes."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / bucket)), 3, 40))
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(miss) / np.log1p(-same)))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes (rows x tables) of the rows of x."""
    planes = np.random.default_rng([x.shape[1], bits, 7]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def compare(x: np.ndarray, code: np.ndarray, size: np.ndarray, table: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partners of each row (copies counted), and for each row the least row that it is joined to.

    Compares the rows in left with those in right, which are the same or have none in common. A pair counts if its
    cosine reaches the threshold and its codes do not agree in an earlier table.
    """
    norm = np.linalg.norm(x, axis=1)
    n, label = np.zeros(len(x), np.int64), np.arange(len(x))
    same = left is right
    for low in range(0, len(left), STRIP):
        rows = left[low : low + STRIP]
        cols = right[low:] if same else right  # a pair counts once
        near = (x[rows] @ x[cols].T) >= THRESHOLD * norm[rows][:, None] * norm[cols][None]
        if same:
            near[:, : len(rows)] = np.triu(near[:, : len(rows)], 1)
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            continue
        rows, near = rows[some], near[some]
        for k in range(table):
            near &= code[rows, k][:, None] != code[cols, k][None]
        n[rows] += near @ size[cols]
        n[cols] += size[rows] @ near
        # first one partner of each row; of the rest only pairs that this leaves apart
        for pairs in (lambda: (np.flatnonzero(near.any(axis=1)), near.argmax(axis=1)[near.any(axis=1)]), lambda: np.nonzero(near & (label[rows][:, None] != label[cols][None]))):
            a, b = pairs()
            if len(a):
                child, root = common.forest(label[rows[a]], label[cols[b]])
                to = np.arange(len(x))
                to[child] = root
                label = to[label]
    return n, label


def _compared(bits: int, tables: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, n, root): partners of each node that one task counts, and the forest of its links."""
        held = list(batches)
        node, size, vec, own, table, i, j, width, wide = (np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in held]) for c in ("node", "size", "vec", "own", "tab", "i", "j", "dim", "wide"))
        if len(node) < 2:
            return
        x = np.frombuffer(b"".join(vec), np.float64 if wide[0] else np.float32).reshape(-1, width[0]).astype(float)
        code = codes(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables) if table[0] else np.empty((len(x), 0), np.int64)
        left, right = (np.flatnonzero(own == k) for k in (i[0], j[0]))
        n, label = compare(x, code, size, int(table[0]), left, left if i[0] == j[0] else right)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[label[some]])], ["node", "n", "root"])

    return pairs


def _vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vec, dim, wide): vec holds the components' bytes, null for vectors that link with nothing."""
    wide = "double" in embeddings.schema[vector_column].dataType.simpleString()
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            out, dim = [], []
            for v in batch.column(1):
                raw = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and 0 < np.dot(x.astype(float), x) < np.inf:
                        raw = (x + 0).tobytes()
                out.append(raw)
                dim.append(0 if raw is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dim, pa.int32()), pa.array([wide] * len(out))], ["vec_id", "vec", "dim", "wide"])

    return embeddings.selectExpr(f"cast(`{id_column}` as long) vec_id", f"`{vector_column}` v").mapInArrow(run, "vec_id long, vec binary, dim int, wide boolean")


def near_duplicates(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = common.materialize(_vectors(embeddings, id_column, vector_column).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))), "vectors")
    spark = rows.sparkSession
    classes = rows.where("node is not null").groupBy("node", "vec", "dim", "wide").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    known = common.materialize(classes, "known")
    bits, tables = plan(known.count())
    found = [_round(known, bits, tables, low) for low in range(0, tables, ROUND)]
    linked = found[0]
    for more in found[1:]:
        linked = linked.unionByName(more)
    count = linked.groupBy("node").agg(F.sum("n").alias("n"))
    parts = common.connected_components(linked.selectExpr("node a", "root b"))
    named = known.select("node", "size", "least").join(count, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # n: rows of a class
    named = common.materialize(named.join(lowest, "component").select("node", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.col("size").alias("n")), "named")
    common.release_shuffles(spark)
    out = common.join_hot(rows.where("node is not null").select("vec_id", "node"), named, "node", HOT).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("node is null").selectExpr("vec_id", "0L n_links", "cast(null as long) component_id"))
    return out.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _round(known: DataFrame, bits: int, tables: int, low: int) -> DataFrame:
    """(node, n, root) of the pairs that are found first in the tables from low on, up to ROUND of them."""
    some = range(low, min(low + ROUND, tables))

    def spread(batches, with_vectors):
        for batch in batches:
            dim, vec = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            wide = batch.column("wide").to_pylist()
            c = np.empty((len(vec), len(some)), np.int64)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.frombuffer(b"".join(vec[k] for k in at), np.float64 if wide[0] else np.float32).reshape(-1, d).astype(float)
                c[at] = codes(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables)[:, some.start : some.stop]
            for k, t in enumerate(some):
                cols = {"dim": batch.column("dim"), "tab": pa.array(np.full(len(vec), t, np.int32)), "code": pa.array(c[:, k])}
                if with_vectors:
                    cols |= {name: batch.column(name) for name in ("node", "vec", "wide", "size")}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    key = ["dim", "tab", "code"]
    schema = "dim int, tab int, code long"
    held = known.select("dim", "vec", "wide").mapInArrow(lambda b: spread(b, False), schema).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    big = common.materialize(held.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")), "big")
    entry = known.drop("least").mapInArrow(lambda b: spread(b, True), f"{schema}, node long, vec binary, wide boolean, size long")
    own = common.join_hot(entry, big, key, HOT).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    task = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).drop("o")
    found = common.materialize(task.groupBy(*key, "i", "j").applyInArrow(_compared(bits, tables), "node long, n long, root long"), "links")
    common.release_shuffles(known.sparkSession)
    return found
