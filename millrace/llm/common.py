"""What several operators need: tables, shared scratch space, word hashes and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts are long, so that few of them fill a Python worker.
BATCH_ROWS = 512
#: Bytes of text that the vectorised code handles at once.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the driver and all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries within delete their shuffle files as they end; the session's setting comes back after them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and the shuffle files of the write go.

    Left to the driver's collections, more than half of the shuffle files of a large write were seen to outlive it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def read_from_files(df: DataFrame) -> DataFrame:
    """df if it is files read row by row, which every pass over it partitions alike; else df written and read back."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter") and not node.nodeName().startswith(("LogicalRelation", "Relation")):
            return materialize(df, "rows")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return df


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df._millrace_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now; else they stay until the driver's next collection.

    After large queries on a cluster, one collection alone was seen to release nothing; the next one, right after it, did.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str | list[str], limit: int) -> DataFrame:
    """rows with the columns of keyed (key, n, ...), null where it lacks the key; keyed has a row for each key.

    n tells how many rows have a key. At most limit keys are broadcast, those with the largest n; where there are
    more, rows of the others join by key, so that no task gets very many rows of one key.
    """
    keys = [key] if isinstance(key, str) else key
    more = keyed.count() > limit
    hot = (keyed.orderBy(F.desc("n"), *keys).limit(limit) if more else keyed).drop("n").withColumn("_hot", F.lit(True))
    out = rows.join(F.broadcast(hot), keys, "left")
    if not more:
        return out.drop("_hot")
    rest = out.where("_hot is null").select(rows.columns).join(keyed.drop("n"), keys, "left")
    return out.where("_hot").drop("_hot").unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Word hashes -----------------------------------------------------------------------------------------

_POW = 4096
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_POSITION = _rng.integers(1, 2**63, _POW, dtype=np.uint64) | np.uint64(1)
#: ASCII white space and lower case.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space and ASCII punctuation, for words without it.
PUNCTUATED = _SPACE.copy()
PUNCTUATED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _segment_words(a: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of an array of bytes."""
    a = _LOWER[a]
    word = np.empty(len(a) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(breaks[a], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    size = end - start
    at = np.arange(len(a))
    at[: start[0]] = 0
    # from each start on, count from zero
    base = np.zeros(len(a), np.int64)
    base[start[0]] = start[0]
    base[start[1:]] = np.diff(start)
    at = (at - np.cumsum(base)) & (_POW - 1)
    x = _BYTE[a] * _POSITION[at]
    x[breaks[a]] = 0
    h = np.add.reduceat(x, start)
    return start, end, mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: for each word its text's index, hash, and start and end byte in that text.

    Words are maximal runs of bytes that are not in breaks, compared with A-Z in lower case. Works through
    segments that end at white space, so that temporary arrays stay small however long a text is.
    """
    joined = b"\n".join(texts) + b"\n"
    whole = np.frombuffer(joined, np.uint8)
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    starts, ends, hashes, low = [], [], [], 0
    while low < len(whole):
        high = min(low + CHUNK_BYTES, len(whole))
        while high < len(whole) and not _SPACE[whole[high - 1]]:
            ahead = np.flatnonzero(_SPACE[whole[high : high + 65536]])
            high = high + int(ahead[0]) + 1 if len(ahead) else min(high + 65536, len(whole))
        s, e, h = _segment_words(whole[low:high], breaks)
        starts.append(s + low)
        ends.append(e + low)
        hashes.append(h)
        low = high
    start, end, h = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, hashes))
    doc = np.searchsorted(offset, start, side="right") - 1
    return doc, h.astype(np.uint64), start - offset[doc], end - offset[doc]


_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each of the first len(h) - n + 1 words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += mix(h[k : len(h) - n + 1 + k] ^ _GRAM[k]) * _GRAM[k]
    return mix(out)


def chunks(rows: Iterable, size, limit: int = CHUNK_BYTES) -> Iterator[list]:
    """Lists of rows of about limit bytes in all; size(row) gives a row's bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
    held = None
    release()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on, and their next task may need less."""
    pa.default_memory_pool().release_unused()
    trim = _libc()
    if trim is not None:
        trim(0)


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def binary(column: pa.Array) -> list:
    """Values of a string or binary column as bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.to_pylist()


def map_texts(docs: DataFrame, score, columns: str, names: list[str]) -> DataFrame:
    """(doc_id, columns...) of every row of docs: score(texts) gives the arrays of the columns."""

    def run(batches):
        for batch in batches:
            for part in chunks(zip(batch.column(0).to_pylist(), binary(batch.column(1))), lambda r: len(r[1] or b"")):
                found = score([r[1] or b"" for r in part])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *map(pa.array, found)], ["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {columns}")


def filter_texts(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, all columns, whose texts keep(texts) marks; null texts count as empty."""
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            low = 0
            for part in chunks([t or b"" for t in binary(batch.column(text))], len):
                yield batch.slice(low, len(part)).filter(pa.array(np.asarray(keep(part), bool)))
                low += len(part)

    return docs.mapInArrow(run, docs.schema)


# Connected components --------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges a-b: each node that isn't the least of its component, with that least node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(node)))
    return node[own], node[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition by fewer that join the same nodes; holds a bounded number."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
            if len(a) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = np.empty(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent: found by one job."""
    many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    deep = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return not many.union(deep).limit(1).count()


#: Nodes with most neighbours, which are broadcast; the neighbours of any other are 2 * edges / HOT_NODES at most.
HOT_NODES = 1 << 16
#: Rows of a node below which it is never hot.
LEAST_HOT = 256


def beside_least(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """both (a, b) with the columns of least (a, n, ...): n counts the rows of a in both.

    Of the nodes with more than a certain number of rows there are at most HOT_NODES: they are broadcast, so that
    no task gets all rows of one node.
    """
    bound = max(LEAST_HOT, 2 * edges // HOT_NODES)
    hot = least.where(F.col("n") > bound).withColumn("hot", F.lit(True))
    marked = both.join(F.broadcast(hot), "a", "left")
    return marked.where("hot is null").select("a", "b").join(least.where(F.col("n") <= bound), "a").drop("n").unionByName(marked.where("hot").drop("n", "hot"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b: long); component is the least node reachable.

    Alternates the large-star and small-star steps, each on partitions that are first contracted to forests,
    until every node has the root of its component as its only parent; so many rounds as it takes, about the
    logarithm of the longest path. Every round is written to the shared folder, so no lineage grows and a lost
    executor costs one round. Edges with nulls are ignored. No edges give no rows.
    """
    if edges.columns != ["a", "b"]:
        raise ValueError("edges need the columns a and b")
    clean = edges.where("a is not null and b is not null and a <> b")
    now = materialize(clean.mapInArrow(_contract, "a long, b long"), "cc")
    while not _settled(now):
        count = now.count()
        both = now.union(now.select("b", "a")).toDF("a", "b")
        # large star: larger neighbours of a node point to the least of its neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        down = materialize(beside_least(both.where("b > a"), least, count).selectExpr("b a", "m b"), "star")
        # small star: a node's smaller neighbours and the node itself point to the least of them
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = beside_least(down, least, count).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialize(small.mapInArrow(_contract, "a long, b long"), "cc")
        discard(now, down)
        now = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.toDF("node", "component").unionByName(roots)
