"""Token counts of documents in flat token files without an index.

A token file is a run of unsigned little-endian ids of 16 or 32 bits; every document ends with the end-of-document
id. One file, or several whose names say their order, make a stream; documents may begin in one file and end in
another. counts() cuts every file into blocks of `BLOCK` tokens, which tasks scan on their own for the end id,
vectorised; a block yields the lengths of the documents that begin and end in it, the tokens before its first end
and after its last. Prefix sums over the blocks of a stream (window functions) number the documents and carry the
open length across the borders of blocks and files.

write() makes such files of the ids of a byte-level BPE plus one, so that `END` is 0. The files of an input
partition are a stream and hold its documents in order, `FILE_ROWS` chunks of about `CHUNK` bytes of text each;
document_counts() joins stream and ordinal to the ids that the same partitioning gives the rows. Rows that are not
read straight from files are written first, so that both passes see the same partitions; a document without a
count is an error. Files are read as one row each, so they must be smaller than 2 GB, the limit of Spark's binary
source; their blocks are cut before any Python sees them.

Null and empty texts are documents of no tokens. Null ids stay null. Repeated rows are documents of their own. Very
long texts are encoded whole. Tokens after the last end id of a stream are an open document (closed false). Files
whose length is no multiple of an id's are refused. An empty table, and empty files, give no rows. Other columns,
also such with the names of results, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import bpe, common

END = 0
BLOCK = 1 << 20
#: Bytes of text of a chunk, and chunks of a file.
CHUNK, FILE_ROWS = 1 << 20, 64


def id_bytes(vocabulary: str) -> int:
    """Bytes of an id in the files of a vocabulary."""
    return 2 if len(bpe.encoder(vocabulary).tokens) < (1 << 16) - 1 else 4


def write(docs: DataFrame, path: str, vocabulary: str, width: int | None = None) -> None:
    """Writes the texts of docs as token files below path; files part-N hold the rows of partition N."""
    width = width or id_bytes(vocabulary)

    def run(batches):
        enc, kind, end = bpe.encoder(vocabulary), f"<u{width}", bytes(width)
        for batch in batches:
            for part in common.chunks((t or "" for t in batch.column(0).to_pylist()), len, CHUNK):
                ids = [(np.frombuffer(p, "<u4") + 1).astype(kind).tobytes() for p in enc.encode_packed(part)]
                yield pa.RecordBatch.from_arrays([pa.array([end.join(ids)], pa.binary())], ["ids"])

    ids = docs.select("text").mapInArrow(run, "ids binary")
    # the text source writes bytes as they are; the zero bytes after each row are the last document's end id
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0" * width).option("maxRecordsPerFile", FILE_ROWS).text(path)


def scan_block(tokens: np.ndarray, end: int = END) -> tuple[int, int, int, np.ndarray]:
    """Ends in a block, tokens before the first and after the last end, lengths between ends."""
    at = np.flatnonzero(tokens == end)
    if not len(at):
        return 0, len(tokens), len(tokens), at
    return len(at), int(at[0]), len(tokens) - int(at[-1]) - 1, np.diff(at) - 1


def counts(spark: SparkSession, path: str, end: int = END, block: int = BLOCK, width: int = 2, stream=None) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document of the token files below path.

    stream: columns for the stream of a file and its place in it, by the column path; each file is its own without.
    """
    name, place = stream or (F.col("path"), F.lit(0))

    def scan(batches):
        for batch in batches:
            for file, at, k, data in zip(*(batch.column(c) for c in range(4))):
                raw = data.as_buffer()
                if raw.size % width:
                    raise ValueError(f"{file} ends within an id")
                part = np.frombuffer(raw, f"<u{width}")
                n, lead, tail, inner = scan_block(part, end)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([at.as_py() << 32 | k.as_py()]), pa.array([len(part)]), pa.array([n]), pa.array([lead]), pa.array([tail]), pa.array([inner.astype("<i8").tobytes()], pa.binary())], ["file", "block", "n", "ends", "lead", "tail", "inner"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select(name.alias("file"), place.cast("long").alias("place"), "content")
    step = block * width
    cut = files.selectExpr("file", "place", f"posexplode(transform(sequence(0, cast((length(content) - 1) div {step} as int)), k -> substring(content, k * {step} + 1, {step}))) as (k, part)")
    blocks = cut.selectExpr("file", "place", "cast(k as long) k", "part").mapInArrow(scan, "file string, block long, n long, ends long, lead long, tail long, inner binary")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    stitched = (
        blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("open", F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail")))
        .withColumn("carry", F.col("start") - F.coalesce(F.max("open").over(before), F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("final", F.lead("block").over(order).isNull())
    )

    def expand(batches):
        for batch in batches:
            for file, n_ends, lead, tail, inner, carry, first, final in zip(*(batch.column(c).to_pylist() for c in ("file", "ends", "lead", "tail", "inner", "carry", "first", "final"))):
                size = np.concatenate([[carry + lead], np.frombuffer(inner, "<i8")]) if n_ends else np.empty(0, np.int64)
                rest = tail if n_ends else carry + lead
                closed = [True] * len(size)
                if final and rest:
                    size, closed = np.append(size, rest), [*closed, False]
                if len(size):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(size)), pa.array(np.arange(len(size)) + first), pa.array(size.astype(np.int64)), pa.array(closed)], ["file", "ordinal", "n_tokens", "closed"])

    return stitched.select("file", "ends", "lead", "tail", "inner", "carry", "first", "final").mapInArrow(expand, "file string, ordinal long, n_tokens long, closed boolean")


def document_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, shard, ordinal, n_tokens) of every row of docs, through token files in the shared folder."""
    spark, width = docs.sparkSession, id_bytes(vocabulary)
    docs = common.read_from_files(docs.select("doc_id", "text"))
    path = common.scratch(spark, "tokens")
    write(docs, path, vocabulary, width)
    at = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftright(at, 33).cast("int").alias("shard"), at.bitwiseAND((1 << 33) - 1).alias("ordinal"))
    part = (F.regexp_extract("path", r"part-(\d+)-", 1), F.regexp_extract("path", r"-c(\d+)\D*$", 1).cast("long"))
    found = counts(spark, path, width=width, stream=part).select(F.col("file").cast("int").alias("shard"), "ordinal", "n_tokens")
    lost = F.raise_error(F.lit("a document has no count: the rows were not partitioned as they were written")).cast("long")
    return rows.join(found, ["shard", "ordinal"], "left").select("doc_id", "shard", "ordinal", F.coalesce("n_tokens", lost).alias("n_tokens"))
