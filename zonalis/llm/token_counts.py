"""Token counts of flat token files by a separator scan.

A token file is nothing but token identifiers, 16 or 32 bits each in little-endian order, with
an end-of-document identifier after every document: no index, no ids, no lengths.
Files are cut into blocks of ``BLOCK`` bytes that any task can read by itself.  Inside a
block one vectorised comparison finds the separators.  Documents that cross blocks
are stitched by a prefix scan over one summary per block: the last separator
before the block, and the number of separators before it.

Spark itself writes such files: the text writer puts raw bytes and a line
separator of our choice, and its commit protocol survives lost tasks.

Defined results: two separators in a row enclose a document of 0 tokens, so null and empty texts
count 0.  Tokens after the last separator of a file are a document with ``terminated`` false.
An odd byte at a file's end is no token and ignored.  An empty file has no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import drop_table, materialise, new_path

BLOCK = 8 << 20
#: Stores of which a range of a file can be read outside the JVM.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def write_token_files(docs: DataFrame, path: str, *, text: str = "text", tokenizer: str | None = None, width: int = 2, separator: int | None = None) -> int:
    """Write the tokens of every text to flat files below ``path``; returns the separator.

    Strings of added tokens inside a text are ordinary text, so a document never holds the separator.
    """
    tokenizer = tokenizer or bpe.default_path()
    if separator is None:
        separator = max(bpe.codec(tokenizer).added.values())

    @F.arrow_udf(T.BinaryType())
    def packed(texts: pa.Array) -> pa.Array:
        own, kind, out = bpe.codec(tokenizer), f"<u{width}", []
        for t in texts:
            ids = np.frombuffer(own.encode_packed(t.as_py() or "", special=False), dtype="<u4")
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"token {ids.max()} does not fit {width} bytes")
            out.append(ids.astype(kind).tobytes())
        return pa.array(out, pa.binary())

    end = separator.to_bytes(width, "little").decode("latin-1")
    rows = docs.select(packed(F.col(text)).cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)
    return separator


def _scan(content: bytes, width: int, separator: int, first: int) -> np.ndarray:
    """Places of the separators, counted in tokens from the start of the file."""
    count = len(content) // width
    return np.flatnonzero(np.frombuffer(content, dtype=f"<u{width}", count=count) == separator) + first // width


def _scanner(width: int, separator: int, ranged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, first, last in zip(*(batch.column(c) for c in ("path", "block", "first", "last" if ranged else "content")), strict=True):
                first = first.as_py()
                if ranged:
                    store, place = fs.FileSystem.from_uri(path.as_py().replace("s3a://", "s3://"))
                    with store.open_input_file(place) as f:
                        content = f.read_at(last.as_py() - first, first)
                else:
                    content = last.as_py()
                ends = _scan(content, width, separator, first)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "block", "ends"])

    return run


def count_tokens(spark: SparkSession, path: str, *, separator: int, width: int = 2, block: int = BLOCK, ranged: bool | None = None) -> DataFrame:
    """One row per document: path, doc_index in the file, first_token, n_tokens and terminated.

    ``ranged`` says whether tasks read ranges of files by themselves; by default the path's scheme does.
    """
    block -= block % width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = files.select("path", "length")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.greatest("length", F.lit(1)) - 1) / block).cast("int")))
    if ranged is None:
        ranged = path.partition("://")[0] in RANGED or "://" not in path
    if ranged:
        blocks = sizes.filter("length > 0").select("path", "length", cut.alias("block"))
        first = F.col("block").cast("long") * block
        blocks = blocks.select("path", F.col("block").cast("long"), first.alias("first"), F.least(first + block, "length").alias("last")).repartition("path", "block")
    else:
        # A store that only Spark reads: whole files come through the JVM, which Spark limits to 2 GB each.
        blocks = files.filter("length > 0").select("path", "content", cut.alias("block"))
        first = F.col("block").cast("long") * block
        blocks = blocks.select("path", F.col("block").cast("long"), first.alias("first"), F.expr(f"substring(content, cast(block * {block} as int) + 1, {block})").alias("content"))
    found = materialise(blocks.mapInArrow(_scanner(width, separator, ranged), "path string, block long, ends array<long>"), "ends")
    # The prefix scan: what lies before each block of a file.
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("path", "block", F.size("ends").cast("long").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    carried = summary.select("path", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    own = found.filter(F.size("ends") > 0).join(carried, ["path", "block"])
    begins = F.concat(F.array("carry"), F.slice("ends", 1, F.size("ends") - 1))
    rows = own.select("path", "rank", F.posexplode(F.arrays_zip(begins.alias("a"), F.col("ends").alias("b"))).alias("i", "span"))
    closed = rows.select("path", (F.col("rank") + F.col("i")).alias("doc_index"), (F.col("span.a") + 1).alias("first_token"), (F.col("span.b") - F.col("span.a") - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    totals = summary.groupBy("path").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("n").alias("n"))
    open_ended = totals.join(sizes.select("path", F.floor(F.col("length") / width).alias("tokens")), "path").filter("tokens > last + 1")
    return closed.union(open_ended.select("path", F.col("n"), F.col("last") + 1, F.col("tokens") - F.col("last") - 1, F.lit(False)))


def token_counts(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write the texts as token files, scan these, and give (shard, doc_index, first_token, n_tokens, terminated).

    A shard is the file of one input partition; its documents are in the order of that partition.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    separator = write_token_files(docs, path, text=text, tokenizer=tokenizer)
    counts = count_tokens(spark, path, separator=separator, block=block)
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    done = materialise(counts.select(shard.alias("shard"), "doc_index", "first_token", "n_tokens", "terminated"), "counts")
    drop_table(spark, path)
    return done
