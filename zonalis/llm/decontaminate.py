"""Benchmark decontamination: exact windows of benchmark words inside documents.

Words are lower-cased (A-Z only) runs of digits, letters a-z and non-ASCII
characters.  An item of ``width`` words or more contributes each window of
``width`` consecutive words; a shorter one, if it has any word, is one window.

The benchmark is read in blocks of at most ``block_bytes`` of text (or of one longer item).
A block becomes a hash set of window hashes in a
broadcast variable, and one pass over the documents probes it; a hit is verified
word by word.  One block is the normal case.  With more blocks the documents are written once with
numbered rows, each block has a job of its own that writes the marks it finds, and is given up
before the next one is built: driver and workers hold one block at a time.  The marks are then
united by row, so no window is ever left out.

Defined results: null or wordless texts give 0 words and no hit.  Null item texts
have no window.  A window of an item with a null id still hits words, but
has no id to report.  Repeated rows each get their own result.  An empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fresh, materialise

WIDTH = 13
#: A document is contaminated when hits make up one word in SHARE or more.
SHARE = 20
BLOCK_BYTES = 16 << 20

_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Windows:
    """The hash set of one block of the benchmark, with what verification needs.

    A window is its hash, its item and its place among the block's words, so a block
    takes about 20 bytes for each word beside its vocabulary.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WIDTH):
        self.ids: dict[bytes, int] = {}
        seqs = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)] for _, text in items]
        self.names = [item for item, _ in items]
        self.flat = np.array([x for seq in seqs for x in seq], dtype=np.uint64)
        size = np.array([len(seq) for seq in seqs], dtype=np.int64)
        begin = np.cumsum(size) - size
        #: By window length: hashes in order, and each one's item and place.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(size[size > 0], width)).tolist():
            own = np.flatnonzero(size >= width if n == width else size == n)
            count = size[own] - n + 1
            item = np.repeat(own, count)
            place = np.repeat(begin[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hashes = _mix([self.flat[place + k] for k in range(n)])
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], item[order].astype(np.int32), place[order].astype(np.int32)

    def scan(self, text: bytes | None) -> tuple[int, list[int], list[int], list[str]]:
        """Word count, hit intervals (end exclusive, disjoint, ascending) and the items that occur."""
        seq = words(text)
        if not seq or not self.windows:
            return len(seq), [], [], []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in seq), dtype=np.uint64, count=len(seq))
        # A window needs n known words in a row.
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        marks, items = None, set()
        for n, (hashes, item, place) in self.windows.items():
            if len(seq) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            got = _mix([ids[at + k] for k in range(n)])
            low, high = np.searchsorted(hashes, got, "left"), np.searchsorted(hashes, got, "right")
            for i, a, b in zip(at[met := high > low].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
                true = (self.flat[place[a:b, None] + np.arange(n)] == ids[i : i + n]).all(axis=1)
                if true.any():
                    if marks is None:
                        marks = np.zeros(len(seq) + 1, dtype=np.int32)
                    marks[i] += 1
                    marks[i + n] -= 1
                    items.update(item[a:b][true].tolist())
        if marks is None:
            return len(seq), [], [], []
        covered = np.diff(np.concatenate(([0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0])))
        names = sorted({self.names[k] for k in items if self.names[k] is not None})
        return len(seq), np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist(), names


def _mix(columns) -> np.ndarray:
    """A 64-bit polynomial hash of the rows that the columns make up."""
    out = None
    for c in columns:
        out = c.copy() if out is None else out * np.uint64(0x9E3779B97F4A7C15) + c
        out = out ^ (out >> np.uint64(29))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark's rows in blocks of bounded size, streamed through the driver."""
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("binary"))
    block, size = [], 0
    for item, body in rows.toLocalIterator():
        body = bytes(body) if body is not None else None
        if block and size + len(body or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += len(body or b"")
    yield block


def _scanner(windows):
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        own = windows.value
        n, starts, ends, items = zip(*map(own.scan, bytes_of(texts)), strict=True)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            names=FOUND.names,
        )

    return scan


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for t in bytes_of(texts)], pa.int64())


@F.arrow_udf(FOUND)
def _united(n_words: pa.Array, marks: pa.Array) -> pa.Array:
    """The union of what the passes found in the same text; ``marks`` are lists of (starts, ends, items)."""
    rows = []
    for n, own in zip(n_words.to_pylist(), marks.to_pylist(), strict=True):
        starts, ends, items = [], [], set()
        for s, e in sorted(p for m in own or () for p in zip(m["starts"], m["ends"], strict=True)):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        items.update(*(m["items"] for m in own or ()))
        rows.append({"n_words": n, "starts": starts, "ends": ends, "items": sorted(items)})
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))


def find_windows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, into: str = "found") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, hit intervals of words, and item ids."""
    context, blocks = docs.sparkSession.sparkContext, _blocks(benchmark, item_id, item_text, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return docs.withColumn(into, _scanner(context.broadcast(Windows(block, width)))(F.col(text)))
    row, n_words, marks = fresh(docs, "row"), fresh(docs, "n_words"), fresh(docs, "marks")
    numbered, passes = materialise(docs.withColumns({row: F.monotonically_increasing_id(), n_words: _n_words(F.col(text))}), "numbered"), []
    while block is not None:
        windows = context.broadcast(Windows(block, width))
        found = numbered.select(row, _scanner(windows)(F.col(text)).alias("found")).filter(F.size("found.starts") > 0)
        passes.append(materialise(found.select(row, F.struct("found.starts", "found.ends", "found.items").alias("mark")), "marks"))
        windows.destroy()
        block, after = after, next(blocks, None)
    every = reduce(DataFrame.unionAll, passes).groupBy(row).agg(F.collect_list("mark").alias(marks))
    return numbered.join(every, row, "left").withColumn(into, _united(n_words, marks)).select(*docs.columns, into)


def verdict(found: str, share: int = SHARE) -> dict:
    """Columns of the contamination rule over a struct made by find_windows."""
    n_words = F.col(f"{found}.n_words")
    n_hit = F.aggregate(F.zip_with(f"{found}.starts", f"{found}.ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_sort(F.array_distinct(f"{found}.items"))
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (n_hit * share >= n_words),
    }


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    into = fresh(docs, "found")
    return find_windows(docs, benchmark, text=text, width=width, into=into).filter(~verdict(into, share)["contaminated"]).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with each hit run of words cut out of the text.

    What lies between two kept words stays as it is; a text without hits is unchanged.
    """
    into = fresh(docs, "found")

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _cut(t, f).decode() for t, f in zip(bytes_of(texts), found.to_pylist(), strict=True)], pa.string())

    marked = find_windows(docs, benchmark, text=text, width=width, into=into)
    return marked.withColumn(text, cut(F.col(text), F.col(into))).select(*docs.columns)


def _cut(text: bytes, found: dict) -> bytes:
    if not found["starts"]:
        return text
    # Offsets of the words: where a non-blank of the translated text begins or ends.
    blank = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) == 32
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for s, e in zip(found["starts"], found["ends"], strict=True):
        out.append(text[at : begin[s]])
        at = end[e - 1]
    return b"".join([*out, text[at:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
