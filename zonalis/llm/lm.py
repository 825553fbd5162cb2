"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are blank-separated words with A-Z lower-cased, then one end mark for each text.
Unigram counts are exact.  All bigram counts are quantised to powers of two and stored in a
Bloom filter: a pair counted c times is entered once for every level 0 .. floor(log2 c), so
that its level is found by membership probes that stop at the first miss.  The filter consists of
parts by hash of the pair; every part is counted, sized and built by its own task.

A filter of at most ``GROUP_BYTES`` is broadcast to the workers.  A larger one stays where it
is, in the shared folder: every bucket of documents sends its distinct pairs to their parts, which are probed there,
and the levels come back.  So neither the driver nor a worker ever holds more than that.

A pair's probability is ``weight`` times its quantised share of its first word's count, plus
1 - ``weight`` times the smoothed unigram probability; after an unknown word it is the latter.
The weight is the Good-Turing estimate from all training texts of how often the next pair has been seen:
one less the share of tokens whose pair occurs once.
Quantised counts are rounded down, so but for false positives the probabilities add up to one at most.

Scoring deals the documents into buckets of about ``BUCKET_BYTES`` by hash.  Each
bucket's distinct tokens are joined with the counts and come back to the bucket: the corpus
vocabulary is never held in one place.

Defined results: a null text is an empty one, whose only token is the end mark.  A row with a null
id is a training row.  Without training rows every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise

PSEUDO = 0.1
#: Bits of the filter for each entry, and probes of an entry.
BITS, PROBES = 10, 4
#: A filter that is broadcast at most, text of a bucket, tokens of a part.
GROUP_BYTES, BUCKET_BYTES, PART_TOKENS = 128 << 20, 12 << 20, 2_000_000
#: Tokens that a task gathers before it passes on counts, and that it scores at a time.
FLUSH, RUN = 1_500_000, 500_000
#: The end mark and the start mark; neither can be a word.
END, START = b"", b" "
_KEY = np.uint64((1 << 40) - 1)


def tokens(text: bytes | None) -> list[bytes]:
    return (text.lower().split() if text else []) + [END]


token_hash = partial(xxhash.xxh64_intdigest, seed=11)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _split_key(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair's part (there are at most 2**23), and the 40 bits that name it inside the part; without parts both are there."""
    if not parts:
        return (keys >> np.uint64(40)).astype(np.int64), keys & _KEY
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64), keys & _KEY


def _place(key: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    """The place of a bit of (key, level) in a filter of ``bits`` bits."""
    x = (key + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    # The halves swapped make a step that reaches all of the filter.
    x = x + np.uint64(probe) * ((x << np.uint64(32)) | (x >> np.uint64(32)) | np.uint64(1))
    return ((x >> np.uint64(32)) * bits) >> np.uint64(32)


def build_part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of one part, as bytes, for distinct keys with their counts."""
    level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    entries = int(level.sum()) + len(level)
    if not entries:
        return np.zeros(0, dtype=np.uint8)
    size = np.uint64(-(-entries * BITS // 64) * 64)
    bits = np.zeros(int(size), dtype=bool)
    for at in range(int(level.max()) + 1):
        own = keys[level >= at]
        for probe in range(PROBES):
            bits[_place(own, at, probe, size)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Some parts of the filter, end to end."""

    def __init__(self, total: int, segments: dict[int, bytes] | Iterator[tuple[int, bytes]], sizes: dict[int, int] | None = None):
        """``segments`` may come one after the other, in any order, if ``sizes`` tells their lengths."""
        self.total = total
        size = np.zeros(total, dtype=np.int64)
        sizes = {p: len(b) for p, b in segments.items()} if sizes is None else sizes
        size[list(sizes)] = list(sizes.values())
        self.begin, self.bits = (np.cumsum(size) - size).astype(np.int64), (size * 8).astype(np.uint64)
        self.bytes = np.zeros(int(size.sum()), dtype=np.uint8)
        for p, held in segments.items() if isinstance(segments, dict) else segments:
            self.bytes[self.begin[p] : self.begin[p] + size[p]] = np.frombuffer(held, dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each pair, -1 for those that are not found or belong to other parts."""
        part, key = _split_key(keys, self.total)
        found = np.full(len(keys), -1, dtype=np.int64)
        at, level = np.flatnonzero(self.bits[part] > 0), -1
        while len(at):
            level += 1
            for probe in range(PROBES):
                own = part[at]
                place = _place(key[at], level, probe, self.bits[own])
                hit = self.bytes[self.begin[own] + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
                at = at[(hit & 1).astype(bool)]
            found[at] = level
        return found


@dataclass
class Model:
    """Counts of the training texts; the tables lie in the shared folder."""

    vocabulary: DataFrame  # token, n
    segments: DataFrame  # part, bytes, size
    parts: int
    tokens: int
    distinct: int
    texts: int
    weight: float


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen = Counter(), 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "n"])

    for batch in batches:
        for text in bytes_of(batch.column(0)):
            own = tokens(text)
            counts.update(own)
            seen += len(own)
            if seen >= FLUSH:
                yield out()
                counts.clear()
                seen = 0
    yield out()


def _count_pairs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end, held, seen = token_hash(START), token_hash(END), [], 0

        def out() -> pa.RecordBatch:
            part, key = _split_key(np.concatenate(held), parts)
            # One number in order of part and key; part < 2**23.
            both = np.sort((part.astype(np.uint64) << np.uint64(40)) | key)
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            count = np.diff(np.concatenate((first, [len(both)]))).astype("<u4")
            part, key = (both[first] >> np.uint64(40)).astype(np.int64), (both[first] & _KEY).astype("<u8")
            cut = np.searchsorted(part, np.unique(part))
            rows = []
            for s, e in zip(cut, [*cut[1:], len(part)], strict=True):
                # Planes of bytes: the leading ones of sorted keys and of counts shrink to little.
                planes = np.concatenate((key[s:e].view(np.uint8).reshape(-1, 8)[:, :5], count[s:e].view(np.uint8).reshape(-1, 4)), axis=1)
                rows.append((int(part[s]), np.ascontiguousarray(planes.T).tobytes()))
            ids, packed = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], names=["part", "packed"])

        for batch in batches:
            for text in bytes_of(batch.column(0)):
                hashes = np.array([start, *map(token_hash, text.lower().split() if text else ()), end], dtype=np.uint64)
                held.append(pair_keys(hashes[:-1], hashes[1:]))
                seen += len(hashes) - 1
                if seen >= FLUSH:
                    yield out()
                    held, seen = [], 0
        if held:
            yield out()

    return run


def _build(table: pa.Table) -> pa.Table:
    keys, counts = [], []
    for packed in table["packed"]:
        planes = np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(9, -1)
        wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        wide[:, :5] = planes[:5].T
        keys.append(wide.view("<u8")[:, 0])
        counts.append(np.ascontiguousarray(planes[5:].T).view("<u4")[:, 0])
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.add.reduceat(counts[order], first)
    made = build_part(keys[first], counts).tobytes()
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "bytes": pa.array([made], pa.binary()), "size": pa.array([len(made)], pa.int64()), "once": pa.array([int((counts == 1).sum())], pa.int64())})


def train(docs: DataFrame, *, text: str = "text") -> Model:
    """Count the training texts given; the caller leaves out those to be held out."""
    texts = docs.select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = materialise(counted, "vocabulary")
    total, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    ends = vocabulary.filter(F.col("token") == F.lit(END)).agg(F.sum("n")).first()[0]
    parts = min(1 << 23, max(1, -(-(total or 0) // PART_TOKENS)))
    pairs = texts.mapInArrow(_count_pairs(parts), "part int, packed binary")
    segments = materialise(pairs.groupBy("part").applyInArrow(_build, "part int, bytes binary, size long, once long"), "segments")
    once = segments.agg(F.sum("once")).first()[0] or 0
    return Model(vocabulary, segments, parts, total or 0, distinct, ends or 0, ((total or 0) - once) / ((total or 0) + 1))


def _whole(model: Model):
    """The whole filter, broadcast; the driver takes up some parts at a time."""
    sizes = {r["part"]: r["size"] for r in model.segments.select("part", "size").collect()}  # one row for PART_TOKENS tokens
    rows = ((r["part"], r["bytes"]) for r in model.segments.select("part", "bytes").toLocalIterator())
    return model.segments.sparkSession.sparkContext.broadcast(Filter(model.parts, rows, sizes))


def _numbered(texts: list[bytes]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the distinct tokens, the texts' tokens end to end by number, and their sizes."""
    place: dict[bytes, int] = {}
    ids, sizes = [], []
    for text in texts:
        own = tokens(text)
        ids.append(np.fromiter((place.setdefault(w, len(place)) for w in own), dtype=np.int32, count=len(own)))
        sizes.append(len(own))
    return place, np.concatenate(ids), np.array(sizes)


def _pairs(hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token (the start mark is the last of ``hashes``), and the pairs' keys."""
    before = np.concatenate(([0], flat[:-1]))
    before[np.cumsum(sizes) - sizes] = len(hashes) - 1
    return before, pair_keys(hashes[before], hashes[flat])


def _asked(parts: int):
    """The distinct pairs of a bucket, a row for each part: planes of 5 bytes of sorted keys."""

    def run(table: pa.Table) -> pa.Table:
        place, flat, sizes = _numbered(bytes_of(table["text"]))
        hashes = np.array([*map(token_hash, place), token_hash(START)], dtype=np.uint64)
        part, key = _split_key(np.unique(_joined(_pairs(hashes, flat, sizes)[1], parts)), 0)
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        packed = [np.ascontiguousarray(key[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes() for s, e in zip(cut, [*cut[1:], len(part)], strict=True)]
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(cut), pa.int32()), "part": pa.array(part[cut], pa.int32()), "packed": pa.array(packed, pa.binary())})

    return run


def _joined(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part and key of pairs as one number, in order of part."""
    part, key = _split_key(keys, parts)
    return (part.astype(np.uint64) << np.uint64(40)) | key


def _answered(asked: pa.Table, segment: pa.Table) -> pa.Table:
    """The levels of the pairs asked for of one part: a byte for each, 0 where it is not found."""
    own = Filter(1, {0: segment["bytes"][0].as_py()} if len(segment) else {})
    levels = []
    for packed in asked["packed"]:
        planes = np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(5, -1)
        wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        wide[:, :5] = planes.T
        levels.append((own.levels(wide.view("<u8")[:, 0]) + 1).astype(np.uint8).tobytes())
    return pa.table({"bucket": asked["bucket"], "part": asked["part"], "levels": pa.array(levels, pa.binary())})


def _distinct(table: pa.Table) -> pa.Table:
    found: set[bytes] = set()
    for text in bytes_of(table["text"]):
        found.update(tokens(text))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(found), pa.int32()), "token": pa.array(list(found), pa.binary())})


def _scorer(whole, parts: int, total: int, distinct: int, texts: int, weight: float):
    """Scores of a bucket; levels come from the broadcast filter ``whole`` or, if that is None, with the counts."""
    floor = total + PSEUDO * (distinct + 1)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        place, flat, sizes = _numbered(bytes_of(docs["text"]))
        counts = found.filter(pc.is_valid(found["token"]))
        # One more entry than words: the start mark.
        n = np.zeros(len(place) + 1)
        n[np.fromiter(map(place.__getitem__, counts["token"].to_pylist()), dtype=np.int64, count=len(counts))] = counts["n"].to_numpy()
        n[-1] = texts
        logs = np.log10((n + PSEUDO) / floor) if floor else np.zeros(len(n))
        hashes = np.array([*map(token_hash, place), token_hash(START)], dtype=np.uint64)
        del place
        begin = np.cumsum(sizes) - sizes
        base = np.add.reduceat(logs[flat], begin)
        known = np.add.reduceat((n[flat] > 0).astype(np.int64), begin)
        before, keys = _pairs(hashes, flat, sizes)
        if whole is None:
            answers = found.filter(pc.is_valid(found["levels"])).sort_by("part")
            levels = np.frombuffer(b"".join(answers["levels"].to_pylist()), dtype=np.uint8).astype(np.int64) - 1
            level = levels[np.unique(_joined(keys, parts), return_inverse=True)[1]]
        else:
            level = np.concatenate([whole.value.levels(keys[at : at + RUN]) for at in range(0, len(keys), RUN)])
        # Where the first word is known, a pair that is not found keeps 1 - weight of the unigram.
        ratio = np.where(n[before] > 0, math.log10(1 - weight), 0.0)
        hit = np.flatnonzero((level >= 0) & (n[before] > 0))
        first = n[before[hit]]
        ratio[hit] = np.log10(weight * np.minimum(np.exp2(level[hit]), first) / first + (1 - weight) * 10.0 ** logs[flat[hit]]) - logs[flat[hit]]
        score = base + np.add.reduceat(ratio, begin)
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(sizes), total), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", held_out=None, weight: float | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")).repartition(int(buckets), "bucket")
    found = dealt.groupBy("bucket").applyInArrow(_distinct, "bucket int, token binary")
    found = found.join(model.vocabulary, "token", "left").select("bucket", "token", F.coalesce("n", F.lit(0)).alias("n"))
    if (model.segments.agg(F.sum("size")).first()[0] or 0) <= group_bytes:
        whole = _whole(model)
    else:
        whole = None
        asked = dealt.groupBy("bucket").applyInArrow(_asked(model.parts), "bucket int, part int, packed binary")
        levels = asked.groupBy("part").cogroup(model.segments.select("part", "bytes").groupBy("part")).applyInArrow(_answered, "bucket int, part int, levels binary")
        found = found.unionByName(levels, allowMissingColumns=True)
    if whole is not None:
        found = found.withColumns({"part": F.lit(None).cast("int"), "levels": F.lit(None).cast("binary")})
    run = _scorer(whole, model.parts, model.tokens, model.distinct, model.texts, model.weight if weight is None else weight)
    kind = own.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
