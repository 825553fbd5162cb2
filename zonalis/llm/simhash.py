"""SimHash near-dedup: popcount grid join, exact verification, components.

A fingerprint bit is the majority of that bit over the XXH64 values of the
text's word shingles.  Equal fingerprints become one class first, so copies cost
one row.  A class is embedded as the popcounts of its 32 two-bit segments, each written as
that many ones, so that the Manhattan distance of two embeddings is the count of bits in which they
differ.  It is a lower bound of the Hamming distance, and the range join finds all pairs
within 3 of each other: such a pair differs in at most 3 of m groups of coordinates, so it falls into
one cell of the grid that is left by at least one of the C(m, 3) choices of m-3 groups.  m grows with
the number of classes, which keeps the cells small.  Cells beyond ``CELL`` rows are split into blocks and each pair
of blocks becomes a cell of its own.  Inside a cell pairs within the Manhattan distance are verified by
their Hamming distance, and what comes out is fewer edges than rows, never all pairs.

Defined results: null and wordless texts have fingerprint 0, which links like any
other.  Fewer than three words make one shingle of all of them.  A null id keeps its
row and takes its group's id, null only if the group has no other; repeated rows each keep theirs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fresh, materialise
from .components import connected_components, stars

SHINGLE, SEED, BITS = 3, 42, 3
#: Rows of a cell, and of a task's share of cells.
CELL, SHARE = 4096, 30_000
#: One bit of each two-bit segment.
_FIELDS = 0x5555555555555555
#: Pairs of id and text that are broadcast at most.
TABLE = 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = starts[min(shingle, len(words)) :].tolist()
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(joined[s : e - 1], SEED) for s, e in zip(starts.tolist(), ends)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in bytes_of(texts)], dtype=np.uint64).view(np.int64), pa.int64())


def groups(n: int, bits: int = BITS) -> int:
    """How many groups of fields for n classes: a class meets about 16 others by chance at most."""
    m = bits + 1
    # Two random segments of two bits have equal popcounts with probability 3/8.
    while m < 16 and n * len(list(itertools.combinations(range(m), bits))) * 0.375 ** (32 * (m - bits) / m) > 16:
        m += 1
    return m


def _masks(m: int, bits: int) -> list[int]:
    """Signed masks over the 32 fields, one for each choice of m - bits of m groups."""
    bounds = [32 * g // m for g in range(m + 1)]
    own = [sum(3 << 2 * f for f in range(a, b)) for a, b in itertools.pairwise(bounds)]
    masks = (sum(own[g] for g in chosen) for chosen in itertools.combinations(range(m), m - bits))
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def embedded(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the two-bit segments, each as that many ones."""
    one, more = np.uint64(1), np.uint64(_FIELDS)
    return ((fp | fp >> one) & more) | ((fp & fp >> one) & more) << one


def _cell_edges(bits: int):
    def near(fp, at, one, two):
        """Of the pairs of places, whether the Manhattan distance allows them and the Hamming distance confirms it."""
        allowed = np.bitwise_count(at[one] ^ at[two]) <= bits
        allowed[allowed] = np.bitwise_count((fp[one] ^ fp[two])[allowed]) <= bits
        return allowed

    def edges(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        keys = [table[c].to_numpy() for c in ("two", "one", "cell", "choice")]
        order = np.lexsort(keys)
        fp = fp[order].view(np.uint64)
        counts = embedded(fp)
        change = np.zeros(len(fp), dtype=bool)
        for k in keys:
            k = k[order]
            change[1:] |= k[1:] != k[:-1]
        run = np.cumsum(change)
        sizes = np.bincount(run)
        left, right = [], []
        # Small cells all at once: compare each row with the d-th row after it.
        small = np.flatnonzero(sizes[run] <= 64)
        r = run[small]
        for d in range(1, 64):
            same = r[d:] == r[:-d]
            if not same.any():
                break
            at = np.flatnonzero(same)
            at = at[near(fp, counts, small[at], small[at + d])]
            left.append(small[at])
            right.append(small[at + d])
        # Large cells: spread from row to row, over those not yet reached.
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for k in np.flatnonzero(sizes > 64):
            rest = np.arange(starts[k], starts[k + 1])
            while len(rest):
                first, reached, rest = rest[0], [rest[0]], rest[1:]
                while reached and len(rest):
                    found = near(fp, counts, rest, np.full(len(rest), reached.pop()))
                    if found.any():
                        reached += rest[found].tolist()
                        left.append(np.full(int(found.sum()), first))
                        right.append(rest[found])
                        rest = rest[~found]
        a = np.concatenate(left) if left else np.empty(0, int)
        b = np.concatenate(right) if right else np.empty(0, int)
        # The same fingerprint occurs in several cells of a share: number them once.
        value, node = np.unique(fp.view(np.int64), return_inverse=True)
        member, root = stars(len(value), node[a], node[b])
        return pa.table({"a": value[member], "b": value[root]})

    return edges


def linked(classes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct values within ``bits`` bits."""
    fps = classes.select(F.col(column).alias("fp"))
    n = fps.count()
    masks = _masks(groups(n, bits), bits)
    # The same embedding as in embedded().
    low, high = F.col("fp").bitwiseAND(F.lit(_FIELDS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_FIELDS))
    fields = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = fps.withColumn("fields", fields).select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fields").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])).alias("c")).select("fp", "c.*")
    full = cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (
        cells.join(full, ["choice", "cell"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("fp", "choice", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fp", "choice", "cell", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    )
    shares = max(1, -(-n * len(masks) // SHARE))
    share = F.pmod(F.xxhash64("choice", "cell", "one", "two"), F.lit(shares))
    return met.withColumn("share", share).groupBy("share").applyInArrow(_cell_edges(bits), met.select(F.col("fp").alias("a"), F.col("fp").alias("b")).schema).distinct()


def component_ids(ids: DataFrame, doc_id: str, column: str, bits: int = BITS, label: str = "component_id") -> DataFrame:
    """(fingerprint, label): the least id of each fingerprint's component."""
    classes = materialise(ids.groupBy(column).agg(F.min(doc_id).alias("least")), "classes")
    roots = connected_components(linked(classes, column, bits))
    named = classes.join(roots, classes[column] == roots["node"], "left").select(classes[column], "least", F.coalesce("root", classes[column]).alias("root"))
    named = materialise(named, "roots")
    return named.join(named.groupBy("root").agg(F.min("least").alias(label)), "root").select(column, label)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: the id, the fingerprint in hexadecimal and the component's least id."""
    ids = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    found = ids.join(component_ids(ids, "doc_id", "fp", bits), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One whole row of ``docs`` for each component: the least id, then the least hash of the text.

    Ids, hashes and fingerprints are written once and decide which rows go; the texts are only
    shuffled if those rows are more than ``TABLE``.  Of rows with the same id and text one stays.
    """
    hashed = F.xxhash64(F.col(text))
    ids = materialise(docs.select(F.col(doc_id).alias("id"), hashed.alias("hash"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    classes = materialise(ids.groupBy("fp").agg(F.min(rank).alias("least")), "classes")
    roots = connected_components(linked(classes, "fp", bits)).filter("node <> root")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
    best = rooted.agg(F.min("least").alias("least")).select(F.col("least.id").alias("best_id"), F.col("least.hash").alias("best_hash"), F.lit(True).alias("stays"))
    rows = ids.groupBy("id", "hash").agg(F.count("*").alias("n"))
    judged = rows.join(best, rows["id"].eqNullSafe(best["best_id"]) & (rows["hash"] == best["best_hash"]), "left")
    # What becomes of rows that do not simply stay: they go, or one of several stays.
    fate = materialise(judged.filter("stays is null or n > 1").select("id", "hash", F.col("stays").isNotNull().alias("stays")), "fates")
    if fate.count() <= TABLE:
        fate = F.broadcast(fate)
    own = [docs[c] for c in docs.columns]
    met = docs[doc_id].eqNullSafe(fate["id"]) & (F.xxhash64(docs[text]) == fate["hash"])
    plain = docs.join(fate, met, "left_anti")
    several = docs.join(fate, met & fate["stays"]).groupBy("id", "hash").agg(F.first(F.struct(*own)).alias("row")).select("row.*")
    return plain.unionAll(several)
