"""Embedding near-dedup: sign hashing in several tables, exact cosines, components.

Equal vectors become one class first.  Random hyperplanes give every class one
sign code in each table; the code length grows with the number of classes so that
buckets stay small, and the number of tables follows from it so that a pair at the
cosine bound shares a bucket with probability ``RECALL`` or more.
Candidates are verified by the cosine in double precision.  A pair that shares
several buckets counts in the first table only, which each pair can tell from its own
codes, so link counts are exact without gathering pairs.  Buckets beyond
``CELL`` rows are split into blocks and each pair of blocks is a cell of its own;
a cell gives back counts and star edges, never its pairs.

Defined results: null, zero and non-finite vectors, or ones with a null component,
link with nothing and are their own component.  Vectors of different lengths do not
link.  Repeated rows link with each other.  A row with a null id counts as a link of others but
takes part in no minimum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import connected_components, stars

COSINE, RECALL, SEED = 0.95, 0.999, 7
#: Classes that meet in a bucket by chance; rows of a cell; rows of a task's share.
CHANCE, CELL, SHARE = 24, 1024, 8_192


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code and number of tables for n classes."""
    bits = min(48, max(6, math.ceil(math.log2(max(n, 1) / CHANCE + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def code_bytes(bits: int) -> int:
    return -(-bits // 8)


def _coder(bits: int, tables: int):
    planes: dict[int, np.ndarray] = {}

    @F.arrow_udf(T.BinaryType())
    def codes(vectors: pa.Array) -> pa.Array:
        """The codes of all tables, code_bytes(bits) bytes each."""
        out = []
        for v in vectors:
            x = np.array(v.as_py(), dtype=np.float64)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((tables * bits, len(x)))
            signs = (planes[len(x)] @ (x / np.abs(x).max()) > 0).reshape(tables, bits)
            out.append(np.packbits(signs, axis=1, bitorder="little").tobytes())
        return pa.array(out, pa.binary())

    return codes


def _cell_links(cosine: float, width: int):
    def links(table: pa.Table) -> pa.Table:
        rows = table.num_rows
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=np.uint8).reshape(rows, -1, width)
        code = codes[np.arange(rows), table["place"].to_numpy()].astype(np.int64) @ (1 << 8 * np.arange(width))
        keys = [table["two"].to_numpy(), table["one"].to_numpy(), table["size"].to_numpy(), code, table["place"].to_numpy()]
        order = np.lexsort(keys)
        keys = [k[order] for k in keys]
        change = np.zeros(rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.concatenate((np.flatnonzero(np.concatenate(([True], change[1:]))), [rows]))
        table, codes = table.take(pa.array(order)), codes[order]
        node, own, copies = table["node"].to_pylist(), table["own"].to_numpy(), table["copies"].to_numpy()
        flat, size = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64), keys[2]
        offset = np.concatenate(([0], np.cumsum(size)))
        number = {x: i for i, x in enumerate(dict.fromkeys(node))}
        numbered = np.array([number[x] for x in node], dtype=np.int64)
        counts, left, right = np.zeros(len(number), dtype=np.int64), [], []
        one, two, place = keys[1], keys[0], keys[4]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            x = flat[offset[s] : offset[e]].reshape(e - s, -1)
            # Squares of very large or small components would leave the range of doubles.
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            across = one[s] != two[s]
            left_rows = np.flatnonzero(own[s:e] == one[s])
            cols = np.flatnonzero(own[s:e] == two[s])
            for at in range(0, len(left_rows), 256):
                i = left_rows[at : at + 256]
                a, b = np.nonzero((x[i] @ x[cols].T) / (norm[i][:, None] * norm[cols][None, :]) >= cosine)
                a, b = i[a], cols[b]
                if not across:
                    a, b = a[keep := a < b], b[keep]
                # Pairs that met in an earlier table were counted there.
                new = ~(codes[s + a, : place[s]] == codes[s + b, : place[s]]).all(axis=2).any(axis=1)
                a, b = s + a[new], s + b[new]
                np.add.at(counts, numbered[a], copies[b])
                np.add.at(counts, numbered[b], copies[a])
                member, root = stars(len(number), numbered[a], numbered[b])
                left.append(member)
                right.append(root)
        member, root = stars(len(number), np.concatenate([*left, np.empty(0, int)]).astype(int), np.concatenate([*right, np.empty(0, int)]).astype(int))
        names = np.array(list(number), dtype=object)
        to = np.arange(len(number))
        to[member] = root
        met = np.flatnonzero((counts > 0) | (to != np.arange(len(number))))
        return pa.table({"node": pa.array(names[met], pa.string()), "root": pa.array(names[to[met]], pa.string()), "n": pa.array(counts[met], pa.int64())})

    return links


def links(classes: DataFrame, n: int, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(node, root, n) of classes (node, vector, copies): edges of stars, and link counts to be summed by node."""
    bits, tables = plan(n, cosine, recall)
    width = code_bytes(bits)
    coded = materialise(classes.select("node", "vector", "copies", F.size("vector").alias("size"), _coder(bits, tables)("vector").alias("codes")), "codes")
    place = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("place")
    code = F.expr(f"substring(codes, place * {width} + 1, {width})")
    # Only buckets of more than CELL rows need more than one block; there are at most n * tables / CELL.
    cells = coded.select("codes", "size", place).groupBy("place", code.alias("code"), "size").agg(F.count("*").alias("rows")).filter(F.col("rows") > CELL)
    large = materialise(cells, "buckets")
    spread = (
        coded.select("*", place)
        .withColumn("code", code)
        .join(large, ["place", "code", "size"], "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / CELL), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    )
    share = F.pmod(F.xxhash64("place", "code", "size", "one", "two"), F.lit(max(1, -(-n * tables // SHARE))))
    # Vectors travel once for each table, in their own type.
    sent = spread.select("node", "vector", "copies", "codes", "size", "place", "own", "one", "two", share.alias("share"))
    return sent.groupBy("share").applyInArrow(_cell_links(cosine, width), "node string, root string, n long")


def near_duplicates(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    array = F.col(vector).cast("array<double>")
    odd = F.exists(array, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(~odd & F.exists(array, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value; the text of the components names a vector exactly.
    named = F.when(fit, F.substring(F.sha2(F.to_json(F.transform(array, lambda x: x + F.lit(0.0))).cast("binary"), 256), 1, 32))
    ids = rows.select(F.col(vec_id).alias("vec_id"), named.alias("node"), F.when(fit, F.col(vector)).alias("vector"))
    classes = materialise(ids.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    found = materialise(links(classes.select("node", "vector", "copies"), classes.count(), cosine, recall), "links")
    roots = connected_components(found.select("node", "root")).filter("node <> root")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = materialise(classes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = named.join(least, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = ids.select("vec_id", "node").join(by_class, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
