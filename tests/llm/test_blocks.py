"""Blocks of a benchmark, kept rows of near-duplicates, and the bound that the range join uses."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from zonalis.llm import decontaminate, simhash


def test_blocks_one_at_a_time_find_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    build, seen = decontaminate.Windows.__init__, []

    def counted(self, items, *args):
        seen.append(len(items))
        build(self, items, *args)

    rows = lambda **more: sorted((r["doc_id"], r["f"].asDict()) for r in decontaminate.find_windows(docs, bench, into="f", **more).select("doc_id", "f").collect())
    whole = rows()
    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    parts = rows(block_bytes=4_000)
    norm = lambda found: [(i, {**f, "items": sorted(set(f["items"]))}) for i, f in found]
    assert len(seen) > 2 and norm(parts) == norm(whole) and any(f["starts"] for _, f in whole)


def test_manhattan_distance_is_a_lower_bound():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    counts = [[(x >> 2 * k & 1) + (x >> 2 * k + 1 & 1) for k in range(32)] for x in values]
    own = simhash.embedded(np.array(values, dtype=np.uint64)).tolist()
    for i, j in itertools.combinations(range(len(values)), 2):
        distance = sum(abs(a - b) for a, b in zip(counts[i], counts[j]))
        assert (own[i] ^ own[j]).bit_count() == distance <= (values[i] ^ values[j]).bit_count()


def test_kept_rows_are_the_components_least(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.union(docs.filter("doc_id % 3 = 0")).union(docs.filter("doc_id % 50 = 1").withColumn("doc_id", F.lit(None).cast("long")))
    found = simhash.near_duplicates(docs).filter("component_id is not null").select("component_id").distinct().collect()
    least = sorted(r["component_id"] for r in found)
    for table in (10**6, -1):
        monkeypatch.setattr(simhash, "TABLE", table)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == least
        assert kept.exceptAll(docs).isEmpty()
