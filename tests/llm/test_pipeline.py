"""The pipeline against a brute-force version of its stages."""

import re

import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_ops import base_spans, brute_components
from zonalis.llm import bpe


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert set(corpus_pipeline.queries()) == {"pipeline"}


def contaminated(text: str, bench: list[str]) -> bool:
    ws = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    own, hit = ws(text), set()
    windows = {tuple(b[i : i + min(13, len(b))]) for b in map(ws, bench) for i in range(max(0, len(b) - 12) or 1) if b}
    for n in {len(w) for w in windows}:
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    known = corpus_pipeline.identify_language(spark, docs, DATA)
    assert known.columns == docs.columns and known.count() == docs.filter("text rlike '\\\\p{L}'").count()
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    keep = {c for _, _, c in brute_components(rows)}
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    expected = {}
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    for i, text in rows:
        if i in keep and not contaminated(text, bench):
            expected[i] = text
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(expected)
    for i, text in expected.items():
        spans, out, at = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in base_spans(text))), "", 0
        for s, e in spans:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        assert got[i]["ids"] == library.encode(out + text[at:], add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["ids"])


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "long " * 30_000, "en"), (None, "no id at all here", "en"), (5, "twice the same text here", "en"), (5, "twice the same text here", "en"), (6, "12345 !!!", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "language_found": F.lit("own"), "found": F.lit("own"), "fp": F.lit("own")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.filter("language_found <> 'own' or found <> 'own' or fp <> 'own'").isEmpty()
        docs = out
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 3, 5]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 3
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, DATA)
    assert nothing.count() == 0
