"""Language identification and the quality classifier against plain versions of themselves."""

import itertools
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import DATA
from zonalis.llm import langid, quality


def test_words_keep_their_marks_and_letters_decide():
    assert langid.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and langid.words("ตั้ง") == ["ตั้ง"]
    assert langid.words("½ ② ² 12 _ ̂") == [] and langid.words("Don't 漢字3x") == ["don", "t", "漢字", "x"]


def test_texts_without_a_letter_are_und(spark):
    model = langid.train([("en", ["the", "and"]), ("hi", ["हिन्दी"])])
    df = spark.createDataFrame([(1, "½ ② ² ٣ 🙂"), (2, "x"), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["language"] for r in langid.predict(df, model).collect()}
    assert [got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 3, 4)] == [True] * 3 and got[2]["lang_pred"] in model.langs


def test_scripts_of_long_letters_are_told_apart():
    """Languages of one script differ by single characters and their neighbours."""
    rng = np.random.default_rng(1)
    letters = {"ja": "のをはがにでとる日本語", "zh": "的了是在不我有他这中国", "hi": "कखगघचछजझहि", "mr": "ळझञणतथदधनप", "th": "กขคงจฉช"}
    make = lambda lang: ["".join(rng.choice(list(letters[lang]), size=rng.integers(3, 9))) for _ in range(40)]
    model = langid.train([(lang, make(lang)) for lang in letters for _ in range(10)])
    for lang in letters:
        found, scores = model.predict([" ".join(make(lang))])
        assert found == [lang] and scores[0] > 0.8


def log_likelihood(model, chain, gold):
    scores, n = model.scores(chain), len(chain)
    weight = lambda path: model.start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))
    return weight(gold) - math.log(sum(math.exp(weight(p)) for p in itertools.product(range(len(model.langs)), repeat=n)))


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    pieces = [(0, ["ab", "cd", "ab"]), (1, ["xy", "ab", "xz"]), (2, ["q"]), (1, ["cd", "xz", "q", "ab"])]
    model = langid.Model(["a", "b", "c"], rng.normal(0, 0.3, (256, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    data = langid.Chains(pieces, 3, 256)
    chains, golds = langid._switched(pieces)
    whole = lambda: sum(log_likelihood(model, c, g.tolist()) for c, g in zip(chains, golds))
    weights, moves, start = data.gradients(model)
    step = 1e-5
    for values, gradient in ((model.weights, weights), (model.moves, moves), (model.start, start)):
        flat = rng.permutation(np.flatnonzero(gradient.ravel()))[:25]
        assert len(flat)
        for at in flat:
            old = values.flat[at]
            values.flat[at] = old + step
            up = whole()
            values.flat[at] = old - step
            down = whole()
            values.flat[at] = old
            assert gradient.flat[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6)


def test_more_languages_than_a_few_hundred_are_all_learned(spark):
    rows = [(f"l{k:03d}", f"word{chr(0x4E00 + k)} {chr(0x4E00 + k) * 3}") for k in range(230)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), docs=2)
    assert len(model.langs) == 230 and model.weights.size <= langid.WEIGHTS
    assert model.predict([rows[17][1], rows[229][1]])[0] == ["l017", "l229"]


def test_whole_training_texts_are_read(spark):
    """What only stands at the end of a long text is learned too."""
    rows = [("en", "the " * 3000 + "zebra quagga"), ("fr", "le " * 3000 + "okapi girafe")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.predict(["zebra quagga", "okapi girafe"])[0] == ["en", "fr"]


# Quality ------------------------------------------------------------------------


def plain_sizes(texts, cut=1024):
    parts = [t[i : i + cut] for t in texts for i in range(0, len(t), cut)]
    made = zstandard.train_dictionary(min(112_640, sum(map(len, parts)) // 4), parts, level=3)
    return lambda t: sum(len(zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False, write_dict_id=False).compress(t[i : i + cut])) for i in range(0, len(t), cut))


def test_quality_scores_against_a_plain_version(spark):
    """Dictionaries, sizes and calibration made anew from the labelled rows; the calibration must be at its optimum."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(400), spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    model = quality.fit(docs, labels, sample=10**6)
    every = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("m")).filter("y = m")
    share = every.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id", F.lit(8)).bitwiseAND(F.lit((1 << 62) - 1))
    known = [(r["y"], r["text"].encode()) for r in docs.join(every, "doc_id").filter("text <> ''").orderBy(order).collect()]
    kinds = {y: [t for k, t in known if k == y] for y in (0, 1)}
    good, bad = plain_sizes(kinds[1]), plain_sizes(kinds[0])
    a, b, c = model.state[2]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, into="score").collect()}
    for r in docs.collect():
        t = (r["text"] or "").encode()
        x = a + b * (bad(t) - good(t)) / (len(t) + 128) + c * 128 / (len(t) + 128)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, x)))), rel=1e-9)
    # The calibration's penalised gradient vanishes on evidence from dictionaries of the other half.
    rows = []
    for half in (0, 1):
        g, w = plain_sizes(kinds[1][half::2]), plain_sizes(kinds[0][half::2])
        rows += [(1.0, (w(t) - g(t)) / (len(t) + 128), 128 / (len(t) + 128), y) for y in (0, 1) for t in kinds[y][1 - half :: 2]]
    rows = np.array(rows)
    x, y = rows[:, :3], rows[:, 3]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    p = 1 / (1 + np.exp(-(x @ [a, b, c])))
    pull = np.array([1e-5, *(1e-4 * x[:, 1:].var(axis=0))])
    assert np.allclose((weight * (y - p)) @ x / len(x), pull * [a, b, c], atol=1e-6)


def test_a_mark_at_the_end_of_long_training_texts_counts(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    tails = ["splendid prose of the finest kind " * 20, "buy now cheap pills click here " * 20]
    rows = [(k, noise(1500) + tails[k % 2], 1 - k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    good, bad = (model.evidence(t.encode())[0] for t in tails)
    assert good > 0.02 and bad < -0.02
