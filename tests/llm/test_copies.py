"""Copies of texts change nothing in what the language model learns."""

from zonalis.llm import langid


def test_language_of_copies_is_learned_from_all_its_texts(spark):
    names = [f"w{chr(97 + i)}rt" for i in range(8)]
    once = spark.createDataFrame([("en", f"the plain text {n}") for n in names] + [("xx", f"zyq xqv {n}") for n in names], "lang string, text string")
    copies = once.filter("lang = 'xx'").crossJoin(spark.range(2000)).select("lang", "text")
    few, many = langid.fit(once, docs=8), langid.fit(once.filter("lang = 'en'").union(copies), docs=8)
    assert many.langs == few.langs == ["en", "xx"]
    df = spark.createDataFrame([(1, "zyq xqv"), (2, "the plain text")], "doc_id int, text string")
    one, two = ({r["doc_id"]: r["language"] for r in langid.predict(df, m).collect()} for m in (few, many))
    assert one == two and (two[1]["lang_pred"], two[2]["lang_pred"]) == ("xx", "en")
