"""The model knows every language with enough labelled rows, however small its share of the table is."""

from pyspark.sql import functions as F

from quartzgrid.llm import langid


def rows(n, first, text, lang):
    return [(first + i, f"{text} {'x' * (i % 7)}", lang, "h") for i in range(n)]


def test_rare_languages_are_in_the_sample(table):
    docs = table(rows(600, 0, "the and of with hand", "en") + rows(600, 1000, "der die und mit hand", "de") + rows(6, 2000, "le la et avec une main", "fr") + rows(4, 3000, "el la y con una mano", "es"))
    model = langid.train(docs, rows=50, each=10)
    assert model.languages == ("de", "en", "fr")
    got = langid.identify(docs, model).where("lang = 'fr'").collect()
    assert len(got) == 6 and all(r["language"] == "fr" and r["accepted"] for r in got)


def test_equal_rows_are_drawn_as_one(table):
    """A language of one repeated row is in the model, and a repeated row does not outweigh the rest of its language."""
    docs = table([(1, "le la et avec une main", "fr", "h")] * 300 + [(2, "zz", "en", "h")] * 300 + rows(300, 100, "the and of with hand", "en"))
    model = langid.train(docs, rows=40, each=20)
    assert model.languages == ("en", "fr")
    a, b = (model.table[0][langid.trigrams(langid.fold(t))].mean() for t in ("the and of with", "zz"))
    assert a > b
    assert langid.train(docs.drop("doc_id"), rows=40, each=20).languages == ("en", "fr")
    assert langid.train(docs.withColumn("lang", F.lit(None).cast("string"))).languages == ()


def test_pages_of_all_kinds(spark, table):
    model = langid.train(table(rows(60, 0, "the and of with hand", "en") + rows(60, 100, "der die und mit hand", "de")))
    page = "<html lang='de'><body>der die und mit hand</body></html>"
    pages = [
        (1, "https://a.de/x", page, "k", 1), (1, "https://a.de/x", page, "k", 1), (2, None, page, "k", 2), (3, "no address", "the and of with hand", None, 3),
        (4, "https://a.de", None, "k", 4), (5, "https://a.de", "", "k", 5), (None, None, None, None, None), (6, "https://b.com", "<p>" + "the and of with hand " * 50_000, "k", 6),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, language string, _plain int")
    out = langid.identify_pages(df, model)
    assert set(out.columns) == {"page_id", "url", "html", "_plain", "language", "confidence", "accepted", "text_language"}
    got = sorted((r["page_id"] or 0, r["language"], r["accepted"]) for r in out.collect())
    assert got == [(0, "und", False), (1, "de", True), (1, "de", True), (2, "de", True), (3, "en", True), (4, "und", False), (5, "und", False), (6, "en", True)]
    assert langid.identify_pages(df.limit(0), model).collect() == []
