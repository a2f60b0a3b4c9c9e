"""Held-out accuracy of the two classifiers, and their scores by plain loops."""

from pyspark.sql import functions as F

from provena.llm import language_id, quality_cnn, queries

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has too few labels to learn from
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rows = [r for r in queries.op1_quality_cnn(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert len(rows) > 500 and right >= 0.98 * len(rows), (right, len(rows))


def test_held_out_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").collect()}
    rows = [r for r in queries.op5_language_id(spark, SF).collect() if r["held_out"] and r["doc_id"] in langs and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows)
    assert len(rows) > 250 and right >= 0.98 * len(rows), (right, len(rows))


def test_texts_without_letters_are_undetermined(spark):
    docs = [(i, f"the words of a text in a language {i}", "en") for i in range(40)] + [(100 + i, f"die Wörter eines Textes in einer Sprache {i}", "de") for i in range(40)]
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))
    odd = [(1, "² ½ 12"), (2, "Ⅷ ①"), (3, "_ _ 7"), (4, ""), (5, None), (6, "ª"), (7, "漢"), (8, "́ ·")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert {i for i, x in got.items() if x == "und"} == {1, 2, 3, 4, 5, 8} and got[6] in ("de", "en") and got[7] in ("de", "en")


def test_one_huge_labelled_text_does_not_stop_learning(spark):
    docs = [(i, ("$$$ " if i % 2 else "plain words ") * 30) for i in range(60)] + [(1000 + i, "z" * 5000) for i in range(8)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int")
    net = quality_cnn.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True), size=40_000)
    assert net is not None
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(spark.createDataFrame([(0, "plain words " * 30), (1, "$$$ " * 30)], "doc_id long, text string"), net).collect()}
    assert got[0] > 0.7 > 0.5 > got[1]
