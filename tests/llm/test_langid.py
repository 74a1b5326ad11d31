import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalake.llm import langid
from quotalake.llm.queries import op13_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = op13_langid(spark, SF).join(truth, "doc_id").where("held_out").toPandas()
    right = found.lang_pred == found.lang
    assert len(found) > 200 and right.mean() > 0.98
    assert found.score.between(0, 1).all() and abs(found.score.mean() - right.mean()) < 0.03
    assert found.rejected.mean() < 0.05


def test_held_out_rows_and_other_columns_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = langid.fold(F.col("doc_id"))
    turned = docs.withColumn("lang", F.when(fold == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    one, two = (langid.fit(x, fold != 2) for x in (docs, turned))
    assert one.langs == two.langs == ("de", "en", "es", "fr")
    assert (one.table == two.table).all() and (one.bias == two.bias).all() and one.temperature == two.temperature


def test_pieces_give_the_grams_of_the_whole(monkeypatch):
    text = "Ünder the Brücke, 3 cats; 日本語 and \U00010400x! a b cd " * 7
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    for size in (5, 7, 64, len(text), len(text) + 1):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


def test_grams_are_those_inside_words():
    text = "Ab, cde"
    words, want = ["ab", "cde"], 0
    for w in words:
        bordered = f"<{w}>"
        want += sum(max(0, len(bordered) - n + 1) for n in (2, 3, 4))
    # The two borders between the words are neighbours, which is no gram.
    assert sum(map(len, langid.grams(text))) == want
    assert sum(map(len, langid.grams("12 -- 3"))) == sum(map(len, langid.grams(""))) == sum(map(len, langid.grams(None))) == 0


def test_table_is_the_averaged_embedding_model(spark):
    rows = [(lang, *langid._counted(text)) for lang, text in [("a", "aba bab ab"), ("b", "xyx yxy xy")] * 15]
    model = langid.fit_rows(rows)
    assert model.langs == ("a", "b")
    p = [model.probabilities(t) for t in ("bab aba", "yxy")]
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and all(abs(x.sum() - 1) < 1e-9 for x in p)
    assert langid.fit_rows([]) is None


def test_unlike_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    texts = ["щука моржа будет вечер когда", "漢字 仮名 交じり 文章", "qqq zzz xkx wvw jjq"] * 3
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert langid.identify(odd, model, F.lit(False)).where("rejected").count() >= 3


def test_odd_rows(spark, odd_docs, no_docs):
    fold = langid.fold(F.col("doc_id"))
    held = F.coalesce(fold == 2, F.lit(False))
    docs = (odd_docs.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y"))
            .withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 3 == 0, "yy")))
    rows = langid.identify(docs, langid.fit(docs, fold != 2), held).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.lang_pred for r in rows if r.doc_id in (30, 31, 32)}
    assert blank == {"und"} and {r.lang_pred for r in rows if r.doc_id is not None and r.doc_id not in (30, 31, 32)} <= {"xx", "yy"}
    digits = docs.withColumn("text", F.lit("12 - 3 \t !"))
    assert {(r.lang_pred, r.score) for r in langid.identify(digits, langid.fit(docs, fold != 2), held).collect()} == {("und", 0.0)}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(none, langid.fit(none, fold != 2), held).collect()} == {("und", 0.0, True)}
    assert langid.fit(no_docs, fold != 2) is None and langid.identify(no_docs, None, held).count() == 0
    one = docs.withColumn("lang", F.lit("zz"))
    assert {r.lang_pred for r in langid.identify(one, langid.fit(one, fold != 2), held).collect()} == {"zz", "und"}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_calibration_keeps_order(n):
    z = np.array([[1.0, 0.5, -2.0]])
    p = langid._calibrated(z, np.array([n]), (0.5, 0.3))
    assert p.argmax() == 0 and abs(p.sum() - 1) < 1e-12
