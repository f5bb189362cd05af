import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import langid, quality, queries
from tests.conftest import SF001

SF01 = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.op9_language_id(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"),
                                  ("le chien et le chat " * 5, "fr"), (None, "en"), ("nothing", None), ("", "de"), ("12 34 !!", "fr")])],
                                 "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"] and model.code.shape == (3, 3)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["en", "de", "fr"]
    assert [got[i]["lang_pred"] for i in (3, 5, 6)] == ["und"] * 3 and got[3]["score"] == 0.0
    long = spark.createDataFrame([(1, "der hund " * 200000), (1, "der hund " * 200000)], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(long, model).collect()} == {"de"}
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    one = langid.fit(docs.where("lang = 'de'"))
    assert langid.predict(docs.where("doc_id = 0"), one).first()["lang_pred"] == "de"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    d = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)]
    assert len(code) == n and d.min() >= max(1, code.shape[1] // 4)
    assert (np.abs(code.sum(0)) < n).all()  # every bit splits the languages


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    m = langid.LanguageModel(list("abcd"), code, np.zeros((1, 7)), np.ones(7), np.ones(7))
    for i in range(4):
        for bit in range(7):
            margins = code[i].astype(float)
            margins[bit] *= -0.4
            assert int(np.argmin(m.decode(margins))) == i


def test_quality_held_out(spark):
    got = queries.op4_quality(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = got["quality"].to_numpy(), got["score"].to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    assert auc > 0.97 and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert got["predicted"][got["quality"] == 1].mean() > 0.97


def test_quality_density_equals_formula():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, len(quality.STATS)))
    cov = np.cov(x.T) + np.eye(x.shape[1])
    low = np.linalg.cholesky(cov)
    m = quality.QualityModel(0.5, np.zeros((2, x.shape[1])) + [[0.0], [0.3]], np.array([np.linalg.inv(low)] * 2), np.array([-1.0, -2.0]))
    inv = np.linalg.inv(cov)
    dens = [o - 0.5 * np.einsum("ij,jk,ik->i", x - mu, inv, x - mu) for o, mu in zip(m.offsets, m.means, strict=True)]
    odds = dens[1] - dens[0]
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(-odds / (1 + np.abs(odds) / 30))))


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 300000, "x"), (3, "word " * 300000, "x"), (None, "Some text.", "x")],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 1), (3, 1), (99, 0)], "doc_id long, quality int")
    assert quality.fit(docs, odd).means is None
    docs0 = spark.read.parquet(f"{SF001}/documents.parquet")
    model = quality.fit(docs0, spark.read.parquet(f"{SF001}/labels.parquet"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0
