import zlib

import corpus_pipeline
from kestrel.llm import jaccard, langid
from tests.conftest import SF001


def test_stages_follow_the_contract(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "byte_bpe"]
    rows = {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, SF001).checkpoint()
        rows[name] = cur
        if name != "byte_bpe":
            assert cur.columns == docs.columns and cur.dtypes == docs.dtypes
    assert rows["language_id"].count() == docs.count()
    clean = spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1").select("doc_id")
    assert rows["quality"].join(clean, "doc_id").count() >= 0.97 * clean.count()
    kept = {r[0] for r in rows["near_duplicates"].select("doc_id").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.join(rows["quality"]).collect()}
    assert kept == set(classes.values())
    mixed = {r[0] for r in rows["mixing"].select("doc_id").collect()}
    assert mixed == kept
    assert rows["byte_bpe"].count() == rows["mixing"].count()
    assert corpus_pipeline.run(spark, SF001).count() == rows["byte_bpe"].count()


def test_ambiguous_languages_go(spark):
    """A near tie of two languages and unlearned ones go; clean short texts stay."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    said = {lang: docs.where(docs.lang == lang).orderBy("doc_id").first() for lang in ("de", "en", "es", "fr")}
    bad = [said["de"]["text"][:400] + " " + said["en"]["text"][:400], "Καλημέρα σας τι κάνετε σήμερα", "Привет как дела сегодня"]
    extra = [(-1 - i, t, None) for i, t in enumerate(bad)] + [(-10 - i, r["text"][:30], lang) for i, (lang, r) in enumerate(said.items())]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True), SF001).checkpoint()
    assert {r["doc_id"]: r["lang"] for r in kept.where("doc_id < 0").collect()} == {i: lang for i, _, lang in extra if lang}
    assert kept.where("doc_id >= 0").count() == docs.count()


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "short text", None, "a", 10), (2, "short text", None, "a", 10)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    none = docs.limit(0)
    cur, cur0 = docs, none
    for _, stage in corpus_pipeline.STAGES:
        cur, cur0 = stage(spark, cur, SF001).checkpoint(), stage(spark, cur0, SF001).checkpoint()
        assert cur0.count() == 0
    assert langid.UND == "und" and zlib.crc32(b"1") >= 0
