"""Mixtures of languages pass the first stage; what has no language does not."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from assayer.llm.langid import identify
from tests.llm import corpus


def test_a_text_in_three_languages_stays(spark):
    docs = corpus.documents(spark)
    by_lang = {}
    for r in docs.where("n_chars > 2000").orderBy("doc_id").select("lang", "text").collect():
        by_lang.setdefault(r["lang"], r["text"])
    cuts = zip(sorted(by_lang)[:3], (800, 750, 700), strict=True)
    mixed = "\n".join(by_lang[lang][:n] for lang, n in cuts)
    extra = docs.limit(1).drop("doc_id", "text").crossJoin(
        spark.createDataFrame([(10**9, mixed), (10**9 + 1, "123 --- 456")], "doc_id long, text string")
    )
    docs = docs.unionByName(extra.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    score = identify(docs, keep=["doc_id"]).where(f"row.doc_id = {10**9}").first()["score"]
    assert 0 < score < 0.5
    left = {r["doc_id"] for r in pipeline.languages(spark, docs, "").where(f"doc_id >= {10**9}").collect()}
    assert left == {10**9}
