"""The pipeline's stages against plain versions of what they decide, on the small tables."""

from fractions import Fraction

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quillon.llm import quality_classifier, quality_rules  # noqa: E402
from quillon.llm.common import materialize  # noqa: E402
from tests.llm.test_ngram_join import brute  # noqa: E402


def test_stages(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
        seen.append(docs)
    rules, quality, unique, mixed, encoded = seen
    assert all(d.columns == documents.columns for d in seen[:4])
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(rules) == ids(quality_rules.quality_rules(documents, labels).where("kept"))
    assert ids(quality) == ids(quality_classifier.quality_classifier(rules, labels).where("predicted = 1"))
    rows = [(r.doc_id, r.text) for r in quality.collect()]
    assert ids(unique) == sorted({c for _, _, c in brute(rows, 5, Fraction(4, 5))})
    assert set(ids(mixed)) == set(ids(unique)) and len(ids(mixed)) >= len(ids(unique))
    assert ids(encoded) == ids(mixed) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(encoded.columns)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    base_ok = set(ids(quality_rules.quality_rules(documents, labels).where("not base_failed")))
    judged = good & base_ok
    assert len(judged & set(ids(quality))) >= 0.95 * len(judged)


def test_one_of_each_with_repeated_rows(spark):
    from quillon.llm.ngram_join import one_of_each

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (5, text, "a"), (3, text + " x", "a"), (None, text, "a"), (9, "", "a"), (10, None, "a"), (11, "other words here", "b")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert got.columns == ["doc_id", "text", "key"]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["10", "11", "3", "9", "None"]


def test_odd_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text + " more", "en", "s"), (None, text, None, None), (3, None, "en", "s"), (4, "", None, "s"), (5, "other " + text[::-1], "xx", None), (6, "#$% " * 50, "de", "s")]
    columns = "doc_id long, text string, lang string, source string, key int, node string, tile long, x int, row string, tokens int, p string, m string"
    more = (7, "n", 8, 9, "r", 1, "p", "m")
    spark.createDataFrame([(d, x, 1) for d, x in ((1, 1), (2, 1), (2, 0), (6, 0), (None, 1), (5, None))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(*r, *more) for r in rows], columns).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, f"{tmp_path}/odd"), "test")
        assert [c.split()[0] for c in columns.split(", ")] == docs.columns
    kept = sorted(str(r.doc_id) for r in docs.collect())
    assert set(kept) <= {"1", "5", "None"} and "None" in kept and all(r.key == 7 and r.p == "p" for r in docs.collect())
    assert sorted(str(r.doc_id) for r in corpus_pipeline.encode(spark, docs, f"{tmp_path}/odd").collect()) == kept

    for name in ("labels", "documents"):
        spark.read.parquet(f"{tmp_path}/odd/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
