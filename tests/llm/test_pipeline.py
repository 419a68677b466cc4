"""The pipeline's stages, each on its own input, against plain conditions."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert set(out.columns) == set(corpus_pipeline.COLUMNS), name
        assert out.join(kept, "doc_id", "left_anti").count() == 0, name
        kept = out
    assert 0.5 * docs.count() < kept.count() <= docs.count()
    assert kept.groupBy("text").count().filter("count > 1").count() == 0
    pieces = corpus_pipeline.packing(spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.count()


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.filter(F.col("length") > 2048).count() == 0


def test_secrets_are_gone(spark):
    rows = [(1, "my token = 'abcdefghijkl1234' and more", "en", "s", 38), (2, "nothing here", "en", "s", 12), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    assert "abcdefghijkl1234" not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[3]["n_chars"]) == ("nothing here", None, None)


def test_stages_on_odd_and_empty_tables(spark):
    """Null and empty texts, null ids, languages and sources, repeated rows, and clashing columns.

    Near-dedup keeps rows without an id, as it states.
    """
    text = "the cat sat on a mat by the door of that house"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, text, "en", "a", 46), (4, text, "de", "b", 46), (4, text, "de", "b", 46)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, node string")
    kept = {"language ID": 3, "quality rules": 0, "near-dedup": 4, "secret scans": 5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(corpus_pipeline.COLUMNS), name
        assert out.count() == kept[name], name
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert len(pieces) == 5 and sum(r["length"] == 1 for r in pieces) == 2
    assert corpus_pipeline.packing(spark, docs.filter("false"), SF).count() == 0
