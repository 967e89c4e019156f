import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    good = labels.where("quality = 1").join(docs, "doc_id").where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 20)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_pipeline_on_odd_rows(spark, tmp_path, rows):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    data = [(1, text, "en", "a", 0), (2, text, "en", None, 0), (3, None, None, "a", None), (4, "", "en", "b", 0), (None, other, "en", "b", 0), (5, other[::-1], "en", "b", 0), (5, other[::-1], "en", "b", 0)]
    df = spark.createDataFrame(data if rows == "edge" else [], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)] if rows == "edge" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (rows == "edge")
    if rows == "edge":
        assert {r["doc_id"] for r in out} >= {1} and not {2, 3, 4} & {r["doc_id"] for r in out}
