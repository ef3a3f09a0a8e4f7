from pyspark.sql import functions as F

from gleanery.plans import catalogue


def test_late_rows_of_many_pages_meet(spark, tmp_path):
    """Ids more than the watermark's day of seconds apart: what comes in the second part is late, but not lost."""
    ids = [*range(40), *range(100_000, 100_040), *range(300_000, 300_040)]
    pages = spark.createDataFrame([(i,) for i in ids], "page_id long").select("page_id", F.concat(F.lit("https://a.example/"), F.col("page_id").cast("string")).alias("url"), F.lit("x").alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    cells = [sorted((r.key, r.change) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()) for name in ("changed_between_streams", "changed_between_runs")]
    assert cells[0] == cells[1] and len(cells[0]) > 100
