"""Rows are dealt to tasks by their number, whatever their file or key."""

from pyspark.sql import functions as F

from maskwright.operators import blocks as bl, detectors as dt
from maskwright.plans import queries as q
from maskwright.session import SPREAD, dealt
from maskwright.sources import fixtures as fx


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_equal_keys_and_nulls_are_dealt(spark):
    keys = spark.range(1000, numPartitions=1).select(F.when(F.col("id") % 2 == 0, 7).alias("k"))
    sizes = _sizes(dealt(keys, rows=100))
    assert len(sizes) == 10 and max(sizes) <= 120 and sum(sizes) == 1000
    assert dealt(keys).rdd.getNumPartitions() == 1  # few rows stay where they are


def test_derived_texts_come_in_many_tasks(spark, tmp_path):
    spark.range(50_000, numPartitions=1).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    texts = fx.run_sql(spark, str(tmp_path), fx.CONTACTS)
    assert texts.count() == 50_000 and max(_sizes(texts)) < 20_000


def test_texts_of_one_row_group_come_in_many_tasks(spark, tmp_path):
    """Without the spread setting, as on a cluster."""
    rows = spark.range(20_000, numPartitions=1).withColumn("text", F.when(F.col("id") % 3 > 0, F.lit("mail a@b.example.org")))
    rows.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(SPREAD, "false")
    try:
        texts = q.text_table(spark, str(tmp_path), "documents")
        sizes = _sizes(texts)
    finally:
        spark.conf.set(SPREAD, "true")
    assert sum(sizes) == 20_000 and max(sizes) < 6_000
    assert texts.select("doc_id").distinct().count() == 20_000
    assert texts.where("text is null").count() == len(range(0, 20_000, 3))


def test_a_part_is_parsed_once(spark):
    raw = spark.createDataFrame([(1, '{"paragraphs":["a"]}', "[7]", '{"cells":null}')], "doc_id long, body string, header string, footer string")
    read = bl.parts(raw, ["doc_id"])
    assert read._jdf.queryExecution().optimizedPlan().toJSON().count('"functionName":"parseJson"') == 1
    assert [(r.section, r.part is None) for r in read.collect()] == [("body", False), ("header", True), ("footer", False)]


def test_rules_are_not_merged_into_lambdas(spark):
    """What is merged into the sweep is interpreted for every row, gates included."""
    df = spark.createDataFrame([("Mail a@b.example.org or c@d.example.org",)], "text string")
    found = dt.detect(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " AS _candidates#" in plan
    assert [s.value for s in found.first().spans] == ["a@b.example.org", "c@d.example.org"]
