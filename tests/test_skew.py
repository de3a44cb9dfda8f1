from pyspark.sql import functions as F

from logloom.operators import feedback, quality
from logloom.operators.skew import repeated, spread_join
from logloom.sources import records


def test_a_hot_key_is_split_without_a_ceiling(spark):
    many = spark.range(20_000).select("id", F.lit("hot").alias("key"))
    few = spark.createDataFrame([("hot", 1)], "key string, v int")
    joined = spread_join(many, few, ["key"], hot_rows=20)
    assert joined.count() == 20_000 and joined.select("id").distinct().count() == 20_000


def test_equal_rows_are_spread(spark):
    rows = spark.createDataFrame([("hot", "Noise", 100_000)], "message string, class string, n bigint")
    out = repeated(rows, "n", 1000)
    assert out.columns == ["message", "class"] and out.count() == 100_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_feedback_keeps_the_number_of_equal_rows(spark):
    base = spark.createDataFrame([("a", "Noise")] * 5 + [("b", "Error")], "message string, class string")
    events = spark.createDataFrame([("e1", "2024-01-01", "a", "SYSTEM"), ("e2", "2024-01-01", "c", "Error")], "event_id string, received_at string, message string, correct_label string")
    got = sorted(tuple(r) for r in feedback.upsert_feedback(base, events).collect())
    assert got == [("a", "SYSTEM")] * 5 + [("b", "Error"), ("c", "Error")]


def test_files_of_any_suffix_case_are_read_once(spark, tmp_path):
    for name, text in {"a.TXT": "one", "b.Json": '["two"]', "c.Jsonl": '"three"', "d.xyz": "four", "e.log": "five"}.items():
        (tmp_path / name).write_text(text)
    assert sorted(r["message"] for r in records.read_scoring_records(spark, str(tmp_path)).collect()) == ["five", "four", "one", "three", "two"]


def test_golden_rows_without_a_prediction_stay(spark):
    golden = spark.createDataFrame([(2, "m", "Noise"), (3, "n", "Error")], "line_number int, message string, label string")
    judged = quality.score_join(golden, spark.createDataFrame([(2, "Noise")], "line_number int, predicted_label string"))
    assert sorted((r["line_number"], r["predicted_label"], r["match"]) for r in judged.collect()) == [(2, "Noise", True), (3, "", False)]


def test_text_after_an_object_is_plain_text(spark):
    from logloom.functions.payload import extract_message, normalize_payload

    row = spark.createDataFrame([('{"a":1} boom',)], "raw string").select(extract_message("raw").alias("m"), normalize_payload("raw", F.lit("T")).alias("p")).first()
    assert row["m"] == '{"a":1} boom' and row["p"] == '{"message":"{\\"a\\":1} boom","received_at":"T"}'
