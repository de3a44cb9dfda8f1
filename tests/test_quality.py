import pytest
from pyspark.sql import functions as F

from logloom import domain
from logloom.operators import dataset, quality


@pytest.fixture
def counts(spark):
    pairs = [("Error", "Error")] * 3 + [("Error", "Noise")] + [("Noise", "Noise")] * 4 + [("SYSTEM", "")] + [("Noise", "Odd")]
    return quality.confusion_counts(spark.createDataFrame(pairs, "true_label string, predicted_label string"))


def test_matrix_lists_base_labels_then_unseen_ones(counts):
    cells = quality.confusion_matrix(counts).collect()
    names = {r["true_index"]: r["true_label"] for r in cells}
    assert [names[i] for i in sorted(names)] == [*domain.LABELS, "Odd"]
    assert len(cells) == 25 and sum(r["n"] for r in cells) == 9  # the blank prediction has no column


def test_metrics_by_hand(counts):
    per = {r["label"]: r for r in quality.per_class_metrics(counts).collect()}
    assert (per["Error"]["precision"], per["Error"]["recall"], per["Error"]["support"]) == (1.0, 0.75, 4)
    assert (per["Noise"]["precision"], per["Noise"]["recall"]) == (0.8, 0.8)
    assert (per["CONFIGURATION"]["f1"], per["CONFIGURATION"]["present"]) == (0.0, False)
    row = quality.summary_metrics(quality.per_class_metrics(counts)).first()
    assert row["accuracy"] == pytest.approx(0.7)
    # Present: Error, Noise, SYSTEM, Odd and the blank prediction.
    assert row["macro_recall"] == pytest.approx((0.75 + 0.8) / 5)
    assert row["weighted_recall"] == pytest.approx(0.7)


def test_gate_names_its_failures(counts):
    verdict = quality.gate_verdict(quality.per_class_metrics(counts)).first()
    assert not verdict["gate_pass"]
    assert verdict["failed_checks"][0] == "accuracy 0.7000 < min_accuracy 0.9000"
    assert "recall[CONFIGURATION] 0.0000 < min_recall_per_class[CONFIGURATION] 0.8500" in verdict["failed_checks"]


def test_perfect_predictions_pass_and_are_no_drift(spark):
    rows = spark.createDataFrame([(x, x) for x in domain.LABELS], "true_label string, predicted_label string")
    per = quality.per_class_metrics(quality.confusion_counts(rows))
    assert quality.gate_verdict(per).first()["gate_pass"]
    assert quality.drift_status(per).first()["status"] == "ok"


def test_drift_levels(spark):
    rows = spark.createDataFrame([(x, x) for x in domain.LABELS] * 10 + [("Error", "Noise")] * 3, "true_label string, predicted_label string")
    status = quality.drift_status(quality.per_class_metrics(quality.confusion_counts(rows))).first()
    assert status["status"] == "warning" and status["critical_failures"] == []
    assert status["warning_failures"][0].startswith("warning.recall[Error] 0.7692 < warning.min_recall_per_class[Error]")


def test_policies():
    with pytest.raises(ValueError, match="missing"):
        quality.checked_policy({})
    with pytest.raises(ValueError, match="outside"):
        quality.checked_policy({**domain.GATE_POLICY, "min_accuracy": 2})
    assert list(quality.checked_drift_policy(domain.GATE_POLICY)) == ["critical"]
    with pytest.raises(ValueError, match="critical"):
        quality.checked_drift_policy({"warning": domain.GATE_POLICY})


def test_gate_cache(spark):
    history = spark.createDataFrame(
        [(1, "2024-01-01", True, "m", "g", "p"), (2, "2024-01-03", False, "m", "g", "p"), (3, "2024-01-02", True, "m", "g", "p"), (4, "2024-01-09", True, "m", "x", "p")],
        "report_id int, created_at string, gate_pass boolean, model_hash string, golden_set_hash string, policy_hash string")
    asked = spark.createDataFrame([("m", "g", "p"), ("m", "q", "p")], "model_hash string, golden_set_hash string, policy_hash string")
    hits = {r["golden_set_hash"]: (r["cache_hit"], r["report_id"]) for r in quality.gate_cache_lookup(asked, history).collect()}
    assert hits == {"g": (True, 3), "q": (False, None)}


def test_earliest_of_equal_trials_wins(spark):
    trials = spark.createDataFrame([(1, 0.5), (3, 0.9), (2, 0.9)], "trial_index int, macro_f1 double")
    assert quality.select_trial(trials).first()["trial_index"] == 2


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("x", 1)], "a string, b int")
    key = lambda df: dataset.dataset_fingerprint(df).first()["data_version_id"]
    assert key(a) == key(a.orderBy(F.desc("a")).repartition(3))
    assert key(a) != key(a.distinct())


def test_valid_rows_only(spark):
    rows = spark.createDataFrame([("a", " ERROR "), (None, "Noise"), ("b", "what"), ("c", None)], "message string, class string")
    assert [(r["message"], r["class"], r["label"]) for r in dataset.valid_labeled(rows).collect()] == [("a", "Error", 0)]
    with pytest.raises(ValueError):
        dataset.valid_labeled(rows.where("message = 'b'"), check=True)


def test_ordered_fingerprint_follows_the_order_and_not_the_partitions(spark):
    rows = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    of = lambda df, fan=8: dataset.ordered_fingerprint(df, ["id"], ["text"], fan).first()
    whole = of(rows)
    assert whole["row_count"] == 1000 and all(of(rows.repartition(n)) == whole for n in (1, 7, 40))
    swapped = rows.withColumn("id", F.when(F.col("id") == 500, 501).when(F.col("id") == 501, 500).otherwise(F.col("id")))
    assert of(swapped) != whole and dataset.dataset_fingerprint(swapped, ["text"]).first() == dataset.dataset_fingerprint(rows, ["text"]).first()
    assert of(rows.where("id < 999")) != whole and of(rows.limit(0))["row_count"] == 0 and of(rows.limit(1))["row_count"] == 1


def test_file_fingerprints_are_those_of_the_bytes(spark, tmp_path):
    import hashlib

    for name, data in (("a.csv", b"x,y\r\n1,2\n"), ("b.bin", bytes(range(256)))):
        (tmp_path / name).write_bytes(data)
    got = {r["source_file"]: (r["file_sha256"], r["bytes"]) for r in dataset.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in tmp_path.iterdir()}
