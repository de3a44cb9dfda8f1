import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import domain
from logloom.operators import dataset, labeling, splits, training
from logloom.operators.indexing import into_batches, with_order_index


@pytest.fixture(scope="module")
def labelled(spark):
    # 400 groups of uneven size over four labels; group 0 holds a third of all rows.
    ids = spark.range(6000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.pmod(F.hash("id"), F.lit(400))))
    letters = F.translate(F.col("g").cast("string"), "0123456789", "ghijklmnop")
    label = F.element_at(F.array(*[F.lit(x) for x in domain.LABELS]), F.pmod("g", F.lit(4)).cast("int") + 1)
    return ids.select("id", F.concat(F.lit("kind "), letters, F.lit(" user="), "id").alias("message"), label.alias("class"))


@pytest.mark.parametrize("max_classes", [20_000, 40, 3])
def test_grouped_split_keeps_groups_whole(labelled, max_classes):
    out = splits.grouped_split(labelled, 0.2, max_classes=max_classes)
    assert out.count() == 6000
    assert dataset.leakage_check(out).count() == 0
    share = out.where("split = 'heldout'").count() / 6000
    assert 0.1 < share < 0.3


def _cost(counts, chosen, ratio):
    target = counts.sum(axis=0) * ratio
    held = counts[chosen].sum(axis=0)
    size = ((held.sum() - target.sum()) / max(target.sum(), 1.0)) ** 2
    return size + (((held - target) / np.maximum(target, 1.0)) ** 2).sum()


def _one_by_one(counts, ratio, order):
    """The plain rule: the group that lowers the cost most is added until none does; the first of equals in the order."""
    chosen, left = [], list(order)
    now = _cost(counts, chosen, ratio)
    while left:
        costs = [_cost(counts, [*chosen, g], ratio) for g in left]
        if min(costs) >= now:
            break
        now = min(costs)
        chosen.append(left.pop(costs.index(now)))
    return now


def _as_classes(counts):
    """(means, groups) of the classes of equal rows."""
    rows, number = np.unique(counts, axis=0, return_counts=True)
    return rows, number


def test_choice_is_never_worse_than_the_plain_rule():
    draw = np.random.default_rng(0)
    for case in range(300):
        counts = draw.integers(0, draw.integers(2, 9), size=(draw.integers(2, 14), draw.integers(1, 5))).astype(float)
        counts = counts[counts.sum(axis=1) > 0]
        if len(counts) < 2:
            continue
        ratio = float(draw.choice([0.1, 0.15, 0.3, 0.5]))
        means, groups = _as_classes(counts)
        chosen = splits.choose_heldout(means, groups, counts.sum(axis=0) * ratio, case)
        assert (chosen <= groups).all() and (chosen >= 0).all()
        mine = _cost(np.repeat(means, groups, axis=0), np.concatenate([np.arange(g) < c for g, c in zip(groups, chosen)]), ratio)
        for seed in range(3):
            assert mine <= _one_by_one(counts, ratio, np.random.default_rng(seed).permutation(len(counts))) + 1e-12


def test_choice_over_many_groups_of_few_classes_is_exact_and_quick():
    means = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [3, 1, 0, 0], [10**6, 0, 0, 0]], dtype=float)
    groups = np.array([10**9, 3 * 10**8, 10**7, 11, 10**6, 3])
    total = (means * groups[:, None]).sum(axis=0)
    chosen = splits.choose_heldout(means, groups, total * 0.15, 1)
    held = (means * chosen[:, None]).sum(axis=0)
    assert (chosen <= groups).all() and np.abs(held - total * 0.15).max() <= 4  # of hundreds of millions: a double holds no finer cost


def test_unlike_groups_of_one_class_are_made_up_for(spark):
    # Sizes from 40 to 240, told apart by few bits only, and single rows to fill up with.
    letters = lambda c: F.translate(F.col(c).cast("string"), "0123456789", "ghijklmnop")
    large = spark.range(60).select("id", F.explode(F.sequence(F.lit(1), 40 + F.pmod(F.col("id") * 37, F.lit(200)))).alias("i"))
    rows = large.select(F.concat(F.lit("kind "), letters("id")).alias("message"), F.when(F.col("id") % 3 == 0, "Error").alias("class"))
    rows = rows.union(spark.range(900).select(F.concat(F.lit("single x"), letters("id")), F.when(F.col("id") % 2 == 0, "Error")))
    for max_classes in (20_000, 30, 2):
        out = splits.grouped_split(rows, 0.2, max_classes=max_classes).cache()
        assert out.count() == rows.count() and dataset.leakage_check(out).count() == 0
        held = {r["class"]: r["n"] for r in out.where("split = 'heldout'").groupBy("class").agg(F.count("*").alias("n")).collect()}
        whole = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
        assert set(held) == set(whole) == {None, "Error"}
        if max_classes > 2:
            assert all(abs(held[x] - 0.2 * whole[x]) <= 5 for x in whole)


def test_folds_of_null_labels_and_many_equal_groups(spark):
    letters = F.translate(F.col("id").cast("string"), "0123456789", "ghijklmnop")
    rows = spark.range(3000).select("id", F.concat(F.lit("single x"), letters).alias("message"), F.when(F.col("id") % 3 > 0, "Error").alias("class"))
    out = splits.group_kfold(rows, 5)
    sizes = {(r["fold"], r["class"]): r["n"] for r in out.groupBy("fold", "class").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(f, c): n for f in range(5) for c, n in ((None, 200), ("Error", 400))}


def test_one_group_cannot_be_split(spark):
    rows = spark.createDataFrame([(f"a user={i}", "Noise") for i in range(20)], "message string, class string")
    with pytest.raises(splits.SplitImpossible):
        splits.grouped_split(rows, 0.2)
    assert splits.split_with_fallback(rows, 0.5).select("split").distinct().count() == 2


def test_kfold(labelled):
    out = splits.group_kfold(labelled, 4)
    sizes = {r["fold"]: r["n"] for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(sizes) == {0, 1, 2, 3} and sum(sizes.values()) == 6000
    assert out.groupBy("template_group").agg(F.count_distinct("fold").alias("f")).where("f > 1").isEmpty()
    with pytest.raises(splits.SplitImpossible):
        splits.group_kfold(labelled.limit(3), 4)


def test_order_index_is_dense_and_in_order(spark):
    rows = spark.range(5000).select("id", F.pmod(F.hash("id"), F.lit(3)).alias("g"), F.hash(F.col("id") * 7).alias("v"))
    got = with_order_index(rows, ["v", "id"], ["g"]).collect()
    for g in (0, 1, 2):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["row_index"] for r in mine] == list(range(len(mine)))
    batches = into_batches(with_order_index(rows, ["id"])).groupBy("batch_id").count().collect()
    assert len(batches) == 500 and all(r["count"] == 10 for r in batches)


def test_labelling_waits_and_pays_once(spark):
    rows = spark.range(25).select("id", F.concat(F.lit("m"), F.format_string("%02d", "id")).alias("message"))

    def client(messages):
        import json

        return {"content": json.dumps({"results": [{"class": m} for m in messages[:7]]}), "prompt_tokens": 1, "completion_tokens": None}

    labelled, usage = labeling.label_rows(rows, client, ["id"])
    got = {r["message"]: r["class"] for r in labelled.collect()}
    assert got["m03"] == "m03" and got["m08"] == "Noise" and len(got) == 25
    assert usage.first()["prompt_tokens"] == 3

    calls = []

    def busy(messages):
        calls.append(1)
        raise labeling.RateLimited

    with pytest.raises(RuntimeError):
        labeling.ask_with_patience(busy, ["a"], 3, 0.0)
    assert len(calls) == 3


def test_a_stopped_labelling_pays_for_each_batch_once(spark, tmp_path):
    import json

    rows = spark.range(230).select("id", F.concat(F.lit("m"), F.format_string("%03d", F.col("id") % 200)).alias("message"))
    log, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    log.mkdir()

    def client(broken):
        def ask(messages):
            import uuid

            if broken and messages[0] in ("m050", "m110"):
                raise TimeoutError("no answer")
            (log / f"{messages[0]}-{uuid.uuid4().hex}").write_text("")
            return {"content": json.dumps({"results": [{"class": m} for m in messages]}), "prompt_tokens": 2, "completion_tokens": 1}

        return ask

    with pytest.raises(labeling.LabellingStopped, match="2 batches got no answer: TimeoutError"):
        labeling.label_rows_with_ledger(rows, client(True), ["id"], ledger, callers=3)
    assert len(list(log.iterdir())) == 18
    labelled, usage = labeling.label_rows_with_ledger(rows, client(False), ["id"], ledger, wave=1)
    assert {r["id"]: r["class"] for r in labelled.collect()} == {i: f"m{i % 200:03d}" for i in range(230)}
    # 20 different batches, as the last three repeat the first: each was paid for once over both runs.
    assert sorted(p.name[:4] for p in log.iterdir()) == [f"m{i:03d}" for i in range(0, 200, 10)] and usage.first()["prompt_tokens"] == 4
    again, none = labeling.label_rows_with_ledger(rows, client(True), ["id"], ledger)
    assert again.count() == 230 and none.first()["prompt_tokens"] == 0 and len(list(log.iterdir())) == 20


def test_bad_answers_are_noise(spark):
    batches = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "batch_id bigint, pos int")
    said = spark.createDataFrame([(1, '{"results":[{"class":"Error"}]}'), (2, "no json")], "batch_id bigint, content string")
    got = {(r["batch_id"], r["pos"]): r["class"] for r in labeling.align_labels(batches, said).collect()}
    assert got == {(1, 0): "Error", (1, 1): "Noise", (2, 0): "Noise", (3, 0): "Noise"}


def test_grid(spark):
    grid = training.candidate_grid(spark, {"a": [1, 2, 1], "b": [3.0, 4.0]}, 3).collect()
    assert len({(r["a"], r["b"]) for r in grid}) == 3
    assert training.candidate_grid(spark, {"a": [1, 2, 1], "b": [3.0, 4.0]}, 99).count() == 4


def test_training_learns_templates(spark, labelled):
    model, trials, test = training.train_classifier(labelled.where("id >= 2000"), [{"max_iter": 3}], test_size=0.2, val_size=0.2)
    assert trials.count() == 1 and test.count() > 0
    assert set(r["predicted_label"] for r in test.select("predicted_label").distinct().collect()) <= set(domain.LABELS)


def test_quotas_of_equal_rows(spark):
    rows = spark.createDataFrame([("same text", "Noise")] * 40 + [("one", "Error")] + [("two", None)] * 3, "message string, class string")
    sides = {(r["class"], r["split"]): r["count"] for r in splits.quota_split(rows, 0.25).groupBy("class", "split").count().collect()}
    assert sides == {("Noise", "heldout"): 10, ("Noise", "train"): 30, ("Error", "train"): 1, (None, "heldout"): 1, (None, "train"): 2}


def test_groups_may_be_null_in_an_order_index(spark):
    rows = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "g string, v int")
    assert sorted((r["g"] or "", r["v"], r["row_index"]) for r in with_order_index(rows, ["v"], ["g"]).collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_training_masks_each_message_once(spark, monkeypatch):
    asked = []
    masks = splits.template_group
    monkeypatch.setattr(splits, "template_group", lambda message: asked.append(message) or masks(message))
    rows = spark.createDataFrame([(f"{'failed' if i % 2 else 'fine'} step{i % 40}x", "Error" if i % 2 else "Noise") for i in range(400)], "message string, class string")
    model, trials, test = training.train_classifier(rows, [{"max_iter": 2}])
    assert len(asked) == 1 and trials.count() == 1 and 0 < test.count() < 400
    assert not set(r[0] for r in test.select("template_group").distinct().collect()) & {"", None}
