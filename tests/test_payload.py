import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import payload


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first()["r"]


@pytest.mark.parametrize("raw,message", [
    ('{"text":"b","message":"a"}', "a"), ('{"message":"","msg":"m"}', "m"), ('{"zeta":"last","alpha":"first"}', "last"),
    ('{"n":null,"k":5}', "5"), ("{}", ""), ("plain", "plain"), (None, ""),
])
def test_extract_message(spark, raw, message):
    assert one(spark, raw, payload.extract_message) == message


def test_normalize_payload(spark):
    shape = lambda c: payload.normalize_payload(c, F.lit("T"))
    assert json.loads(one(spark, '{"a":{"b":[1]}}', shape)) == {"a": {"b": [1]}, "received_at": "T"}
    assert json.loads(one(spark, '{"received_at":"X"}', shape)) == {"received_at": "X"}
    assert json.loads(one(spark, "{}", shape)) == {"received_at": "T"}
    assert json.loads(one(spark, 'say "hi"', shape)) == {"message": 'say "hi"', "received_at": "T"}
    assert json.loads(one(spark, '"quoted"', shape)) == {"message": "quoted", "received_at": "T"}
    assert json.loads(one(spark, "[1,2]", shape)) == {"message": "[1,2]", "received_at": "T"}


@pytest.mark.parametrize("raw,value", [
    ('{"sha":"x","commit_sha":"y"}', "y"), ('{"sha":"top","git":{"commit_sha":"in"}}', "top"), ('{"git":{"sha":"a"},"metadata":{"sha":"m"}}', "m"),
    ('{"a":{"b":{"Commit-Sha":"deep"}}}', "deep"), ('{"a":[{"x":1},{"commitSHA":"listed"}]}', "listed"),
    ('{"a":{"b":{"commit_sha":"low"}},"z":{"commit sha":"high"}}', "high"), ('{"sha":{"no":1}}', ""), ('{"sha":"  "}', ""), ("text", ""),
    ('{"a":{"b":{"c":{"d":{"e":{"commit_sha":"at depth five"}}}}}}', "at depth five"),
    ('{"a":{"b":{"c":{"d":{"e":{"f":{"commit_sha":"too deep"}}}}}}}', ""),
])
def test_nested_value(spark, raw, value):
    assert one(spark, raw, lambda c: payload.nested_value(c, ["commit_sha", "sha"])) == value


@pytest.mark.parametrize("raw,label", [
    ('{"predictions": [{"label": "Error"}]}', "Error"), ('{"result": {"output": "Predicted class: Error"}}', "Error"),
    ('{"results": [{"class": "SYSTEM"}]}', "SYSTEM"), ("classification: CONFIGURATION", "CONFIGURATION"),
    ('{"errorMessage": "System.NullReferenceException"}', ""), ('{"other": "free words"}', ""), ('{"label": "free words"}', "free words"),
    ('{"x": "noise"}', "Noise"), ("Noise.", "Noise"), ("free words", "free words"), ("error or noise", "error or noise"),
    ('{"output": "{\\"class\\": \\"noise\\"}"}', "Noise"), (None, ""), ("{broken", "{broken"),
])
def test_prediction_label(spark, raw, label):
    assert one(spark, raw, payload.prediction_label) == label


def test_redact(spark):
    raw = json.dumps({"password": "p", "a": {"Api_Key": "k", "list": list(range(30))}, "code": 5, "text": "x" * 2000, "decoder": 1})
    shown = json.loads(one(spark, raw, payload.redact))
    assert shown["password"] == "<redacted>" and shown["code"] == "<redacted>" and shown["a"]["Api_Key"] == "<redacted>"
    assert shown["decoder"] == 1 and len(shown["a"]["list"]) == 20 and len(shown["text"]) < 1001


def test_a_payload_is_parsed_once_whatever_the_keys(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("raw")).select(payload.extract_message("raw"))
    assert plan._jdf.queryExecution().analyzed().toString().count("from_json") == 1


def test_nested_values_of_several_lists_equal_those_of_each(spark):
    texts = ['{"a":"1","metadata":{"b":"2"},"x":[{"y":{"C c":"3"}}]}', '{"c_C":"4"}', '{"a":"","b":{"a":"5"}}', "no json", None, "{}", '{"d":{"e":{"f":{"a":"6","B":"7"}}}}']
    lists = [["a"], ["b"], ["cc"]]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = rows.select(payload.nested_values(payload.payload_map("raw"), lists).alias("all"), F.array(*[payload.nested_value("raw", k) for k in lists]).alias("each")).collect()
    assert all(r["all"] == r["each"] for r in got)
    assert [r["all"] for r in got] == [["1", "2", "3"], ["", "", "4"], ["5", "", ""], [""] * 3, [""] * 3, [""] * 3, ["6", "7", ""]]
