"""Typed values and attributes of payloads: each list is read once, values nest to any depth, of a repeated key the last holds."""

import json

from pyspark.sql import functions as F

from lumenlake.sources import payloads

_LIST = "array<struct<key:string,value:string>>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_list_of_attributes_is_made_once(spark):
    """The list may be dear to make; it is not made again for each entry."""
    df = spark.createDataFrame([("[]",)], "raw string").select(payloads.attrs_to_map(F.from_json("raw", _LIST)).alias("m"))
    assert _plan(df).count("from_json(") == 1 and df.first()["m"] == {}


def test_spans_are_parsed_once(spark):
    df = payloads.flatten_spans(spark.createDataFrame([('{"resourceSpans":[]}',)], "payload string"))
    assert _plan(df).count("from_json(") == 1 and df.count() == 0


def test_attributes_as_maps(spark):
    """Repeated, absent and null entries, a value that is no JSON, and rows that are null, in one batch."""
    rows = [(1, [("a", '{"intValue":1}'), (None, '{"intValue":9}'), ("b", "{"), ("a", '{"intValue":2}')]), (2, None), (3, []), (4, [("a", None), ("c", '{"boolValue":true}')])]
    found = spark.createDataFrame(rows, f"id int, attributes {_LIST}").coalesce(1).select("id", payloads.attrs_to_map(F.col("attributes")).alias("m"))
    assert {r["id"]: r["m"] for r in found.collect()} == {1: {"b": "", "a": "2"}, 2: {}, 3: {}, 4: {"a": "", "c": "true"}}


def test_values_of_any_depth(spark):
    """Lists within lists beyond four levels are plain JSON too; a key that is absent in a map is the empty one."""
    value, wanted = {"intValue": "7"}, "7"
    for _ in range(9):
        value, wanted = {"arrayValue": {"values": [value, {}]}}, f"[{wanted},null]"
    keyless = {"kvlistValue": {"values": [{"value": {"doubleValue": -0.5}}, {"key": "z\u001f", "value": {"stringValue": "&\n"}}]}}
    rows = [(json.dumps(value), wanted), (json.dumps(keyless), '{"":-0.5,"z\\u001F":"\\u0026\\n"}'), ('{"doubleValue":"NaN"}', "nan"), ('{"doubleValue":1.5e300}', "1.5e+300"), ('{"stringValue":"\\ud800x"}', "?x")]
    found = spark.createDataFrame(rows, "raw string, wanted string").withColumn("got", payloads.any_value(F.col("raw"))).collect()
    assert [r["got"] for r in found] == [r["wanted"] for r in found]


def test_attributes_of_events(spark):
    """Each event of a span keeps its own attributes; spans without events have none."""
    event = lambda n: {"name": f"e{n}", "timeUnixNano": str(n), "attributes": [{"key": "n", "value": {"intValue": str(n)}}] * n}
    spans = [{"spanId": "a", "events": [event(2), event(0), event(1)]}, {"spanId": "b"}, {"spanId": "c", "events": [event(3)]}]
    text = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})
    found = payloads.flatten_spans(spark.createDataFrame([(text,)], "payload string")).select("span_id", "events").collect()
    assert [(r["span_id"], [(e["time_unix_nano"], e["name"], e["attributes"]) for e in r["events"]]) for r in found] == [
        ("a", [(2, "e2", {"n": "2"}), (0, "e0", {}), (1, "e1", {"n": "1"})]), ("b", []), ("c", [(3, "e3", {"n": "3"})])
    ]
