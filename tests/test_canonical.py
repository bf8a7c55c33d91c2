"""Strict decoding of canonical records."""

from __future__ import annotations

from lodestone.functions import identity as I
from lodestone.operators import canonical
from pyspark.sql import functions as F


def test_spellings():
    for text, fault in {
        '{"a":1}': None, '{"a":"é\\n"}': None, '{"a":{"b":[null,true]}}': None, "{}": None,
        '{"a":1,"a":1}': "duplicate_name", '{"a":{"b":1,"b":2}}': "duplicate_name", '{"a":1 }': "spelling", '{"a":"\\u00e9"}': "spelling", '{"a":1.50}': "spelling", '{"a":1e2}': "spelling",
        '{"a":NaN}': "syntax", '{"a":1}{}': "syntax", "[1]": "syntax", "": "syntax", '{"a":"\\ud800"}': "spelling", "nul": "syntax",
    }.items():
        try:
            found = canonical._decode(text)[0]
        except UnicodeError:
            found = "raised"
        assert found == fault or (fault == "spelling" and found == "syntax"), (text, found)
    assert canonical._decode(None)[0] == "syntax"


def test_values_and_ids(spark):
    rows = spark.createDataFrame([("n", "x")], "namespace string, name string")
    good = rows.select(F.to_json(F.struct(F.lit(I.tag("source")).alias("schema"), I.source_id("n", F.col("name")).alias("id"), F.col("namespace"), F.col("name").alias("external_source_id"))).alias("record")).first().record
    cases = {
        good: None, good.replace('"x"', '"y"'): "wrong_id", good.replace('"x"', '""'): "bad_value", good.replace('"x"', "7"): "bad_value", good.replace('"x"', "null"): "bad_value",
        good.replace('"namespace":"n",', ""): "missing_field", good.replace('"namespace"', '"name"'): "unknown_field",
    }
    made = spark.createDataFrame([("source", r) for r in cases] + [(None, good), ("segment", good), ("source", None)], "kind string, record string")
    found = {(r.kind, r.record): r.fault for r in canonical.record_faults(made).collect()}
    assert found == {("source", r): f for r, f in cases.items()} | {(None, good): "unknown_kind", ("segment", good): "unknown_field", ("source", None): "syntax"}
