"""JSON that models cut off or write in another language's way."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import repaired_json

CASES = [
    ('[{"a": 1', [{"a": 1}]),
    ('[{"a": [1, 2, {"b": "x', [{"a": [1, 2, {"b": "x"}]}]),
    ('text {"a": "None, True [", "b": None, "c": True,} more }', {"a": "None, True [", "b": None, "c": True}),
    ('{"a": "}]", "b": [1, 2,],}', {"a": "}]", "b": [1, 2]}),
    ('{"a": 1]}', {"a": 1}),
    ('{"a": [1, {"b": 2]}', {"a": [1, {"b": 2}]}),
    ('{"q": "say \\"hi\\" {", "r": False', {"q": 'say "hi" {', "r": False}),
    ("{“a”: “b”}", {"a": "b"}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_repair(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(repaired_json(F.col("t")).alias("j")).first().j
    assert json.loads(got) == want
