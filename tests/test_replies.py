"""JSON in model replies against Python's parser on replies worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import replies as R

FOUND = [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
    ('{"a": "points to "no effect" - but"}', {"a": 'points to "no effect" - but'}),
    ('{"a": "two\nlines", "b": "c\rd"}', {"a": "two\nlines", "b": "c\rd"}),
    ('Here it is: {"a": {"b": "}"}} and {"c": 2}', {"a": {"b": "}"}}),
    ('Sure. {"a": "say "hi" now", "n": {"m": 1}} done', {"a": 'say "hi" now', "n": {"m": 1}}),
    ('{"a": "back\\\\", "b": "q\\"uote"}', {"a": "back\\", "b": 'q"uote'}),
    ('  [1, "x"]  ', [1, "x"]),
    ("5", 5),
    ("no json", None), ("", None), (None, None), ('{"a": 1', None), ('{"a": "unclosed }', None), ("{{}", None),
    ('x {"k": "' + "long " * 5000 + 'with "quotes" in it"}', {"k": "long " * 5000 + 'with "quotes" in it'}),
]


def test_replies(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "id int, reply string")
    got = rows.select("id", F.to_json(R.extract_json(F.col("reply"))).alias("j")).orderBy("id").collect()
    assert [None if r.j is None else json.loads(r.j) for r in got] == [want for _, want in FOUND]


@pytest.mark.parametrize("greedy", [False, True])
def test_fences(spark, greedy):
    cases = [('a ```json\n{"a": {"b": 1}}\n``` b', {"a": {"b": 1}}), ('say {"a": 1} end', {"a": 1}), ("none", None), (None, None), ('```\n{"x": 1}\n```\n```{"y": 2}```', None if greedy else {"x": 1}), ("} {", None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, reply string")
    got = rows.select("id", F.to_json(R.fenced_json(F.col("reply"), greedy)).alias("j")).orderBy("id").collect()
    assert [None if r.j is None else json.loads(r.j) for r in got] == [want for _, want in cases]
