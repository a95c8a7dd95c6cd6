"""JSON files that split: objects found by composing what every piece does to the state of a reader."""

import json
import random

import pytest
from pyspark.sql import functions as F
from rinsewell import read_table
from rinsewell.sources.json import REST_COLUMN, _json_lines, json_records, read_json


@pytest.fixture(autouse=True)
def small_splits(spark):
    for key, value in (("maxPartitionBytes", "200"), ("openCostInBytes", "100")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def objects(n):
    random.seed(n)
    found = []
    for i in range(n):
        one = {"i": i, "t": random.choice(['}{"x', "a\\", '\\"', "[]]]", "{{", "plain", "é\n}", '"', ""]) * random.randint(0, 3)}
        if i % 3 == 0:
            one["n"] = {"a": [{"b": 1}, {"c": "}"}], "z": None}
        if i % 7 == 0:
            one["big"] = '}]"{[,' * 120  # over three splits and more
        found.append(one)
    return found


@pytest.mark.parametrize(("indent", "ascii_only", "around"), [(None, True, ("", "")), (2, False, ("﻿\n ", "\n")), (None, False, (" ", " "))])
def test_a_list_over_many_splits(spark, tmp_path, indent, ascii_only, around):
    expected = objects(40)
    path = tmp_path / "list.json"
    path.write_text(around[0] + json.dumps(expected, indent=indent, ensure_ascii=ascii_only) + around[1])
    records = json_records(spark, [str(path)])
    assert [json.loads(r.record) for r in records.orderBy("place").collect()] == expected
    plan = records._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower() and "multiLine" not in plan
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
    df = read_table(spark, str(path))
    assert df.columns == ["i", "t", "n", "big", "__position"]
    rows = df.orderBy("__position").collect()
    assert [(r.i, r.t, r.big) for r in rows] == [(o["i"], o["t"], o.get("big")) for o in expected]


def test_a_string_without_braces_over_many_splits(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text(json.dumps([{"a": "x" * 5000, "b": "]" * 900}, {"a": "y"}]))
    assert [len(r.a) for r in read_table(spark, str(path)).orderBy("__position").collect()] == [5000, 1]


def test_shapes_side_by_side(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"y": [{"z": 1}]}, "k": "v"}')
    (tmp_path / "b.json").write_text("[ ]\n")
    one = read_table(spark, str(tmp_path / "a.json"))
    assert one.columns == ["x.y", "k", "__position"]  # a single object has its position too
    both = read_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert [r.k for r in both.collect()] == ["v"]
    (tmp_path / "c.json").write_text('[{"k": "w"}, {}]')
    mixed = read_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "c.json")])
    assert mixed.columns == ["x", "k", "__position"] and [r.k for r in mixed.orderBy("__position").collect()] == ["v", "w", None]
    typed = read_json(spark, str(tmp_path / "c.json"), schema="k string, more long")
    assert [(r.k, r.more) for r in typed.orderBy("__position").collect()] == [("w", None), (None, None)]


WRONG = ['[{"a":1}, 3]', '[{"a":1},{"b":', '{"a":1}{"b":2}', '"x"', '[{"a":1} {"a":2}]', '[null,{"a":1}]', '[{"a":x}]', '[{"a":1},]', '[{"a":1}}]']


@pytest.mark.parametrize("text", WRONG)
def test_text_that_is_no_table(spark, tmp_path, text):
    (tmp_path / "wrong.json").write_text(text)
    with pytest.raises(Exception, match="JSON"):
        read_table(spark, str(tmp_path / "wrong.json")).collect()


@pytest.mark.parametrize("lines", [False, True])
def test_keys_that_are_data(spark, tmp_path, lines):
    made = [{"id": i, **{f"k{(i * 37 + j) % 500}": (i if j % 2 else f"v{i}") for j in range(4)}, "o": {"a": [i, None]}} for i in range(200)]
    (tmp_path / "many.json").write_text("\n".join(map(json.dumps, made)) if lines else json.dumps(made))
    df = read_json(spark, str(tmp_path / "many.json"), lines=lines, max_columns=2)
    assert df.columns == ["id", "o", REST_COLUMN, "__position"]
    rows = df.select("id", F.to_json("o").alias("o"), F.to_json(REST_COLUMN).alias("rest")).orderBy("id").collect()
    back = [{"id": r.id, **json.loads(r.rest), "o": json.loads(r.o)} for r in rows]
    assert back == [dict(sorted(o.items(), key=lambda kv: list(b).index(kv[0]))) for o, b in zip(made, back, strict=True)]
    assert [dict(b) for b in back] == made


def test_keys_are_found_without_sorting_the_keys_of_all_objects(spark, tmp_path, monkeypatch):
    """An aggregate that sorts holds every key of its split in memory; one that hashes holds the distinct ones."""
    import rinsewell.sources.json as source

    lines = [json.dumps({f"k{(i * j) % 11}": i for j in range(1, 4)}) for i in range(60)] + ['{"z": 1, "a": 2, "z": 3}']
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines))
    first, n = {}, {}
    for i, line in enumerate(lines):
        for slot, (key, _) in enumerate(json.loads(line, object_pairs_hook=list)):
            first.setdefault(key, (i, slot))
            n[key] = n.get(key, 0) + 1
    records = _json_lines(spark, [str(path)])
    assert records.rdd.getNumPartitions() > 5
    plans, collect = [], type(records).collect

    def collected(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(records), "collect", collected)
    for limit in (4, 12, 100):
        most = sorted(n, key=lambda key: (-n[key], first[key]))[:limit]
        assert source._columns(records, limit) == (sorted(most, key=first.get), len(n) > limit)
    below = plans[0].splitlines()
    above = below[: next(i for i, line in enumerate(below) if "Generate" in line)]
    aggregates = [line for line in above if "Aggregate" in line]
    assert "HashAggregate" in aggregates[-1] and "Sort" not in aggregates[-1], plans[0]
