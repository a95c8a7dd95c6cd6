"""Streams: what needs rows to look at, duplicates across batches, decisions that last, reports by batch."""

import datetime
import warnings

import pytest
from pyspark.sql import functions as F

from rinsewell import clean_stream, clean_stream_batches, read_reports, reported_stream, union_chunks
from rinsewell.operators.base import _STEPS, Decisions
from rinsewell.streaming import DecisionLog, first_rows, is_stateless

SCHEMA = "k string, v string, n long, d double"


def one(step, **options):
    return [{"id": step, "options": options}]


ROW_WISE = [
    "text.trim_whitespace",
    *one("text.normalize_case", columns=["k"], case="title"),
    *one("text.remove_non_printable", columns=["k"]),
    *one("text.normalize_for_matching", columns=["k"]),
    *one("text.normalize_empty_strings", columns=["k"]),
    *one("text.replace_values", mapping={"a": "b"}),
    *one("core.fill_nulls", value="x", columns=["k"]),
    *one("core.rename_columns", mapping={"k": "q"}),
    *one("core.drop_columns", columns=["v"]),
    *one("core.drop_rows_missing_required", columns=["n"]),
    *one("validation.coerce_numeric", columns=["n"]),
    *one("validation.coerce_datetime", columns=["q"], format="%Y"),
]
LOOKING = [
    one("core.drop_empty_columns"),
    one("core.fill_nulls", value="x", columns=["n"]),
    one("validation.coerce_numeric", columns=["v"], downcast="float"),
    one("validation.coerce_numeric", columns=["v"], downcast="integer"),
    one("validation.coerce_numeric", columns=["v"], errors="ignore"),
    one("validation.coerce_datetime", columns=["v"]),
    one("validation.coerce_datetime", columns=["v"], format="%Y", errors="ignore"),
    one("dedupe.drop_duplicates"),
]


@pytest.fixture()
def source(spark, tmp_path):
    """A folder that gets a file per list of rows, and the stream that reads it, one file a batch."""

    class Source:
        def add(self, *rows, schema=SCHEMA):
            frame = spark.createDataFrame(list(rows), schema)
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def stream(self, schema=SCHEMA):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

        def run(self, steps, schema=SCHEMA, **options):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                clean_stream_batches(self.stream(schema), steps, f"{tmp_path}/out", f"{tmp_path}/check", **options).awaitTermination()
            return self

        def parts(self):
            found = sorted(tmp_path.glob("out/batch=*"), key=lambda p: int(p.name[6:]))
            return [spark.read.parquet(str(p)) for p in found]

    return Source()


def test_the_plan_knows_who_looks_at_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert is_stateless(df, ROW_WISE)
    assert not [steps for steps in LOOKING if is_stateless(df, steps)]
    tried = {s if isinstance(s, str) else s["id"] for s in [*ROW_WISE, *(s for steps in LOOKING for s in steps)]}
    built_in = {name for name in _STEPS if name.split(".")[0] in ("text", "core", "validation", "dedupe")}
    missing = {name for name in built_in - tried if not is_stateless(df, one(name, columns=["k"]))}
    assert not missing, "steps that look at rows need a case above"
    # A fill value of the column's own type needs no look.
    assert is_stateless(df, one("core.fill_nulls", value=1, columns=["n"]))


def test_row_wise_steps_run_on_a_stream(spark, source, tmp_path):
    source.add(("2020", " a ", 1, None), (None, "b", None, 2.0))
    run = clean_stream(source.stream(), ROW_WISE).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
    run.trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1
    for steps in LOOKING[:-1]:
        with pytest.raises(ValueError, match="clean_stream_batches"):
            clean_stream(source.stream(), steps)


def test_first_rows_across_batches(spark, source):
    steps = ["text.trim_whitespace", *one("dedupe.drop_duplicates", subset=["k"]), *one("text.normalize_case", columns=["v"], case="upper")]
    source.add(("a", "x", 3, None), (" a", "y", 2, 1.5), (None, "z", 1, None))
    source.run(steps, order_by="n", across_batches=True, reports=None)
    source.add(("a ", "earlier", 0, None), ("b", "w", 9, None), ("b", "v", 8, None), (None, "late", 0, None))
    source.add(("c", "u", 7, None), ("b", "t", 0, None))
    source.run(steps, order_by="n", across_batches=True)
    rows = sorted(tuple(r) for part in source.parts() for r in part.select(F.coalesce("k", F.lit("")), "v", "n").collect())
    assert rows == [("", "Z", 1), ("a", "Y", 2), ("b", "V", 8), ("c", "U", 7)]


def test_whole_rows_across_batches_and_a_horizon(spark, source, tmp_path):
    source.add(("a", "x", 1, None), ("a", "x", 1, None))
    source.add(("a", "x", 1, None), ("a", "x", 2, None))
    source.run(one("dedupe.drop_duplicates"), across_batches=True)
    assert sorted(r.n for part in source.parts() for r in part.collect()) == [1, 2]
    with pytest.raises(ValueError, match="order_by"):
        first_rows(source.stream(), ["k"])
    for keep in ("last", False):
        with pytest.raises(ValueError, match="duplicates of all batches"):
            source.run(one("dedupe.drop_duplicates", subset=["k"], keep=keep), order_by="n", across_batches=True)
    timed = source.stream().withColumn("t", F.timestamp_seconds("n"))
    run = clean_stream(timed, one("dedupe.drop_duplicates", subset=["k"]), within=("t", "1 hour"))
    run.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1


def test_decisions_hold_for_later_batches(spark, source):
    schema = "at long, day string, n string, empty string"
    steps = one("validation.coerce_datetime", columns=["day"]) + one("validation.coerce_numeric", columns=["n"], downcast="integer") + one("core.drop_empty_columns")
    options = {"order_by": "at", "across_batches": True, "schema": schema}
    source.add((1, None, "5", None), schema=schema)  # shows no layout yet
    source.add((2, "13/04/2024", "6", None), schema=schema)
    source.run(steps, **options)
    source.add((3, "02/03/2024", "70000", "now"), schema=schema)
    source.add((4, None, None, None), schema=schema)
    source.run(steps, **options)
    parts = source.parts()
    assert [p.columns for p in parts] == [["at", "n"], ["at", "day", "n"], ["at", "day", "n", "empty"], ["at", "day", "n", "empty"]]
    assert [dict(p.dtypes)["n"] for p in parts] == ["tinyint", "tinyint", "int", "int"]
    assert parts[1].first().day == datetime.datetime(2024, 4, 13) and parts[2].first().day == datetime.datetime(2024, 3, 2)
    whole = union_chunks(parts).orderBy("at")
    assert [r.n for r in whole.collect()] == [5, 6, 70000, None]


def test_a_repeated_batch_decides_the_same(spark, tmp_path):
    log = DecisionLog(spark, f"{tmp_path}/log")
    never = lambda old, new: pytest.fail("merged")
    first = log.of(3)
    first.find("0:a/q", lambda: ["x"], never)
    log.write(3, first)
    again = log.of(3)
    assert again.settled and again.find("0:a/q", lambda: pytest.fail("looked"), never) == ["x"]
    later = log.of(4)
    assert not later.settled and later.find("0:a/q", lambda: ["y"], lambda old, new: old + new) == ["x", "y"]
    log.write(4, later)
    log.write(5, log.of(5))  # nothing new
    assert sorted(p.name for p in tmp_path.glob("log/batch=*")) == ["batch=3", "batch=4"]
    assert log.of(2).known == {} and log.of(9).known == {"0:a/q": ["x", "y"]} and Decisions().known == {}


def test_reports_of_a_stream(spark, source, tmp_path):
    source.add((" a", "b", 1, None), ("c ", None, None, None))
    source.add(("d", "e ", 2, None))
    steps = ["text.trim_whitespace", *one("core.drop_rows_missing_required", columns=["n"])]
    for extra in (None, ("f ", "g", None, None)):  # a restart goes on where it ended
        if extra:
            source.add(extra)
        rows, report = reported_stream(source.stream(), steps, f"{tmp_path}/reports")
        spark.streams.addListener(report)
        run = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        run.start(f"{tmp_path}/rows").awaitTermination()
        report.wait(60)
        spark.streams.removeListener(report)
    found = read_reports(spark, f"{tmp_path}/reports").collect()
    assert sorted((r.rows_loaded, r.rows_output, r.rows_dropped) for r in found) == [(1, 0, 1), (1, 1, 0), (2, 1, 1)]
    assert sum(int(r.module_stats["text.trim_whitespace"]["cells_changed"]) for r in found) == 4
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2
