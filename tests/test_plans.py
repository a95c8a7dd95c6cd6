"""The shape of plans: what makes them hold at scale."""

import pytest

from rinsewell import clean, clean_chunks, preset, read_table
from rinsewell.catalog.inputs import contacts

from conftest import TABLES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parquet(spark, name):
    return spark.read.parquet(f"{TABLES}/{name}.parquet")


def one(step_id, **options):
    return {"id": step_id, "options": options}


def test_rowwise_steps_do_not_shuffle(spark):
    steps = [s for s in preset("crm") if s["id"] != "dedupe.drop_duplicates"]
    result = clean(contacts(spark, TABLES), steps)
    for text in (plan(result.df), plan(result.counted()[0])):
        assert "Exchange" not in text and "Python" not in text


def test_counting_adds_no_shuffle_and_no_pass(spark):
    df = contacts(spark, TABLES).drop("row_id")
    result = clean(df, preset("crm"))
    counted, plain = plan(result.counted()[0]), plan(result.df)
    assert counted.count("Exchange") == plain.count("Exchange") == 1
    assert counted.count("FileScan") == plain.count("FileScan")


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_dedupe_merges_before_the_shuffle(spark, keep):
    steps = [one("dedupe.drop_duplicates", subset=["o_orderstatus"], keep=keep)]
    text = plan(clean(parquet(spark, "orders"), steps, "o_orderkey").df)
    assert text.count("Exchange") == 1 and "partial_" in text.split("Exchange")[1]
    assert "Window" not in text


def test_filters_and_columns_reach_the_scan(spark):
    steps = [
        one("core.select_columns", columns=["o_orderkey", "o_custkey"]),
        one("core.drop_rows_missing_required", columns=["o_custkey"]),
    ]
    text = plan(clean(parquet(spark, "orders"), steps).df)
    assert "PushedFilters: [IsNotNull(o_custkey)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_work_is_done_once_when_counted(spark):
    steps = [one("validation.standardize_phone", columns=["phone"])]
    result = clean(contacts(spark, TABLES), steps)
    text = result.counted()[0]._jdf.queryExecution().optimizedPlan().toString()
    branches = text.count("Union") + 1
    assert text.count("RLIKE(") == branches


def test_counts_survive_merging(spark):
    """Counters of merged rows add up to those of the same steps without duplicates removed."""
    df = contacts(spark, TABLES).drop("row_id")
    rowwise = preset("crm")[:-1]
    alone = clean(df, rowwise).report()["module_stats"]
    merged = clean(df, preset("crm")).report()["module_stats"]
    assert all(merged[step] == stats for step, stats in alone.items())


def test_observed_equals_aggregated(spark, tmp_path):
    df = contacts(spark, TABLES).drop("row_id")
    steps = [*preset("crm"), one("core.drop_rows_missing_required", columns=["phone"])]
    written = clean(df, steps).write(str(tmp_path / "x.parquet"))
    aggregated = clean(df, steps).report()
    for key in ("rows_loaded", "rows_output", "rows_dropped", "duplicates_removed", "module_stats"):
        assert written[key] == aggregated[key]


def test_a_look_at_the_result_does_not_spoil_the_report(spark, tmp_path):
    result = clean(contacts(spark, TABLES), preset("leads"))
    result.df.limit(3).collect()
    assert result.write(str(tmp_path / "a.parquet"))["rows_loaded"] == 1541
    assert result.write(str(tmp_path / "b.parquet"))["rows_output"] == 1541


def test_filters_reach_the_scan_past_changes(spark):
    orders = spark.read.parquet(f"{TABLES}/orders.parquet")
    steps = [
        "text.trim_whitespace",
        {"id": "text.normalize_case", "options": {"case": "upper"}},
        {"id": "core.drop_rows_missing_required", "options": {"columns": ["o_custkey", "o_orderstatus"]}},
    ]
    text = plan(clean(orders, steps).df)
    assert "IsNotNull(o_custkey)" in text and "IsNotNull(o_orderstatus)" in text
    assert "CollectMetrics" not in text
    emptied = [{"id": "text.normalize_empty_strings", "options": {"empty_values": ["O"]}}, steps[-1]]
    df = clean(orders, emptied).df
    assert df.count() == orders.filter("o_orderstatus <> 'O'").count()


def test_order_ends_with_the_last_step_that_needs_it(spark):
    orders = spark.read.parquet(f"{TABLES}/orders.parquet").select("o_orderkey", "o_orderstatus")
    first = {"id": "dedupe.drop_duplicates", "options": {"subset": ["o_orderstatus"]}}
    text = plan(clean(orders, [first, "dedupe.drop_duplicates"], "o_orderkey").df)
    assert text.count("SortAggregate") <= 2


def test_write_without_report_counts_nothing(spark, tmp_path):
    df = spark.sql("SELECT ' a ' AS v")
    report = clean(df, ["text.trim_whitespace"]).write(str(tmp_path / "x"), "parquet", report=False)
    assert report == {"output_path": str(tmp_path / "x")}
    assert spark.read.parquet(str(tmp_path / "x")).first().v == "a"


def test_nan_is_null_in_every_table(spark):
    df = spark.sql("SELECT id, double('NaN') AS a, if(id = 0, float('NaN'), 1f) AS b FROM range(3)")
    filled = clean(df, [{"id": "core.fill_nulls", "options": {"values": {"b": 5}}}, "core.drop_empty_columns"]).df
    assert filled.columns == ["id", "b"] and sorted(r.b for r in filled.collect()) == [1, 1, 5]
    missing = {"id": "core.drop_rows_missing_required", "options": {"columns": ["b"]}}
    assert clean(df, [missing]).df.count() == 2


def test_chunks_of_a_filtered_table(spark, tmp_path):
    spark.range(20).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    rows = read_table(spark, str(tmp_path / "t"), "parquet").filter("id % 2 = 1")
    for table in (rows, rows.repartition(4)):
        totals = clean_chunks(table, ["core.drop_empty"], 5).totals().collect()
        assert sorted((r.chunk, r["__n_loaded"]) for r in totals) == [(0, 5), (1, 5)]


def test_empty_columns_by_scope_do_not_move_the_rows(spark):
    """What each scope fills is found once, and a small table of it goes to the rows."""
    df = contacts(spark, TABLES)
    result = clean_chunks(df, ["core.drop_empty_columns"], 1000, df["row_id"], "row_id")
    text = plan(result.df)
    assert "Aggregate" not in text and "SortMergeJoin" not in text and "hashpartitioning" not in text, text
    assert result.df.count() == df.count() and "mostly_empty" not in result.df.columns
