"""Steps and step lists on small tables with known results and metrics."""

import pytest
from pyspark.sql import functions as F

from rinsewell import clean, preset, step

# Small tables whose results and metrics are known.
SAMPLE = [
    ("Alice", 100.0, "first"),
    ("Bob", 200.0, "second"),
    ("Alice", 100.0, "first"),
    (None, None, "empty"),
    ("Carol", 300.0, "third"),
]
PEOPLE = [
    ("Alice", "(555) 123-4567", "12345", "CA"),
    ("Bob", "555-987-6543", "12345-6789", "Texas"),
    ("Carol", "555.111.2222", "00210", "ny"),
    ("Dave", "invalid", "99999", "California"),
]


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(SAMPLE, "name string, value double, notes string")


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, phone string, zip string, state string")


def one(step_id, **options):
    return {"id": step_id, "options": options}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(df, *steps, **how):
    """Rows and stats of the only or last step; the same rows must come out when counted."""
    result = clean(df, steps, **how)
    found = rows(result.df)
    assert rows(result.counted()[0]) == found
    return found, result.report()["steps"][-1]["stats"]


def values(spark, cells, *steps, kind="string", **how):
    df = spark.createDataFrame(list(enumerate(cells)), f"i int, v {kind}")
    result = clean(df, steps, order_by="i", **how)
    return [r["v"] for r in result.df.orderBy("i").collect()], result.report()["steps"][-1]["stats"]


def test_leads_preset(people):
    result = clean(people, preset("leads"))
    assert rows(result.df) == sorted(
        [
            ("alice", "(555) 123-4567", "12345", "CA"),
            ("bob", "555-987-6543", "12345-6789", "TX"),
            ("carol", "555.111.2222", "00210", "NY"),
            ("dave", "invalid", "99999", "CA"),
        ]
    )
    report = result.report()
    assert report["rows_loaded"] == report["rows_output"] == 4
    assert report["modules_executed"] == [s["id"] for s in preset("leads")]
    assert report["module_stats"] == {
        "text.trim_whitespace": {"columns_trimmed": 4, "cells_changed": 0},
        "text.normalize_case": {"columns_normalized": 4, "case": "lower"},
        "validation.standardize_phone": {
            "columns_processed": 0,
            "values_changed": 0,
            "values_invalid": 0,
        },
        "validation.standardize_state": {
            "columns_processed": 1,
            "values_changed": 2,
            "values_unmapped": 0,
        },
        "dedupe.drop_duplicates": {"duplicates_removed": 0},
    }


def test_drop_empty_and_duplicates(sample):
    result = clean(sample, ["core.drop_empty", one("dedupe.drop_duplicates", keep="first")])
    assert rows(result.df) == sorted(set(SAMPLE), key=repr)
    report = result.report()
    assert (report["rows_loaded"], report["rows_output"]) == (5, 4)
    assert (report["rows_dropped"], report["duplicates_removed"]) == (0, 1)


def test_all_modules(sample):
    steps = [
        "text.trim_whitespace",
        one("text.normalize_empty_strings", empty_values=["n/a", "NA", "-", "null"]),
        one("text.normalize_case", case="lower", columns=["name", "notes"]),
        one("text.replace_values", mapping={"first": "1st", "second": "2nd", "third": "3rd"}),
        one("core.rename_columns", mapping={"notes": "remark", "value": "amount"}),
        one("core.drop_columns", columns=["remark"]),
        one("core.select_columns", columns=["name", "amount"], strict=False),
        one("core.fill_nulls", value=0, columns=["amount"]),
        one("core.drop_rows_missing_required", columns=["name"], how="any"),
        "core.drop_empty",
        one("dedupe.drop_duplicates", keep="first"),
    ]
    result = clean(sample, steps)
    assert result.df.columns == ["name", "amount"]
    assert rows(result.df) == [("alice", 100.0), ("bob", 200.0), ("carol", 300.0)]
    report = result.report()
    assert [s["stats"] for s in report["steps"]] == [
        {"columns_trimmed": 2, "cells_changed": 0},
        {"columns_processed": 2, "values_replaced": 0},
        {"columns_normalized": 2, "case": "lower"},
        {"columns_processed": 3, "replacements": 4},
        {"renamed": [{"old": "notes", "new": "remark"}, {"old": "value", "new": "amount"}]},
        {"columns_dropped": 1, "dropped_columns": ["remark"]},
        {"columns_selected": 2, "columns_dropped": 0, "selected": ["name", "amount"]},
        {"columns_filled": 1, "nulls_filled": 1},
        {"rows_dropped": 1, "required_columns": ["name"], "how": "any"},
        {"dropped_empty": 0},
        {"duplicates_removed": 1},
    ]
    assert (report["rows_loaded"], report["rows_output"], report["rows_dropped"]) == (5, 3, 1)


def test_people_standardized(people):
    steps = [
        "text.trim_whitespace",
        one("text.normalize_for_matching", columns=["name"]),
        one("validation.standardize_phone", columns=["phone"], output="us", keep_country_code=True),
        one("validation.standardize_zip", columns=["zip"], output="zip5"),
        one("validation.standardize_state", columns=["state"], output="abbr"),
    ]
    result = clean(people, steps)
    assert rows(result.df) == sorted(
        [
            ("alice", "+1 (555) 123-4567", "12345", "CA"),
            ("bob", "+1 (555) 987-6543", "12345", "TX"),
            ("carol", "+1 (555) 111-2222", "00210", "NY"),
            ("dave", "invalid", "99999", "CA"),
        ]
    )
    assert [s["stats"] for s in result.report()["steps"]] == [
        {"columns_trimmed": 4, "cells_changed": 0},
        {"columns_processed": 1, "values_changed": 4},
        {"columns_processed": 1, "values_changed": 3, "values_invalid": 1},
        {"columns_processed": 1, "values_changed": 1, "values_invalid": 0},
        {"columns_processed": 1, "values_changed": 2, "values_unmapped": 0},
    ]


def test_validation_list(sample):
    steps = [
        "text.trim_whitespace",
        one("text.remove_non_printable", columns=["name", "notes"], strip=True),
        one("validation.coerce_numeric", columns=["value"]),
        one("validation.coerce_datetime", columns=["date"]),
        one("core.drop_empty_columns", treat_blank_strings_as_empty=True),
        "core.drop_empty",
        one("dedupe.drop_duplicates", keep="first"),
    ]
    result = clean(sample, steps)
    assert rows(result.df) == sorted(set(SAMPLE), key=repr)
    assert [s["stats"] for s in result.report()["steps"]] == [
        {"columns_trimmed": 2, "cells_changed": 0},
        {"columns_processed": 2, "values_changed": 0},
        {"columns_processed": 1, "values_converted": 4, "values_failed": 0},
        {"columns_processed": 0, "values_converted": 0, "values_failed": 0},
        {"columns_dropped": 0, "dropped_columns": []},
        {"dropped_empty": 0},
        {"duplicates_removed": 1},
    ]


# -- single steps ------------------------------------------------------------------------------


def test_missing_columns_change_nothing(sample):
    for step_id, stats in {
        "core.drop_columns": {"columns_dropped": 0},
        "core.rename_columns": {"renamed": []},
        "core.select_columns": {"columns_selected": 0},
        "core.fill_nulls": {"columns_filled": 0, "nulls_filled": 0},
        "core.drop_rows_missing_required": {"rows_dropped": 0},
        "text.replace_values": {"columns_processed": 0, "replacements": 0},
        "validation.standardize_zip": {
            "columns_processed": 0,
            "values_changed": 0,
            "values_invalid": 0,
        },
    }.items():
        assert run(sample, step_id) == (rows(sample), stats)


def test_select_repeats_and_strict(sample):
    result = clean(sample, [one("core.select_columns", columns=["notes", "name", "notes", "x"])])
    assert result.df.columns == ["notes", "name", "notes"]
    assert result.report()["steps"][0]["stats"]["columns_dropped"] == 0
    with pytest.raises(KeyError):
        clean(sample, [one("core.select_columns", columns=["x"], strict=True)])


def test_rename_swaps_and_rejects_clashes(sample):
    result = clean(sample, [one("core.rename_columns", mapping={"name": "notes", "notes": "name"})])
    assert result.df.columns == ["notes", "value", "name"]
    assert result.df.filter("notes = 'Bob'").first()["name"] == "second"
    with pytest.raises(ValueError):
        clean(sample, [one("core.rename_columns", mapping={"name": "notes"})])


def test_awkward_names(spark):
    df = spark.createDataFrame([(" x ", None), ("y", "z")], "`a.b c` string, `d``e` string")
    found, _ = run(df, "text.trim_whitespace", one("core.fill_nulls", value="-"), "dedupe.drop_duplicates")
    assert found == [("x", "-"), ("y", "z")]


def test_empty_columns(spark):
    df = spark.createDataFrame([("a", " ", None), ("b", "", None)], "a string, b string, c string")
    found, stats = run(df, "core.drop_empty_columns")
    assert found == [("a",), ("b",)] and stats == {"columns_dropped": 2, "dropped_columns": ["b", "c"]}
    _, stats = run(df, one("core.drop_empty_columns", treat_blank_strings_as_empty=False))
    assert stats["dropped_columns"] == ["c"]
    _, stats = run(df, one("core.drop_empty_columns", subset=["b", "x"]))
    assert stats["dropped_columns"] == ["b"]
    assert clean(df.limit(0), ["core.drop_empty_columns"]).df.columns == []


def test_empty_rows(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("a", "b")], "a string, b string")
    found, stats = run(df, "core.drop_empty")
    assert len(found) == 2 and stats == {"dropped_empty": 1}
    assert len(run(df, one("core.drop_empty", subset=["b"]))[0]) == 1
    assert run(df, one("core.drop_empty", subset=[]))[0] == []
    with pytest.raises(KeyError):
        clean(df, [one("core.drop_empty", subset=["x"])])


def test_required(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("a", "b")], "a string, b string")
    step_id = "core.drop_rows_missing_required"
    assert len(run(df, one(step_id, columns=["a", "b"], how="all"))[0]) == 2
    found, stats = run(df, one(step_id, columns=["a", "b", "x"], how="sometimes"))
    assert len(found) == 1
    assert stats == {"rows_dropped": 2, "required_columns": ["a", "b"], "how": "any"}


def test_replace_cascades(spark):
    found, stats = values(spark, ["a", "b", "x", None], one("text.replace_values", mapping={"a": "b", "b": "c"}))
    assert found == ["c", "c", "x", None] and stats["replacements"] == 3
    found, stats = values(spark, ["a", "b"], one("text.replace_values", mapping={"b": "c", "a": "b"}))
    assert found == ["b", "c"] and stats["replacements"] == 2
    found, stats = values(spark, ["n/a"], one("text.replace_values", mapping={"n/a": None}))
    assert found == [None] and stats["replacements"] == 1


def test_replace_numbers(spark):
    found, _ = values(spark, [1, 2], one("text.replace_values", mapping={"1": "x"}), kind="long")
    assert found == [1, 2]
    steps = one("text.replace_values", columns=["v"], mapping={1: 10})
    assert values(spark, [1, 2], steps, kind="long")[0] == [10, 2]
    steps = one("text.replace_values", columns=["v"], mapping={1: "one"})
    assert values(spark, [1, 2], steps, kind="long")[0] == ["one", "2"]


def test_fill_keeps_or_widens_types(spark):
    fill = one("core.fill_nulls", values={"v": 0})
    assert values(spark, [None, 2], fill, kind="long") == ([0, 2], {"columns_filled": 1, "nulls_filled": 1})
    assert values(spark, [None, 2], one("core.fill_nulls", values={"v": 0.5}), kind="long")[0] == [0.5, 2.0]
    assert values(spark, [None, 2], one("core.fill_nulls", values={"v": "?"}), kind="long")[0] == ["?", "2"]
    assert values(spark, [None, "a"], one("core.fill_nulls", value=0))[0] == ["0", "a"]


def test_empty_strings(spark):
    cells = ["  ", " - ", " x ", " ", None]
    found, stats = values(spark, cells, one("text.normalize_empty_strings", empty_values=["-"]))
    assert found == [None, None, " x ", None, None] and stats["values_replaced"] == 3
    found, _ = values(
        spark, [0, 5], one("text.normalize_empty_strings", columns=["v"], empty_values=["0"]), kind="int"
    )
    assert found == [None, 5]


def test_text_steps(spark):
    found, stats = values(spark, ["  a\t", "​ a", None], "text.trim_whitespace")
    assert found == ["a", "​ a", None] and stats["cells_changed"] == 1
    found, stats = values(spark, ["a\tb\u007f", "a\u0085"], "text.remove_non_printable")
    assert found == ["ab", "a\u0085"] and stats["values_changed"] == 1
    assert values(spark, [1, 2], one("text.normalize_case", columns=["v"]), kind="int")[0] == ["1", "2"]
    assert values(spark, ["Ab"], one("text.normalize_case", case="odd")) == (
        ["ab"],
        {"columns_normalized": 1, "case": "lower"},
    )


def test_numeric_errors_and_downcast(spark):
    step_id = "validation.coerce_numeric"
    found, stats = values(spark, ["1", "x", None], one(step_id, columns=["v"]))
    assert found == [1.0, None, None]
    assert stats == {"columns_processed": 1, "values_converted": 1, "values_failed": 1}
    assert values(spark, ["1,0", "x"], one(step_id, columns=["v"], errors="ignore"))[0] == ["10", "x"]
    assert values(spark, ["1", " "], one(step_id, columns=["v"], errors="raise"))[0] == [1.0, None]
    with pytest.raises(Exception, match="cannot parse"):
        values(spark, ["1", "x"], one(step_id, columns=["v"], errors="raise"))
    df = spark.createDataFrame([("1", "300", "1.5")], "a string, b string, c string")
    down = clean(df, [one(step_id, columns=["a", "b", "c"], downcast="integer")]).df
    assert [t for _, t in down.dtypes] == ["tinyint", "smallint", "double"]


def test_dates_follow_the_first_value(spark):
    def parsed(*cells, **options):
        found, _ = values(spark, cells, one("validation.coerce_datetime", columns=["v"], **options))
        return [f and str(f)[:16] for f in found]

    assert parsed("2024-01-05", "01/06/2024", "2024-01-07 10:00") == ["2024-01-05 00:00", None, None]
    assert parsed("13/06/2024", "01/06/2024") == ["2024-06-13 00:00", "2024-06-01 00:00"]
    assert parsed("01/06/2024", "13/06/2024") == ["2024-01-06 00:00", None]
    assert parsed("01/06/2024", "13/06/2024", dayfirst=True) == ["2024-06-01 00:00", "2024-06-13 00:00"]
    assert parsed("garbage", "2024-01-05", "01/06/2024", "13/06/2024", "2024-01-07 10:00", "Jan 5, 2024") == [
        None,
        "2024-01-05 00:00",
        "2024-01-06 00:00",
        "2024-06-13 00:00",
        "2024-01-07 10:00",
        "2024-01-05 00:00",
    ]


def test_each_scope_has_its_own_date_layout(spark):
    data = [
        (1, "a", "2024-01-05"),
        (2, "a", "01/06/2024"),
        (3, "b", "13/06/2024"),
        (4, "b", "01/06/2024"),
        (5, "c", "garbage"),
        (6, "c", "01/06/2024"),
        (7, None, None),
    ]
    df = spark.createDataFrame(data, "i int, s string, v string")
    steps = [one("validation.coerce_datetime", columns=["v"]), "dedupe.drop_duplicates"]
    result = clean(df, steps, order_by="i", scope="s")
    found = {r["i"]: r["v"] and str(r["v"])[:10] for r in result.df.collect()}
    assert found == {
        1: "2024-01-05",
        2: None,
        3: "2024-06-13",
        4: "2024-06-01",
        5: None,
        6: "2024-01-06",
        7: None,
    }
    totals = {r["s"]: r["__n_0_values_failed"] for r in result.totals().collect()}
    assert totals == {"a": 1, "b": 0, "c": 1, None: 0}


def test_zip_and_state_counts(spark):
    found, stats = values(spark, [" 123 ", " 12345 "], one("validation.standardize_zip", columns=["v"]))
    assert found == ["123", "12345"]
    assert stats == {"columns_processed": 1, "values_changed": 0, "values_invalid": 1}
    cells = ["ny", "Texas", " Ontario", " "]
    found, stats = values(spark, cells, one("validation.standardize_state", columns=["v"]))
    assert found == ["NY", "TX", " Ontario", " "]
    assert stats == {"columns_processed": 1, "values_changed": 1, "values_unmapped": 2}


def test_dedupe_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "i int, k string")
    by = {"order_by": "i"}
    step_id = "dedupe.drop_duplicates"
    assert run(df, one(step_id, subset=["k"]), **by)[0] == [(1, None), (3, "x")]
    assert run(df, one(step_id, subset=["k"], keep="last"), **by)[0] == [(2, None), (3, "x")]
    found, stats = run(df, one(step_id, subset=["k"], keep=False))
    assert found == [(3, "x")] and stats == {"duplicates_removed": 2}
    with pytest.raises(KeyError):
        clean(df, [one(step_id, subset=[])])
    with pytest.raises(ValueError):
        clean(df, [one(step_id, keep="some")])
    with pytest.raises(ValueError, match="order"):
        clean(df, [one(step_id, subset=["k"])])


def test_hot_key_against_brute_force(spark):
    """A key that holds a third of all rows, and two dedupes in a row."""
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", f"v{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(data, "i int, k string, v string").repartition(7)
    first = {}
    for i, k, v in data:
        first.setdefault((k, v), (i, k, v))
    last = {}
    for row in first.values():
        last[row[1]] = max(last.get(row[1], row), row)
    steps = [
        one("dedupe.drop_duplicates", subset=["k", "v"], keep="first"),
        one("dedupe.drop_duplicates", subset=["k"], keep="last"),
    ]
    result = clean(df, steps, order_by="i")
    assert rows(result.df) == sorted(last.values(), key=repr)
    counts = [s["stats"]["duplicates_removed"] for s in result.report()["steps"]]
    assert counts == [3000 - len(first), len(first) - len(last)]


def test_steps_of_ones_own(sample):
    @step("mine.upper")
    def upper(df, options):
        return df.withColumn("name", F.upper("name")).filter(F.col("name").isNotNull())

    @step("mine.stats")
    def stats(df, options):
        return df.drop("notes"), {"made": options["x"]}

    result = clean(sample, ["text.trim_whitespace", "mine.upper", one("mine.stats", x=1), "dedupe.drop_duplicates"])
    assert rows(result.df) == [("ALICE", 100.0), ("BOB", 200.0), ("CAROL", 300.0)]
    report = result.report()
    assert report["module_stats"]["mine.upper"] == {"rows_before": 5, "rows_after": 4}
    assert report["module_stats"]["mine.stats"] == {"made": 1}
    assert (report["rows_loaded"], report["rows_output"], report["duplicates_removed"]) == (5, 3, 1)


def test_bad_specs(sample):
    with pytest.warns(UserWarning):
        result = clean(sample, [{"module": "core.drop_empty"}, "core.drop_empty"])
    assert result.report()["modules_executed"] == ["core.drop_empty"]
    with pytest.raises(ValueError):
        clean(sample, ["nodot"])
    with pytest.raises(KeyError):
        clean(sample, ["core.unknown"])


def test_repeated_steps_keep_their_own_entry(people):
    result = clean(people, [one("text.normalize_case", case="upper"), "text.normalize_case"])
    report = result.report()
    assert [s["stats"]["case"] for s in report["steps"]] == ["upper", "lower"]
    assert report["module_stats"]["text.normalize_case"]["case"] == "lower"


IDEMPOTENT = [
    "text.trim_whitespace",
    "text.normalize_for_matching",
    one("text.normalize_empty_strings", empty_values=["-"]),
    one("validation.standardize_phone", columns=["phone"]),
    one("validation.standardize_zip", columns=["zip"]),
    one("validation.standardize_state", columns=["state"]),
    "dedupe.drop_duplicates",
]


@pytest.mark.parametrize("spec", IDEMPOTENT, ids=str)
def test_idempotent(spark, spec):
    from rinsewell.catalog.inputs import contacts

    from conftest import TABLES

    df = contacts(spark, TABLES).drop("row_id")
    assert rows(clean(df, [spec, spec]).df) == rows(clean(df, [spec]).df)


def test_rows_add_up(spark):
    from rinsewell.catalog.inputs import contacts

    from conftest import TABLES

    df = contacts(spark, TABLES).drop("row_id")
    steps = [*preset("crm"), one("core.drop_rows_missing_required", columns=["phone"]), "core.drop_empty"]
    report = clean(df, steps).report()
    removed = report["rows_dropped"] + report["duplicates_removed"]
    assert report["rows_loaded"] - report["rows_output"] == removed > 0
