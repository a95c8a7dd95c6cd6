"""Reading and writing: record boundaries, null tokens, types, shapes of JSON and YAML."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinsewell import clean, clean_chunks, clean_file, clean_files, flatten, infer_types, read_table
from rinsewell import read_reports, run_totals, with_overrides, write_table
from rinsewell.plans import number_rows
from rinsewell.sources import ORDER_COLUMN, format_of


def rows(df):
    return [tuple(r) for r in df.drop(ORDER_COLUMN).collect()]


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_csv_like_pandas(spark, put):
    text = 'a,a,x y,,d.e\n1,"p ""q"" \n z",NA,3,x\n2,,  ,4\n\n5,"",n/a,7,y\n'
    path = put("odd name.csv", text)
    df = read_table(spark, path)
    expected = pd.read_csv(path)
    assert df.columns[:-1] == list(expected.columns)
    assert rows(df) == [
        tuple(None if pd.isna(v) else v for v in r) for r in expected.itertuples(index=False, name=None)
    ]


@pytest.mark.parametrize("multiline", [None, True, False])
def test_csv_long_rows_raise_short_rows_do_not(spark, put, multiline):
    short = put("short.csv", "a,b\n1,2\n3\n")
    assert rows(read_table(spark, short, multiline=multiline)) == [(1, 2), (3, None)]
    long = put("long.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_table(spark, long, types=False, multiline=multiline).count()


def test_csv_files_with_and_without_line_ends_in_fields(spark, tmp_path, put):
    (tmp_path / "d").mkdir()
    put("d/1.csv", 'k,v\n1,"a\nb"\n2,c\n')
    put("d/2.csv", "k,v\n3,d\n4,e\n")
    df = read_table(spark, str(tmp_path / "d"))
    assert sorted(rows(df)) == [(1, "a\nb"), (2, "c"), (3, "d"), (4, "e")]
    last = clean(df, [{"id": "dedupe.drop_duplicates", "options": {"subset": ["k"], "keep": "last"}}])
    assert last.df.count() == 4


@pytest.mark.parametrize("seed", range(6))
def test_csv_records_across_line_ends_and_splits(spark, tmp_path, seed):
    random.seed(seed)
    parts = ["a", "b", " ", '"', "\r\n", "\n", "\r", ",", "", "é", "\ue000", "\ue0001"]
    table = [["x", "y", "z\r\nz" if seed % 2 else "z"]]
    table += [["".join(random.choices(parts, k=random.randint(0, 8))) for _ in range(3)] for _ in range(30)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(k in c for k in '",\r\n') else c
    end = random.choice(["\n", "\r\n"])
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as file:
        file.write(end.join(",".join(map(quoted, row)) for row in table) + end * (seed % 3))
    expected = pd.read_csv(path, dtype=str)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "97")
    own.conf.set("spark.sql.files.openCostInBytes", "10")
    df = read_table(own, path, types=False)
    assert "multiLine" not in df._jdf.queryExecution().toString()
    assert df.columns[:-1] == list(expected.columns)
    found = [tuple(r)[:3] for r in df.orderBy(ORDER_COLUMN).collect()]
    assert found == [tuple(None if pd.isna(v) else v for v in r) for r in expected.itertuples(index=False, name=None)]


COLUMNS = [
    (["1", "+5", " 7 "], "bigint"),
    (["1", None], "bigint"),
    (["1", "1.5"], "double"),
    (["1e3", "inf", "-Infinity"], "double"),
    (["1e400", "2"], "string"),
    (["99999999999999999999", "1"], "string"),
    (["1_0", "1"], "string"),
    (["5d", "1"], "string"),
    (["True", "FALSE", "tRue"], "boolean"),
    (["True", None], "string"),
    (["1.5", "True"], "string"),
    (["2024-01-01"], "string"),
    ([None], "string"),
    (["007", "1"], "bigint"),
]


@pytest.mark.parametrize("cells,expected", COLUMNS, ids=str)
def test_types(spark, cells, expected):
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    assert infer_types(df).dtypes == [("v", expected)]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_csv_quote_that_is_never_closed(spark, put, size):
    """The error names the place, in a file of one split and of many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        text = 'a,b\n1,"é\nx"\n' + "2,yy\n" * 40 + '3,"ok","' + "\n4,z" * 400
        path = put("open.csv", text.replace('"ok","', '"ok'))
        with pytest.raises(ValueError, match=rf"byte {len(text[: text.index('3,')].encode()) + 2}, line 44 of .*open.csv"):
            read_table(spark, path, max_record=1000)
        assert read_table(spark, put("fine.csv", 'a,b\n1,"x\n' + "y" * 500 + '\n"\n' * 1 + "2,z\n"), max_record=1000).count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_shapes(spark, put):
    df = read_table(spark, put("list.json", '[{"z":1,"a":"x"},{"a":null,"m":{"q":1}},{"b":[1]}]'))
    assert df.columns[:-1] == ["z", "a", "m", "b"] and df.count() == 3
    one = read_table(spark, put("one.json", '{"z":1,"a":{"y":2,"b":{"c":[1,2]}}}'))
    assert set(one.columns) == {"z", "a.y", "a.b.c", ORDER_COLUMN} and one.count() == 1
    assert read_table(spark, put("none.json", "[]")).columns == []
    with pytest.raises(Exception, match="JSON values that are not objects"):
        read_table(spark, put("scalars.json", "[1,2]"))
    lines = read_table(spark, put("l.jsonl", '{"b":1}\n{"a":2,"b":3}\n'))
    assert rows(lines) == [(1, None), (3, 2)]


def test_yaml_shapes(spark, put):
    text = "- z: 1\n  a: x\n- a: null\n  m: {q: 1}\n- d: 2024-01-05\n  f: 1.5\n"
    df = read_table(spark, put("list.yaml", text))
    assert df.columns[:-1] == ["z", "a", "m", "d", "f"]
    assert rows(df.select("z", "a", "d", "f", ORDER_COLUMN)) == [
        (1, "x", None, None),
        (None, None, None, None),
        (None, None, "2024-01-05", 1.5),
    ]
    one = read_table(spark, put("one.yml", "z: 1\na: {y: 2, b: {c: [1,2]}}\n"))
    assert rows(one.select("z", "`a.y`", "`a.b.c`", ORDER_COLUMN)) == [(1, 2, [1, 2])]
    assert read_table(spark, put("empty.yaml", "")).columns == []
    assert rows(read_table(spark, put("scalar.yaml", "hello\n"))) == [("hello",)]


def test_formats():
    assert [format_of(p) for p in ("a.csv", "b.YML", "c.json", "d.txt", "x/e.parquet/")] == [
        "csv",
        "yaml",
        "json",
        "csv",
        "parquet",
    ]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x", "xlsx")


def test_csv_sink_shows_dates(spark, tmp_path):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-05' d, TIMESTAMP_NTZ'2024-01-05 10:00:00' t, ' a ' s, '' e, "
        "CAST(NULL AS STRING) n, true b, TIMESTAMP_NTZ'2024-03-10 02:30:00' g, "
        "timestamp_seconds(1704448800) u"
    )
    write_table(df, str(tmp_path / "x.csv"))
    text = next((tmp_path / "x.csv").glob("*.csv")).read_text()
    assert text == (
        "d,t,s,e,n,b,g,u\n2024-01-05,2024-01-05 10:00:00, a ,,,True,2024-03-10 02:30:00,"
        "2024-01-05 10:00:00+00:00\n"
    )


def test_dates_are_known_without_a_job(spark, tmp_path):
    df = spark.sql("SELECT id, '2024-01-05' d, concat('2024-01-05 1', id, ':00') t FROM range(2)")
    dates = {"id": "validation.coerce_datetime", "options": {"columns": ["d"], "format": "%Y-%m-%d"}}
    times = {"id": "validation.coerce_datetime", "options": {"columns": ["t"], "format": "%Y-%m-%d %H:%M"}}
    steps = [dates, times, {"id": "core.rename_columns", "options": {"mapping": {"d": "day"}}}, "dedupe.drop_duplicates"]
    cleaned = clean(df, steps).df
    assert cleaned.schema["day"].metadata and not cleaned.schema["t"].metadata
    write_table(cleaned.coalesce(1).sort("id"), str(tmp_path / "x.csv"))
    text = next((tmp_path / "x.csv").glob("*.csv")).read_text()
    assert text == "id,day,t\n0,2024-01-05,2024-01-05 10:00:00\n1,2024-01-05,2024-01-05 11:00:00\n"


def test_tables_without_rows_or_columns(spark, tmp_path):
    df = spark.createDataFrame([], "a string, b long")
    write_table(df, str(tmp_path / "x.parquet"))
    assert read_table(spark, str(tmp_path / "x.parquet")).columns == ["a", "b", ORDER_COLUMN]
    with pytest.raises(ValueError):
        write_table(df.select(), str(tmp_path / "y.csv"))


def test_nan_is_null(spark, tmp_path):
    spark.sql("SELECT double('NaN') a, 1.5D b").write.parquet(str(tmp_path / "n.parquet"))
    assert rows(read_table(spark, str(tmp_path / "n.parquet"))) == [(None, 1.5)]


def test_row_numbers_follow_the_input(spark, tmp_path, put):
    (tmp_path / "d").mkdir()
    for part in range(3):
        lines = "".join(f"{part * 100 + i}\n" for i in range(100))
        put(f"d/{part}.csv", "v\n" + lines)
    numbered = number_rows(read_table(spark, str(tmp_path / "d")), "n")
    assert numbered.filter("v != n").count() == 0 and numbered.count() == 300


def test_chunks_are_cleaned_apart(spark, put):
    path = put("c.csv", "k,v\n" + "".join(f"{i % 2},x\n" for i in range(10)))
    steps = [{"id": "dedupe.drop_duplicates", "options": {}}]
    result = clean_chunks(read_table(spark, path), steps, 4)
    assert sorted(rows(result.df)) == [(0, "x")] * 3 + [(1, "x")] * 3
    totals = {r["chunk"]: r["__n_loaded"] for r in result.totals().collect()}
    assert totals == {0: 4, 1: 4, 2: 2}
    assert result.report()["duplicates_removed"] == 4


def test_files_to_files(spark, tmp_path, put):
    path = put("people.csv", "name,state\n Ann ,texas\nANN,TX\n")
    out = str(tmp_path / "out")
    job = {"path": path, "out": out, "steps": ["text.trim_whitespace", "text.normalize_case"]}
    state = {"id": "validation.standardize_state", "options": {"columns": ["state"]}}
    job["steps"] += [state, "dedupe.drop_duplicates"]
    report = clean_files(spark, [job], output_format="json")[0]
    assert (report["rows_loaded"], report["rows_output"], report["duplicates_removed"]) == (2, 1, 1)
    found = spark.read.json(f"{out}/people_cleaned").select("name", "state").collect()
    assert [tuple(r) for r in found] == [("ann", "TX")]
    reports = read_reports(spark, f"{out}/people_report")
    assert reports.first()["module_stats"]["text.trim_whitespace"]["cells_changed"] == "1"
    assert tuple(run_totals(reports).first()) == (1, 1)


def test_write_restores_settings(spark, tmp_path):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit", None)
    clean(spark.range(3), ["core.drop_empty"]).write(str(tmp_path / "r.parquet"))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) == before


def test_reports_in_any_layout(spark, put):
    import json

    path = put("r.json", json.dumps({"rows_loaded": 4, "rows_output": 3, "module_stats": {}}))
    assert tuple(run_totals(read_reports(spark, path)).first()) == (1, 3)


def test_overrides_merge_one_level():
    merged = with_overrides({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}})
    assert merged == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}


def test_flatten_quotes_names(spark):
    df = spark.sql("SELECT named_struct('x y', named_struct('p.q', 1)) AS `a.b`")
    assert flatten(df).columns == ["a.b.x y.p.q"]


@pytest.mark.parametrize("split", [1 << 20, 40])
def test_csv_dialects(spark, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        text = "no table; |at all\nnor this|\nä;bc;d\n1;|x;\n||y|;é\n\n2;z;|ü\r\n|\n"
        (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
        df = read_table(spark, str(tmp_path / "a.csv"), sep=";", quote="|", encoding="ISO-8859-1", skip_rows=2)
        assert df.columns[:-1] == ["ä", "bc", "d"]
        assert rows(df.orderBy(ORDER_COLUMN)) == [(1, "x;\n|y", "é"), (2, "z", "ü\r\n")]
        (tmp_path / "b.csv").write_text("﻿a\tb\n1\t'x'\n2\t3,4\n")
        tabs = read_table(spark, str(tmp_path / "b.csv"), sep="\t", quote="'")
        assert tabs.columns[:-1] == ["a", "b"] and rows(tabs.orderBy(ORDER_COLUMN)) == [(1, "x"), (2, "3,4")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for wrong in ({"sep": ";;"}, {"sep": '"'}, {"quote": "\n"}, {"encoding": "UTF-16"}):
        with pytest.raises(ValueError):
            read_table(spark, str(tmp_path / "b.csv"), **wrong)


def test_yaml_without_a_schema_is_parsed_once(spark, tmp_path):
    file = tmp_path / "a.yaml"
    file.write_text("- {b: 1, a: x}\n- {a: y, c: 2.5}\n")
    found = read_table(spark, str(file))
    file.write_text("- {b: 7, a: z}\n")  # nobody looks at the file again
    assert [tuple(r) for r in found.drop("__position").collect()] == [(1, "x", None), (None, "y", 2.5)]


@pytest.mark.parametrize("skip", [0, 2])
@pytest.mark.parametrize("first_lines", [1, 10_000])
def test_csv_records_over_lines_are_found_once(spark, tmp_path, monkeypatch, skip, first_lines):
    """Types and rows come from the records as they were found; a look at some lines does not settle that no field goes on."""
    import rinsewell.sources.csv as source

    monkeypatch.setattr(source, "FIRST_LINES", first_lines, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        expected = [(i, f"x\n{i}'" if i % 3 else "y" * (i + 1)) for i in range(60)]
        body = "".join(f"""{i},"{text}"\n""" for i, text in expected)
        (tmp_path / "f.csv").write_text('one " only\nsecond\n' * (skip // 2) + "a,b,b\n" + body)
        df = read_table(spark, str(tmp_path / "f.csv"), skip_rows=skip)
        assert df.columns[:-1] == ["a", "b", "b.1"]
        assert [tuple(r)[:2] for r in df.orderBy(ORDER_COLUMN).collect()] == expected
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan or "FileScan parquet" in plan
        assert "FileScan text" not in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("name", "size"), [("scan_csv_crlf", "FILE_DOCS"), ("scan_csv_dialects", "FILE_KEYS")])
def test_csv_inputs_have_as_many_files_as_rows_need(spark, tmp_path, monkeypatch, name, size):
    from rinsewell.catalog import queries

    read, files = queries.read_table, []
    monkeypatch.setattr(queries, "scratch_folder", lambda _: str(tmp_path / f"out{getattr(queries, size)}"))
    monkeypatch.setattr(queries, "read_table", lambda spark, path, *a, **b: files.append(len(spark.read.text(path).inputFiles())) or read(spark, path, *a, **b))
    found = []
    for keys in (getattr(queries, size), 100):
        monkeypatch.setattr(queries, size, keys)
        found.append(sorted(map(repr, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    assert found[0] == found[1] and found[0]
    few, many = (files[0], files[1]) if size == "FILE_DOCS" else (files[0], files[2])
    assert many >= 2 * few
