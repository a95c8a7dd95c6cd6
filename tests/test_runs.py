"""Several inputs side by side, and totals that grow."""

import time

import pytest

from rinsewell import clean_files, module_totals, read_reports, read_totals, run_totals, step, totals_stream, write_report

LIST = ["text.trim_whitespace"]


@pytest.fixture()
def jobs(tmp_path):
    out = []
    for i in range(4):
        (tmp_path / f"in{i}.csv").write_text("a,b\n" + "".join(f" x{j} ,{j}\n" for j in range(i + 1)))
        out.append({"path": str(tmp_path / f"in{i}.csv"), "out": str(tmp_path / "out"), "steps": LIST})
    return out


def test_inputs_side_by_side(spark, jobs, tmp_path):
    side = clean_files(spark, jobs, parallel=3, output_format="parquet")
    alone = clean_files(spark, jobs, out=str(tmp_path / "alone"), output_format="parquet")
    times = {"processing_time_seconds", "output_path", "report_path"}
    assert [{k: v for k, v in r.items() if k not in times} for r in side] == [{k: v for k, v in r.items() if k not in times} for r in alone]
    assert [r["rows_output"] for r in side] == [1, 2, 3, 4]
    assert spark.read.parquet(f"{tmp_path}/out/in3_cleaned").count() == 4


def test_the_first_error_ends_all(spark, jobs, tmp_path):
    @step("test.slow")
    def slow(df, options):
        return df.sparkSession.range(0, 10**14, 1, 1).filter("id < 0").selectExpr("'x' AS a", "0 AS b")

    @step("test.fails")
    def fails(df, options):
        while not list(tmp_path.glob("out/in0_report/*.json")):
            time.sleep(0.2)
        raise RuntimeError("this one")

    done, running, failing, never = jobs
    running = {**running, "steps": ["test.slow"]}
    failing = {**failing, "steps": ["test.fails"]}
    never = {**never, "out": str(tmp_path / "never")}
    with pytest.raises(RuntimeError, match="this one"):
        clean_files(spark, [done, running, failing, {**never, "steps": ["test.slow"]}, never], parallel=3, output_format="parquet")
    # The slow step would go on for days.
    assert spark.read.parquet(f"{tmp_path}/out/in0_cleaned").count() == 1  # finished before, and kept
    assert not (tmp_path / "never" / "in3_report").exists()


def test_totals_grow_by_new_reports(spark, tmp_path):
    def report(rows, changed):
        return {"rows_loaded": rows + 1, "rows_output": rows, "module_stats": {"a.b": {"cells_changed": changed, "case": "lower"}}}

    for part, new in enumerate(([(3, 1), (4, 2)], [(5, 7)], [])):
        for rows, changed in new:
            write_report(spark, report(rows, changed), f"{tmp_path}/reports")
        totals_stream(spark, f"{tmp_path}/reports", f"{tmp_path}/totals", f"{tmp_path}/check").awaitTermination()
        runs, modules = read_totals(spark, f"{tmp_path}/totals")
        everything = read_reports(spark, f"{tmp_path}/reports")
        assert runs.collect() == run_totals(everything).collect()
        assert modules.select("step", "metric", "runs", "total").collect() == module_totals(everything).collect()
    assert len(list(tmp_path.glob("totals/version=*"))) == 2  # nothing new, no new version
