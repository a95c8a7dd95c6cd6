"""The queries: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import functions as fn
from ..operators import step
from ..plans import (
    clean,
    clean_chunks,
    clean_file,
    module_totals,
    preset,
    read_reports,
    read_totals,
    report_row,
    run_totals,
    totals_stream,
    union_chunks,
    write_report,
)
from ..sources.csv import NULL_TOKENS
from ..sources import flatten, infer_types, null_tokens, read_table, scratch_folder, write_table
from ..streaming import clean_stream, clean_stream_batches, reported_stream
from .inputs import contacts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def steps_query(name: str, source: Query, steps: list, order_by: str | None = None) -> None:
    """A query that is one list of steps over one source."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return clean(source(spark, folder), steps, order_by).df

    run.__name__ = name
    QUERIES[name] = run


def one(step_id: str, **options) -> list:
    return [{"id": step_id, "options": options}]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def unnumbered(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts without their row number, so that rows can be equal."""
    return contacts(spark, folder).drop("row_id")


def with_empty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of which some rows are null in every column."""
    df = contacts(spark, folder)
    empty = F.col("row_id") % 41 == 0
    return df.select(*[F.when(~empty, fn.col(n)).alias(n) for n in df.columns if n != "row_id"])


# -- columns and rows --------------------------------------------------------------------------

steps_query("drop_columns", contacts, one("core.drop_columns", columns=["mostly_empty", "absent", "cust"]))
steps_query(
    "select_columns", contacts, one("core.select_columns", columns=["state", "row_id", "absent", "name"])
)
steps_query(
    "rename_columns",
    contacts,
    one("core.rename_columns", mapping={"name": "phone", "phone": "name", "cust": "customer", "no": "x"}),
)
steps_query("drop_empty_columns", contacts, one("core.drop_empty_columns"))
steps_query(
    "drop_empty_columns_null_only",
    contacts,
    one("core.drop_empty_columns", treat_blank_strings_as_empty=False),
)
steps_query("drop_empty", with_empty_rows, one("core.drop_empty"))
steps_query("drop_empty_subset", contacts, one("core.drop_empty", subset=["phone", "zip", "state"]))
steps_query(
    "drop_missing_any", contacts, one("core.drop_rows_missing_required", columns=["name", "phone", "no"])
)
steps_query(
    "drop_missing_all",
    contacts,
    one("core.drop_rows_missing_required", columns=["name", "phone", "zip"], how="all"),
)
steps_query("dedupe_all", unnumbered, one("dedupe.drop_duplicates"))
for kept, label in (("first", "first"), ("last", "last"), (False, "none")):
    steps_query(
        f"dedupe_{label}",
        contacts,
        one("dedupe.drop_duplicates", subset=["name", "state", "status"], keep=kept),
        "row_id",
    )

# -- values ------------------------------------------------------------------------------------

REPLACED = {"y": "yes", "yes": "confirmed", "n/a": None, "texas": "Texas", "Texas": "TX", "O": "open"}
REPLACED_BY_COLUMN = {
    "status": {"n/a": None, " - ": "-", "-": "none", "F": "final"},
    "state": {"Ontario": None, "dc": "DC"},
}
EMPTY_VALUES = ["n/a", "-", "dc"]

steps_query("fill_nulls_scalar", contacts, one("core.fill_nulls", value="?", columns=["name", "phone", "cust"]))
steps_query(
    "fill_nulls_per_column",
    contacts,
    one("core.fill_nulls", values={"state": "XX", "cust": 0, "amount": "0", "name": None}),
)
steps_query(
    "normalize_empty_strings", contacts, one("text.normalize_empty_strings", empty_values=EMPTY_VALUES)
)
steps_query("replace_values", contacts, one("text.replace_values", mapping=REPLACED))
steps_query("replace_values_per_column", contacts, one("text.replace_values", mappings=REPLACED_BY_COLUMN))

# -- text --------------------------------------------------------------------------------------

steps_query("trim_whitespace", contacts, one("text.trim_whitespace"))
steps_query("case_lower", documents, one("text.normalize_case"))
steps_query("case_upper", contacts, one("text.normalize_case", case="upper"))
steps_query("case_title", documents, one("text.normalize_case", case="title", columns=["text"]))
steps_query("remove_non_printable", documents, one("text.remove_non_printable", columns=["text"]))
steps_query(
    "remove_non_printable_collapse",
    documents,
    one("text.remove_non_printable", columns=["text"], collapse_whitespace=True, strip=True),
)
steps_query("normalize_for_matching", documents, one("text.normalize_for_matching", columns=["text"]))
steps_query(
    "normalize_for_matching_keep_punct",
    documents,
    one("text.normalize_for_matching", columns=["text"], remove_punctuation=False),
)
steps_query(
    "normalize_for_matching_no_collapse",
    contacts,
    one("text.normalize_for_matching", columns=["name", "status"], collapse_whitespace=False),
)

# -- types and standard forms ------------------------------------------------------------------

steps_query("coerce_numeric", contacts, one("validation.coerce_numeric", columns=["amount", "zip"]))
steps_query(
    "coerce_numeric_currency",
    contacts,
    one("validation.coerce_numeric", columns=["amount"], strip_currency=True),
)
steps_query(
    "coerce_datetime_format",
    contacts,
    one("validation.coerce_datetime", columns=["signup_date"], format="%m/%d/%Y"),
)
steps_query(
    "coerce_datetime_inferred",
    contacts,
    one("validation.coerce_datetime", columns=["signup_date"]),
    "row_id",
)
for output in ("us", "digits", "e164"):
    steps_query(
        f"phone_{output}",
        contacts,
        one("validation.standardize_phone", columns=["phone"], output=output),
    )
steps_query(
    "phone_us_local",
    contacts,
    one("validation.standardize_phone", columns=["phone"], keep_country_code=False),
)
for output in ("zip5", "zip9"):
    steps_query(output, contacts, one("validation.standardize_zip", columns=["zip"], output=output))
for output in ("abbr", "name"):
    steps_query(
        f"state_{output}", contacts, one("validation.standardize_state", columns=["state"], output=output)
    )

# -- whole step lists --------------------------------------------------------------------------

# Renaming and choosing before work, a filter before and one after it, the last of equal rows.
ALL_MODULES = [
    *one("core.rename_columns", mapping={"status": "remark", "cust": "customer"}),
    *one("core.drop_rows_missing_required", columns=["customer"]),
    *one("core.drop_columns", columns=["mostly_empty", "signup_date", "amount"]),
    *one("text.normalize_empty_strings", empty_values=["-", "y"], columns=["remark", "zip"]),
    "text.trim_whitespace",
    *one("core.drop_empty", subset=["remark", "zip"]),
    *one("text.replace_values", mappings={"state": {"texas": "TX", "ny": "NY", "TX": "Texas"}}),
    *one("core.fill_nulls", values={"remark": "none", "zip": "00000"}),
    *one("text.normalize_case", case="upper", columns=["remark"]),
    *one("dedupe.drop_duplicates", subset=["customer", "remark"], keep="last"),
    *one("core.select_columns", columns=["customer", "remark", "state", "zip"], strict=True),
]
# Three steps that decide by data, with work between them, and no order.
VALIDATION = [
    *one("core.drop_empty_columns", subset=["mostly_empty", "phone", "zip"]),
    *one("validation.coerce_numeric", columns=["amount", "zip"], downcast="float", strip_currency=True),
    *one("core.drop_rows_missing_required", columns=["zip", "phone"], how="all"),
    *one("validation.coerce_datetime", columns=["signup_date"], format="%Y-%m-%d"),
    *one("core.fill_nulls", value="?", columns=["state", "status"]),
    *one("validation.standardize_phone", columns=["phone"], output="e164"),
    *one("dedupe.drop_duplicates", keep=False),
]
# Standard forms first, then text, on overlapping columns.
CONTACTS = [
    *one("validation.standardize_state", columns=["state"], output="name"),
    *one("validation.standardize_zip", columns=["zip"], output="zip9"),
    *one("text.remove_non_printable", columns=["name"], collapse_whitespace=True),
    *one("text.normalize_for_matching", columns=["name", "state"], remove_punctuation=False),
    *one("text.normalize_case", case="title", columns=["name"]),
]


def contents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).drop("doc_id")


steps_query("config_all_modules", contacts, ALL_MODULES, "row_id")
steps_query("config_validation", unnumbered, VALIDATION)
steps_query("config_contacts", contacts, CONTACTS)
steps_query("preset_crm", unnumbered, preset("crm"))
steps_query("preset_leads", unnumbered, preset("leads"))
steps_query("preset_scrape", contents, preset("scrape"))


@step("custom.area_code")
def area_code(df: DataFrame, options: dict) -> DataFrame:
    """A step of one's own: keep rows with a number, and add its first three digits."""
    digits = F.regexp_replace(fn.col(options["column"]), r"\P{Nd}+", "")
    return df.withColumn("area_code", F.substring(digits, 1, 3)).filter("area_code != ''")


@query
def custom_step(spark: SparkSession, folder: str) -> DataFrame:
    steps = ["text.trim_whitespace", *one("custom.area_code", column="phone"), *one("dedupe.drop_duplicates")]
    return clean(unnumbered(spark, folder), steps).df


@query
def custom_step_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """A step of one's own before a step that keeps the first row by the order of the input."""
    steps = [*one("custom.area_code", column="phone"), *one("dedupe.drop_duplicates", subset=["area_code", "status"])]
    return clean(contacts(spark, folder), steps, "row_id").df


@query
def custom_step_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every state as a table of its own."""
    steps = [*one("custom.area_code", column="phone"), *one("dedupe.drop_duplicates", subset=["status"], keep="last")]
    return clean(contacts(spark, folder), steps, "row_id", scope="state").df


@query
def custom_step_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows before and after a step of one's own, and what the steps around it took away."""
    steps = [
        *one("core.drop_rows_missing_required", columns=["name"]),
        *one("custom.area_code", column="phone"),
        *one("dedupe.drop_duplicates", subset=["area_code"]),
    ]
    report = clean(contacts(spark, folder), steps, "row_id").write(scratch_folder(spark), "parquet")
    own = report["module_stats"]["custom.area_code"]
    row = [report["rows_dropped"], own["rows_before"], own["rows_after"], report["duplicates_removed"], report["rows_output"]]
    names = "rows_dropped long, rows_before long, rows_after long, duplicates_removed long, rows_output long"
    return spark.createDataFrame([row], names)


# -- results of runs together ------------------------------------------------------------------

TRIMMED = [
    "text.trim_whitespace",
    *one("core.drop_rows_missing_required", columns=["name"]),
    *one("text.normalize_empty_strings", empty_values=["n/a"]),
    *one("core.drop_rows_missing_required", columns=["status"]),
]


@query
def union_of_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs that filter after changes, put together."""
    df = contacts(spark, folder)
    parts = [clean(df.filter("row_id % 2 = 0"), TRIMMED).df, clean(df.filter("row_id % 2 = 1"), TRIMMED).df]
    return union_chunks(parts)


@query
def join_of_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    df = contacts(spark, folder)
    left, right = clean(df, TRIMMED).df, clean(df, one("core.drop_empty", subset=["zip"])).df
    return left.select("row_id", "name").join(right.select("row_id", "zip"), "row_id")


@query
def clean_twice(spark: SparkSession, folder: str) -> DataFrame:
    once = clean(contacts(spark, folder), TRIMMED).df
    return clean(once, TRIMMED[1:] + one("core.drop_rows_missing_required", columns=["zip"])).df


# -- NaN, types ----------------------------------------------------------------------------------


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a price that is sometimes NaN, a customer that is sometimes null, and numbers as text."""
    n, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    return table(spark, folder, "orders").select(
        n.alias("id"),
        F.when(n % 5 == 0, float("nan")).otherwise(price).alias("price"),
        F.lit(float("nan")).alias("no_price"),
        F.when(n % 53 != 0, F.col("o_custkey").cast("long")).alias("cust"),
        (n % 100).cast("string").alias("small"),
        (n * 1000).cast("string").alias("whole"),
        ((n % 1000) / 4).cast("string").alias("quarter"),
        (n + 0.1).cast("string").alias("tenth"),
    )


def shown(df: DataFrame) -> DataFrame:
    """Types as columns of their own, and numbers as doubles, so that both engines show the same."""
    types = [F.lit(dtype).alias(f"{name}_type") for name, dtype in df.dtypes if name != "id"]
    cells = [fn.col(n) if d == "string" or n == "id" else fn.col(n).cast("double").alias(n) for n, d in df.dtypes]
    return df.select(*cells, *types)


@query
def nan_is_null(spark: SparkSession, folder: str) -> DataFrame:
    steps = [
        *one("core.drop_empty_columns"),
        *one("core.drop_empty", subset=["price", "cust"]),
        *one("core.fill_nulls", values={"price": -1}),
        *one("core.drop_rows_missing_required", columns=["cust"]),
    ]
    return shown(clean(measures(spark, folder), steps).df.select("id", "price", "cust"))


@query
def coerce_numeric_downcast_integer(spark: SparkSession, folder: str) -> DataFrame:
    steps = one("validation.coerce_numeric", columns=["small", "whole", "quarter"], downcast="integer")
    return shown(clean(measures(spark, folder).select("id", "small", "whole", "quarter"), steps).df)


@query
def coerce_numeric_downcast_float(spark: SparkSession, folder: str) -> DataFrame:
    """Quarters are exact as floats; tenths of large numbers are not."""
    df = measures(spark, folder).withColumn("tenth", (F.col("id") + 1e6 + 0.1).cast("string"))
    steps = one("validation.coerce_numeric", columns=["quarter", "tenth"], downcast="float")
    return shown(clean(df.select("id", "quarter", "tenth"), steps).df)


@query
def fill_nulls_no_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Only columns with nulls take a fill value of another type."""
    df = measures(spark, folder).select("id", "cust", "whole", F.col("id").alias("full"))
    return shown(clean(df, one("core.fill_nulls", value="?", columns=["cust", "whole", "full"])).df)


@query
def infer_types_nullable_long(spark: SparkSession, folder: str) -> DataFrame:
    df = measures(spark, folder).select("id", F.col("cust").cast("string").alias("cust"), "quarter")
    return shown(infer_types(df))


# -- metrics and reports -----------------------------------------------------------------------


def _named(totals: DataFrame, names: dict[str, str]) -> DataFrame:
    """Counters under readable names; no rows at all count as 0."""
    return totals.select(*[F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in names.items()])


@query
def metrics_text(spark: SparkSession, folder: str) -> DataFrame:
    steps = [
        *one("text.trim_whitespace"),
        *one("text.remove_non_printable"),
        *one("text.normalize_empty_strings", empty_values=["en", "n/a"]),
        *one("text.normalize_for_matching"),
    ]
    return _named(
        clean(documents(spark, folder), steps).totals(),
        {
            "rows_loaded": "__n_loaded",
            "trimmed": "__n_0_cells_changed",
            "control_removed": "__n_1_values_changed",
            "emptied": "__n_2_values_replaced",
            "matching_changed": "__n_3_values_changed",
        },
    )


@query
def metrics_validation(spark: SparkSession, folder: str) -> DataFrame:
    steps = [
        *one("validation.coerce_numeric", columns=["amount"], strip_currency=True),
        *one("validation.coerce_datetime", columns=["signup_date"]),
        *one("validation.standardize_phone", columns=["phone"]),
        *one("validation.standardize_zip", columns=["zip"]),
        *one("validation.standardize_state", columns=["state"]),
        *one("core.fill_nulls", value="?", columns=["status", "name"]),
    ]
    return _named(
        clean(contacts(spark, folder), steps, "row_id").totals(),
        {
            "numbers_converted": "__n_0_values_converted",
            "numbers_failed": "__n_0_values_failed",
            "dates_converted": "__n_1_values_converted",
            "dates_failed": "__n_1_values_failed",
            "phones_changed": "__n_2_values_changed",
            "phones_invalid": "__n_2_values_invalid",
            "zips_changed": "__n_3_values_changed",
            "zips_invalid": "__n_3_values_invalid",
            "states_changed": "__n_4_values_changed",
            "states_unmapped": "__n_4_values_unmapped",
            "nulls_filled": "__n_5_nulls_filled",
        },
    )


@query
def metrics_replace(spark: SparkSession, folder: str) -> DataFrame:
    result = clean(contacts(spark, folder), one("text.replace_values", mapping=REPLACED))
    return _named(result.totals(), {"replacements": "__n_0_replacements"})


@query
def metrics_by_step(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a whole list of steps in long form, filters and duplicates included."""
    steps = [*preset("crm"), *one("core.drop_rows_missing_required", columns=["phone"])]
    return clean(unnumbered(spark, folder), steps).metrics()


@query
def report_row_crm(spark: SparkSession, folder: str) -> DataFrame:
    """Write the cleaned table and return the report measured while writing it."""
    steps = [
        *preset("crm"),
        *one("core.drop_rows_missing_required", columns=["phone", "name"]),
        *one("core.drop_empty"),
    ]
    report = clean(unnumbered(spark, folder), steps).write(scratch_folder(spark), "parquet")
    return report_row(spark, report).select(
        "rows_loaded",
        "rows_output",
        "rows_removed",
        "duplicates_removed",
        "rows_dropped",
        F.size("modules_executed").alias("steps_run"),
    )


@query
def report_empty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the report says of rows without any value."""
    steps = ["text.trim_whitespace", *one("text.normalize_empty_strings"), "core.drop_empty", *one("dedupe.drop_duplicates")]
    report = clean(with_empty_rows(spark, folder), steps).write(scratch_folder(spark), "parquet")
    row = [report["rows_loaded"], report["rows_dropped"], report["duplicates_removed"], report["rows_output"]]
    row.append(report["module_stats"]["core.drop_empty"]["dropped_empty"])
    return spark.createDataFrame([row], "rows_loaded long, rows_dropped long, duplicates_removed long, rows_output long, dropped_empty long")


@query
def report_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Every source of the documents as a table of its own, all in one job."""
    totals = clean(contents(spark, folder), preset("scrape"), scope="source").totals()
    return totals.select(
        "source",
        F.col("__n_loaded").alias("rows_loaded"),
        F.col("__n_output").alias("rows_output"),
        F.col("__n_5_duplicates_removed").alias("duplicates_removed"),
        F.col("__n_0_cells_changed").alias("cells_trimmed"),
    )


def _written_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of three runs over given tables."""
    out = scratch_folder(spark)
    jobs = [
        ("crm", unnumbered(spark, folder)),
        ("leads", unnumbered(spark, folder)),
        ("scrape", contents(spark, folder)),
    ]
    for name, df in jobs:
        report = clean(df, preset(name)).write(f"{out}/{name}_cleaned", "parquet")
        write_report(spark, report, f"{out}/reports/{name}")
    return read_reports(spark, f"{out}/reports")


QUERIES["run_totals"] = lambda spark, folder: run_totals(_written_reports(spark, folder))
QUERIES["run_module_stats"] = lambda spark, folder: module_totals(_written_reports(spark, folder))

# -- chunks, unions, streams -------------------------------------------------------------------


@query
def chunked_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    steps = one("dedupe.drop_duplicates", subset=["state", "status"])
    return clean_chunks(contacts(spark, folder), steps, 1000, F.col("row_id"), "row_id").df


@query
def chunked_empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A column that only every other chunk fills; it stays blank where it was dropped."""
    df = contacts(spark, folder)
    filled = F.floor(F.col("row_id") / 1000) % 2 == 0
    df = df.withColumn("note", F.when(filled, F.col("status")).otherwise(F.lit(" ")))
    steps = [*one("core.drop_empty_columns"), *one("core.fill_nulls", value="none", columns=["note"])]
    return clean_chunks(df, steps, 1000, F.col("row_id")).df


@query
def chunked_report(spark: SparkSession, folder: str) -> DataFrame:
    steps = [*one("core.drop_rows_missing_required", columns=["phone"]), *one("dedupe.drop_duplicates", subset=["state"])]
    result = clean_chunks(contacts(spark, folder), steps, 1000, F.col("row_id"), "row_id")
    return result.totals().select(
        "chunk",
        F.col("__n_loaded").alias("rows_loaded"),
        F.col("__n_0_rows_dropped").alias("rows_dropped"),
        F.col("__n_1_duplicates_removed").alias("duplicates_removed"),
        F.col("__n_output").alias("rows_output"),
    )


@query
def chunked_after_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a table of which every third row was filtered: 100 rows each, but for the last."""
    rows = read_table(spark, f"{folder}/orders.parquet").filter("o_orderkey % 3 <> 0")
    steps = one("core.select_columns", columns=["o_orderkey"])
    return clean_chunks(rows, steps, 100).totals().select("chunk", F.col("__n_loaded").alias("rows_loaded"))


@query
def union_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    df = contacts(spark, folder)
    return union_chunks([df.select("row_id", "name", "phone"), df.select("zip", "row_id")])


def _text_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


@query
def stream_rowwise(spark: SparkSession, folder: str) -> DataFrame:
    """Row-wise steps on a stream of all documents, run until its end."""
    out = scratch_folder(spark)
    schema = documents(spark, folder).schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")
    steps = [*one("text.trim_whitespace"), *one("text.normalize_for_matching", columns=["text"])]
    run = (
        clean_stream(stream, steps)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query
def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of a stream, each cleaned as a table with duplicates removed."""
    out = scratch_folder(spark)
    schema = documents(spark, folder).schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]").drop("doc_id")
    run = clean_stream_batches(
        stream, preset("scrape"), f"{out}/rows", f"{out}/checkpoint", f"{out}/reports"
    )
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query
def stream_of_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates go within a batch: those across the two batches stay."""
    out = scratch_folder(spark)
    df = contacts(spark, folder).select("row_id", "state", "status")
    schema = df.schema
    for part in (0, 1):
        # The stream goes on from its checkpoint, so that what is new is a batch, whatever number of files it has.
        df.filter(F.col("row_id") % 2 == part).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(schema).parquet(f"{out}/in").drop("row_id")
        clean_stream_batches(stream, one("dedupe.drop_duplicates"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query
def stream_dedupe_across_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches, with a restart between each two: of equal trimmed state and status the row of the earliest batch
    stays, and in it the first."""
    out = scratch_folder(spark)
    df = contacts(spark, folder).select("row_id", "state", "status", "phone")
    steps = ["text.trim_whitespace", *one("dedupe.drop_duplicates", subset=["state", "status"])]
    for part in (2, 0, 1):
        df.filter(F.col("row_id") % 3 == part).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{out}/in")
        run = clean_stream_batches(stream, steps, f"{out}/rows", f"{out}/checkpoint", order_by="row_id", across_batches=True)
        run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows").drop("batch")


@query
def stream_dates_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The first batch shows that days come first; alone, the second would be read with months first. Amounts get the
    type that holds both batches, and a column without values in the first is there from the second on."""
    out = scratch_folder(spark)
    two = lambda number: F.lpad(number.cast("string"), 2, "0")
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    second = key % 2 == 1
    day = F.when(second, F.lit(1) + key % 12).otherwise(F.lit(13) + key % 15)
    df = orders.select(
        "o_orderkey",
        F.concat_ws("/", two(day), two(F.lit(1) + key % 7), F.lit("2024")).alias("day"),
        F.when(second, key * 1000).otherwise(key % 100).cast("string").alias("amount"),
        F.when(second, "b").alias("note"),
    )
    steps = one("validation.coerce_datetime", columns=["day"]) + one("validation.coerce_numeric", columns=["amount"], downcast="integer") + one("core.drop_empty_columns")
    for part in (0, 1):
        df.filter(key % 2 == part).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{out}/in")
        clean_stream_batches(stream, steps, f"{out}/rows", f"{out}/checkpoint", order_by="o_orderkey", across_batches=True).awaitTermination()
    parts = [spark.read.parquet(f"{out}/rows/batch={n}") for n in (0, 1)]
    return union_chunks(parts).select("o_orderkey", "day", F.col("amount").cast("long").alias("amount"), "note")


STREAMED_FILES = 4  # of which each batch reads one


@query
def stream_report(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of a stream's batches, summed up: those of the whole table."""
    out = scratch_folder(spark)
    df = contacts(spark, folder).select("name", "state", "status")
    df.repartition(STREAMED_FILES).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    steps = ["text.trim_whitespace", "text.normalize_empty_strings", *one("core.drop_rows_missing_required", columns=["name", "state"])]
    rows, report = reported_stream(stream, steps, f"{out}/reports")
    spark.streams.addListener(report)
    try:
        run = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
        run.awaitTermination()
        report.wait(600)
    finally:
        spark.streams.removeListener(report)
    reports = read_reports(spark, f"{out}/reports")
    sums = reports.agg(F.sum("rows_loaded").alias("rows_loaded"), F.sum("rows_output").alias("rows_output"), F.sum("rows_dropped").alias("rows_dropped"))
    counted = module_totals(reports).drop("runs").filter(~F.col("metric").startswith("columns_"))
    return counted.crossJoin(F.broadcast(sums))  # one row


@query
def run_totals_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a folder of reports that grows between two runs, each report read once."""
    out = scratch_folder(spark)
    df = contacts(spark, folder)
    for part in (0, 1):
        rows = df.filter(F.col("row_id") % 2 == part)
        for steps in (["text.trim_whitespace"], one("core.drop_rows_missing_required", columns=["phone"])):
            write_report(spark, clean(rows, steps).report(), f"{out}/reports")
        totals_stream(spark, f"{out}/reports", f"{out}/totals", f"{out}/checkpoint").awaitTermination()
    runs, modules = read_totals(spark, f"{out}/totals")
    return modules.filter(~F.col("metric").startswith("columns_")).crossJoin(F.broadcast(runs))  # one row


# -- sources and sinks -------------------------------------------------------------------------


@query
def scan_null_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return null_tokens(contacts(spark, folder))


@query
def scan_null_tokens_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every null token, and texts that only look like one."""
    number = (F.col("row_id") % len(NULL_TOKENS)).cast("int")
    token = F.element_at(F.array(*map(F.lit, NULL_TOKENS)), number + 1)
    cell = F.when(F.col("row_id") % 2 == 0, token).otherwise(F.concat(token, F.lit(" ")))
    return null_tokens(contacts(spark, folder).select("row_id", cell.alias("cell")))


LIST_ROWS = 10_000  # row_ids of one list at most


@query
def scan_json_list(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of objects, one list to a file, with keys that some objects lack. There are as many as the table needs."""
    out = scratch_folder(spark)
    rows = contacts(spark, folder).select("row_id", F.floor(F.col("row_id") / LIST_ROWS).alias("part"), F.to_json(F.struct("row_id", "name", "zip", "cust")).alias("o"))
    lists = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("row_id", "o"))).alias("os"))
    text = F.concat(F.lit("["), F.array_join(F.transform("os", lambda x: x["o"]), ",\n"), F.lit("]"))
    lists.select("part", text.alias("value")).repartition("part").write.partitionBy("part").text(out)
    return read_table(spark, f"{out}/part=*", "json").drop("__position")


def _with_settings(spark: SparkSession, settings: dict[str, str], make) -> DataFrame:
    """``make()`` run under other settings of the session, as a table of its own."""
    out = scratch_folder(spark)
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = make()
        df.write.parquet(out)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(out)


@query
def scan_json_list_split(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of nested objects, with brackets, braces and quotes in their texts, each read by several tasks."""
    out = scratch_folder(spark)
    meta = F.struct("lang", F.array(F.struct("source"), F.struct("source")).alias("from"))
    text = F.concat(F.lit('}]"{[\\'), "text", F.lit('\\"}'))
    docs = documents(spark, folder).select("doc_id", F.floor(F.col("doc_id") / LIST_ROWS).alias("part"), F.to_json(F.struct("doc_id", meta.alias("meta"), text.alias("text"))).alias("o"))
    lists = docs.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "o"))), lambda x: x["o"]), ", ").alias("os"))
    lists.select("part", F.concat(F.lit("[ "), "os", F.lit("]")).alias("value")).repartition("part").write.partitionBy("part").text(out)

    def rows() -> DataFrame:
        found = read_table(spark, f"{out}/part=*", "json")
        return found.select("doc_id", "meta.lang", F.size("meta.from").alias("n_from"), F.element_at("meta.from.source", -1).alias("source"), "text")

    return _with_settings(spark, {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "64k"}, rows)


@query
def scan_json_many_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Objects whose keys are data: two are columns, all others stay together, and every cell comes back."""
    out = scratch_folder(spark)
    key = F.concat(F.lit("k"), (F.col("row_id") % 100_000).cast("string"))
    own = F.create_map(F.lit("row_id"), F.col("row_id").cast("string"), F.lit("name"), "name", key, "state")
    contacts(spark, folder).select(F.to_json(own, {"ignoreNullFields": "false"}).alias("value")).write.text(out)
    found = read_table(spark, out, "json", lines=True, max_columns=2)
    return found.select(F.col("row_id").cast("long").alias("row_id"), "name", F.to_json("__rest").alias("rest"))


@query
def scan_json_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Single objects, one to a file, as flat rows."""
    out = scratch_folder(spark)
    nations = table(spark, folder, "nation")
    one_each = nations.select("n_nationkey", F.to_json(F.struct("n_nationkey", F.struct("n_name", "n_regionkey").alias("n"))).alias("value"))
    one_each.repartition("n_nationkey").write.partitionBy("n_nationkey").text(out)
    flat = read_table(spark, f"{out}/n_nationkey=*", "json").drop("__position")
    return flat.select("n_nationkey", F.col("`n.n_name`").alias("n_name"), F.col("`n.n_regionkey`").alias("n_regionkey"))


@query
def clean_csv_file(spark: SparkSession, folder: str) -> DataFrame:
    """From a CSV folder to a cleaned CSV folder and its report."""
    out = scratch_folder(spark)
    write_table(contacts(spark, folder), f"{out}/people.csv")
    steps = ["text.trim_whitespace", *one("validation.standardize_state", columns=["state"]), *one("core.drop_rows_missing_required", columns=["name"])]
    report = clean_file(spark, f"{out}/people.csv", out, steps)
    rows = read_table(spark, report["output_path"], "csv").select("row_id", "name", "state", F.col("cust").cast("double"))
    return rows.withColumn("rows_output", F.lit(report["rows_output"]))

@query
def infer_types_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Columns given as text, typed by what they hold."""
    df = contacts(spark, folder)
    texts = df.select(
        "row_id",
        F.col("cust").cast("string").alias("cust"),
        F.concat(F.lit(" "), (F.col("row_id") / 4).cast("string")).alias("ratio"),
        (F.col("row_id") % 3 == 0).cast("string").alias("third"),
        F.when(F.col("cust").isNotNull(), "true").alias("has_cust"),
        "amount",
        "signup_date",
    )
    return infer_types(texts)


@query
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts written as CSV and read back: null tokens and types as found."""
    path = f"{scratch_folder(spark)}/contacts.csv"
    write_table(contacts(spark, folder), path)
    return read_table(spark, path).drop("__position")


@query
def scan_csv_multiline(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with line ends and quotes inside fields, through CSV and back."""
    path = f"{scratch_folder(spark)}/documents.csv"
    write_table(documents(spark, folder), path)
    return read_table(spark, path).drop("__position")


# Keys that share a few files, so that there are as many files, and tasks that write them, as the table needs.
FILE_KEYS, FILE_DOCS = 4_000_000, 30_000

CRLF_TEXT = """CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), concat(chr(13), chr(10)))
  WHEN 1 THEN replace(text, ' ', concat(chr(13), '"')) ELSE concat(text, chr(13), chr(10)) END"""


@query
def scan_csv_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts between semicolons, with single quotes, in Latin-1, below two lines that are no table; and between tabs."""
    out = scratch_folder(spark)
    quoted = lambda name: F.coalesce(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")), F.lit(""))
    note = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("é;\n'"), "status"))
    rows = contacts(spark, folder).withColumn("note", note).filter("name NOT LIKE '%€%'")
    line = F.concat_ws(";", F.col("row_id").cast("string"), *[quoted(F.col(n)) for n in ("name", "phone", "note")])
    part = F.floor(F.col("row_id") / FILE_KEYS) * 4 + F.col("row_id") % 4
    lines = rows.select(part.alias("part"), "row_id", line.alias("line"))
    top = F.lit("made by hand;;\nit's data\nrow_id;name;phone;note")
    lines = lines.unionByName(rows.select(part.alias("part")).distinct().select("part", F.lit(-1).alias("row_id"), top.alias("line")))
    lines = lines.repartition("part").sortWithinPartitions("part", "row_id")
    encoded = F.encode("line", "ISO-8859-1").cast("string")  # the bytes as they are
    lines.select("part", encoded.alias("value")).write.partitionBy("part").text(f"{out}/semicolons")
    found = read_table(spark, f"{out}/semicolons/part=*", "csv", sep=";", quote="'", encoding="ISO-8859-1", skip_rows=2, nulls=False)
    plain = {"header": True, "sep": "\t", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    contacts(spark, folder).select("row_id", F.replace("name", F.lit("\t"), F.lit("\t ")).alias("name")).write.options(**plain).csv(f"{out}/tabs")
    other = read_table(spark, f"{out}/tabs", "csv", sep="\t", nulls=False)
    return union_chunks([found.drop("__position"), other.drop("__position")])


@query
def scan_csv_crlf(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with line ends of all kinds, and quotes, in files whose lines end in CR LF."""
    out = scratch_folder(spark)
    text = F.concat(F.lit('"'), F.replace(F.expr(CRLF_TEXT), F.lit('"'), F.lit('""')), F.lit('"'))
    docs = documents(spark, folder).select(
        (F.floor(F.col("doc_id") / FILE_DOCS) * 3 + F.col("doc_id") % 3).alias("part"),
        "doc_id",
        F.concat_ws(",", F.col("doc_id").cast("string"), text, F.concat("source", F.lit("\r"))).alias("value"),
    )
    header = docs.select("part").distinct().select("part", F.lit(-1).alias("doc_id"), F.lit("doc_id,text,source\r").alias("value"))
    lines = docs.unionByName(header).repartition("part").sortWithinPartitions("part", "doc_id")
    lines.select("part", "value").write.partitionBy("part").text(out)
    return read_table(spark, f"{out}/part=*", "csv").drop("__position")


@query
def scan_csv_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a CSV table numbered in input order and cleaned in chunks of 500."""
    path = f"{scratch_folder(spark)}/orders.csv"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    write_table(orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    result = clean_chunks(
        read_table(spark, path),
        one("dedupe.drop_duplicates", subset=["o_orderstatus", "o_orderpriority"]),
        500,
    )
    return result.df


CODE = "CASE WHEN o_orderkey % 1000 = 777 THEN 'n/k' ELSE lpad(CAST(o_orderkey % 100 AS STRING), 3, '0') END"
RATIO = "CASE WHEN o_orderkey % 1500 = 3 THEN '0.5' ELSE CAST(o_orderkey % 7 AS STRING) END"


@query
def scan_csv_chunked_types(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 500 rows typed each by itself: codes are numbers in some and words in others, ratios whole in some."""
    path = f"{scratch_folder(spark)}/orders.csv"
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", f"{CODE} AS code", f"{RATIO} AS ratio")
    write_table(orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return clean_chunks(read_table(spark, path, types=False), ["text.trim_whitespace"], 500, infer=True).df


@query
def chunked_after_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks go by the position of rows, however they lie by now."""
    rows = read_table(spark, f"{folder}/orders.parquet").sortWithinPartitions(F.desc("o_orderkey"))
    steps = one("core.select_columns", columns=["o_orderkey"])
    return clean_chunks(rows, steps, 100).totals().select("chunk", F.col("__n_loaded").alias("rows_loaded"))


@query
def union_of_types(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that give columns other types: whole numbers with words, with halves, dates with times and with words."""
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int"))
    first = orders.select("o_orderkey", key.alias("code"), key.cast("int").alias("half"), day.alias("day"), day.alias("due"))
    second = orders.select(
        "o_orderkey",
        F.concat(F.lit("k"), key).alias("code"),
        (key / 2).alias("half"),
        F.concat(F.lit("day "), (key % 300).cast("string")).alias("day"),
        F.timestamp_add("HOUR", F.lit(5), day.cast("timestamp_ntz")).alias("due"),
    )
    return union_chunks([first, second])


@query
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/contacts.json"
    write_table(contacts(spark, folder), path)
    return read_table(spark, path, lines=True).drop("__position")


@query
def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Nested objects as flat columns; the list stays one cell (here shown by its size)."""
    path = f"{scratch_folder(spark)}/nested.json"
    nested = documents(spark, folder).select(
        "doc_id",
        F.struct("lang", F.struct(F.col("source").alias("name"), "n_chars").alias("from")).alias("meta"),
        F.split("text", " ").alias("words"),
    )
    write_table(nested, path)
    flat = flatten(read_table(spark, path, lines=True).drop("__position"))
    return flat.select(
        "doc_id",
        F.col("`meta.lang`").alias("meta_lang"),
        F.col("`meta.from.name`").alias("meta_from_name"),
        F.col("`meta.from.n_chars`").alias("meta_from_n_chars"),
        F.size("words").alias("n_words"),
    )


@query
def scan_yaml(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/customer.yaml"
    write_table(table(spark, folder, "customer"), path)
    return read_table(spark, path).drop("__position")


@query
def sink_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned contacts, dates included, as CSV shows them."""
    path = f"{scratch_folder(spark)}/cleaned.csv"
    steps = one("validation.coerce_datetime", columns=["signup_date"], format="%Y-%m-%d")
    clean(contacts(spark, folder), steps).write(path)
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


@query
def sink_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their timestamps as milliseconds since 1970."""
    path = f"{scratch_folder(spark)}/orders.json"
    orders = table(spark, folder, "orders")
    write_table(orders, path, json_epoch=True)
    return read_table(spark, path, lines=True).drop("__position")


@query
def sink_yaml_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/supplier.yaml"
    write_table(table(spark, folder, "supplier"), path)
    return read_table(spark, path, schema=table(spark, folder, "supplier").schema).drop("__position")
