"""JSON: lists of objects, single objects, and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import col, quoted
from .order import ORDER_COLUMN
from .scratch import scratch_folder

#: Keys that become columns; where objects have more, the others share one column.
MAX_COLUMNS = 2_000
REST_COLUMN = "__rest"


def flatten(df: DataFrame, keep: str = "") -> DataFrame:
    """Turn nested objects into columns ``a.b``, at every depth; lists stay one cell, and so does the column ``keep``."""

    def leaves(schema: T.StructType, path: str, name: str) -> list[Column]:
        found = []
        for field in schema.fields:
            inner, label = path + quoted(field.name), name + field.name
            if isinstance(field.dataType, T.StructType) and (path or field.name != keep):
                found += leaves(field.dataType, inner + ".", label + ".")
            else:
                found.append(F.col(inner).alias(label))
        return found

    return df.select(*leaves(df.schema, "", ""))


def _net(text: Column) -> Column:
    """Brackets opened less brackets closed; the braces that close stand between pieces."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "{[", ""))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files cut after every closing brace, wherever it stands, and what each piece does to the state of a
    reader: ``d0`` and ``d1`` are the changes of depth if it begins outside or inside a string."""
    value = F.col("value")
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace(value, r"\A\x{FEFF}", ""))
        .otherwise(value)
        .alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    bare = F.split(F.regexp_replace(value, r"(?s)\\.", ""), '"', -1)
    every_other = lambda odd: F.array_join(F.filter("bare", lambda _, i: i % 2 == odd), "")
    pieces = pieces.withColumn("bare", bare).select(
        "value", "file", "block", "row",
        (F.size("bare") - 1).alias("quotes"),
        _net(every_other(0)).alias("d0"),
        _net(every_other(1)).alias("d1"),
    )
    outside_after = lambda start: (F.col("quotes") + start) % 2 == 0
    return pieces.withColumns(
        {f"d{start}": F.col(f"d{start}") - F.when(outside_after(start), 1).otherwise(0) for start in (0, 1)}
    )


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``place``, ``listed``, ``record``: each object of a list, or the single object of a file, as JSON text.

    No task reads more than its split of a file. A piece of text changes the state of a reader (inside a string
    or not, depth) in a way that depends on the state before it, so a split is a function of that state: its two
    outcomes are summed up by split, a running composition over the few splits gives the state at the start of
    each, and running sums within a split the state at every piece. Objects of one piece are records as they are;
    only the others are gathered.
    """
    lines = _pieces(spark, paths)
    rows = Window.partitionBy("file", "block").orderBy("row")
    before, so_far = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.unboundedPreceding, 0)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1  # quotes before the piece, in its split
    lines = lines.withColumn("odd", odd).withColumns(
        {
            "e0": F.when(F.col("odd"), F.col("d1")).otherwise(F.col("d0")),
            "e1": F.when(F.col("odd"), F.col("d0")).otherwise(F.col("d1")),
        }
    )
    lines = lines.withColumns({f"r{s}": F.coalesce(F.sum(f"e{s}").over(before), F.lit(0)) for s in (0, 1)})

    # The state at the start of each split: a table with a row per split.
    head = F.substring(F.ltrim(F.regexp_replace("value", r"\A\s+", "")), 1, 1)
    splits = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.sum("e0").alias("e0"),
        F.sum("e1").alias("e1"),
        F.min("row").alias("first"),
        F.min(F.when(F.col("block") == 0, F.struct("row", head.alias("head")))).alias("head"),
    )
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file")
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("change", F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0")))
    splits = splits.withColumns(
        {
            "depth": F.coalesce(F.sum("change").over(earlier), F.lit(0)),
            "left": F.sum("change").over(whole_file),
            "all_quotes": F.sum("quotes").over(whole_file),
            "head": F.max("head.head").over(whole_file),
            "start": F.min("first").over(whole_file),
        }
    )
    # The piece after the last closing brace counts as if one followed.
    complete = F.col("all_quotes") % 2 == 0
    base = F.when((F.col("head") == "[") & complete & (F.col("left") == -1), 1)
    base = base.when((F.col("head") == "{") & complete & F.col("left").isin(0, -1), 0)
    base = base.when(F.col("head") == "", 0)
    wrong = F.when(F.col("head").isin("[", "{"), "JSON text that is not complete: ").otherwise(
        "JSON values that are not objects cannot form a table: "
    )
    base = base.otherwise(F.raise_error(F.concat(wrong, "file")).cast("int"))
    splits = splits.select("file", "block", "first", "start", "inside", "depth", base.alias("base"))

    lines = lines.join(splits, ["file", "block"])
    inside = F.col("inside") != F.col("odd")
    depth = F.col("depth") + F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))
    after = depth + F.when(inside, F.col("d1")).otherwise(F.col("d0"))
    outside_after = (inside.cast("int") + F.col("quotes")) % 2 == 0
    opens = (F.col("block") == 0) & (F.col("row") == F.col("start"))
    lines = lines.select(
        "file", "block", "row", "value", "first", "base",
        opens.alias("opens"),
        (opens | (~inside & (depth == F.col("base")))).alias("begins"),
        (outside_after & (after == F.col("base"))).alias("ends"),
    )
    # What stands after the last object, or in place of any.
    nothing = F.when(F.col("base") == 0, r"\A\s*\z").when(F.col("opens"), r"\A\s*\[\s*\]\s*\z").otherwise(r"\A\s*\]\s*\z")
    lines = lines.filter(~(F.col("begins") & F.regexp_like("value", nothing)))
    # Before an object stands what its place allows; anything else shows up in front of the brace and is an error.
    lead = F.when(F.col("opens") & (F.col("base") == 1), r"\A\s*\[\s*").when(F.col("base") == 1, r"\A\s*,\s*").when(F.col("opens"), r"\A\s*")
    clean = F.when(F.col("begins"), F.when(lead.isNotNull(), F.regexp_replace("value", lead, "")).otherwise("")).otherwise(F.col("value"))
    lines = lines.withColumn("value", F.concat(clean, F.lit("}")))
    lines = lines.withColumn("begun", F.last(F.when(F.col("begins"), F.col("row")), True).over(so_far))

    alone = F.col("begins") & F.col("ends")
    whole = lines.filter(alone).select("file", "block", "row", "base", F.col("value").alias("record"))
    # The object that is open at the start of a split began in the last split before in which any did.
    parts = lines.filter(~alone)
    last = lines.filter("begins").groupBy("file", "block").agg(F.max("row").alias("last"))
    place = F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("row")))
    owners = splits.join(last, ["file", "block"], "left").select(
        F.col("file").alias("own_file"), F.col("block").alias("at"), F.last(place, True).over(earlier).alias("owner")
    )
    parts = parts.join(owners, (F.col("file") == F.col("own_file")) & (F.col("block") == F.col("at")))
    own = F.when(F.col("begun").isNotNull(), F.struct("block", F.col("begun").alias("row"))).otherwise(F.col("owner"))
    gathered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "")
    joined = parts.select("*", own.alias("own")).groupBy("file", "own").agg(gathered.alias("record"), F.max("base").alias("base"))
    joined = joined.select("file", "own.block", "own.row", "base", "record")

    records = whole.unionByName(joined)
    message = F.concat(F.lit("JSON values that are not objects cannot form a table: "), F.substring("record", 1, 80))
    record = F.when(F.col("record").startswith("{"), F.col("record")).otherwise(F.raise_error(message).cast("string"))
    return records.select(F.struct("file", "block", "row").alias("place"), (F.col("base") == 1).alias("listed"), record.alias("record"))


def _json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = spark.read.text(paths).select(place.alias("place"), F.lit(True).alias("listed"), F.trim("value").alias("record"))
    return lines.filter(F.col("record") != "")


def _keys(records: DataFrame) -> DataFrame:
    """``key``, ``n``, ``first``: how often each key appears, and where first."""
    message = F.concat(F.lit("not a JSON object: "), F.substring("record", 1, 80))
    own = F.coalesce(F.json_object_keys("record"), F.raise_error(message).cast("array<string>"))
    keys = records.select("place.file", "place.block", "place.row", F.posexplode(own).alias("slot", "key"))
    # One task numbers the rows of a split, so the digits below the task's own and the slot are one whole number. Its
    # minimum is hashed, where a minimum of structs would sort every key of every object; that is left for the small
    # table with a row per key and split.
    place = F.shiftleft(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), 30) + F.col("slot")
    by_split = keys.groupBy("key", "file", "block").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    return by_split.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("file", "block", "place")).alias("first"))


def _columns(records: DataFrame, limit: int) -> tuple[list[str], bool]:
    """The most frequent keys, ``limit`` at most, in the order of their first appearance, and whether there are more.
    The driver gets a bounded list, however many keys there are."""
    top = _keys(records).orderBy(F.desc("n"), "first").limit(limit + 1).collect()
    return [row["key"] for row in sorted(top[:limit], key=lambda row: row["first"])], len(top) > limit


def _inferred(records: DataFrame) -> T.StructType:
    """The schema that Spark infers from all records."""
    spark = records.sparkSession
    texts = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(texts).schema().json()))


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    lines: bool = False,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Read JSON files: a list of objects is a table, a single object one flattened row.

    Files split, lists as well (see ``json_records``); ``lines=True`` reads JSON lines. Without a schema Spark
    infers one, and the columns take the order in which their names first appear. Where objects have more than
    ``max_columns`` keys, the most frequent become columns, and the others stay together as one VARIANT object
    in the column ``__rest``: keys that are data do not become a schema. Text that is not JSON, or not complete, is
    an error. The objects of files that are not JSON lines are kept in a scratch table, unless there is a schema. The
    result has a hidden position for first and last.
    """
    paths = [path] if isinstance(path, str) else list(path)
    records = _json_lines(spark, paths) if lines else json_records(spark, paths)
    position = F.col("place").alias(ORDER_COLUMN)
    if schema is not None:
        parsed = records.select(F.from_json("record", schema).alias("r"), position)
        return parsed.select("r.*", ORDER_COLUMN)
    single = False
    if not lines:
        # Finding the objects is the dear part, and three passes need them.
        folder = scratch_folder(spark)
        records.write.parquet(folder)
        records = spark.read.schema(records.schema).parquet(folder)
        single = records.agg(F.bool_or("listed")).first()[0] is False
    names, more = _columns(records, max_columns)
    if not names:
        return spark.createDataFrame([], T.StructType()) if records.isEmpty() else records.select(position)
    rest = []
    if more:
        cells = F.from_json("record", "map<string,variant>", {"mode": "FAILFAST"})
        chosen = lambda key, value: key.isin(names)
        others = F.parse_json(F.to_json(F.map_filter("cells", lambda key, value: ~key.isin(names))))
        records = records.select("*", cells.alias("cells")).select(
            "place", F.to_json(F.map_filter("cells", chosen)).alias("record"), others.alias(REST_COLUMN)
        )
        rest = [F.col(REST_COLUMN)]
    inferred = _inferred(records)
    fields = [T.StructField(name, inferred[name].dataType) for name in names if name in inferred.fieldNames()]
    parsed = F.from_json("record", T.StructType(fields), {"mode": "FAILFAST"}).alias("r")
    rows = records.select(parsed, *rest, position).select("r.*", *rest, ORDER_COLUMN)
    return flatten(rows, keep=ORDER_COLUMN) if single and not more else rows
