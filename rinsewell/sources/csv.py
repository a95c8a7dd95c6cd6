"""CSV: reading with exact record boundaries, null tokens, and the type ladder."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import col, is_text, join_types, to_type
from .order import ORDER_COLUMN, with_position
from .scratch import kept

# Texts read as null.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

_INTEGER = r"\A[ \t]*[+-]?\d+[ \t]*\z"
_FLOAT = r"(?i)\A[ \t]*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)[ \t]*\z"

# Classes of values, as bits.
_NULL, _LONG, _WHOLE, _DOUBLE, _BOOLEAN, _TEXT = 1, 2, 4, 8, 16, 32


def _class_of(value: Column) -> Column:
    fits_double = (F.abs(value.try_cast("double")) < float("inf")) | value.rlike("(?i)inf")
    return (
        F.when(value.isNull(), _NULL)
        .when(value.rlike(_INTEGER), F.when(value.try_cast("long").isNull(), _WHOLE).otherwise(_LONG))
        .when(value.rlike(_FLOAT) & fits_double, _DOUBLE)
        .when(F.lower(value).isin("true", "false"), _BOOLEAN)
        .otherwise(_TEXT)
    )


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn null tokens into nulls in every text column."""
    types = {field.name: field.dataType for field in df.schema.fields}
    return df.select(
        *[
            F.when(~col(name).isin(NULL_TOKENS), col(name)).alias(name) if is_text(dtype) else col(name)
            for name, dtype in types.items()
        ]
    )


def infer_types(df: DataFrame, columns: list[str] | None = None, scope: Column | None = None) -> DataFrame:
    """Give text columns the type that all their values allow: long, double, boolean or string.

    One aggregation decides: each value is put in one class, and the classes met in a column are
    collected as bits. Dates stay strings, and so does a boolean column with a null in it; a column
    without any value stays a string column as well.

    With ``scope`` every scope is typed as a table of its own, and a column gets the least type that holds those of all
    scopes: ``007`` is 7 where a scope holds whole numbers only, and as text ``7`` if another scope holds words.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not columns:
        return df
    met = [F.bit_or(_class_of(col(n))) for n in columns]
    if scope is not None:
        return _typed_by_scope(df, columns, scope, met)
    found = df.agg(*met).first()
    return _typed(df, dict(zip(columns, found)))


def _type_name(met: int | None) -> str:
    """The type that the classes met in a column allow."""
    values = (met or 0) & ~_NULL
    if values == _LONG:
        return "long"
    if values & _DOUBLE and not values & (_BOOLEAN | _TEXT):
        return "double"
    # Whole numbers that do not fit a long are text: they keep all their digits.
    return "boolean" if met == _BOOLEAN else "string" if values else ""


_TYPES = {"": T.NullType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def _typed(df: DataFrame, classes: dict[str, int | None]) -> DataFrame:
    """The columns in the types that the classes met in them allow."""
    names = {name: _type_name(met) for name, met in classes.items()}
    typed = {name: col(name).try_cast(kind).alias(name) for name, kind in names.items() if kind not in ("", "string")}
    return df.select(*[typed.get(name, col(name)) for name in df.columns])


def _typed_by_scope(df: DataFrame, columns: list[str], scope: Column, met: list[Column]) -> DataFrame:
    """The classes of each scope are a table with a row per scope. It meets the rows again only where a column is text
    because its scopes differ: all other columns need one cast whatever their scope."""
    kinds = [F.element_at(F.create_map(*_all_kinds()), F.coalesce(bits, F.lit(0))).alias(f"__kind_{i}") for i, bits in enumerate(met)]
    scopes = df.groupBy(scope.alias("__scope")).agg(*kinds)
    found = scopes.agg(*[F.collect_set(f"__kind_{i}") for i in range(len(columns))]).first()
    targets = [join_types(_TYPES[kind] for kind in sorted(each)) for each in found]
    mixed = [i for i, each in enumerate(found) if targets[i] == T.StringType() and {*each} - {"", "string"}]
    typed = {}
    for i, name in enumerate(columns):
        if i in mixed:
            as_kind = {kind: to_type(col(name).try_cast(kind), _TYPES[kind], targets[i]) for kind in found[i] if kind not in ("", "string")}
            cell = col(name)
            for kind, shown in as_kind.items():
                cell = F.when(F.col(f"__kind_{i}") == kind, shown).otherwise(cell)
            typed[name] = cell.alias(name)
        elif targets[i] not in (T.StringType(), T.NullType()):
            typed[name] = col(name).try_cast(targets[i]).alias(name)
    rows = df
    if mixed:
        lookup = scopes.select("__scope", *[f"__kind_{i}" for i in mixed])
        rows = df.join(lookup, scope.eqNullSafe(F.col("__scope")), "left")
    return rows.select(*[typed.get(name, col(name)) for name in df.columns])


def _all_kinds() -> list[Column]:
    """Every set of classes, as bits, and the type that it allows."""
    return [F.lit(x) for bits in range(2 * _TEXT) for x in (bits, _type_name(bits))]


#: Bytes of a record whose fields go on over line ends. A quote that is never closed makes one of the rest of its file.
MAX_RECORD = 64 << 20

#: Lines that are looked at before all are.
FIRST_LINES = 10_000

_BAD = "__bad_record"
#: Encodings in which a line end is one byte, and no part of any other character.
ENCODINGS = ("UTF-8", "US-ASCII", "ISO-8859-1")


@dataclass(frozen=True)
class Dialect:
    """How a CSV file is written; ``skip`` lines before the header are no part of the table."""

    sep: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"
    skip: int = 0

    def __post_init__(self):
        if len(self.sep) != 1 or len(self.quote) != 1 or self.sep == self.quote or {self.sep, self.quote} & {"\n", "\r"}:
            raise ValueError("separator and quote are one character each, and not the same")
        if self.encoding not in ENCODINGS:
            raise ValueError(f"encoding must be one of {ENCODINGS}: files in others cannot be split at line ends")

    def options(self) -> dict[str, str]:
        return {"sep": self.sep, "quote": self.quote, "escape": self.quote}

    def lines(self, spark: SparkSession, paths: list[str] | str, **options: str) -> DataFrame:
        """value, file, block: the lines as text, and the file and split they stand in."""
        lines = spark.read.options(**options).text(paths)
        value = F.col("value")
        if self.encoding != "UTF-8":
            value = F.decode(value.cast("binary"), self.encoding)
        return lines.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


# With a digit after it, a character of the private use area stands for itself (0), a carriage return (1)
# and a line feed (2) in a field, and for the end of a record (3).
_MARK = "\ue000"
_MARKED = [("\n", _MARK + "2"), ("\r", _MARK + "1"), (_MARK, _MARK + "0")]


def _header(spark: SparkSession, paths: list[str], dialect: Dialect) -> tuple[list[str], str]:
    """Column names from the first record of the first file (repeats become ``a``, ``a.1``), and its
    first line as it is."""
    files = spark.read.text(paths).inputFiles()
    if not files:
        raise ValueError(f"no CSV file in {paths}")
    file = unquote(min(files))
    lines = dialect.lines(spark, file, lineSep="\n").select("value")
    if not dialect.skip:
        lines = lines.filter("trim(value) NOT IN ('', '\r')")
    wanted, record = 1, None
    while record is None:
        found = [row[0] for row in lines.take(wanted + dialect.skip)][dialect.skip :]
        if not found:
            raise ValueError(f"empty CSV file: {file}")
        whole = [n for n in range(1, len(found) + 1) if "\n".join(found[:n]).count(dialect.quote) % 2 == 0]
        if whole or len(found) < wanted:
            record = "\n".join(found[: whole[0] if whole else None])
        wanted *= 2
    text = io.StringIO(record.removeprefix("\ufeff"), newline="")
    first = next(csv.reader(text, delimiter=dialect.sep, quotechar=dialect.quote, strict=False))
    names, seen = [], set()
    for i, name in enumerate(first):
        name = base = name or f"Unnamed: {i}"
        repeat = 0
        while name in seen:
            repeat += 1
            name = f"{base}.{repeat}"
        seen.add(name)
        names.append(name)
    return names, re.split("[\r\n]", record)[0]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    types: bool = True,
    nulls: bool = True,
    multiline: bool | None = None,
    max_record: int = MAX_RECORD,
    sep: str = ",",
    quote: str = '"',
    encoding: str = "UTF-8",
    skip_rows: int = 0,
) -> DataFrame:
    """Read CSV files with a header row; all files share the columns of the first.

    ``sep`` and ``quote`` are a character each (a quote within quotes is doubled), ``encoding`` is one of ``ENCODINGS``,
    and ``skip_rows`` lines at the top of each file are passed over. A byte-order mark of UTF-8 is no part of a name.

    Fields may hold line ends of any kind inside quotes, and keep them. ``multiline=None`` finds out
    whether some do, in the pass that also finds the types; pass True or False where the answer is
    known. Files are split either way. A row with more fields than the header is an error, and so is a record over
    several lines of more than ``max_record`` bytes: its lengths are summed before any lines are put together, and the
    error says where the quote stands. Lines of such files, and their records where types are to be found, are kept in
    scratch tables. The result has a hidden position for first and last.
    """
    paths = [path] if isinstance(path, str) else list(path)
    dialect = Dialect(sep, quote, encoding, skip_rows)
    header, header_line = _header(spark, paths, dialect)
    classes = None
    if skip_rows:
        multiline = True  # there lines are looked at one by one
    if multiline is None:
        multiline, classes = _first_look(spark, paths, header, header_line, types, nulls, dialect)
    if multiline:
        rows = _across_lines(spark, paths, header, max_record, dialect)
        if types:  # finding the records is the dear part, and two passes need them
            rows = kept(rows.toDF(*[f"c{i}" for i in range(len(header))], ORDER_COLUMN)).toDF(*header, ORDER_COLUMN)
    else:
        rows = _line_by_line(spark, paths, header, dialect)
    if nulls:
        rows = null_tokens(rows)
    if not types:
        return rows
    return _typed(rows, classes) if classes else infer_types(rows, header)


def _quotes(line: Column, dialect: Dialect) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(dialect.quote), F.lit("")))


def _fields(record: Column, names: list[str], dialect: Dialect) -> Column:
    """The fields of a record as a struct with one more, which is null unless there are too many."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)]
    return F.from_csv(record, ", ".join(f"{f.name} string" for f in fields), dialect.options())


def _first_look(spark, paths, header, header_line, types, nulls, dialect) -> tuple[bool, dict | None]:
    """Whether a field holds a line end, and if none does, the classes of values in each column.

    If every line has an even number of quotes, no quoted field goes on in the next line, and each line
    is a record. The lines equal to the header line must be as many as the files, or else some of them
    are data, and the classes are left for another pass. Where fields hold line ends, the first lines mostly tell, and
    the pass over all of them, which parses them too, is spared.
    """
    line = F.col("value")
    lines = dialect.lines(spark, paths)
    is_header = line == F.lit(header_line)
    odd = _quotes(line, dialect) % 2 == 1
    if any(row[0] for row in lines.select(odd).take(FIRST_LINES)):
        return True, None
    facts = [
        F.count_if(odd).alias("odd"),
        F.count_if(is_header).alias("headers"),
        F.count_distinct("file").alias("files"),
    ]
    wanted = header if types else []
    if wanted:
        record = F.when(~is_header & (F.trim(line) != ""), line)
        lines = lines.select("value", "file", _fields(record, header, dialect).alias("r"))
        for i in range(len(wanted)):
            cell = F.col("r").getField(f"c{i}")
            cell = F.when(~cell.isin(NULL_TOKENS), cell) if nulls else cell
            facts.append(F.bit_or(F.when(F.col("r").isNotNull(), _class_of(cell))).alias(f"k{i}"))
    found = lines.agg(*facts).first()
    if found["odd"]:
        return True, None
    if not wanted or found["headers"] != found["files"]:
        return False, None
    return False, {name: found[f"k{i}"] for i, name in enumerate(header)}


def _line_by_line(spark: SparkSession, paths: list[str], header: list[str], dialect: Dialect) -> DataFrame:
    """Every line is a record."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _BAD]])
    rows = (
        spark.read.options(header=True, encoding=dialect.encoding, **dialect.options())
        .option("columnNameOfCorruptRecord", _BAD)
        .option("columnPruning", False)  # a pruned scan does not notice long rows
        .schema(schema)
        .csv(paths)
    )
    extra = _fields(F.col(_BAD), header, dialect).getField(f"c{len(header)}")
    # Naming a data column keeps one in the scan: Spark refuses to read the bad records alone.
    text = F.concat_ws(" ", _BAD, col(header[0]))
    fits = _not_too_long(F.col(_BAD).isNotNull() & extra.isNotNull(), text, header)
    return with_position(rows, row_index=False).filter(fits).drop(_BAD)


def _across_lines(spark: SparkSession, paths: list[str], header: list[str], max_record: int, dialect: Dialect) -> DataFrame:
    """Records that may go on over line ends, and over the ends of file splits.

    A line begins a record where the quotes before it in the file are even in number. Within a split their parity is
    a running sum, and what follows from it is found for either parity at the start of the split; which of them
    holds comes from a small table with a row per split. Both are kept in scratch tables: lines are dealt out and sorted
    once, and meet the small table where they lie. Lines with all quotes closed are records as they are; only the others
    are gathered by record.
    """
    value, row = F.col("value"), F.col("row")
    width = F.octet_length if dialect.encoding == "UTF-8" else F.length  # of a text, in bytes of the file
    lines = dialect.lines(spark, paths, lineSep="\n").select(
        "value",
        "file",
        "block",
        F.monotonically_increasing_id().alias("row"),
        _quotes(value, dialect).alias("quotes"),
        (width(value) + 1).alias("bytes"),
        (width(value) - width(F.substring_index(value, dialect.quote, -1)) - 1).alias("last_quote"),
    )
    in_split = Window.partitionBy("file", "block").orderBy("row")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, 0)
    if dialect.skip:
        below = (F.col("block") > 0) | (row >= F.col("top") + dialect.skip)
        lines = lines.withColumn("top", F.first("row").over(so_far)).filter(below).drop("top")
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1  # quotes before the line, in its split
    begun = [F.when(~F.col("odd"), row), F.when(F.col("odd"), row)]  # if the split begins outside, or inside, of quotes
    lines = lines.withColumn("odd", odd)
    lines = kept(lines.withColumns({f"start{s}": F.last(begun[s], True).over(so_far) for s in (0, 1)}))

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("all"), F.min("row").alias("first"), F.sum("bytes").alias("size"), F.count("*").alias("lines"),
        F.max("start0").alias("last0"), F.max("start1").alias("last1"),
    )
    sums = {"open": "all", "offset": "size", "line": "lines"}
    splits = splits.withColumns({name: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for name, n in sums.items()})
    # The record that is open at the start of a split began in the last split before in which any did.
    splits = splits.withColumn("last", F.when(F.col("open") % 2 == 0, F.col("last0")).otherwise(F.col("last1")))
    place = F.when(F.col("last").isNotNull(), F.struct("block", "last", "first"))
    splits = kept(splits.select("file", "block", "first", *sums, F.last(place, True).over(earlier).alias("owner")))

    inside = F.col("open") % 2 == 1
    lines = lines.join(splits, ["file", "block"]).select(
        "*", (inside == F.col("odd")).alias("begins"), F.when(inside, F.col("start1")).otherwise(F.col("start0")).alias("start")
    )
    alone = F.col("begins") & (F.col("quotes") % 2 == 0)
    whole = lines.filter(alone).select("file", "block", "row", "first", value.alias("record"))
    parts = lines.filter(~alone).select(
        "file",
        F.when(F.col("start").isNotNull(), F.struct("block", F.col("start").alias("last"), "first"))
        .otherwise(F.col("owner"))
        .alias("place"),
        F.struct("block", "row", "value").alias("line"),
        "bytes",
    )
    _check_lengths(parts, lines, max_record)
    gathered = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["value"]), "\n")
    joined = parts.groupBy("file", "place").agg(gathered.alias("record"))
    joined = joined.select(
        "file", "place.block", F.col("place.last").alias("row"), "place.first", "record"
    )
    records = whole.unionByName(joined).filter(~((F.col("block") == 0) & (F.col("row") == F.col("first"))))

    # A carriage return ends a record too, outside of quotes: there, between every other two quotes.
    safe = F.replace(F.regexp_replace("record", r"\r\z", ""), F.lit(_MARK), F.lit(_MARK + "0"))
    outer = lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("\r"), F.lit(_MARK + "3"))).otherwise(x)
    ends = F.split(F.array_join(F.transform(F.split(safe, rf"\Q{dialect.quote}\E", -1), outer), dialect.quote), _MARK + "3", -1)
    pieces = F.when(safe.contains("\r"), ends).otherwise(F.array(safe))
    records = records.select("file", "block", "row", F.posexplode(pieces).alias("part", "record"))
    safe = F.replace(F.replace("record", F.lit("\r"), F.lit(_MARK + "1")), F.lit("\n"), F.lit(_MARK + "2"))
    rows = records.filter(F.trim("record") != "").select(
        F.struct("file", "block", "row", "part").alias(ORDER_COLUMN), "record", _fields(safe, header, dialect).alias("r")
    )
    extra = F.col("r").getField(f"c{len(header)}")
    rows = rows.filter(_not_too_long(extra.isNotNull(), F.col("record"), header))
    cells = []
    for i, name in enumerate(header):
        cell = F.col("r").getField(f"c{i}")
        for text, mark in _MARKED:
            cell = F.replace(cell, F.lit(mark), F.lit(text))
        cells.append(cell.alias(name))
    # The rows of a split together and in order, as a scan would give them.
    place = F.col(ORDER_COLUMN)
    dealt = rows.repartition(place["file"], place["block"]).sortWithinPartitions(place)
    return dealt.select(*cells, ORDER_COLUMN)


def _check_lengths(parts: DataFrame, lines: DataFrame, max_record: int) -> None:
    """Fail on a record of too many bytes, with the place of the quote that opens it: only lengths are moved and summed."""
    sizes = parts.groupBy("file", "place").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > max_record)
    worst = sizes.select("file", "place.block", F.col("place.last").alias("row"), "bytes").orderBy("file", "block", "row").first()
    if worst is None:
        return
    own = lines.filter((F.col("file") == worst["file"]) & (F.col("block") == worst["block"]) & (F.col("row") <= worst["row"]))
    before = own.filter(F.col("row") < worst["row"]).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("lines")).first()
    place = own.filter(F.col("row") == worst["row"]).select("offset", "line", "last_quote").first()
    offset = place["offset"] + before["bytes"] + place["last_quote"]
    raise ValueError(
        f"CSV record of {worst['bytes']} bytes over several lines, more than {max_record}: the quote at byte {offset}, "
        f"line {place['line'] + before['lines'] + 1} of {worst['file']} may not be closed"
    )


def _not_too_long(too_long: Column, record: Column, header: list[str]) -> Column:
    """Fail on rows with more fields than the header; missing fields are nulls."""
    message = F.concat_ws(" ", F.lit(f"CSV row with more than {len(header)} fields:"), record)
    return F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
