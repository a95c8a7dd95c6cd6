"""The lattice of types, types by chunk, and rows numbered by position."""

import datetime
import decimal
import itertools

import pytest
from pyspark.sql import functions as F, types as T

from rinsewell import clean_chunks, clean_file, infer_types, read_table, union_chunks
from rinsewell.functions import join_types, to_type
from rinsewell.plans import chunked, number_rows

TYPES = [
    T.NullType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2),
    T.DecimalType(38, 10), T.DateType(), T.TimestampNTZType(), T.TimestampType(), T.StringType(), T.BinaryType(), T.ArrayType(T.LongType()),
]


def test_types_form_a_lattice():
    for a, b, c in itertools.product(TYPES, repeat=3):
        assert join_types([a, b]) == join_types([b, a])
        assert join_types([a, a]) == a
        if not any(isinstance(t, (T.DecimalType, T.FloatType)) for t in (a, b, c)):  # sizes of decimals add up
            assert join_types([join_types([a, b]), c]) == join_types([a, join_types([b, c])])
    assert join_types([]) == T.NullType()
    assert join_types([T.LongType(), T.DecimalType(10, 2)]) == T.DecimalType(21, 2)


def test_any_two_types_unite(spark):
    moment = "2024-01-05 07:30:00"
    values = [None, True, 1, 2, 3, 4, 0.5, 1e7, decimal.Decimal("1.50"), decimal.Decimal("2.5"), datetime.date(2024, 1, 5), moment, None, "x", b"y", [1, None]]
    parts = []
    for kind, value in zip(TYPES, values, strict=True):
        value = "2024-01-05 12:30:00Z" if isinstance(kind, T.TimestampType) else value
        cell = F.array(F.lit(1), F.lit(None)) if isinstance(value, list) else F.lit(value)
        parts.append(spark.range(1).select((cell if isinstance(kind, T.NullType) else cell.cast(kind)).alias("v")))
    assert [r.v for r in union_chunks(parts).collect()] == [
        None, "True", "1", "2", "3", "4", "0.5", "10000000.0", "1.50", "2.5000000000", "2024-01-05", "2024-01-05 07:30:00", "2024-01-05 12:30:00+00:00", "x", "eQ==", "[1,null]",
    ]
    for (a, one), (b, two) in itertools.combinations(zip(TYPES, parts, strict=True), 2):
        both = union_chunks([one, two])
        assert both.schema["v"].dataType == join_types([a, b])
    assert union_chunks(parts[2:8]).collect()[0].v == 1.0
    assert str(to_type(F.col("v"), T.LongType(), T.LongType())) == str(F.col("v"))


def test_types_by_scope(spark):
    rows = [(0, "007", "1", "true", "1", None), (0, "8", None, "false", "2", None), (1, "007", "2.5", "true", "x", ""), (1, "n", " 3", None, "3", None), (None, "9", "4", "true", "true", None)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, s int, a string, b string, c string, d string, e string")
    typed = infer_types(df, scope=F.col("s"))
    assert [t for _, t in typed.dtypes] == ["int", "int", "string", "double", "string", "string", "string"]
    assert [tuple(r)[2:] for r in typed.orderBy("i").collect()] == [
        ("7", 1.0, "True", "1", None), ("8", None, "False", "2", None), ("007", 2.5, "true", "x", ""), ("n", 3.0, None, "3", None), ("9", 4.0, "True", "True", None),
    ]
    assert infer_types(df.limit(0), scope=F.col("s")).dtypes == df.dtypes
    same = infer_types(df.filter("s = 0"), scope=F.col("i"))
    assert dict(same.dtypes)["a"] == "bigint" and "Join" not in same._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_typed_by_chunk(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n01,1\n02,2\n03,x\nNA,\n05,5.5\n")
    clean_file(spark, str(tmp_path / "p.csv"), str(tmp_path / "out"), ["text.trim_whitespace"], chunk_size=2, output_format="parquet")
    found = spark.read.parquet(f"{tmp_path}/out/p_cleaned")
    assert found.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(map(tuple, found.fillna(-1).fillna("-").collect())) == [(-1, "-"), (1, "1"), (2, "2"), (3, "x"), (5, "5.5")]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_rows_are_numbered_by_position(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(chunked, "BLOCK", block)
    spark.range(50).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t.parquet")
    rows = read_table(spark, f"{tmp_path}/t.parquet")
    for moved in (rows, rows.sortWithinPartitions(F.desc("id")), rows.repartition(5), rows.filter("id % 2 = 0").join(F.broadcast(spark.range(50)), "id")):
        numbered = number_rows(moved, "n").select("id", "n").orderBy("id").collect()
        assert [r.n for r in numbered] == list(range(len(numbered)))
    sizes = clean_chunks(rows.sortWithinPartitions(F.desc("id")), [], 20).totals().select("chunk", "__n_loaded").orderBy("chunk")
    assert [tuple(r) for r in sizes.collect()] == [(0, 20), (1, 20), (2, 10)]
