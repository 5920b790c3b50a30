"""Reading by suffix, promotion, narrowing, naming and integrity."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.registry import table
from tidemark.sources import readers


def test_csv_dates_are_promoted(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("day,label,x\n2024-01-01,a,1.5\n2024-02-01,b,2.5\n,c,\n")
    df = readers.read_table(spark, str(path))
    types = dict(df.dtypes)
    assert types["day"] in ("date", "timestamp", "timestamp_ntz")
    assert types["label"] == "string" and types["x"] == "double"
    assert df.where("day is null").count() == 1


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"id": 1, "when": "2024-03-01 10:00:00"}, {"id": 2, "when": "2024-03-02 11:00:00"}]
    array, lines = tmp_path / "array.json", tmp_path / "lines.json"
    array.write_text(json.dumps(rows))
    lines.write_text("\n".join(json.dumps(r) for r in rows))
    for df in (readers.read_table(spark, str(array)), readers.read_table(spark, str(lines), json_lines=True)):
        assert df.count() == 2
        assert dict(df.dtypes)["when"].startswith("timestamp")


def test_json_lines_are_read_whole_by_default(spark, tmp_path):
    lines, array = tmp_path / "lines.json", tmp_path / "array.json"
    lines.write_text("\n" + "\n".join(json.dumps({"id": i}) for i in range(3)))
    array.write_text("\n  [" + ",\n".join(json.dumps({"id": i}) for i in range(4)) + "]")
    assert readers.read_table(spark, str(lines)).count() == 3
    assert readers.read_table(spark, str(array)).count() == 4


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,said,n\n1,"say ""hi"", ok",2\n2,"a, b",3\n')
    df = readers.read_table(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, 'say "hi", ok', 2), (2, "a, b", 3)]
    path.write_text('id,said\n1,"two\nlines"\n2,one\n')
    df = readers.read_table(spark, str(path), csv_multiline=True)
    assert sorted(map(tuple, df.collect())) == [(1, "two\nlines"), (2, "one")]


def test_malformed_csv_rows_are_counted(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,x\n1,2\nfew\n3,4,5\n6,7\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.IntegerType())])
    assert tuple(readers.malformed_rows(spark, str(path), schema).first())[:2] == (4, 2)


def test_a_keyed_sample_does_not_depend_on_partitions(spark):
    df = spark.range(20_000)
    one = {r["id"] for r in readers.sample_rows(df.repartition(1), 0.1, keys=["id"]).collect()}
    assert one == {r["id"] for r in readers.sample_rows(df.repartition(7), 0.1, keys=["id"]).collect()}
    assert abs(len(one) - 2000) < 200


def test_parquet_round_trip_limit_and_unknown_suffix(spark, folder, tmp_path):
    out = str(tmp_path / "part.parquet")
    readers.write_table(table(spark, folder, "part"), out)
    assert readers.read_table(spark, out).count() == table(spark, folder, "part").count()
    assert readers.read_table(spark, out, row_limit=7).count() == 7
    with pytest.raises(ValueError):
        readers.read_table(spark, "somewhere/table.xlsx")


def test_narrowing_keeps_every_value(spark):
    df = spark.createDataFrame(
        [(1, 40_000, "7", 0.5, 0.1, "x"), (2, 50_000, "8", 1.5, 0.2, "x"), (3, 60_000, "9", 2.5, 0.3, "y")],
        "small long, middle long, digits string, half double, tenth double, label string",
    )
    types = dict(readers.narrow_types(df).dtypes)
    assert types == {
        "small": "tinyint", "middle": "int", "digits": "bigint", "half": "float", "tenth": "double", "label": "string",
    }


def test_names_are_cleaned_and_collisions_refused(spark):
    assert readers.clean_name("  Gas  Flow (MMcf)__x ") == "gas_flow_mmcf_x"
    df = spark.createDataFrame([(1, 2)], ["A b", "a-b"])
    with pytest.raises(ValueError):
        readers.clean_column_names(df)


def test_integrity_of_empty_and_sparse_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    found = {r["check"]: r["status"] for r in readers.verify_integrity(empty).collect()}
    assert found["has_rows"] == "error"
    sparse = spark.createDataFrame([(1, None, None)], "a int, b string, c double")
    found = {r["check"]: (r["status"], r["detail"]) for r in readers.verify_integrity(sparse).collect()}
    assert found["all_null_columns"] == ("warning", "b,c")
    assert found["completeness_percent"] == ("warning", "33.3")


def test_load_verifies_and_cleans(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).select(F.col("id").alias("Row Id"), F.lit("x").alias("Some Text")).write.parquet(path)
    df = readers.load(spark, path)
    assert df.dtypes == [("row_id", "tinyint"), ("some_text", "string")]
    empty = str(tmp_path / "empty.parquet")
    spark.range(0).write.parquet(empty)
    with pytest.raises(ValueError):
        readers.load(spark, empty)
