import os
import tempfile

from pyspark.sql import types as T

from silverline.sources import readers as RD


def _files(named):
    root = tempfile.mkdtemp(prefix="sl-schemas-")
    for name, text in named.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    return root


def test_csv_headers_in_any_order_and_broken_rows(spark):
    root = _files({"a.csv": "x,y\n1,2\n", "b.csv": "y,x,z\r\n9,8,7\r\n5\r\n6,5,4,3\r\n", "sub dir/[c] 100%+.CSV": "﻿\nx,y\n3,text\n", "empty.csv": "", "only.csv": "x,y\n"})
    frames, errors = RD.ingest_files(spark, root)
    rows = sorted((str(r["x"]), str(r["y"]), r["z"]) for r in frames["csv"].collect())
    assert rows == [("1", "2", None), ("3", "text", None), ("8", "9", 7)]
    assert sorted((r["reason"], r["record"]) for r in errors.collect()) == [("malformed record", "5"), ("malformed record", "6,5,4,3")]
    assert {os.path.basename(r["path"]) for r in errors.select("path").collect()} == {"b.csv"}


def test_json_forms_in_one_directory(spark):
    root = _files({"l.json": '{"a": 1, "b": {"c": "x"}}\n{"a": 2}\nnot json\n', "arr.json": '\n [{"a": 3}, {"a": 4, "d": true}]', "one.json": '{\n  "a": 5,\n "b": {"c": "y"}\n}\n',
                   "void.json": "  \n"})
    frames, errors = RD.ingest_files(spark, root)
    assert sorted((r["a"], r["b"]["c"] if r["b"] else None, r["d"]) for r in frames["json"].collect()) == [
        (1, "x", None), (2, None, None), (3, None, None), (4, None, True), (5, "y", None)]
    assert [r["record"] for r in errors.collect()] == ["not json"]


def test_parquet_with_extra_columns_and_two_types(spark):
    root = tempfile.mkdtemp(prefix="sl-pq-")
    for i, (rows, kind) in enumerate([([(1, "a")], "id int, v string"), ([(2, 7, 1.5)], "id long, v int, w double"), ([("c", 3)], "v string, id int")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/{i}")
    frames, errors = RD.ingest_files(spark, root)
    assert sorted((r["id"], r["v"], r["w"]) for r in frames["parquet"].collect()) == [(1, "a", None), (2, "7", 1.5), (3, "c", None)]
    assert errors.count() == 0 and dict(frames["parquet"].dtypes)["id"] == "bigint"


def test_common_type_keeps_values():
    assert RD.common_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert RD.common_type(T.IntegerType(), T.DoubleType()) == T.DoubleType()
    assert RD.common_type(T.LongType(), T.DoubleType()) == T.StringType()
    assert RD.common_type(T.NullType(), T.DateType()) == RD.common_type(T.DateType(), T.NullType()) == T.DateType()
    assert RD.common_type(T.DateType(), T.TimestampType()) == T.StringType()
