"""Validation, scoring and coercion edge cases (AGG2-AGG6, TYP1-TYP4, FLT4/FLT5)."""


from silverline.functions import types as TY
from silverline.operators import catalog as C
from silverline.operators import profile as PR
from silverline.plans.clean import coerce_columns


def _emails(spark, valid, total):
    rows = [(f"user{i}@mail.vn",) if i < valid else (f"bad value {i}",) for i in range(total)]
    return spark.createDataFrame(rows, "email string")


def _quality(df):
    return PR.table_quality(PR.validate_columns(df)).first()


def test_level_thresholds(spark):
    assert _quality(_emails(spark, 19, 20))["quality_level"] == "gold"          # exactly 95
    q = _quality(_emails(spark, 9499, 10000))
    assert abs(q["overall_score"] - 94.99) < 1e-9 and q["quality_level"] == "silver"
    assert _quality(_emails(spark, 4, 5))["quality_level"] == "silver"          # exactly 80
    assert _quality(_emails(spark, 7999, 10000))["quality_level"] == "bronze"   # 79.99


def test_empty_table_and_all_null_column(spark):
    empty = spark.createDataFrame([], "a string")
    q = _quality(empty)
    assert q["overall_score"] == 0.0 and q["quality_level"] == "bronze"
    nulls = spark.createDataFrame([(None, "x")] * 4, "a string, b string")
    v = {r["column_name"]: r for r in PR.validate_columns(nulls).collect()}
    assert v["a"]["expected_type"] == "unknown" and v["a"]["valid_percentage"] == 0.0
    assert "High null rate: 4/4" in v["a"]["issues"]


def test_boolean_and_numeric_types(spark):
    df = spark.createDataFrame([(True, 1, 1.5, "1,234"), (False, 2, None, "2")], "b boolean, i bigint, d double, s string")
    v = {r["column_name"]: r["expected_type"] for r in PR.validate_columns(df).collect()}
    assert v == {"b": "boolean", "i": "integer", "d": "numeric", "s": "numeric"}


def test_nulls_lower_validity_and_phone_order(spark):
    # reference order: numeric is tested before phone, so 0-prefixed numbers look numeric
    df = spark.createDataFrame([("0912345678",), ("0987654321",), ("0911111111",), (None,)], "p string")
    r = PR.validate_columns(df).first()
    assert r["expected_type"] == "numeric" and r["valid_percentage"] == 75.0
    df = spark.createDataFrame([("+84912345678",), ("+84987654321",), (None,), (None,)], "p string")
    r = PR.validate_columns(df).first()
    assert r["expected_type"] == "phone" and r["valid_percentage"] == 50.0


def test_validity_edge_values(spark):
    vals = ["0912345678", "+84912345678", "84912345678", "a.b@c.vn", "31/12/24", "1-1-2024", "1.000.000 đ",
            "12.5 %", "có", "không", "yes", "2"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = df.select(*[TY.is_valid_for_type("v", t).alias(t) for t in ["phone", "email", "date", "money", "boolean",
                                                                       "numeric"]]).collect()
    phone = [r["phone"] for r in out]
    assert phone[:3] == [True, True, False]
    assert [r["email"] for r in out][3] is True
    assert [r["date"] for r in out][4:6] == [True, True]
    assert [r["money"] for r in out][6] is True
    assert [r["boolean"] for r in out][8:11] == [True, True, True]
    assert [r["numeric"] for r in out][11] is True and [r["numeric"] for r in out][7] is False


def test_typed_parsers(spark):
    vals = ["1,234", "1 234", "1_000", "1d", "nan", "inf", "1e5", ".5", "1.", "1.2.3", "$5", "2.5", "3.5", "-0.5",
            "2024-03-04", "3/4/24", "31/02/2024", "12/25/2024"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select("v", TY.clean_numeric("v").alias("n"), TY.clean_integer("v").alias("i"),
                     TY.clean_date("v").alias("d"), TY.clean_money("v").alias("m")).collect()
    got = {r["v"]: r for r in rows}
    assert got["1,234"]["n"] == 1234.0 and got["1 234"]["n"] == 1234.0
    assert got["1_000"]["n"] is None and got["1d"]["n"] is None and got["nan"]["n"] is None and got["inf"]["n"] is None
    assert got["1e5"]["n"] == 100000.0 and got["$5"]["n"] == 5.0
    assert (got["2.5"]["i"], got["3.5"]["i"], got["-0.5"]["i"]) == (2, 4, 0)  # half to even
    assert str(got["2024-03-04"]["d"].date()) == "2024-03-04"
    assert str(got["3/4/24"]["d"].date()) == "2024-04-03"
    assert got["31/02/2024"]["d"] is None and got["12/25/2024"]["d"] is None
    assert got["2.5"]["m"] == 25.0  # dots are thousands separators in money


def test_coercion_gate(spark):
    eight = [(str(i),) for i in range(8)] + [("x",), (None,)]
    nine = [(str(i),) for i in range(9)] + [(None,)]
    out8, rep8 = coerce_columns(spark.createDataFrame(eight, "a string"))
    out9, rep9 = coerce_columns(spark.createDataFrame(nine, "a string"))
    assert rep8.count() == 0 and dict(out8.dtypes)["a"] == "string"   # 80 % is not enough
    assert rep9.count() == 1 and dict(out9.dtypes)["a"] == "double"   # 90 % converts


def test_invalid_samples_first_five(spark):
    rows = [(i, "ok@mail.vn" if i % 5 else f"bad{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, e string")
    v = PR.validate_columns(df)
    s = PR.invalid_samples(df, v, ["k"], 5).orderBy("rank").collect()
    assert [r["value"] for r in s] == ["bad0", "bad5", "bad10", "bad15", "bad20"]


def test_smallest_invalid_of_all_groups(spark):
    rows = [("a", f"ok{i}@mail.vn", str(i)) for i in range(40)] + [("b", f"ok{i}@mail.vn", str(i)) for i in range(40)]
    rows += [("a", "N/A", "1")] * 9 + [("a", x, "2") for x in ("zz", "none", "none", "-")] + [("b", None, "x"), ("b", "bad", "3"), (None, "c@mail.vn", "4")]
    df = spark.createDataFrame(rows, "part string, e string, n string").repartition(4)
    v = PR.validate_columns(df, columns=["e", "n"], group_by=["part"])
    got = {(r["part"], r["column_name"]): r["sample_values"] for r in PR.smallest_invalid(df, v, ["part"], 3).collect()}
    assert got == {("a", "e"): ["-", "N/A", "none"], ("b", "e"): ["bad"], ("b", "n"): ["x"]}
    _, columns = C.promote_all(df, "part", samples=2)
    found = {(r["dataset_id"], r["column_name"]): r["sample_values"] for r in columns.collect()}
    assert len(found) == 6 and found["a", "e"] == '["-","N/A"]' and found["a", "n"] == found[None, "e"] == "[]"
    assert "sample_values" not in C.promote_all(df, "part")[1].columns
    none = df.limit(0)
    assert PR.smallest_invalid(none, PR.validate_columns(none, columns=["e", "n"], group_by=["part"]), ["part"]).count() == 0
    assert PR.smallest_invalid(df.select("part"), v, ["part"]).columns == ["part", "column_name", "sample_values"]


def test_recommendations_and_low_quality(spark):
    df = spark.createDataFrame([(f"col{i}", None) for i in range(20)], "col_a string, col_b string")
    low = PR.low_quality_table(df).first()
    assert low["low_quality"] is True
    v = PR.validate_columns(df)
    recs = [r["text"] for r in PR.recommendations(v, PR.table_quality(v)).collect()]
    assert any("Consider filling" in t for t in recs)
