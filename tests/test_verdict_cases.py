"""Cases beyond the given tables: null keys, null versions, failing SQL, provenance columns, large sums."""

from pyspark.sql import functions as F

from silverline.operators import catalog as C
from silverline.operators.asof import asof_join
from silverline.operators.context import pack_context
from silverline.operators.integrity import table_fingerprint
from silverline.sources.readers import utf8_text
from silverline.sources.sinks import write_gold


def test_asof_null_keys_and_times_match_nothing(spark):
    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3)], "k string, t bigint, l int")
    right = spark.createDataFrame([("a", 4, 10), (None, 4, 20), ("a", None, 30)], "k string, t2 bigint, r int")
    got = {r["l"]: r["r"] for r in asof_join(left, right, ["k"], "t", "t2", 10.0).collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_upsert_keeps_values_of_null_versions(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id int, v string, version int")
    b = spark.createDataFrame([(2, "z", None)], a.schema)
    assert {r["id"]: r["v"] for r in C.upsert(a, b, "id", "version").collect()} == {1: "x", 2: "y"}


def test_logged_sql_records_failures_of_any_column(spark):
    spark.createDataFrame([("1",), ("x",)], "s string").createOrReplaceTempView("verdict_cases")
    df, log = C.run_sql_logged(spark, "select cast(s as int) as n from verdict_cases", "u")
    assert df is None and log.first()["status"] == "error"
    df, log = C.run_sql_logged(spark, "select s from verdict_cases", "u")
    assert df.count() == 2 and log.first()["row_count"] == 2


def test_promote_leaves_provenance_columns(spark):
    df = spark.createDataFrame([(f"091234567{i}", str(i)) for i in range(8)], "_source_file string, amount string")
    out, _, columns = C.promote(df, "t")
    assert dict(out.dtypes)["_source_file"] == "string" and {r["column_name"] for r in columns.collect()} == {"amount"}


def test_fingerprint_sum_is_a_wide_decimal(spark):
    df = spark.range(10)
    assert dict(table_fingerprint(df).dtypes)["digest"] == "decimal(38,0)"
    assert table_fingerprint(df.select(F.lit(None).cast("string").alias("a"))).first() != table_fingerprint(df.select(F.lit("").alias("a"))).first()


def test_valid_replacement_characters_stay(spark):
    df = spark.createDataFrame([(bytearray("a\ufffdb".encode()),), (bytearray(b"a\xffb"),)], "content binary")
    assert [r[0] for r in df.select(utf8_text()).collect()] == ["a\ufffdb", "ab"]


def test_context_keeps_whole_texts_by_default(spark):
    docs = spark.createDataFrame([("s", f"f{i}", "x" * 9000) for i in range(9)], "space string, name string, text string")
    assert pack_context(docs, "space", "name", "text").first()["context"].count("x") == 81000


def test_second_promotion_replaces_the_metadata(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "n string, s string")
    for name in ("first", "second", "first"):
        out = write_gold(*C.promote(df, name), str(tmp_path), name)
    assert sorted(r["table_name"] for r in spark.read.parquet(out["tables"]).collect()) == ["first", "second"]
    assert spark.read.parquet(out["columns"]).count() == 4


def test_entities_carry_the_offset_of_every_match(spark):
    import re

    from silverline.operators.entities import ENTITY_RULES, extract_entities

    texts = ["a@b.co x a@b.co, a@b.co", "", None, "1/2/2024 11/2/2024x1/2/2024", "x 0912345678 0912345678 +84912345678", "5 VND 5 VND 1,000đ 5đ", "@", "a@b.c-x@y.z a@@b.c .@-.d",
             "é" * 40 + " mail@x.vn " + "é" * 40 + " mail@x.vn", "1-1-20011-1-2001", "no marks at all"]
    rules = {k: rx.replace(r"\p{L}\p{N}_", r"\w") for k, rx, _ in ENTITY_RULES}
    want = set()
    for i, t in enumerate(texts):
        for kind in ("email", "phone", "date"):
            for n, m in enumerate(re.finditer(rules[kind], t or ""), 1):
                want.add((i, kind, n, m[1], m.start(1) + 1))
        for n, m in enumerate(re.finditer(r"([0-9][0-9.,]*\s?(?:VNĐ|VND|đồng|đ))", t or ""), 1):
            want.add((i, "money", n, m[1], m.start(1) + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    rows = extract_entities(df, "body", ["id"]).collect()
    assert {(r["id"], r["kind"], r["ordinal"], r["value"], r["offset"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert texts[r["id"]][r["offset"] - 1:].startswith(r["value"]) and r["value"] in r["context"]
    places = {r["ordinal"]: r["position"] for r in rows if r["id"] == 0}
    assert places == {1: "start", 2: "middle", 3: "end"}


def test_clean_counts_its_rows_in_the_one_write(spark):
    from pyspark.sql import functions as F

    from silverline.plans.clean import clean

    touched = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touch(v):
        touched.add(1)
        return v

    df = spark.createDataFrame([(i, f" v{i} ") for i in range(40)], "id int, v string").select("id", touch.asNondeterministic()("v").alias("v"))
    res = clean(df)
    assert touched.value == 40 and res.data.count() == 40 and touched.value == 40  # the source was read once
