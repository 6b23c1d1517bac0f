import os
import tempfile

from pyspark.sql import functions as F

from silverline.operators import catalog as C
from silverline.operators import usage as U
from silverline.operators.entities import extract_entities
from silverline.plans.clean import clean
from silverline.sources import readers as RD


def test_ingest_directory_and_rejects(spark):
    root = tempfile.mkdtemp(prefix="sl-ingest-")
    spark.createDataFrame([(1, "a"), (2, "b")], "Id int, `Tên (VN)` string").write.option("header", True).csv(f"{root}/c")
    spark.createDataFrame([(1, {"x": 5})], "id int, obj struct<x:int>").write.json(f"{root}/j")
    with open(f"{root}/note.TXT", "wb") as fh:
        fh.write("xin chào".encode() + b"\xff\xfe" + " bạn".encode())
    with open(f"{root}/scan.pdf", "wb") as fh:
        fh.write(b"%PDF-1.4")
    with open(f"{root}/run.exe", "wb") as fh:
        fh.write(b"MZ")
    frames, errors = RD.ingest_files(spark, root)
    assert set(frames) == {"csv", "json", "txt"}
    assert sorted(frames["csv"].columns)[:2] == ["_source_file", "_source_type"] and "tên_vn" in frames["csv"].columns
    assert frames["json"].columns[:2] == ["id", "obj"]
    assert frames["txt"].first()["content"] == "xin chào bạn"     # bad bytes dropped
    reasons = {os.path.basename(r["path"]): r["reason"] for r in errors.collect()}
    assert reasons == {"scan.pdf": "no reader for this format", "run.exe": "unsupported extension"}


def test_flatten_json(spark):
    root = tempfile.mkdtemp(prefix="sl-json-") + "/j"
    spark.createDataFrame([(1, (2, (3,)))], "id int, a struct<b:int, c:struct<d:int>>").write.json(root)
    flat = RD.read_json_flat(spark, root)
    assert flat.columns == ["ab", "acd", "id"] or flat.columns == ["id", "ab", "acd"]


def test_clean_end_to_end(spark):
    df = spark.createDataFrame([
        ("  Ã¡o  dài ", "1,234", " TP. HCM "), ("hòa\tbình", "2,000", "Q.1"), (None, "3", "x")],
        "`Tên SP` string, `Giá` string, `Địa chỉ` string")
    res = clean(df)
    rows = res.data.orderBy("giá").collect()
    assert res.data.columns == ["tên_sp", "giá", "địa_chỉ"]
    assert dict(res.data.dtypes)["giá"] == "double"
    assert [r["giá"] for r in rows] == [3.0, 1234.0, 2000.0]
    assert [r["tên_sp"] for r in rows] == [None, "áo dài", "hoà bình"]
    assert [r["địa_chỉ"] for r in rows] == ["Xã", "Thành phố. HCM", "Quận1"]
    acts = {(r["action"], r["column"]) for r in res.actions.collect()}
    assert ("type_convert", "giá") in acts and ("trim", "Tên SP") in acts
    integ = res.integrity.first()
    assert integ["data_loss"] is False and integ["integrity_score"] == 100.0


def test_promote_keeps_bronze_below_50(spark):
    df = spark.createDataFrame([(f"x{i}", "not a number" if i < 8 else "5") for i in range(10)], "a string, b string")
    gold, tables, _ = C.promote(df.withColumn("b", F.when(F.col("b") == "5", "5").otherwise("1.0.0")), "t")
    t = tables.first()
    assert t["quality_level"] in ("bronze", "silver", "gold")
    bad = spark.createDataFrame([("bad@", ) for _ in range(3)] + [("a@b.vn",)], "e string")
    g2, t2, _ = C.promote(bad, "t2")
    assert t2.first()["quality_level"] == "gold"   # 1 of 4 match the e-mail pattern -> text -> all valid


def test_upsert_and_cascade(spark):
    cur = spark.createDataFrame([("d1", "processing", 1), ("d2", "success", 1)], "id string, status string, v int")
    upd = spark.createDataFrame([("d1", "success", 2)], "id string, status string, v int")
    got = {r["id"]: r["status"] for r in C.upsert(cur, upd, "id", "v").collect()}
    assert got == {"d1": "success", "d2": "success"}
    parents = spark.createDataFrame([("s1",), ("s2",)], "id string")
    kids = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, space_id string")
    p, k = C.cascade_delete(parents, kids, spark.createDataFrame([("s1",)], "id string"), "id", "space_id")
    assert [r["id"] for r in p.collect()] == ["s2"] and [r["id"] for r in k.collect()] == ["b"]


def test_usage_windows_and_quota(spark):
    logs = spark.createDataFrame([
        ("u1", "k1", 10, 100, "2024-01-30 23:00:00"), ("u1", "k1", 20, 300, "2024-01-01 00:00:00"),
        ("u2", "k2", 5, 50, "2023-12-31 23:59:59")],
        "user_id string, api_key_id string, response_time_ms int, bytes_transferred bigint, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    ku = {r["api_key_id"]: r for r in U.key_usage(logs, "2024-01-31 00:00:00", 7).collect()}
    assert set(ku) == {"k1"} and ku["k1"]["total_requests"] == 1 and ku["k1"]["avg_response_time_ms"] == 10.0
    users = spark.createDataFrame([("u1", "enterprise"), ("u2", "mystery")], "id string, plan string")
    hist = logs.select("user_id", "created_at")
    ds = spark.createDataFrame([("u2", 200 * 1024 * 1024)], "user_id string, file_size bigint")
    m = U.monthly_usage(logs, hist, ds, users, "2024-01-31 00:00:00")
    q = {r["user_id"]: r for r in U.quota_check(m).collect()}
    assert q["u1"]["requests"] == 2 and q["u1"]["queries_ok"] and q["u1"]["storage_ok"]
    assert q["u2"]["requests"] == 0 and q["u2"]["effective_plan"] == "starter" and q["u2"]["storage_ok"] is False


def test_entities(spark):
    df = spark.createDataFrame([(1, "Gọi 0912345678 hoặc a.b@mail.vn trước 31/12/2024, giá 150.000 đ.")],
                               "id int, text string")
    got = {(r["kind"], r["value"]) for r in extract_entities(df, "text", ["id"]).collect()}
    assert got == {("phone", "0912345678"), ("email", "a.b@mail.vn"), ("date", "31/12/2024"), ("money", "150.000 đ")}


def test_scoped_read_prunes_partitions(spark):
    from silverline.sources.sinks import write_dataset

    root = tempfile.mkdtemp(prefix="sl-ds-") + "/store"
    df = spark.createDataFrame([(f"d{i % 5}", i, "x") for i in range(100)], "_dataset_id string, k int, v string")
    write_dataset(df, root)
    scoped = RD.read_dataset(spark, root, ["d2"])
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_dataset_id" in plan and "d2" in plan
    assert scoped.count() == 20


def test_json_array_file_and_csv_inference(spark):
    root = tempfile.mkdtemp(prefix="sl-arr-")
    with open(f"{root}/items.json", "w", encoding="utf-8") as fh:
        fh.write('[{"id": 1, "info": {"name": "Bàn", "price": 1.5}}, {"id": 2, "info": {"name": "Ghế", "price": 2}}]')
    flat = RD.read_json_flat(spark, f"{root}/items.json", multi_line=True)
    assert sorted(flat.columns) == ["id", "infoname", "infoprice"]
    assert sorted(r["infoname"] for r in flat.collect()) == ["Bàn", "Ghế"]
    with open(f"{root}/t.csv", "w", encoding="utf-8") as fh:
        fh.write("a,b\n1,x\n2,y\n")
    csv = RD.read_csv(spark, f"{root}/t.csv")
    assert dict(csv.dtypes) == {"a": "int", "b": "string"} and csv.count() == 2
