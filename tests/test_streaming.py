import datetime as dt
import tempfile


from silverline.streaming import jobs as J

LOG_SCHEMA = "id bigint, user_id string, api_key_id string, bytes_transferred bigint, created_at timestamp_ntz"


def _ts(h, m):
    return dt.datetime(2024, 1, 1, h, m, 0)


def test_late_rows_are_dropped_past_the_watermark(spark):
    base = tempfile.mkdtemp(prefix="sl-stream-")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    # Spark drops input rows older than the PREVIOUS batch's watermark, so the late row
    # arrives in the third batch (the second batch moves the watermark to 10:35)
    first = [(i, "u1", "k1", 10, _ts(10, i)) for i in range(30)]
    second = [(100, "u1", "k1", 10, _ts(10, 45))]
    third = [(101, "u1", "k1", 10, _ts(9, 0)), (102, "u1", "k1", 10, _ts(10, 50))]  # 09:00 is late
    spark.createDataFrame(first, LOG_SCHEMA).coalesce(1).write.parquet(src)
    spark.createDataFrame(second, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(third, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    keys = spark.createDataFrame([("k1", "u1")], "id string, user_id string")
    users = spark.createDataFrame([("u1", "pro")], "id string, plan string")
    J.rate_windows(spark, src, LOG_SCHEMA, keys, users, out, ckpt, max_files_per_trigger=1)
    final = J.latest_per_key(spark.read.parquet(out), ["api_key_id", "window_start"])
    rows = {r["window_start"]: r for r in final.collect()}
    assert _ts(9, 0) not in rows                      # the late row was dropped
    assert rows[_ts(10, 45)]["requests"] == 1 and rows[_ts(10, 5)]["limit"] == 100
    assert rows[_ts(10, 50)]["requests"] == 1 and len(rows) == 32


def test_ingest_numbers_continue_across_batches(spark):
    base = tempfile.mkdtemp(prefix="sl-ingest-")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    schema = "ds string, k bigint, text string"
    spark.createDataFrame([("a", 1, " x  y "), ("a", 2, "z"), ("a", 3, "Ã¡o")], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", 4, "w"), ("b", 1, "v\nv")], schema).coalesce(1).write.mode("append").parquet(src)
    J.incremental_ingest(spark, src, schema, out, ckpt, "ds", "k", ["text"], max_files_per_trigger=1)
    got = sorted((r["ds"], r["k"], r["_row_number"], r["text"]) for r in J.read_ingested(spark, out).collect())
    assert got == [("a", 1, 1, "x y"), ("a", 2, 2, "z"), ("a", 3, 3, "áo"), ("a", 4, 4, "w"), ("b", 1, 1, "v v")]


def test_feeds_keep_every_row(spark, tmp_path, monkeypatch):
    import datetime as dt

    from silverline.plans import queries_streaming as Q

    ids = [None, -5, 0, 1, 2, 3, 2**40]
    docs = spark.createDataFrame([("s" if i else None, i, f"t{i}", None) for i in ids], "source string, doc_id long, text string, lang string")
    monkeypatch.setattr(Q, "read_table", lambda *a: docs)
    assert {r["doc_id"] for r in Q.q_stream_ingest(spark, "").collect()} == set(ids)
    assert {r["dataset_id"] for r in Q.q_stream_status(spark, "").collect()} == {"s", None}
    times = [None, dt.datetime(1969, 1, 1), dt.datetime(2024, 1, 15), dt.datetime(2150, 1, 1)]
    logs = spark.createDataFrame([(i, t, 10) for i, t in enumerate(times)], "api_key_id long, created_at timestamp_ntz, bytes_transferred long")
    monkeypatch.setattr(Q, "derived", lambda *a: logs)
    assert {r["api_key_id"] for r in Q.q_stream_daily(spark, "").collect()} == {0, 1, 2, 3}
    Q._write_day_chunks(logs, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 4


def _ingest_dir(spark, name):
    base = tempfile.mkdtemp(prefix=f"sl-{name}-")
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"


def test_broken_files_and_records_are_set_aside_and_the_stream_goes_on(spark):
    import os

    from pyspark.sql import functions as F

    src, out, ckpt = _ingest_dir(spark, "quarantine")
    os.makedirs(src)
    texts = {"1.json": '{"ds": 1, "k": 1, "body": " b  y "}\n{"ds": 1, "k": 2, "body": "Ã¡o"}\n', "2.json": '{"ds": 1, "k": 3, "body": null}\nnot json\n{"ds": null, "k": 9, "body": "n"}\n',
             "3.json": '{"ds": 1, "k": 4, "body": "hòa"}\n'}
    for i, (name, text) in enumerate(texts.items()):
        with open(f"{src}/{name}", "w", encoding="utf-8") as fh:
            fh.write(text)
        os.utime(f"{src}/{name}", (1_700_000_000 + 100 * i,) * 2)
    os.symlink(f"{src}/3.json", f"{src}/other.txt")  # not picked up
    schema = "ds int, k bigint, body string"
    job = J.FileIngest(spark, out, schema, F.col("ds"), ["k"], J.provenance_transform("json", "2024-01-01", "body"), fmt="json")
    J.ingest_stream(job, src, ckpt, 1, glob="*.json")
    rows = sorted((r["k"], r["_row_number"], r["body"], r["_source_type"], r["_batch_id"], r["_source_file"][-6:]) for r in J.read_ingested(spark, out).collect())
    assert rows == [(1, 1, "b y", "json", 0, "1.json"), (2, 2, "áo", "json", 0, "1.json"), (3, 3, None, "json", 1, "2.json"), (4, 4, "hoà", "json", 2, "3.json"),
                    (9, 1, "n", "json", 1, "2.json")]
    errors = spark.read.parquet(out + "_errors").collect()
    assert [(r["record"], r["reason"], r["path"][-6:]) for r in errors] == [("not json", "malformed record", "2.json")]
    # a batch that runs again changes nothing
    before = [sorted(map(str, spark.read.parquet(out + x).collect())) for x in ("", "_errors", "_files", "_status", "_totals")]
    job(spark.createDataFrame([(f"file:{src}/2.json",)], "path string"), 1)
    assert before == [sorted(map(str, spark.read.parquet(out + x).collect())) for x in ("", "_errors", "_files", "_status", "_totals")]


def test_a_fault_that_is_not_a_files_own_stops_the_batch(spark):
    import pytest
    from pyspark.sql import functions as F

    src, out, _ = _ingest_dir(spark, "fault")
    spark.createDataFrame([("a", 1)], "ds string, k bigint").coalesce(1).write.parquet(src)
    path = spark.read.parquet(src).inputFiles()[0]

    def broken(rows):
        raise ValueError("no such rule")

    job = J.FileIngest(spark, out, "ds string, k bigint", F.col("ds"), ["k"], broken)
    with pytest.raises(ValueError):
        job(spark.createDataFrame([(path,)], "path string"), 0)
    assert [r["status"] for r in J.file_status(spark, out).collect()] == ["processing"]
    with open(f"{src}/bad.parquet", "w") as fh:
        fh.write("no parquet")
    J.FileIngest(spark, out, "ds string, k bigint", F.col("ds"), ["k"])(spark.createDataFrame([(path,), (f"file:{src}/bad.parquet",)], "path string"), 0)
    assert {r["path"][-11:]: r["status"] for r in J.file_status(spark, out).collect() if r["status"] == "error"} == {"bad.parquet": "error"}
    assert J.read_ingested(spark, out).count() == 1


def test_daily_counters_keep_no_state_of_finished_days(spark):
    import os

    src, out, ckpt = _ingest_dir(spark, "daily")
    days = 12
    late = (900, "u", "k1", 7, dt.datetime(2024, 1, 1, 9))  # a finished day by then: dropped
    for d in range(days):
        rows = [(i, "u", f"k{i % 3}", 10, dt.datetime(2024, 1, 1 + d, i)) for i in range(9)] + [(99, "u", "k1", None, None)]
        rows += [(50, "u", "k2", 5, dt.datetime(2024, 1, d, 23))] if d else []  # of the day before: counted
        spark.createDataFrame(rows + ([late] if d == 9 else []), LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.startswith("part-") and not f.startswith(f"part-{d}") and os.path.getmtime(f"{src}/{f}") > 1_800_000_000:
                os.utime(f"{src}/{f}", (1_700_000_000 + 100 * d,) * 2)
    q = J.daily_counters(spark, src, LOG_SCHEMA, out, ckpt, max_files_per_trigger=1)
    state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert len(state) >= days and max(state[4:]) <= 13 and max(state[4:]) == max(state[4:8])  # flat: few days, not all
    got = {(r["api_key_id"], r["date"]): (r["requests"], r["bytes"]) for r in J.daily_totals(spark, out).collect()}
    want = {(f"k{k}", dt.date(2024, 1, 1 + d)): (3 + (k == 2 and d < days - 1), 30 + 5 * (k == 2 and d < days - 1)) for k in range(3) for d in range(days)}
    want["k1", None] = (days, None)
    assert got == want and J.daily_totals(spark, out).count() == len(want)
    finished = spark.read.parquet(out).where("_finished = 1").groupBy("api_key_id", "date").count()
    assert finished.where("count > 1").count() == 0
