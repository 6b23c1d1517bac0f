
from silverline.operators.context import context_parts, pack_context
from silverline.operators.routing import classify_intent, route
from silverline.operators.search import context_hints, provenance_search


def _intent(spark, q):
    df = spark.createDataFrame([(q,)], "question string")
    r = classify_intent(df, "question").first()
    return r["intent"], r["confidence"]


def test_intents(spark):
    assert _intent(spark, "Xin chào") == ("general", 0.5)
    assert _intent(spark, "Liệt kê danh sách") == ("list", 0.7)
    assert _intent(spark, "tìm địa chỉ email") == ("lookup", 0.8)
    assert _intent(spark, "tổng") == ("aggregate", 0.6)
    assert _intent(spark, "account")[0] == "aggregate"       # substring "count"
    assert _intent(spark, "admin")[0] == "aggregate"         # substring "min"
    assert _intent(spark, "tổng cộng bao nhiêu") == ("numeric", 0.7)  # numeric 2 beats aggregate 1
    assert _intent(spark, "thống kê số liệu con số giá trị chi phí 5")[1] == 0.9  # capped


def test_route(spark):
    q = spark.createDataFrame([("s0", "tổng là bao nhiêu"), ("s9", "tổng là bao nhiêu"),
                               ("s9", "liệt kê tài liệu"), ("s0", "xin chào")], "space_id string, question string")
    gold = spark.createDataFrame([("s0", "t1")], "space_id string, id string")
    got = [r["route"] for r in route(q, gold).orderBy("space_id", "question").collect()]
    assert sorted(got) == sorted(["sql", "ai", "ai", "list_documents"])


def test_context_budgets(spark):
    def budget(n):
        docs = spark.createDataFrame([("s", f"f{i}", "x" * 9000) for i in range(n)], "space string, name string, text string")
        ctx = pack_context(docs, "space", "name", "text", max_chars=8000, total_chars=50000).first()
        return ctx["files"], len(ctx["context"].split("\n\n")[0].split("\n", 1)[1])

    assert budget(1) == (1, 8000)
    assert budget(6) == (6, 8000)
    assert budget(7) == (7, 7142)


def test_context_parts_keep_whole_texts(spark):
    rows = [("hot", i, f"doc_{i}", None if i == 7 else f"é{i} " * (i % 50)) for i in range(900)]
    rows += [(None, 1, "n", "x" * 1000), ("one", None, None, "no name"), ("one", 5, "a", "b"), ("one", 5, "a", "a")]
    docs = spark.createDataFrame(rows, "space string, o long, name string, text string").repartition(5)
    got = {}
    for r in context_parts(docs, "space", "name", "text", "o", 100).collect():
        got.setdefault(r["space"], []).append((r["part"], r["context"], r["files"], r["file_list"]))
    want = {"hot": "\n\n".join(f"=== {n} ===\n{t or ''}" for _, _, n, t in rows[:900]), None: "=== n ===\n" + "x" * 1000}
    want["one"] = "\n\n".join(["===  ===\nno name", "=== a ===\na", "=== a ===\nb"])
    assert set(got) == set(want)
    for space, parts in got.items():
        parts.sort()
        assert [p for p, *_ in parts] == list(range(1, len(parts) + 1)) and "".join(c for _, c, _, _ in parts) == want[space]
        assert all(len(c) == 100 for _, c, _, _ in parts[:-1]) and {f for _, _, f, _ in parts} == {sum(r[0] == space for r in rows)}
    assert got[None][3][3] == "• n"
    assert context_parts(docs.limit(0), "space", "name", "text", "o", 100).count() == 0


def test_search_hints(spark):
    df = spark.createDataFrame([(1, "Công ty X, 1 Lê Lợi", "a.pdf"), (2, "Công ty X, 9 Hai Bà", "b.pdf"),
                                (3, "khác", "a.pdf"), (4, "_Công ty X", "c.pdf")],
                               "id int, content string, _source_file string")
    hits = provenance_search(df, "công ty x")
    h = context_hints(hits, "công ty x").first()
    assert h["total_matches"] == 3 and h["total_files_matched"] == 3
    assert h["hints"] == ["multiple_sources", "multiple_matches"]
    one = context_hints(provenance_search(df, "9 hai"), "9 hai").first()
    assert one["hints"] == []
