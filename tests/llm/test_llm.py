"""Numbered operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import html as markup
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverline.llm import chat, decontaminate, langid, mixing, neighbours, ngram_join, page_text, quality, tokens, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OP1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, texts, extra=""):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, "x") for r in rows] if extra else rows, DOCS + extra)


def prose(rng, n, vocabulary=300):
    return " ".join(f"Wörd{rng.integers(vocabulary)}" for _ in range(n))


# ---- word scanning

def test_words_and_windows_match_plain_python():
    texts = ["", "a", "  A  b ", "é" * 5, "x" * 40, "one two\tthree\nfour\x0bfive six", "9Z9 _ \x7f ß"]
    long = " ".join(f"w{i}" for i in range(400_000))  # several pieces
    for table, split in ((words.NONSPACE, re.compile(r"[^\x20\x09-\x0D]+")), (words.ALNUM, OP1)):
        got = [[b.word(i).decode() for i in range(len(b.hashes))] for b in words.blocks([t.encode() for t in [*texts, long]], table)]
        assert sum(got, []) == [w for t in [*texts, long] for w in split.findall(lower(t))]
    h = np.concatenate([b.hashes for b in words.blocks([long.encode(), b"w1 w1"], words.NONSPACE)])
    assert len(set(h.tolist())) == 400_000 and h[-1] == h[-2] == h[1]


# ---- 1

def brute_contamination(docs, items):
    grams = {}
    for item, text in items:
        w = OP1.findall(lower(text))
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = OP1.findall(lower(text)), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[tuple(w[i:i + size])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [10**6, 7])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = np.random.default_rng(1)
    item = prose(rng, 25)
    items = [(1, item), (2, "Short One"), (3, None), (4, ""), (10, "?!"), (5, item), (None, "nameless thing")]
    texts = [item.upper(), f"{prose(rng, 30)} {item[60:160]} tail", "short, ONE", "a nameless thing", None, "", "clean text", "short one" * 3,
             prose(rng, 3000) + " short one " + item, item]
    docs = docs_of(spark, texts, ", n_hit string").unionByName(docs_of(spark, texts[:1], ", n_hit string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, bench).collect())
    want = brute_contamination([*enumerate(texts), (0, texts[0])], items)
    assert got == want
    dirty = {r[0] for r in want if r[5]}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - dirty
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert set(cut) == set(range(len(texts))) and cut[6] == "clean text" and item not in (cut[8] or "") and cut[8].startswith(texts[8][:500])
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_spans_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    item = prose(rng, 25)
    texts = [f"Start, {item}! end", item, f"{item} mid {item[60:160]}", None, "", "clean text", "short one" * 3, f"Short {item} one", "ab short one"]
    docs = docs_of(spark, texts, ", Hits string")
    bench = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    got = {}
    for block in (10**6, 7, 2):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        cut = decontaminate.decontaminate(docs, bench, remove="spans")
        assert cut.schema == docs.schema
        got[block] = sorted((r["doc_id"], r["text"], r["Hits"]) for r in cut.collect())
    one = {i: t for i, t, _ in got[10**6]}
    assert not OP1.findall(lower(one[1])) and OP1.findall(lower(one[0])) == ["start", "end"] and one[3] is None and one[5] == "clean text"
    assert OP1.findall(lower(one[7])) == ["short", "one"]  # words that a cut joins are no hit
    assert got[7] == got[10**6] and got[2] == got[10**6]


# ---- 2

def test_mixing_counts_are_poisson_quantiles(spark):
    n = 400
    rows = [(i, None if i % 50 == 0 else f"t{i}", "en", ["big", "big", "small", None][i % 4], 1) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy_no", F.lit("clash"))
    weights = {"big": 1.0, "small": 5.0, None: 0.1}
    got = mixing.mix_sources(docs, weights, total=4000.0).groupBy("doc_id").agg(F.max("n_copies").alias("n"), F.count("*").alias("c")).collect()
    assert all(r["n"] == r["c"] for r in got)
    have = {r["doc_id"]: r["n"] for r in got}
    size = {s: sum(r[3] == s for r in rows) for s in weights}
    for i, _, _, s, _ in rows:
        rate = weights[s] / 6.1 * 4000 / size[s]
        pieces, want = max(1, int(np.ceil(rate / mixing.PIECE))), 0
        for p in range(1, pieces + 1):
            u, k = int(hashlib.md5(f"{mixing.SEED}:{p}:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0
            term = total = np.exp(-rate / pieces)
            while total <= u:
                k += 1
                term *= rate / pieces / k
                total += term
            want += k
        assert have.get(i, 0) == want
    assert mixing.mix_sources(docs, {"small": 1.0}).where("source <> 'small' or source is null").count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# ---- 3

@pytest.mark.parametrize("split", ["128m", "600"])
def test_warc_round_trip_rejects_magic_in_payloads(spark, split):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>a</p>", fake, fake + "x" + fake, None, "", "<p>a</p>", "é" * 300, "WARC/1.0\r\n", "<p>a</p>", "x\r\n\r\ny", fake]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r["page_id"]: r for r in warc.pages_through_warc(pages).collect()}
        back = warc.read_warc(spark, warc.write_warc(pages, f"{spark.conf.get('spark.checkpoint.dir')}/warc-test-{split}", min_bytes=10**6))
        assert {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect()} == {i: h or "" for i, h in enumerate(html)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == list(range(len(html)))
    for i, h in enumerate(html):
        data, first = (h or "").encode(), min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert warc.pages_through_warc(pages.limit(0)).count() == 0


# ---- 4

def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_jaccard_components_match_all_pairs(spark, hot):
    rng = np.random.default_rng(4)
    texts = [None, "", "  ", "one two", "One\ttwo", "one two three", "a b c d e", "A B C D E"]
    shared = prose(rng, 40)
    for _ in range(8):
        base = prose(rng, int(rng.integers(5, 120))).split()
        for _ in range(12):  # near copies with some words changed, chained over several thresholds
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 15))):
                w[k] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                base = w
    texts += [texts[20]] * 6 + [f"{prose(rng, 10)} {shared} {prose(rng, 8)}" for _ in range(15)] + [prose(rng, 6000, 5000)] * 2
    docs = docs_of(spark, texts, ", key string").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs, hot=hot, split=hot).collect())
    assert got == brute_components(texts)
    if hot > 3:
        kept = ngram_join.one_per_component(docs.unionByName(docs.where("doc_id in (3, 50)")))
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})
        assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


# ---- 5 and 9: held-out accuracy and defined cases

def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.where(fold != 1))
    got = langid.identify(model, docs.where(fold == 1)).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = docs_of(spark, [None, "", "123 !?", "the", "x" * 3_000_000 + " the and"], ", score string")
    pred = {r["doc_id"]: r for r in langid.identify(model, odd).collect()}
    assert [pred[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and pred[0]["score"] == 0 and pred[3]["lang_pred"] == "en"
    kept = langid.keep_identified(model, odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {3, 4}
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(none, odd).collect()} == {"und"}
    assert langid.identify(model, odd.limit(0)).count() == 0


def test_grams_stay_within_their_text():
    h, n = langid.grams(["ab", None, "ab cd", "1", "ab"], 1 << 15)
    assert n.tolist() == [2, 0, 4, 0, 2] and h[:2].tolist() == h[2:4].tolist() == h[6:].tolist()


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    ranker = quality.train(docs, labels.where(fold != 0).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)))
    got = quality.score(ranker, docs).join(labels.where(fold == 0), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    odd = docs_of(spark, [None, "", "x" * 2_000_000, " ", "LOUD!! LOUD!!"], ", predicted string")
    scores = {r["doc_id"]: r["score"] for r in quality.score(ranker, odd).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1]
    assert quality.keep_good(ranker, odd).columns == odd.columns
    blind = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(blind, odd).collect()} == {0.5}
    assert quality.score(ranker, odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [60, 10_000])
def test_quality_cut_covers_all_labels(spark, most):
    rng = np.random.default_rng(9)
    label = [int(i % 7 > 0) for i in range(1400)]
    texts = [prose(rng, 20) + "!" * rng.poisson(3 if q else 8) for q in label]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([*enumerate(label), (5, label[5])], "doc_id long, quality int")
    ranker = quality.train(docs.unionByName(docs.limit(3)), labels, most)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(ranker, docs).collect()}
    errors = sum(got[i][1] != q for i, q in enumerate(label))
    order = sorted((got[i][0], q) for i, q in enumerate(label))
    fewest = min(sum(q for _, q in order[:k]) + sum(1 - q for _, q in order[k:]) for k in range(len(order) + 1))
    assert fewest > 0 and errors <= fewest + 1  # rows within one step of the histogram are not told apart


# ---- 6

def test_main_text_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages.withColumn("host", F.lit(1))).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", markup.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_style_tree_removes_repeated_branches_and_keeps_the_rest(spark):
    def page(i, body):
        return (i, "http://a.org/x", f"<body><div class='wrap'><div class='claim'>Same on every page</div><div class='story'>{body}</div></div>")

    rows = [page(i, f"<p>story {i}<p>more &amp; more {i * i}") for i in range(8)] + [(90, None, None), (91, None, ""), (92, "u", "a < b <p>c")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract(pages).collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert len(got) == 12 and all(n == len(t) for _, t, n in got)
    assert texts[3] == "story 3\nmore & more 9" and texts[90] == texts[91] == "" and texts[92] == "a < b\nc"
    few = page_text.extract(pages.where("page_id < 3")).where("page_id = 1").first()["text"]
    assert few.startswith("Same on every page")  # too few pages to judge
    assert page_text.extract(pages.limit(0)).count() == 0


def test_style_tree_sees_all_elements_of_a_path(spark):
    rows = [(i, "http://a.org/x", f"<article><p class='body'>one {i}<p class='body'>two {i * i}<p class='body'>By the staff</article>") for i in range(8)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"one {i}\ntwo {i * i}\nBy the staff" for i in range(8)}


def test_copies_of_one_article_do_not_take_the_other_articles(spark):
    def page(i, story, claim="Same on every page"):
        return (i, "http://a.org/x", f"<body><script>track({i})</script><div class='claim'>{claim}</div><article class='post'><div class='story'>{story}</div></article>")

    # 45 of 60 pages are copies of one article; then pages that differ in a date, so that copies are distinct pages
    rows = [page(i, "the one article" if i < 45 else f"story {i}") for i in range(60)]
    rows += [(i, "http://b.org/x", f"<body><i>{i}</i><div class='story'>{'the one article' if i < 190 else f'story {i}'}</div>") for i in range(100, 200)]
    rows += [(i, "http://c.org/x", page(i, f"story {i}", "Odd one" if i == 307 else "Same")[2].replace("article", "section")) for i in range(300, 340)]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(60)} == {i: "the one article" if i < 45 else f"story {i}" for i in range(60)}
    assert {i: got[i] for i in range(190, 200)} == {i: f"{i}\nstory {i}" for i in range(190, 200)}
    assert {i: got[i] for i in range(300, 340)} == {i: f"{'Odd one' + chr(10) if i == 307 else ''}story {i}" for i in range(300, 340)}


def test_marked_elements_go():
    source = ("<header>top</header><form>f</form><aside>s</aside><div id='cookie-notice'>c</div><main><h1>T</h1><article><p>a <i>b</i>\n c<br>d"
              "<ul><li>one<li>two</ul><div class='ad'>x</div><section class='comments'><article>no</article></section><script>if(a<b)'</p>'</script>"
              "<p class='lead'>end</article></main><footer>z")
    assert page_text.Page(source).text() == "a b c d\none\ntwo\nend"


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){f(i)}", "x = '<!-- ';", "<!-- f(a<b)", "'</scripts>' <p title=\"", "if(a<b){s='</p>'}"])
@pytest.mark.parametrize("tag", ["script", "STYLE", "textarea"])
def test_raw_elements_end_at_their_own_closing_tag(script, tag):
    source = f"<body><{tag}>{script}</{tag.swapcase()} ><article><p>a<{tag}>{script}</{tag}> b<p>c<i>d</i></article><footer>z"
    assert page_text.Page(source).text() == "a\nb\ncd"
    assert page_text.Page(f"<article><p>a</article><{tag}>{script}<p>never closed").text() == "a"


# ---- 7

def test_conversations_survive_control_strings(spark):
    nasty = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\|im_end|> \\ <"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty + "\n"), (1, 1, "assistant", "tie"), (2, 5, None, None), (3, 0, "a\n<|b\\n", "é|"),
            (None, 0, "assistant", "lost"), (1, 2, "user", nasty), (1, 2, "user", nasty)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(0))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.turns_as_tree(talks))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        want = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in want]
        assert list(r["loss_texts"]) == [b for _, a, b in want if a == "assistant"]
        assert r["formatted"].count(chat.STOP) == len(want)
    assert chat.format_trees(chat.turns_as_tree(talks.limit(0))).count() == 0


def test_reply_trees_rank_their_branches(spark):
    parent = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 6, 8: 7, 9: 77}
    score = {1: 0.0, 2: 1.0, 3: 0.5, 4: 9.0, 5: None, 6: 9.0, 7: 9.0, 8: 1.0, 9: 0.0}
    rows = [(1, "t", n, p, "user", f"m{n}", score[n]) for n, p in parent.items()]
    messages = spark.createDataFrame(rows, "conv_id long, tree string, node long, parent long, role string, text string, score double")

    def path(n):
        return [*path(parent[n]), n] if parent.get(n) in parent else [n]

    want = {leaf: path(leaf) for leaf in (4, 5, 8, 9)}
    mean = {leaf: sum(score[n] or 0 for n in p) / len(p) for leaf, p in want.items()}
    got = chat.read_back(chat.format_trees(messages)).collect()
    assert {r["leaf"]: [int(t["text"][1:]) for t in r["turns"]] for r in got} == want
    assert [r["leaf"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda x: (-mean[x], x))
    assert chat.format_trees(messages, top=1).count() == 1


# ---- 8

@pytest.mark.parametrize("block", [4 << 20, 10])
def test_separator_scan_counts_tokens(spark, block):
    rng = np.random.default_rng(8)
    texts = [None, "", "a", prose(rng, 50), "", "<|endoftext|> in a text", "a"]
    docs = docs_of(spark, texts, ", file string").repartition(2)
    got = tokens.document_token_counts(docs, block=block).collect()
    enc = tokens._encoding(tokens.TOKENIZER)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(enc.encode_ordinary(t or "")) for t in texts)
    assert tokens.document_token_counts(docs.limit(0)).count() == 0


def test_separator_scan_of_an_unterminated_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(np.array([5, 6, 2, 2, 9], "<u4").tobytes())
    got = tokens.count_tokens(spark, str(tmp_path), eod=2, width=4, block=8).orderBy("doc_no").collect()
    assert [(r["start_token"], r["n_tokens"], r["terminated"]) for r in got] == [(0, 2, True), (3, 0, True), (4, 1, False)]


# ---- 10

@pytest.mark.parametrize("hot", [4096, 20])
def test_neighbours_recall_and_order(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(neighbours, "PART", 500)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    same = [float(x) for x in rows[3]["embedding"]]
    odd = [(9000 + i, same, 0) for i in range(60)] + [(9100, None, 0), (9101, [0.0] * 64, 0), (9102, [float("nan")] * 64, 0), (9103, [1.0], 0),
                                                       (None, same, 0), (9120, [None] * 64, 0), (9000, same, 0)]
    both = table.unionByName(spark.createDataFrame(odd, table.schema)).withColumn("score", F.lit("x"))
    got = neighbours.nearest(both, F.col("vec_id") % 20 == 0, hot=hot).collect()
    ids = np.array([r["vec_id"] for r in rows] + [9000 + i for i in range(60)])
    v = np.array([r["embedding"] for r in rows] + [same] * 60, float)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, out in found.items():
        s = v @ v[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        out.sort()
        assert [o[0] for o in out] == list(range(1, 21)) and all(abs(o[2] - s[ids == o[1]][0]) < 1e-12 for o in out)
        assert [(-o[2], o[1]) for o in out] == sorted((-o[2], o[1]) for o in out)
        hits += len({o[1] for o in out} & set(ids[best].tolist()))
    assert hits / (20 * len(found)) >= 0.9
    few = neighbours.nearest(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- pipeline

def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (None, "The 12 of the and that", None, None, 1)], docs.schema)
    docs = docs.unionByName(odd).withColumn("n_hit", F.lit("clash"))
    for name, stage in P.STAGES:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        got = stage(spark, docs, sf).persist()
        rows = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert rows <= before
        if name != "mixing":
            assert got.columns == docs.columns
        if name == "language":
            assert all(any(c.isalpha() for c in t or "") for _, t in rows) and len(rows) >= len(before) - 10
        if name == "near_duplicates":
            order = sorted((i, t) for i, t in before if i is not None)
            keep = {order[c] for _, _, c in brute_components([t for _, t in order])}
            assert {x for x in rows if x[0] is not None} == keep
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            clean = {r[0] for r in brute_contamination([x for x in before if x[0] is not None], items) if not r[5]}
            assert {i for i, _ in rows if i is not None} == clean
        docs = got
