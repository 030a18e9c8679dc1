"""Top-k, URL templates, preference pairs and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from codeledger.llm import fertility, language, minhash, preference, topk, url_templates
from codeledger.llm.queries import PIECES, QUERIES
from codeledger.llm.sql import ORACLES, URL_TEMPLATES


@pytest.mark.parametrize("key", ORACLES)
def test_query_against_sql(spark, sf_dir, duck, key):
    frame, checked = QUERIES[key](spark, sf_dir), duck.execute(ORACLES[key])
    names = [column[0] for column in checked.description]
    assert sorted(frame.columns) == sorted(names)
    got = sorted(map(tuple, frame.select(*names).collect()), key=repr)
    assert got == sorted(checked.fetchall(), key=repr) and got


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(key[2:].split("_")[0]) for key in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("scale", [1.0, 2.0**16])
def test_top_k_with_ties_nulls_and_large_numbers(spark, monkeypatch, scale):
    for name, value in {"BLOCK": 4, "RUN": 3, "CHUNK": 5, "PIVOTS": 4}.items():
        monkeypatch.setattr(topk, name, value)
    made = np.random.default_rng(4)
    vectors = [(k, [float(x) * scale for x in made.integers(-3, 4, 6)]) for k in range(200)]
    bad = [(None, [1.0] * 6), (300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] + [0.0] * 5), (600, [float("inf")] + [0.0] * 5)]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS floor", "3 AS rank").repartition(3)
    ints = topk.integers(frame)
    got = {(row.query_id, row.rank): (row.vec_id, row.score) for row in topk.top_k(ints, ints.filter("vec_id % 20 = 0"), 10).collect()}
    exact = {k: [int(np.floor(1024 * x)) for x in v] for k, v in vectors}
    expected = {}
    for q in range(0, 200, 20):
        scores = sorted((-sum(a * b for a, b in zip(exact[q], exact[k], strict=True)), k) for k in exact if k != q)
        expected |= {(q, rank): (k, -score) for rank, (score, k) in enumerate(scores[:10], 1)}
    assert got == expected


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (7, [0.5])], "vec_id long, embedding array<float>")
    ints = topk.integers(frame)
    assert sorted(map(tuple, topk.top_k(ints, ints.filter("vec_id % 100 = 0"), 10).collect())) == [(0, 1, 100, 2097152), (0, 2, 7, 524288), (100, 1, 0, 2097152), (100, 2, 7, 1048576)]
    assert topk.top_k(ints.limit(0), ints.limit(0), 10).count() == 0


def test_pruning_skips_blocks():
    """A bound never lies below a score of its block."""
    made = np.random.default_rng(9)
    ids, vectors = np.arange(1000), made.integers(-50, 51, (1000, 8))
    found = list(topk.search_run(np.array([-1]), vectors[:1], np.array([float("-inf")]), ids, vectors, 5))
    order = np.lexsort((ids, -(vectors @ vectors[0])))[:5]
    assert found[0][1].tolist() == order.tolist()


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "http://a.example.net/de/1", "https://X.example.COM/de/7?x", "http://q.org/fr/", "http://spam.io/win/12", None, "no scheme", "http://badexample.net/en/", "://h", "http://h.net", "http://é.com/a/b/c/d/e.html#x"]
    pages = spark.createDataFrame([(k, url) for k, url in enumerate(urls)] + [(20 + k, f"http://spam.io/win/{k}.html") for k in range(60)] + [(100 + k, f"http://spam.io/ok/{k}") for k in range(60)], "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS parts", "1 AS bad")
    labels = spark.createDataFrame([(20 + k, True) for k in range(60)] + [(100 + k, False) for k in range(60)] + [(None, True)], "page_id long, bad boolean")
    got = {row.page_id: row for row in url_templates.judge(pages, labels).collect()}
    assert [(got[k].rule, got[k].verdict) for k in range(4)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[2].host, got[2].path) == ("x.example.com", "/de/7")
    assert (got[4].template, got[4].verdict) == ("spam.io/win/*", "block") and (got[100].template, got[100].verdict) == ("spam.io/ok/*", "allow")
    assert (got[5].host, got[5].path, got[5].verdict) == (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow")
    assert got[7].rule == "net/" and got[8].host == "h" and got[9].rule is None and (got[10].host, got[10].path) == ("é.com", "/a/b/c/d/e.html")
    assert len(got) == pages.count() and url_templates.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_preference_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "x"), (2, "rejected", 0, "user", "x"), (3, "chosen", 0, None, None), (None, "rejected", 0, "assistant", ""), (1, "other", 0, "user", "no"),
    ]
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "'x' AS prompt")
    got = {row.pair_id: row for row in preference.preference_pairs(frame).collect()}
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[1].prefix_turns == 1
    assert [tuple(piece) for piece in got[1].chosen_pieces] == [("<|im_start|>assistant\n", False), ("good<|im_end|>\n", True)]
    assert (got[1].rejected_text, got[1].rejected_trained) == ("<|im_start|>assistant\nbad<|im_end|>\n", len("bad<|im_end|>\n"))
    assert (got[2].prefix_turns, got[2].chosen_text, got[2].rejected_text) == (1, "", "") and got[3].rejected_text == "" and got[None].rejected_trained == len("<|im_end|>\n")
    assert set(got) == {1, 2, 3, None} and preference.preference_pairs(frame.limit(0)).count() == 0


def test_reply_pairs(spark):
    rows = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (1, 0, "assistant", "z"), (1, 0, "assistant", None), (2, 0, "user", "x"), (3, None, "assistant", "n"),
        (3, 2, "assistant", "m"), (None, 0, "assistant", "q"), (None, 1, None, None), (-1, 0, "user", "k"), (-1, 1, "assistant", "l"), (-2, 4, "assistant", "o"), (5, None, "assistant", "w"), (4, 1, "assistant", "v"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS couple", "'x' AS chosen")
    key = lambda turn: (turn[0] is not None, turn[0] or 0, *turn[1:])
    turns = {conv: sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=key) for conv in {row[0] for row in rows}}
    last = {conv: max((t for t, role, _ in told if role == "assistant" and t is not None), default=None) for conv, told in turns.items()}
    expected = {}
    for conv, told in turns.items():
        replies = [x for x in turns.get(conv ^ 1, []) if x[1] == "assistant" and x[0] is not None and x[0] == last[conv ^ 1]] if conv is not None and any(x[1] == "assistant" for x in told) else []
        before = [x for x in told if conv is not None and None not in (x[0], last[conv]) and x[0] < last[conv]]
        expected[conv] = told, before + [(last[conv], *x[1:]) for x in replies]
    got = preference.reply_pairs(frame)
    assert {row.pair_id: tuple([tuple(turn) for turn in side] for side in (row.chosen, row.rejected)) for row in got.collect()} == expected
    assert preference.completions(got).count() == len(expected) and preference.reply_pairs(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir, documents):
    docs = documents.limit(120)
    kept = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and kept.count() == language.predict(docs, language.fit(docs)).filter("lang_pred <> 'und'").count()
    good = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert {row.doc_id for row in good.collect()} == {row.doc_id for row in fertility.judge(docs, PIECES).filter("kept").collect()}
    one = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    expected = minhash.near_duplicates(docs, minhash.Likeness(words=5, percent=80)).filter("doc_id = component_id")
    assert {row.doc_id for row in one.collect()} == {row.doc_id for row in expected.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]


def test_pipeline_takes_odd_rows(spark, sf_dir, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:3]:
            assert tuple(stage(spark, docs, sf_dir).columns) == corpus_pipeline.COLUMNS
    assert corpus_pipeline.one_of_each(spark, odd_documents, sf_dir).count() > 0


def test_language_stage_rejects_what_no_language_is(spark, sf_dir, documents):
    made = np.random.default_rng(5)
    letters = lambda n: " ".join("".join(made.choice(list("abcdefghijklmnopqrstuvwxyz"), int(made.integers(2, 10)))) for _ in range(n))
    markup = " ".join(made.choice(["<div class='row'>", "</div>", "<span id=x>", "<td>", "</td>", "<br/>", "href='#'"], 300).tolist())
    junk = [letters(100), letters(1000), markup, "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью", "123 !!", None]
    planted = spark.createDataFrame([(10**9 + 4 * k, text, None, "s", 1) for k, text in enumerate(junk)], documents.schema)
    kept = {row.doc_id for row in corpus_pipeline.known_language(spark, documents.unionByName(planted), sf_dir).collect()}
    assert not kept & {10**9 + 4 * k for k in range(len(junk))}
    clean = {row.doc_id for row in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()} & {row.doc_id for row in documents.filter(language.held_out() & (F.length("text") >= 200)).collect()}
    assert clean and clean <= kept


def test_stages_decide_by_row(spark, sf_dir, documents):
    text = documents.filter("lang = 'en' AND length(text) BETWEEN 600 AND 3000").orderBy("doc_id").first().text
    other = " ".join(reversed(text.split()))
    rows = [(7, text), (7, text), (7, "!! 12"), (8, text), (None, text + " end"), (None, other), (None, other), (9, ""), (9, None), (6, other + " x")]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], documents.schema).repartition(3)
    one = sorted(((row.doc_id, row.text) for row in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()), key=str)
    assert one == sorted([(7, text), (7, "!! 12"), (6, other + " x"), (9, ""), (9, None)], key=str)
    good = [(row.doc_id, row.text) for row in corpus_pipeline.good_quality(spark, docs, sf_dir).collect()]
    assert len(good) == 7 and (7, "!! 12") not in good
    known = [row.text for row in corpus_pipeline.known_language(spark, documents.unionByName(docs), sf_dir).collect()]
    assert "!! 12" not in known and "" not in known


def test_url_templates_of_deep_paths_and_few_labels(spark):
    deep = "/".join("x" * (k + 1) for k in range(40))
    rows = [(k, f"http://h.io/en/2021/05/spam-shop/p{k}") for k in range(12)] + [(100 + k, f"http://h.io/en/2021/05/news/p{k}") for k in range(12)] + [(200, f"http://long.io/{deep}")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k < 100) for k, _ in rows], "page_id long, bad boolean")
    got = {row.page_id: row for row in url_templates.judge(pages, labels).collect()}
    assert {(got[k].template, got[k].verdict) for k in range(12)} == {("h.io/en/*/*/spam-shop/*", "block")}
    assert {(got[100 + k].template, got[100 + k].verdict) for k in range(12)} == {("h.io/en/*/*/news/*", "allow")}
    assert got[200].template == f"long.io/{deep}" and len(got) == len(rows)


def test_deep_paths_against_the_checking_sql(spark, tmp_path):
    """Paths of up to nine segments that part and end at every level, bad sections deep down, labels for some, hosts and paths missing."""
    made, urls = np.random.default_rng(5), []
    for k in range(1500):
        depth = int(made.integers(1, 9))
        parts = ["news", *(str(made.choice(["a", "b", "spam", f"p{int(made.integers(60))}"], p=[0.4, 0.3, 0.2, 0.1])) for _ in range(depth))]
        urls.append(f"http://{['one.b', 'two.b', 'x.example.com'][k % 3]}/{'/'.join(parts)}/{k}.html")
    # One section, bad throughout, six segments down; paths that end inside of others; none at all.
    urls += [f"http://three.b/w/x/y/z/{'bad' if k % 2 else 'good'}/more/{k + 1500}" for k in range(60)] + ["http://four.b" + "/s" * k for k in range(40)] + ["http://four.b", "http://five.b//", "", "none", None, None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(k, int(not ("spam" in url if k < 1500 else "/bad/" in url)), 0) for k, url in enumerate(urls[:1560]) if k % 3 or k >= 1500]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    checked = connection.execute(URL_TEMPLATES)
    names = [column[0] for column in checked.description]
    found = QUERIES["op7_url_templates"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(checked.fetchall(), key=repr) and len(found) == len(urls)
    # Each side of the deep section is judged for itself.
    assert {(row.path.split("/")[5], row.verdict) for row in found if row.host == "three.b"} == {("bad", "block"), ("good", "allow")}


def test_long_shared_paths_make_no_long_walk(spark, monkeypatch):
    walked = []
    keep = url_templates.stored
    monkeypatch.setattr(url_templates, "stored", lambda *given: walked.append(1) or keep(*given))
    shared = "http://a.b" + "/s" * 1000
    urls = [f"{shared}/one/x", f"{shared}/two/y", *("http://trap.b" + "/loop" * k for k in range(50, 1001, 50))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {row.page_id: row.template for row in url_templates.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    assert rows[0] == rows[1] == "a.b" + "/s" * 1000 + "/*/*" and rows[21] == "trap.b" + "/loop" * 1000
    assert len(walked) <= 5
