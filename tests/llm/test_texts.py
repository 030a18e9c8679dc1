"""Quality rules, language, unigram pieces and extraction against plain versions."""

import html
import re
import zlib
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from codeledger.llm import fertility, language, unigram, wrapper
from codeledger.llm.queries import PIECES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(line in lines[:k] for k, line in enumerate(lines)), len(hit)


def expect_judged(rows, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in rows:
        text = texts[row.doc_id]
        counts = plain_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        ids = model.encode(" ".join(WORD.findall(text or "")))
        assert row.n_tokens == len(ids)
        if ids:
            part = np.array(list(Counter(ids).values())) / len(ids)
            assert row.chars_per_token == pytest.approx(counts[1] / len(ids))
            assert row.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
            assert row.token_entropy == pytest.approx(-(part * np.log2(part)).sum() / np.log2(len(ids)) if len(ids) > 1 else 1.0)
        own = None if row.base_failed else fertility.verdict(row.script, row.chars_per_token, row.byte_share, min(1, row.token_entropy), fertility.BANDS)
        assert row.reason in (("base",) if row.base_failed else (own,) if own else (None, "language")) and row.kept == (row.reason is None)


def plain_evidence(rows, texts, languages):
    """Of each text that scripts' bands keep, how far it lies from its like: medians and quartiles by sorting, copies counted once."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    groups, copies = {}, {}
    for row in rows:
        if row.reason in (None, "language"):
            ids = np.array(model.encode(" ".join(WORD.findall(texts[row.doc_id]))))
            key = groups[row.doc_id] = (languages[row.doc_id], row.script, int(np.log2(row.n_tokens)))
            copies.setdefault(key, {}).setdefault(fertility.vote(ids), []).append((row.n_tokens, row.chars_per_token, row.token_entropy))
    out = {}
    for row in rows:
        if row.doc_id not in groups or len(copies[groups[row.doc_id]]) < fertility.MEMBERS:
            out[row.doc_id] = None
            continue
        like, total = [min(same) for same in copies[groups[row.doc_id]].values()], 0.0
        for at, value in ((1, row.chars_per_token), (2, row.token_entropy)):
            ranked = sorted(one[at] for one in like)
            low, middle, high = (ranked[max(0, int(np.ceil(share * len(ranked))) - 1)] for share in (0.25, 0.5, 0.75))
            total += (value - middle) / max((high - low) / 1.349, 0.01 * middle)
        out[row.doc_id] = total / np.sqrt(2)
    return out


@pytest.mark.parametrize("members", [None, 20])
def test_quality(spark, sf_dir, documents, monkeypatch, members):
    if members:
        monkeypatch.setattr(fertility, "MEMBERS", members)
    truth = documents.collect()
    rows, texts = QUERIES["op4_quality_rules"](spark, sf_dir).collect(), {row.doc_id: row.text for row in truth}
    expect_judged(rows, texts)
    expected = plain_evidence(rows, texts, {row.doc_id: row.lang for row in truth})
    for row in rows:
        if row.reason in (None, "language"):
            assert row.evidence == (None if expected[row.doc_id] is None else pytest.approx(expected[row.doc_id]))
            assert row.kept == (row.evidence is None or row.evidence >= -2.5)
    assert members is None or any(row.reason == "language" for row in rows)


def test_copies_have_one_vote(spark, documents):
    """Thousands of near copies of one text move no other text's verdict."""
    prose = [row for row in documents.filter("lang = 'en'").collect() if 60 <= len(row.text.split()) <= 400]
    rows = [(row.doc_id, row.text, "en") for row in prose]
    copies = [(10_000 + k, prose[0].text + f" {k}", "en") for k in range(3 * len(rows))]
    judged = lambda some: {row.doc_id: row.reason for row in fertility.judge(spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(5), PIECES).collect()}
    alone, among = judged(rows), judged(rows + copies)
    assert np.mean([among[k] == alone[k] for k in alone]) > 0.97


def test_quality_of_odd_rows(odd_documents, no_documents):
    unique = odd_documents.dropDuplicates(["doc_id", "text"])
    expect_judged(fertility.judge(unique, PIECES).collect(), {row.doc_id: row.text for row in unique.collect()})
    assert fertility.judge(odd_documents, PIECES).count() == odd_documents.count()
    assert fertility.judge(no_documents, PIECES).count() == 0


def test_bands_reject_what_no_language_is(spark):
    made = np.random.default_rng(7)
    prose = "The quick brown fox runs over the hill while seven small dogs sleep under a warm stone near our old river house and dream about bread".split()
    rows = [
        (1, " ".join(made.permutation(prose * 5).tolist())),
        (2, " ".join("".join(made.choice(list("0123456789abcdef"), 40)) for _ in range(80))),
        (3, " ".join("".join(chr(int(c)) for c in made.integers(0x13000, 0x13400, 5)) for _ in range(80))),
        (4, " ".join(f"a{k % 7} a a a b{k} a" if k % 9 else "b a" for k in range(60))),
    ]
    bands = {**fertility.BANDS, "": fertility.Band((0.2, 9.0), 0.5, (0.2, 1.0))}
    found = {row.doc_id: row.reason for row in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, bands).collect()}
    assert found[1] is None and found[2] == "chars_per_token" and found[3] in ("chars_per_token", "byte_share")


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30))
def test_repeated_words(words):
    assert fertility.repeated_words(words) == plain_counts(" ".join(words))[4]


def test_language_on_held_out_documents(spark, sf_dir, documents):
    truth = {row.doc_id: row for row in documents.collect()}
    rows = QUERIES["op10_language"](spark, sf_dir).collect()
    assert {row.doc_id for row in rows} == set(truth)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) and 0 <= row.score <= 1
    held = [row for row in rows if row.held_out]
    assert np.mean([row.lang_pred == truth[row.doc_id].lang for row in held]) > 0.97


def test_held_out_labels_are_not_learned(spark, documents):
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    left, right = language.fit(documents), language.fit(changed)
    assert left.languages == right.languages and np.array_equal(left.weights, right.weights)


def test_language_of_odd_rows(odd_documents, no_documents, documents):
    model = language.fit(documents)
    rows = language.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert {row.doc_id for row in rows if row.lang_pred == "und"} == {0, 1, 2, 6}
    assert language.predict(no_documents, model).count() == 0
    nothing = language.fit(no_documents)
    assert nothing.languages == () and {row.lang_pred for row in language.predict(documents, nothing).collect()} == {"und"}


def test_folded_weights_are_the_kernel_regression():
    """A prediction by the model's weights is the sum over landmarks of kernel times dual weight."""
    flags = np.zeros(language.SLOTS, bool)
    texts = ["the cat and the dog", "a dog and that cat", "der hund und die katze", "die katze ist ein tier", "el perro y el gato", "un gato con perro"]
    rows = [language.grams(text, flags) for text in texts]
    packed = np.zeros((len(texts), language.SLOTS), bool)
    for k, row in enumerate(rows):
        packed[k, row] = True
    model = language.fit_rows(np.packbits(packed, axis=1), ["en", "en", "de", "de", "es", "es"], 6, 1e-3)
    kernel = np.array([[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b in rows] for a in rows])
    target = np.where(np.array(["en", "en", "de", "de", "es", "es"])[:, None] == np.array(["de", "en", "es"])[None, :], 1.0, -1.0)
    dual = np.linalg.solve(kernel.T @ kernel / 2 + 1e-3 * kernel + 1e-8 * np.eye(6), kernel.T @ target / 2)
    direct = np.array([(packed[k] @ model.weights) / np.sqrt(len(rows[k])) for k in range(6)])
    assert np.allclose(direct, kernel @ dual, atol=1e-3)
    assert model.predict(texts)[0] == ["en", "en", "de", "de", "es", "es"]


@pytest.fixture(scope="module")
def library():
    """The library's own search over the same pieces, the model's type set to unigram and its scores to the operator's."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    model = unigram.unigram(PIECES)
    for k, score in zip(model.ids, model.scores, strict=True):
        proto.pieces[k].score = score
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_cuts_are_those_of_the_library(library, documents):
    """Word by word, as over long texts the library's sums of short floats lose the small differences."""
    model = unigram.unigram(PIECES)
    words = sorted({word for row in documents.collect() for word in row.text.split()}) + ["日本語", "☃😀", "naïve", "x\n", "a" * 70, "international"]
    ids, lengths, scores, byte_counts = model.encode_all(pa.array(words))
    cuts = [found.tolist() for found in np.split(ids, np.cumsum(lengths)[:-1])]
    assert library.decode(cuts) == words
    for word, found, other, score, bytes_ in zip(words, cuts, library.encode(words), scores, byte_counts, strict=True):
        if found != other:  # only where the cuts are worth the same
            assert not bytes_ and score == pytest.approx(sum(model.scores[model.ids.index(k)] for k in other), abs=1e-9), word
    assert model.encode("international")[0].tolist() == [library.piece_to_id("▁international")]


def test_scores_are_log_probabilities():
    model = unigram.unigram(PIECES)
    assert np.exp(model.scores).sum() == pytest.approx(1.0)
    assert unigram.log_scores([-1.5, -0.25]) == [-1.5, -0.25] and unigram.log_scores([]) == []
    assert np.diff(unigram.log_scores([0.0, -1.0, -2.0])) == pytest.approx(-np.log([2, 1.5]))


@given(st.lists(st.text("abcé▁ \0\n☃日", max_size=90) | st.text("ab ", min_size=60, max_size=150), max_size=6))
@settings(max_examples=60, deadline=None)
def test_all_at_once_is_one_by_one(texts):
    """Many texts at once have the ids and figures of the plain search over their parts, long parts included."""
    names = ["▁", "▁▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "é", "▁日", "bab"]
    model = unigram.Unigram([(name, -float(k + 1) / 7) for k, name in enumerate(names)], list(range(256)), list(range(256, 256 + len(names))))
    ids, lengths, scores, bytes_ = model.encode_all(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    for k, text in enumerate(texts):
        parts = re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")) if text else []
        plain = [model.viterbi(part) for part in parts]
        assert ids[ends[k] - lengths[k] : ends[k]].tolist() == [one for found, _, _ in plain for one in found]
        assert scores[k] == pytest.approx(sum(score for _, score, _ in plain)) and bytes_[k] == sum(n for _, _, n in plain)
    assert model.decode_all(ids, lengths) == [text.replace("▁", " ") for text in texts]


def best_cut(pieces, unknown, text):
    """Brute force over all cuts."""
    if not text:
        return 0.0
    options = [pieces[text[:k]] + best_cut(pieces, unknown, text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces]
    return max(options + ([unknown + best_cut(pieces, unknown, text[1:])] if text[0] not in pieces else []))


@given(st.dictionaries(st.text("ab▁é", min_size=1, max_size=3), st.integers(-20, 0), min_size=1, max_size=12), st.text("ab cé☃", max_size=7))
@settings(max_examples=150, deadline=None)
def test_best_score_and_round_trip(pieces, text):
    names = list(pieces)
    model = unigram.Unigram([(name, float(pieces[name])) for name in names], list(range(256)), list(range(256, 256 + len(names))))
    ids, score, _ = model.encode(text)
    assert model.decode(ids.tolist()) == text
    assert score == pytest.approx(best_cut(pieces, model.unknown, "▁" + text.replace(" ", "▁")) if text else 0.0)


def test_unigram_query(spark, sf_dir, odd_documents, no_documents):
    assert QUERIES["op6_unigram_pieces"](spark, sf_dir).filter("NOT round_trip OR n_ids <> size(ids)").count() == 0
    rows = unigram.encode(odd_documents, PIECES).collect()
    assert len(rows) == odd_documents.count() and all(row.round_trip for row in rows)
    assert unigram.encode(no_documents, PIECES).count() == 0


def test_extraction(spark, sf_dir):
    pages = {row.page_id: row for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op1_wrapper_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", block)).split()) for block in re.split(r"</?(?:p|h1|br)>", article))
        assert row.text == "\n".join(filter(None, blocks)) and row.n_chars == len(row.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header id="top">Site</header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; line</h1></header><p>One&nbsp;<b>bold</b>
 text<br>next</p><aside>side</aside><form><label>Mail</label><input name=x><button>Go</button></form><p>Two &lt;3<ul><li>item</ul><div class="ad-box ad">Buy</div></article>
<section id="comments"><h2>2 comments</h2><p>First!</p></section></main><footer>&copy; us</footer></body></html>"""


def test_what_is_no_article(spark):
    plain = "<html><body><div>Welcome to our site</div><div id='x'><p>Story {0} of the day</p><p>More {0}</p></div><div><a href=1>Link {0}</a></div></body></html>"
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "http://a.b/2", ""), (None, "http://c.d/", "just text &amp; more")] + [(10 + k, "http://e.f/", plain.format(k)) for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'x' AS nodes", "1 AS pages", "'x' AS text").repartition(3)
    for limit in (wrapper.BROADCAST_BYTES, 0):
        found = {row.page_id: row.text for row in wrapper.extract(frame, limit).collect()}
        assert found[1] == "Head & line\nOne bold text next\nTwo <3\nitem"
        assert found[2] == found[3] == "" and found[None] == "just text & more"
        assert found[14] == "Story 4 of the day\nMore 4"
    assert wrapper.extract(frame.limit(0)).count() == 0


def test_wrapper_of_differing_pages():
    node = lambda token, text: [token, False, False, 1, text, 1, 0]
    left = [node("h1", 1), node("p", 2), node("foot", 9)]
    right = [node("h1", 3), node("note", 4), node("p", 2), node("foot", 9)]
    pages, nodes = wrapper.infer([(1, left), (1, right)])
    assert pages == 2 and wrapper.expression(nodes) == "h1[#PCDATA] (note[fixed])? p[fixed] foot[fixed]"
    structure, place, many = wrapper.folded(["h", "p", "q", "p", "q", "p", "q", "f"])
    assert structure == ("h", "p", "q", "f") and place == [0, 1, 2, 1, 2, 1, 2, 3] and many == [False, True, True, False]


def test_wrapper_judges_beside_and_inside_an_article(spark):
    page = "<html><body><h1>Head {0}</h1><article><p>Teaser</p></article><div><p>Body {0}</p><p>more of {0}</p></div><article><div>Always here</div><p>Own {0}</p></article><div>Same for all</div></body></html>"
    copy = "<html><body><article><h2>Copied</h2><p>One story</p></article><div>stamp {0}</div></body></html>"
    rows = [(k, "http://a.b/", page.format(k)) for k in range(6)] + [(20 + k, "http://c.d/", copy.format(0 if k < 5 else k)) for k in range(8)]
    found = {row.page_id: row.text for row in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[4] == "Head 4\nBody 4\nmore of 4\nOwn 4"
    assert found[20] == found[27] == "Copied\nOne story"


def test_class_names_do_not_empty_a_page(spark):
    shells = [
        "<body class='single no-sidebar'><p>{0}</p></body>", "<body class='has-header comments-open'><main id='main-widget'><p>{0}</p></main></body>", "<body><article class='post related-posts'><p>{0}</p></article></body>",
        "<body><div class='search-result-page'><p>{0}</p></div></body>", "<body><div class='widget'><article><p>{0}</p></article></div><p>note</p></body>", "<body><div class='popup'><p>{0}</p></div><p>note</p></body>",
        "<body><article><header class='entry-header'><h1>{0}</h1></header><div class='ad-box'>Buy</div><div class='relatedPosts'><p>More</p></div></article><div class='comments'><p>%s</p></div></body>" % ("Long comment. " * 20),
    ]
    rows = [(k, f"http://h{k}.b/", shell.format("A story of some length")) for k, shell in enumerate(shells)]
    found = {row.page_id: row.text for row in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in (0, 1, 2, 3, 4, 6)] == ["A story of some length"] * 6 and found[5].startswith("A story of some length")


def test_production_bands(spark):
    """Random letters, wrong encodings and unknown scripts go; prose of many scripts stays."""
    made = np.random.default_rng(11)
    prose = {
        "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm.",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.",
        "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
        "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
        "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है।",
        "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    }
    shuffled = lambda text: " ".join(made.permutation(text.split() * -(-90 // len(text.split()))).tolist())
    letters = lambda low, high, n: " ".join("".join(chr(int(c)) for c in made.integers(low, high, int(made.integers(2, 10)))) for _ in range(n))
    good = [shuffled(text) for text in prose.values()]
    bad = [letters(97, 123, 200), letters(97, 123, 2000), letters(0x430, 0x450, 200), letters(0x13000, 0x13400, 100), *(shuffled(prose[k]).encode().decode("latin-1") for k in ("ru", "el"))]
    rows = list(enumerate(good)) + [(100 + k, text) for k, text in enumerate(bad)]
    found = {row.doc_id: row for row in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert [found[k].reason for k in range(len(good)) if not found[k].base_failed] and {found[k].reason for k in range(len(good))} <= {None, "base"}
    assert all(found[100 + k].reason not in (None, "base") for k in range(len(bad)))


def test_prose_of_marked_latin_stays(spark):
    """Languages that write many letters beyond a-z have few characters per token; their prose is none the worse."""
    prose = {
        "az": "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar. Onların şüurları və vicdanları var və bir-birlərinə münasibətdə qardaşlıq ruhunda davranmalıdırlar.",
        "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá.",
        "nv": "Bílaʼashdaʼii tʼáá ałtsoh yinídlį́įgo bidizhchį dóó aheełtʼeego ílį́į́go bee baahóchįʼ. Eí hákʼeʼáálíní dahólǫ́ǫgo dóó bee háʼáhwiinítʼíinii hólǫ́ǫgo ałʼąą ádaatʼé.",
    }
    rows = [(k, " ".join(np.random.default_rng(k).permutation(text.split() * 5).tolist())) for k, text in enumerate(prose.values())]
    found = fertility.judge(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    assert [(row.script, row.base_failed, row.reason) for row in found if row.reason not in (None, "base")] == [] and not all(row.base_failed for row in found)


def test_class_names_that_mark(spark):
    """What is no article by any part of its name goes, on a page without others of its host too; states and layouts stay."""
    names = ["share-buttons", "ad-slot", "social-links", "newsletter-form", "comment-form", "comment-body", "disqus_thread", "cookie-text"]
    story = "A story of some length, which has more to say than all that stands around it. " * 3
    rows = [(k, f"http://n{k}.b/", f"<body><article><p>{story}</p><div class='{name}'><p>Other words</p></div></article></body>") for k, name in enumerate(names)]
    rows += [(100 + k, f"http://s{k}.b/", f"<body><p>{story}</p><div class='{name}'><p>Other words</p></div></body>") for k, name in enumerate(["nav-open", "page-with-ads", "no-comments", "share-page"])]
    headline = "<body><div><p>Menu of the day</p><h1>The news</h1></div><article><p>{0}</p></article></body>"
    rows += [(200, "http://h.b/", headline.format(story)), (201, "http://h2.b/", headline.format(f"{story}<h1>Own</h1>"))]
    found = {row.page_id: row.text for row in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = story.strip()
    assert {found[k] for k in range(len(names))} == {story}
    assert {found[100 + k] for k in range(4)} == {f"{story}\nOther words"}
    assert found[200] == f"The news\n{story}" and "The news" not in found[201]


def _differing_pages(n, seed):
    """Pages of two hosts and of none, of many structures: parts come and go, repeat and change their order, with template texts and slots."""
    made, rows = np.random.default_rng(seed), []
    for k in range(n):
        word = lambda: " ".join(f"w{x}" for x in made.integers(0, 500, 6))
        parts = ["<div class='a'><p>All rights</p></div>", f"<section class='b'><p>{word()}</p></section>", f"<div class='c'><h2>{word()}</h2></div>", "<ul class='d'><li>Again</li></ul>", "".join(f"<blockquote><p>{word()}</p></blockquote>" for _ in range(int(made.integers(1, 4))))]
        chosen = [parts[i] for i in made.permutation(5) if made.random() < 0.7]
        article = f"<article><p>{word()}</p>{'<p class=x>Read on</p>' if made.random() < 0.5 else ''}</article>" if made.random() < 0.5 else ""
        rows.append((k, [f"http://one.b/{k}", f"http://two.b/{k}", None][k % 3], f"<body>{''.join(chosen)}{article}<div class='e'><p>{word()}</p></div></body>"))
    return rows


def _shuffled_pages(spark, rows, seed, parts):
    return spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(len(rows))], "page_id long, url string, html string").repartition(parts)


def test_wrappers_are_the_same_on_any_layout(spark, monkeypatch):
    rows = _differing_pages(180, 3)
    monkeypatch.setattr(wrapper, "wrappers", partial(wrapper.wrappers, aligned=4))  # several rounds
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 2, 8, 31):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append({row.page_id: row.text for row in wrapper.extract(_shuffled_pages(spark, rows, parts, parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(found == seen[0] for found in seen[1:])
    # Another host's pages change nothing.
    alone = [row for row in rows if row[0] % 3 == 1]
    found = {row.page_id: row.text for row in wrapper.extract(_shuffled_pages(spark, alone, 5, 2)).collect()}
    assert found == {k: seen[0][k] for k in found} and len(found) == 60


def test_inference_by_brute_force(spark):
    """One host's wrapper, made in plain Python page by page, judges as the distributed one does."""
    rows = [row for row in _differing_pages(150, 8) if row[0] % 3 == 0]
    by_tokens, copies = {}, {}
    for _, _, page in rows:
        blocks = wrapper.leaves(page)
        structure, place, many = wrapper.folded([" ".join(block.place) for block in blocks])
        texts = [[block for block, k in zip(blocks, place, strict=True) if k == at] for at in range(len(structure))]
        nodes = [[token, flag, tuple(block.text for block in held), sum(len(block.text) for block in held), sum(block.links for block in held)] for token, flag, held in zip(structure, many, texts, strict=True)]
        copies.setdefault("\n".join(wrapper._prior(blocks)), []).append(nodes)
    assert all(len(same) == 1 for same in copies.values())
    for (nodes,) in copies.values():
        by_tokens.setdefault(tuple(node[0] for node in nodes), []).append(nodes)
    assert 10 < len(by_tokens) <= wrapper.ALIGNED
    crc = lambda held: reduce(lambda value, text: zlib.crc32(f"{text}\n".encode(), value), held, 0)
    merged = []
    for tokens, pages in by_tokens.items():
        column = lambda at, field: [nodes[at][field] for nodes in pages]  # noqa: B023, E731
        merged.append((len(pages), [[token, any(column(at, 1)), False, len(pages), crc(column(at, 2)[0]) if len(set(column(at, 2))) == 1 else None, sum(column(at, 3)), sum(column(at, 4))] for at, token in enumerate(tokens)]))
    expected = wrapper.Extractor(*wrapper.infer(merged))
    found = {row.page_id: row.text for row in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert found == {page_id: expected.text(page) for page_id, _, page in rows}
    # The inference decides: tags and classes alone give other texts.
    assert any(text != "\n".join(wrapper._prior(wrapper.leaves(page))) for (_, _, page), text in zip(rows, map(found.get, [row[0] for row in rows]), strict=True))
