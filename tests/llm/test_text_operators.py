import base64
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nullwise.llm import html_extract, langid, toxicity
from nullwise.llm.common import WORD, vocabulary
from nullwise.llm.fertility import ByteVocabulary, base_measures, fertility, main_script, quality_rules

SMALL = "/root/testdata/sf0.001"
TEXT = st.text(alphabet="ab \n\t#|é\x0b\xa0", max_size=60)


def plain_measures(text):
    found = WORD.findall(text or "")
    grams = Counter(tuple(found[i:i + 3]) for i in range(len(found) - 2))
    marked = {i + k for i in range(len(found) - 2) if grams[tuple(found[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_base_measures(text):
    assert base_measures(text) == plain_measures(text)


def test_fertility_measures():
    vocab = ByteVocabulary.load(vocabulary("byte_bpe_multi_50k.tiktoken"))
    text = "plain words, plain words: \U00012345 " * 3
    ids = vocab.coder.encode_ordinary(text)
    share = np.array(list(Counter(ids).values())) / len(ids)
    chars, fallback, entropy, n = fertility(text, vocab)
    assert (chars, n) == (len(text) / len(ids), len(ids)) and entropy == pytest.approx(-(share * np.log2(share)).sum())
    assert 0 < fallback < 1 and fertility("plain words", vocab)[1] == 0
    long = "word " * 50_000 + "x" * 200_000
    assert len(vocab.encode(long)) > 50_000
    assert [main_script(t) for t in ("abc", "дом и сад", "日本語の", "", "ελληνικά")] == ["LATIN", "CYRILLIC", "CJK", "LATIN", "GREEK"]


def test_quality_rules_edges(spark):
    schema = "doc_id long, text string, lang string, kept string"
    good = ("On a quiet morning the old keeper walked down from his house to count boats along a shore where gulls cried over grey water; "
            "nobody had asked him for this work, yet every season since his father died he wrote each name into one thick book, adding "
            "weather, wind and whatever strangers told him about distant harbours they would never see again before winter closed the bay.")
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, good, "en", "x"), (4, good, None, "x"), (5, good, "zz", "x"), (None, good, "en", "x"),
            (7, "the same three " * 60, "en", "x"), (8, "☃ " * 90, "en", "x"), (9, "zq#%&@ " * 30 + " ".join(f"x{i}" for i in range(80)), "en", "x")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5, None, 7, 8)] == [False, False, True, True, True, True, False, False]
    assert got[7].base_failed and got[1].base_failed and got[1].n_words == 0
    assert quality_rules(spark.createDataFrame([], schema)).collect() == []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = quality_rules(docs).join(labels, "doc_id").where(~F.col("base_failed") & (F.col("quality") == 1))
    assert judged.where("not kept").count() == 0 and judged.count() > 20  # clean documents stay
    for r in quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)


def test_quality_rules_reject_random_strings_and_mojibake(spark):
    rng = random.Random(4)

    def strings(alphabet, low=3, high=10, n=80):
        return " ".join("".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(n))

    russian = ("все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать "
               "в отношении друг друга в духе братства каждый человек должен обладать всеми правами и всеми свободами провозглашенными "
               "настоящей декларацией без какого бы то ни было различия как то пола языка религии политических или иных убеждений")
    french = ("tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent "
              "agir les uns envers les autres dans un esprit de fraternité chacun peut se prévaloir de toutes les libertés proclamées dans "
              "la présente déclaration sans distinction aucune notamment de langue ni de fortune")
    junk = [strings(string.ascii_lowercase), strings(string.ascii_uppercase), strings(string.ascii_letters), strings("0123456789abcdef", 8, 32),
            strings("0123456789ABCDEF", 8, 32), strings(string.digits), strings(string.digits, 2, 4), strings(string.punctuation),
            strings(string.ascii_letters + string.digits), " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(80)),
            russian.encode().decode("latin-1").translate(dict.fromkeys(range(128, 160), "€")), russian.encode("cp1251").decode("latin-1"),
            french.encode().decode("latin-1")]
    junk_without_lang = [strings("абвгдежзийклмнопрстуфхцчшщъыьэюя"), strings("αβγδεζηθικλμνξοπρστυφχψω"),
                         strings([chr(c) for c in range(0x621, 0x64B)]), strings([chr(c) for c in range(0x905, 0x94D)]),
                         strings([chr(c) for c in range(0x4E00, 0x9FA5)]), strings([chr(c) for c in range(0x100, 0x2FFF)])]
    rows = [(t, lang, False) for t in junk for lang in ("en", "de", "fr", "es", None, "zz")] + [(t, None, False) for t in junk_without_lang]
    rows += [(t, lang, True) for t in (russian, russian.upper()) for lang in ("ru", None)]
    rows += [(t, lang, True) for t in (french, french.upper()) for lang in ("fr", None)]
    got = quality_rules(spark.createDataFrame(rows, "text string, lang string, want boolean")).collect()
    assert [(r.text[:30], r.lang, r.kept) for r in got if r.kept != r.want or r.base_failed] == [] and len(got) == len(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ngrams_do_not_span_texts(texts):
    bucket, owner, has = langid.ngrams(texts)
    for i, t in enumerate(texts):
        alone, _, letter = langid.ngrams([t])
        assert sorted(bucket[owner == i]) == sorted(alone) and has[i] == letter[0] == any(c.isalpha() for c in t)


def test_naive_bayes_equals_plain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.where("text is not null and lang is not null").collect()
    languages, matrix = langid.train(spark.createDataFrame(rows).select("text", "lang").repartition(5))
    counts = np.full((len(languages), langid.BUCKETS), langid.SMOOTHING)
    prior = Counter(r.lang for r in rows)
    for r in rows:
        np.add.at(counts[languages.index(r.lang)], langid.ngrams([r.text])[0], 1)
    want = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    assert languages == sorted(prior) and np.allclose(matrix[:-1].T, want, atol=1e-4)
    scores, _ = langid.log_scores([r.text for r in rows[:20]], matrix)
    for s, r in zip(scores, rows):
        alone = [want[k][langid.ngrams([r.text])[0]].sum() + np.log(prior[x] / len(rows)) for k, x in enumerate(languages)]
        assert np.allclose(s, alone, rtol=1e-4)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, "en"), (10**9, "123 !", "de"), (10**9 + 1, "", None), (10**9 + 2, "the of and", None)], docs.schema)
    out = langid.language_id(docs.union(odd).withColumn("score", F.lit("x")), langid.held_out_quarter("doc_id")).collect()
    held = [r for r in out if r.held_out and r.lang and r.lang_pred != "und" and len(r.text) > 100]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in out if r.doc_id in (None, 10**9, 10**9 + 1)] == ["und"] * 3
    none = langid.language_id(odd.where("doc_id is null"), langid.held_out_quarter("doc_id")).collect()
    assert [r.lang_pred for r in none] == ["und"]
    assert langid.language_id(docs.limit(0), langid.held_out_quarter("doc_id")).collect() == []


def page(main, nav="<nav>menu</nav>", extra=""):
    return f"<html><head><title>t</title><style>x</style></head><body>{nav}<article>{main}</article>{extra}<footer>f</footer></body></html>"


CASES = [
    (page("<h1>T &amp; u</h1><p>a  b<br>c<p>d <b>e</b>f"), "T & u\n\na b c\n\nd ef"),
    (page("<p>x</p><div class='ad banner'>buy</div><form><input>go</form><p>y</p><section id=comments><p>nice</p></section>"), "x\n\ny"),
    (page("<p>1 &lt; 2 &#233; &nbsp; &copy &bogus;</p>"), "1 < 2 é © &bogus;"),
    ("<p>one<p>two<script>var t='</p>';</script>", "one\n\ntwo"),
    ("<div class='cookie-notice'>ok?</div><main><p>m</p><aside>s</aside></main><div class=sidebar>z</div>", "m"),
    ("<header><h2>site</h2></header><article><header><h1>own</h1></header><p>p</article>", "own\n\np"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<!-- never closed <p>x", ""), ("<p>a<!--c-->b</p", "ab"),
    ("<article><p>t</p></article><article class=comment><p>long reader comment here</p></article>", "t"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n  f</pre>", "a\n\nb\n\nc\n\nd\n\ne f"),
    ("<p title='a > b'>x</p><p title=\"unclosed>y</p>", "x\n\ny"), ("<b>" * 3000 + "deep", "deep"), ("<div>" * 5000 + "deep", "deep"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_extract(html, want):
    assert html_extract.extract(html, "http://h/", lambda h: False) == want


def test_end_tags_of_deep_elements_close_no_ancestor():
    deep = "<div>" * 250 + "deep" + "</div>" * 250
    html = f"<body><div><article><p>one</p>{deep}<p>two</p></article></div><p>outside</p></body>"
    assert html_extract.extract(html, "http://h/", lambda h: False) == "one\n\ndeep\n\ntwo"


@pytest.mark.parametrize("html, want", [
    ("<main><p>Lead paragraph of some length</p><article><p>card</p></article></main>", "Lead paragraph of some length\n\ncard"),
    ("<main><p>by a. writer</p><article><p>first part of it</p></article><article><p>the second part</p></article></main>",
     "first part of it\n\nthe second part"),
    ("<article><p>one long article of many words</p></article><article><p>two long article of many words</p></article><article>x</article>",
     "one long article of many words\n\ntwo long article of many words"),
    ("<div>" * 210 + "<nav>menu</nav><p>text</p>" + "</div>" * 210, "text"),
    ("<span>" * 3000 + "</b>" * 3000 + "<p>x" * 3000, "\n\n".join(["x"] * 3000)),
])
def test_main_text_is_whole(html, want):
    assert html_extract.extract(html, "http://h/", lambda h: False) == want


def test_templates_with_numbers_on_pages_without_an_article(spark):
    rows = [(i, f"http://c.example/{i}", f"<body><span>Visitors: {i * 17}</span><div><h1>T{i}</h1><p>body {i}</p></div><p>Read <a>{i} more</a></p></body>")
            for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_text(df).collect()} == {i: f"T{i}\n\nbody {i}" for i in range(6)}
    few = {r.page_id: r.text for r in html_extract.extract_text(df.where("page_id < 4")).collect()}
    assert few[1] == "Visitors: 17\n\nT1\n\nbody 1\n\nRead 1 more"


def test_templates_of_one_host_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()
    hosts = {}
    for r in pages:
        hosts.setdefault(html_extract.host_of(r.url), []).append(r)
    host, rows = max(hosts.items(), key=lambda h: len(h[1]))
    seen = {}
    for r in rows:
        root, found = html_extract._prepared(r.html, host)
        for h, _ in found:
            seen.setdefault(h, set()).add(html_extract.main_text(root))
    texts = {html_extract.main_text(html_extract._prepared(r.html, host)[0]) for r in rows}
    want = {h for h, t in seen.items() if len(t) >= (10 if h % 2 else 5) and len(t) >= 0.02 * len(texts)}
    df = spark.createDataFrame([tuple(r) for r in rows], "page_id long, url string, html string")
    assert {r["hash"] for r in html_extract.site_templates(df).collect()} == want
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert got == {r.page_id: html_extract.extract(r.html, r.url, want.__contains__) for r in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-&;\"'= abpdiv", max_size=80))
def test_extract_never_fails(text):
    out = html_extract.extract(text, text, lambda h: False)
    assert out == out.strip()


@pytest.mark.parametrize("limit", [1000, 0])
def test_site_templates(spark, limit):
    box = "<div><p>shop of the week</p><ul><li>x</li></ul></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><h1>Title {i}</h1><p>text {i}</p><p>repeated line</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{box}<p>other {i}</p></body>") for i in range(3)]
    copy = "<body><div><p>a copied page</p></div><p>tail</p></body>"
    rows += [(200 + i, "http://a.example/copy", copy) for i in range(40)]
    rows += [(None, None, None), (300, None, "<p>x</p>")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"),
                                                                broadcast_limit=limit).collect()}
    assert got[3] == "Title 3\n\ntext 3\n\nrepeated line"
    assert got[101] == "shop of the week\n\nx\n\nother 1"  # too few pages of that host
    assert got[205] == "a copied page\n\ntail"  # copies of one page are no template
    assert (got[None], got[300]) == ("", "x")


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    features, index, lengths, _ = toxicity._windows([["alpha", "beta", "gamma", "alpha"], ["delta"] * 60, ["beta", "eps"]])
    target, weight = rng.integers(0, 2, len(index)).astype(float), rng.random(len(index))

    def loss():
        z = net.logits(net.project(net.inputs(features)), index, lengths).astype(np.float64)
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    grad = net.gradients(features, index, lengths, target, weight)
    for k in ("w_f", "u_b", "b_f", "att", "att_v", "out", "gram", "word"):
        g, at = grad[k], (0,) * net.p[k].ndim
        if isinstance(g, tuple):
            at, g = (int(g[0][0]), 0), {(int(g[0][0]), 0): g[1][0, 0]}
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.05, abs=2e-4), k


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        starts = toxicity.window_starts(n)
        covered = set()
        for s in starts:
            covered |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert covered == set(range(n))


def test_toxicity_learns_and_scores_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_STEPS", 120)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, 200, rng.integers(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(int(rng.integers(0, len(text) + 1)), rng.choice(["vileness", "vileword", "rotten"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(words * 40) + " vileness"), (1001, None), (1002, ""), (None, "rotten rotten"), (1003, "w1 w2")]
    labels += [(None, 1), (1001, None), (1002, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known, toxicity.held_out_fifth).collect()}
    assert np.mean([got[i].predicted == t for i, t in labels[:400]]) > 0.95
    assert got[1000].predicted == 1 and got[1003].predicted == 0  # the last of 8001 words decides
    assert got[1001].score == got[1002].score == 0 and got[None].predicted == 1
    empty = toxicity.toxicity(docs.limit(0), known.limit(0), toxicity.held_out_fifth)
    assert empty.collect() == []
