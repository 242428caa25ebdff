import math
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from protolith.llm import html as H
from protolith.llm import language as L
from protolith.llm import quality as Q
from protolith.llm import queries

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op4_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in test) >= 0.95 * len(test) and len(test) > 50


def slow_features(text):
    """The features by their definitions, without numpy."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * 26
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    share = lambda chars: sum(b in chars.encode() for b in raw) / len(raw)
    top = max((words.count(w) for w in set(words)), default=0) if len(words) < 3000 else max(Counter(words).values())
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, top / n,
        1 - len(set(triples)) / len(triples) if triples else 0, math.log1p(len(lines)), math.log1p(len(raw) / m), 1 - len(set(lines)) / m, sum(len(x) < 40 for x in lines) / m,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), sum(b >= 128 for b in raw) / len(raw), share("!"), share("|"), share("#$%&*@^~+="),
        share(".?;:"), share(","), share("/\\"), share("\"'"), share("()[]{}<>"), share("_"),
        sum(len(w) > 18 for w in words) / n, sum(w.istitle() for w in words) / n, sum(w.lower() in Q.COMMON for w in words) / n, share(" \t\n\r"),
    ]


def slow_score(model, x):
    z = model.base + sum(t[bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[bisect_right(list(model.pair_edges[a]), x[a])][bisect_right(list(model.pair_edges[b]), x[b])]
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_quality_matches_brute_force(spark):
    """Every document's score against features and table sums without numpy."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn(docs, labels)
    got = {r.doc_id: r.score for r in queries.op4_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and all(abs(got[d] - slow_score(model, slow_features(t))) < 1e-9 for d, t in texts.items())
    for t in ("", "é É ß", "a\n\nb\n", "\\ \"x\" [y] _z_ " * 9, "Word " * 4000):
        assert np.allclose(Q.features(t), slow_features(t))


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 50000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.learn(df, none)
    assert [r.score for r in Q.score(df, model).collect()] == [0.5] * 4
    assert Q.score(df.limit(0), model).count() == 0 and Q.keep_good(df, model).columns == df.columns
    one = spark.createDataFrame([(1, 1), (2, None), (2, 1)], "doc_id long, quality int")
    assert Q.learn(df, one).score(np.zeros((1, len(Q.FEATURES))))[0] > 0.5


def test_boosting_learns_interactions():
    rng = np.random.RandomState(0)
    x = rng.rand(3000, len(Q.FEATURES))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = Q.fit(x[:2000], y[:2000])
    assert (3, 7) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_language_on_held_out_texts(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    test = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(langs) and np.mean(test) >= 0.95


def slow_trigrams(text):
    raw = text.lower().encode("utf-8", "surrogatepass")
    kept = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw)
    raw = b" " + b" ".join(kept.split()) + b" "
    counts = [0] * L.DIM
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 21] += 1
    size = math.sqrt(sum(counts))
    return [math.sqrt(x) / size if size else 0.0 for x in counts]


def slow_language(model, text):
    """The family first, then the votes of the machines for each pair of its languages."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = slow_trigrams(text)
    say = lambda w: sum(a * b for a, b in zip(x, w)) + w[-1]
    logistic = lambda z: 1 / (1 + math.exp(-4 * z))
    z = [say(w.tolist()) for w in model.first] if len(model.families) > 1 else [0.0]
    f = max(range(len(z)), key=lambda k: z[k])
    sure = logistic(z[f]) if len(model.families) > 1 else 1.0
    langs = model.families[f][1]
    votes, margin = [0.0] * len(langs), [0.0] * len(langs)
    for (a, b), w in zip(*model.second[f]):
        v = say(w.tolist())
        votes[a if v > 0 else b] += 1
        margin[a] += v / len(langs)
        margin[b] -= v / len(langs)
    best = max(range(len(langs)), key=lambda k: votes[k] + 1e-3 * math.tanh(margin[k]))
    return langs[best], sure * (logistic(margin[best]) if len(langs) > 1 else 1.0)


def test_language_matches_brute_force(spark):
    """Predictions of whole texts against trigrams and machines without numpy."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op7_language(spark, sf).collect()}
    assert set(got) == set(texts)
    some = sorted(texts)[:120]
    want = {d: slow_language(model, texts[d]) for d in some}
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-4 for d in some)


def test_language_with_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, "the cat sat" if k % 2 else "le chat est", "en" if k % 2 else "fr", 1, "x") for k in range(200)], "doc_id long, text string, lang string, score int, lang_pred string")
    model = L.learn(df.selectExpr("*", "1 AS d", "2 AS t", "3 AS l"))
    assert [len(m) for _, m in model.families] == [1, 1]
    out = L.identify(df.selectExpr("*", "true AS held_out"), model)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"en", "fr"}
    assert L.identify(df.limit(0), model).count() == 0 and L.learn(df.limit(0)).families == []


def test_language_edges(spark):
    rows = [(k, t, lang) for k in range(0, 400, 4) for t, lang in (("the cat is on the mat", "en"), ("le chat est sur la table", "fr"), ("zzq qqz", "xx"))]
    df = spark.createDataFrame([(3 * k + j, t, lang) for j, (k, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.learn(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the mat"), (None, "la table " * 30000), (4, "zzq")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in L.identify(odd, model).collect()]
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "fr", True), (4, "xx", True)]
    nothing = L.learn(odd.withColumn("lang", odd.text.substr(0, 0)).where("false"))
    assert [r.lang_pred for r in L.identify(odd, nothing).collect()] == ["und"] * 6


@pytest.fixture(scope="module")
def field():
    return H.default_field()


def test_field_on_unseen_pages(field):
    pages = H.training_pages(150, seed=77)
    wrong = sum(a != b for p in pages for a, (_, b) in zip(field.decode([x for x, _ in p]), p, strict=True))
    assert wrong <= 0.01 * sum(map(len, pages))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b>ness<br>line&nbsp;two, &lt;tag&gt; &am.<p>Second one is here, at last.
<div class="ad">Buy this now, it is good.</div><p data-x="a>b">Third one, with a <a href="/c">link</a> in it.</p><!-- hidden --></article>
<section class="comments"><div class="comment"><p>Nice words, I liked them all.</p></div></section>
<aside class="sidebar"><p>Elsewhere, people talk.</p></aside><footer>&copy; Us &middot; 2020</footer></body></html>"""


def test_page(field):
    assert field.extract(PAGE) == "A title & more First boldness line two, <tag> &am. Second one is here, at last. Third one, with a link in it."


@pytest.mark.parametrize("page", ["", None, "<", "<p", "plain words alone", "<script>", "<!--", "<p>&#0;&#xD800;</p>", "</div></p>", "<a href='", "<div>" * 2000, "<p>x</p>" * 5000])
def test_odd_pages_do_not_crash(field, page):
    assert isinstance(field.extract(page), str)


def test_pages_table(spark):
    rows = queries.op8_html(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    import html
    import re

    for r in rows:  # these pages mark their text with one element
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?b>", "", inner))).split())
        assert r.text == want
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.url) for r in H.extract_text(df).collect()] == [(None, None), (1, "u")]
    assert H.extract_text(df.limit(0)).count() == 0


def test_head_without_end_tag_and_self_closed_elements():
    said = lambda page: [b[1] for b in H.blocks(page)]
    assert said("<html><head><title>x</title><body><article><p>Long story here.</p></article>") == ["Long story here."]
    assert said("<head><meta charset=utf-8><script>'<p>no</p>'</script><p>Story.") == ["Story."]
    for tag in ("svg", "math", "iframe", "object", "canvas", "audio", "video"):
        assert said(f'<p>One <{tag} class="i"/> two.</p><p>Three.</p>') == ["One two.", "Three."], tag
        assert said(f"<p>One <{tag}>no</{tag}> two.</p><{tag}-box>Three.</{tag}-box>") == ["One two.", "Three."], tag
    assert "t:head" not in H.blocks("<head><title>x</title><body><p>y")[0][0]


def test_every_language_is_learned(spark):
    codes = [c for f in L.FAMILIES.values() for c in f.split()]
    codes += [f"q{k:02}" for k in range(70 - len(codes))]
    rows = [(20 * k + n, f"{c}{c} word{c}a text{c} " * 5, c) for k, c in enumerate(codes) for n in range(20)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(c for _, m in model.families for c in m) == sorted(codes) and len(codes) == 70
