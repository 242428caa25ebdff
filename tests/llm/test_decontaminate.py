import random

from protolith.llm import decontaminate as D
from protolith.llm.queries import op10_decontaminate

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert D.common_length(a, b) == lcs(a, b)


def test_reader_equals_words(monkeypatch):
    """Ids of whole texts, cut or not, against the pattern; every character of a word and odd case rules."""
    rng = random.Random(3)
    bits = [*"abAB_09 .,\n\t-'", "é", "É", "İ", "ΑΣ", "ΣΑ", "ß", "ẞ", "漢", "字", "😀", "\u0301", "\u00a0", "ǅ", "²", "Ⅷ", "\0", "ﬁ", "the ", "word "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [None, "", " ", "a" * 5000]
    every = "".join(chr(c) + " x " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    vocab = {w: k for k, w in enumerate(sorted({w for t in texts for w in D.words(t)})[::2])}
    read = D.Reader(vocab)
    for chars in (1 << 20, 64):
        monkeypatch.setattr(D, "CHARS", chars)
        got = {low + d: ids[starts[d] : starts[d + 1]].tolist() for low, ids, starts in read.slices(D.pa.array(texts)) for d in range(len(starts) - 1)}
        assert [got[k] for k in range(len(texts))] == [[vocab.get(w, -1) for w in D.words(t)] for t in texts]
    whole = {w: k for k, w in enumerate(sorted(set(D.words(every))))}
    [(_, ids, _)] = D.Reader(whole).slices(D.pa.array([every]))
    assert ids.tolist() == [whole[w] for w in D.words(every)]


def test_leaks_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = {r.item_id: " " + " ".join(D.words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(r.doc_id, k) for r in docs for k, t in items.items() if t in " " + " ".join(D.words(r.text)) + " "}
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate(spark, SF).collect()}
    assert want and got == want


def test_paraphrases_and_recall_of_the_index(spark):
    """Against brute force: every item with replaced words in foreign text is found at 0.9 or better."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = D.build_index(docs.selectExpr("text AS t"), items)
    pool = [w for r in docs.select("text").limit(200).collect() for w in D.words(r.text)]
    rng = random.Random(2)
    for share, least in ((0.0, 1.0), (0.1, 0.95), (0.2, 0.9)):
        hit = 0
        for k, text in items:
            said = [rng.choice(pool) if rng.random() < share else w for w in D.words(text)]
            at = rng.randrange(len(pool) - 500)
            hit += any(x[0] == k for x in index.leaks(" ".join(pool[at : at + 200] + said + pool[at + 200 : at + 400])))
        assert hit >= least * len(items), share


def found_anywhere(index, k, text):
    """By brute force: whether some region of a text holds enough of an item in order, without any index."""
    ids = [index.vocab.get(w, -1) for w in D.words(text)]
    item, reply = index.texts[k], index.answers[k]
    for a in range(0, len(ids), D.BLOCK):
        near = ids[max(0, a - len(item)) : a + 2 * D.BLOCK + len(item)]
        share = lcs(item, near) / len(item)
        if share >= D.COMMON or share >= D.COMMON_ANSWERED and lcs(reply, near) >= 0.8 * len(reply):
            return True
    return False


def test_recall_of_longer_and_reordered_paraphrases(spark):
    """Words put between, sentences swapped, words replaced: of what brute force finds, the index finds 0.9 at least, and nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:60]
    index = D.build_index(docs.selectExpr("text AS t"), items)
    pool = [w for r in docs.select("text").limit(200).collect() for w in D.words(r.text)]
    rng, seen, hit = random.Random(7), 0, 0
    for kind in range(3):
        for k, (key, text) in enumerate(items):
            said = D.words(text)
            if kind == 0:  # longer: a foreign word behind every second one
                said = [w for i, x in enumerate(said) for w in ([x, rng.choice(pool)] if i % 2 else [x])]
            elif kind == 1:  # the last third first
                cut = 2 * len(said) // 3
                said = said[cut:] + said[:cut]
            else:
                said = [rng.choice(pool) if rng.random() < 0.35 else w for w in said]
            at = rng.randrange(len(pool) - 500)
            whole = " ".join(pool[at : at + 90] + said + pool[at + 90 : at + 180])
            want, got = found_anywhere(index, k, whole), any(x[0] == key for x in index.leaks(whole))
            assert want or not got
            seen, hit = seen + want, hit + (want and got)
    assert seen > 100 and hit >= 0.9 * seen


def test_edges(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    item = " ".join(words)
    rows = [(1, None), (2, ""), (3, f"Foo. {item.upper()}! bar"), (3, f"Foo. {item.upper()}! bar"), (None, item), (5, "nothing here at all"), (6, "pad " * 40000 + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS cosine")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(df, bench).collect())
    assert got == [("3", 7), ("3", 7), ("6", 7), ("None", 7)]
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in D.without_leaks(df, bench).collect()) == [1, 2, 5]
    same = df.selectExpr("7 AS doc_id", "text")  # one id for all: rows go by their text alone
    assert sorted(r.text or "" for r in D.without_leaks(same, bench).collect()) == ["", "", "nothing here at all"]
    assert D.without_leaks(df, bench).columns == df.columns


def drawn_items(spark, count, size, salt=0):
    """Runs of ``size`` words of the documents, each from another place, as items; and foreign words around them."""
    pool = [w for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(6000).collect() for w in D.words(r.text)]
    rng = random.Random(size + salt)
    starts = rng.sample(range(0, len(pool) // 2 - size, max(1, size // 2)), count)
    return [(k, " ".join(pool[a : a + size])) for k, a in enumerate(starts)], pool[len(pool) // 2 :], rng


def copies_found(index, items, foreign, rng):
    hit = 0
    for k, text in items:
        at = rng.randrange(len(foreign) - 500)
        hit += any(x[0] == k for x in index.leaks(" ".join([*foreign[at : at + 203], text, *foreign[at + 203 : at + 400]])))
    return hit


def test_exact_copies_are_found_among_a_thousand_items(spark):
    items, foreign, rng = drawn_items(spark, 1000, 38)
    index = D.build_index(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("text AS t"), items)
    some = items[::2]
    assert copies_found(index, some, foreign, rng) >= 0.99 * len(some)


def test_items_copied_into_most_documents_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    copies = spark.createDataFrame([(-k, item.text) for k in range(1, 501)], "doc_id long, text string")
    got = {r.doc_id for r in D.find_leaks(docs.unionByName(copies), bench).where(f"item_id = {item.item_id} AND doc_id < 0").collect()}
    assert len(got) == 500


def test_long_items_are_found(spark):
    """Words that do not repeat: one window holds little of the whole item."""
    _, foreign, rng = drawn_items(spark, 1, 38)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(size))) for k, size in enumerate((1000, 1000, 2000, 2000))]
    index = D.build_index(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("text AS t"), items)
    assert copies_found(index, items, foreign, rng) == len(items)


def test_the_basis_is_of_every_passage(spark, monkeypatch):
    """A'A of several parts, over texts of all lengths, against rows made one by one; long texts and small pieces too."""
    rng, np = random.Random(11), D.np
    vocab = {f"w{k}": k for k in range(60)}
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 80)}" for _ in range(rng.choice([0, 1, 31, 32, 33, 64, 200]))) for _ in range(120)] + [None, "", "W3 W3 w3"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(7)
    weight = np.array([rng.uniform(1, 5) for _ in vocab])
    places = []
    for terms in (np.arange(0, 60, 2), np.array([3, 4, 5]), np.array([59])):
        local = np.full(60, -1, np.int32)
        local[terms] = np.arange(len(terms))
        places.append((local, weight[terms]))
    for words_, piece in ((D.SLICE, D.PIECE), (50, 7)):
        monkeypatch.setattr(D, "SLICE", words_)
        monkeypatch.setattr(D, "PIECE", piece)
        for gram, (local, own) in zip(D._grams(docs, vocab, places), places, strict=True):
            want = np.zeros((len(own), len(own)))
            for text in texts:
                found = D.words(text)
                for a in range(0, len(found), 2 * D.BLOCK):
                    x = np.zeros(len(own))
                    held = [local[vocab[w]] for w in found[a : a + 2 * D.BLOCK] if w in vocab and local[vocab[w]] >= 0]
                    np.add.at(x, held, own[held])
                    want += np.outer(x, x) / (own[held] ** 2).sum() if held else 0
            assert np.allclose(D._times(gram, np.eye(len(own))), want)


def test_all_texts_reach_the_basis(spark, monkeypatch):
    """More passages than any sample had: each counts once in the trace."""
    docs = spark.range(30_000).selectExpr("concat('alpha x', id, ' beta') AS t")
    seen = []
    monkeypatch.setattr(D, "_basis", lambda gram, own, rank, basis=D._basis: (seen.append(2 * sum(gram[[0, 2]])), basis(gram, own, rank))[1])
    index = D.build_index(docs, [(1, "alpha beta")])
    assert abs(seen[0] - 30_000) < 1e-6 and index.leaks("x alpha beta")


def test_parts_fit_the_matrices_of_a_pass(spark, monkeypatch):
    """Wide parts are halved and passes made as needed; leaks stay the same."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    whole, passes = found(), []
    monkeypatch.setattr(D, "GRAM", 1 << 17)
    monkeypatch.setattr(D, "_grams", lambda d, v, p, grams=D._grams: (passes.append(sum(D._triangle(len(w)) for _, w in p)), grams(d, v, p))[1])
    assert found() == whole and len(passes) > 1 and max(passes) <= 1 << 17
