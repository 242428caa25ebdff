import random
import re

import numpy as np
import pytest
import xxhash

from protolith.llm import simhash as S

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    """The contract word by word, in Python integers."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in [*texts, None, "", " ", "A", "a b", "a b c", "É é\u00a0x \x0by", "\x1ca b"]:
        assert S.fingerprint(t) == slow_fingerprint(t), t


def brute(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    return comp


def test_golay_shares_a_key_within_one_bit():
    golay, rng = S.Golay(), np.random.RandomState(1)
    v = rng.randint(0, 1 << 23, 3000)
    for bit in range(23):
        a, b = golay.keys(v), golay.keys(v ^ (1 << bit))
        assert all((set(x) & set(y)) - {-1} for x, y in zip(a, b))


def test_buckets_cover_three_bits():
    golay, rng = S.Golay(), random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        row, key = S.bucket_keys(golay, np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


@pytest.mark.parametrize("block", [4, 4096])
def test_components_match_brute_force(spark, block, monkeypatch):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = []
    for t in base:
        for _ in range(12):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    texts += [None, "", " \t", "One", "one", "two words", "É", "é", base[0], base[0], "w " * 70000]
    rows = [(i * 3 + 1, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df, block=block).collect()}
    fps = {i: S.fingerprint(t) for i, t, _ in rows}
    assert {i: int(f, 16) for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute(fps)
    kept = {r.doc_id for r in S.one_per_group(df).collect()}
    assert kept == {i for i, c in brute(fps).items() if i == c}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert S.one_per_group(empty).count() == 0
    kept = sorted(((r.doc_id, r.text) for r in S.one_per_group(df.selectExpr("*", "1 AS uid", "2 AS row")).collect()), key=repr)
    assert kept == [(5, "a b c"), (None, "zz")]
    twice = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (2, "quite another text"), (2, "quite another text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.one_per_group(twice).collect()) == [(1, "a b c d e"), (2, "quite another text")]


def test_rows_without_id_are_bridges(spark, monkeypatch):
    """A chain of fingerprints three bits apart whose middle, or whose least, has no id."""
    chain = [0b0, 0b111, 0b111111, 0b111111111, 0b111111111111]
    monkeypatch.setattr(S, "fingerprint", lambda text: chain[int(text)])
    make = lambda *ids: spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    for ids, want in (((4, None, 9, None, 2), 2), ((None, 7, None, None, 8), 7), ((None, None, None, None, None), None)):
        fps = spark.createDataFrame([(i, chain[k]) for k, i in enumerate(ids)], "doc_id long, fp long")
        monkeypatch.setattr(S, "fingerprints", lambda *_, fps=fps: fps)
        assert [r.component_id for r in S.near_duplicates(make(*ids)).collect()] == [want] * 5


def test_whole_small_table(spark):
    from protolith.llm.queries import op9_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute({r.doc_id: S.fingerprint(r.text) for r in docs})
    assert {r.doc_id: r.component_id for r in op9_simhash(spark, SF).collect()} == want
