import random
from collections import Counter
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protolith.llm import packing as K
from protolith.llm import tokenfiles as TF
from protolith.llm.tokenize import Encoder

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
SF = "/root/testdata/sf0.001"
TEXTS = [
    "a\n\nb", "a  b", " x ", "\ta", "x\n", "don't  'S  <|endoftext|> x", "é́ ́a", "a\x1cb c", "a \n b", "\n", "  ", "İ ſ ΑΣ ΑΣ.", "a b", "x 　y", "12 34a_b", "\n\n",
    "a\r\nb", "foo \nbar", "foo\n bar", "", "tail ", "Ünïcödé, déjà!", "it's ''s", "x" * 300, "a b", "??!! $$ ok", "İstanbul ß ẞ", "漢字 かな", "😀 x😀",
]


def full(path):
    t = Tokenizer.from_file(path)
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_equal_whole_texts(spark, path):
    e, whole = Encoder(path), full(path)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab é\n\t .'1漢") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "a", "é", "endoftext", "'s", "\x1c"]
    noise += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text in TEXTS + docs + noise:
        assert e.encode(text) == whole(text).tobytes(), repr(text)


def test_packings_are_whole_and_near_the_bound():
    for seed in range(300):
        rng = random.Random(seed)
        cap = rng.choice([10, 20, 64])
        counts = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(0, 12))}
        bins, got = K.pack_histogram(counts, cap), Counter()
        for pattern, times in bins:
            assert times > 0 and sum(s * k for s, k in pattern) <= cap
            for s, k in pattern:
                got[s] += k * times
        assert got == Counter(counts)
        places, taken = K.Places(bins), {}
        for size, k in counts.items():
            for b, o in zip(*places.find(np.full(k, size), np.arange(k)), strict=True):
                assert not any((b, o + x) in taken for x in range(size))
                taken |= {(b, o + x): 1 for x in range(size)}
        for b in {b for b, _ in taken}:
            spots = sorted(o for x, o in taken if x == b)
            assert spots == list(range(len(spots)))


def optimum(items, cap):
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                at = rooms.index(r)
                go(k + 1, rooms[:at] + [r - items[k]] + rooms[at + 1 :])
        go(k + 1, rooms + [cap - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    for seed in range(150):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 8))), reverse=True)
        fixed, left = K.reduce_dominated(Counter(items), 12)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for _, t in fixed) + (optimum(rest, 12) if rest else 0) == optimum(items, 12), items


def test_pack_documents(spark):
    whole = full(WORD)
    rows = [(1, "w " * 5000, "p"), (2, None, "p"), (3, "", "p"), (4, "hello world", "p"), (4, "hello world", "p"), (None, "x", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    out = K.pack_documents(df, WORD, capacity=64, with_ids=True).toPandas()
    assert out.length.sum() == sum(len(whole(t)) + 1 for _, t, _ in rows)
    big = out[out.doc_id == 1].sort_values("piece")
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in big.ids])
    assert (ids == np.r_[whole(rows[0][1]), 0]).all() and (big.length.iloc[:-1] == 64).all() and list(big.start) == list(range(0, len(ids), 64))
    assert all(zlib.crc32(x) == c for x, c in zip(out.ids, out.ids_crc32, strict=True))
    ends = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64 for _, g in ends)
    assert K.pack_documents(df.limit(0), WORD).count() == 0


def test_token_files(spark, tmp_path):
    whole = full(BYTE)
    rows = [(7, "seven"), (None, "none"), (3, None), (5, "five é\n\n x"), (5, "again"), (-2, "w " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    TF.write_tokens(df, BYTE, str(tmp_path / "t"))
    got = TF.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, ((d, [*whole(t).tolist(), 0]) for d, t in rows)))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [None, -2, 3, 5, 5, 7]
    TF.write_tokens(df.limit(0), BYTE, str(tmp_path / "e"))
    assert TF.read_tokens(spark, str(tmp_path / "e")).count() == 0


def least_sequences(lengths, capacity):
    """A lower bound of the number of sequences: by total, and by pieces over half, which never meet, with what cannot lie beside them."""
    lengths = np.array(lengths)
    best = -(-int(lengths.sum()) // capacity)
    for k in np.unique(np.r_[0, lengths[lengths <= capacity // 2]]):
        alone, half = lengths > capacity - k, (lengths <= capacity - k) & (lengths > capacity // 2)
        small = lengths[(lengths >= k) & (lengths <= capacity // 2)].sum()
        best = max(best, int(alone.sum() + half.sum() + max(0, -(-(small - (half.sum() * capacity - lengths[half].sum())) // capacity))))
    return best


def test_op1_whole_table(spark):
    """Every piece's ids, gapless places and the number of sequences, against the library over whole texts."""
    from protolith.llm.queries import op1_packing

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole, out = full(WORD), op1_packing(spark, SF).toPandas()
    want = {}
    for d, t in docs.items():
        ids = np.append(whole(t), 0).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[d, k] = (at, len(cut), zlib.crc32(cut.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want and len(out) == len(want)
    at = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048 for _, g in at)
    assert out.sequence_id.nunique() <= least_sequences(out.length, 2048) + 1


def test_op6_whole_table(spark):
    from protolith.llm.queries import op6_token_files

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole, at, want = full(BYTE), 0, []
    for d in sorted(docs):
        ids = np.append(whole(docs[d]), 0).astype("<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op6_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_extra_columns_that_clash(spark, tmp_path):
    df = spark.createDataFrame([(1, "one", 5, 6, "x")], "doc_id long, text string, d long, part long, t string")
    TF.write_tokens(df, BYTE, str(tmp_path / "t"), parts=3)
    assert [(r.doc_id, r.start, r.n_tokens) for r in TF.read_tokens(spark, str(tmp_path / "t")).collect()] == [(1, 0, 2)]
    assert [r.length for r in K.pack_documents(df.selectExpr("*", "1 AS length", "2 AS nth", "3 AS offset"), WORD).collect()] == [2]
