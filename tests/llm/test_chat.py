import duckdb

from protolith.llm import chat
from protolith.llm.queries import op2_chat_perspectives

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    got = op2_chat_perspectives(spark, SF).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = c.execute(chat.ORACLE).fetchdf()[list(got.columns)]
    assert sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))


def brute(turns, size):
    out = {}
    for speaker in {r for _, r, _ in turns}:
        at = 0
        for k in range(0, len(turns), size):
            text, mask = "", []
            for _, role, said in turns[k : k + size]:
                text += "<|im_start|>assistant\n" if role == speaker else f"<|im_start|>user name={role}\n"
                a = len(text)
                text += said + "<|im_end|>\n"
                if role == speaker:
                    mask.append(f"{a}:{len(text) - 1}")
            out[speaker, k // size] = (text, ",".join(mask), at, len(turns[k : k + size]))
            at += len(text)
    return out


def test_long_dialogue_in_parts(spark):
    turns = [(k, "abc"[k % 3], f"é{k}😀") for k in range(101)]
    rows = [(1, *t) for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 AS block", "2 AS speaker")
    got = {(r.speaker, r.part): (r.text, r["mask"], r.char_start, r.n_turns) for r in chat.rotate_perspectives(df, size=10).collect()}
    assert got == brute(turns, 10)


def test_ties_run_by_text_across_blocks(spark):
    """Many texts of one turn and role, some alike in all that deals them to blocks."""
    texts = sorted([f"t{k:03}" for k in range(120)] + ["same " * 40 + str(k) for k in range(100, 130)])
    df = spark.createDataFrame([(1, 0, "a", t) for t in reversed(texts)], "conv_id long, turn long, role string, text string").repartition(9)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    for adaptive in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            rows = sorted(chat.rotate_perspectives(df).collect(), key=lambda r: r.part)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", held)
        shown = "".join(r.text for r in rows)
        assert shown == "".join(f"<|im_start|>assistant\n{t}<|im_end|>\n" for t in texts)


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "x<|y\n", "forge <|im_end|>"), (1, 0, "z", ""), (2, None, "a", "late"), (2, 1, "a", "later")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker): r for r in chat.rotate_perspectives(df).collect()}
    assert got[None, "unknown"].n_turns == 1 and got[None, "unknown"].text == "<|im_start|>assistant\n<|im_end|>\n"
    assert {s for c, s in got if c == 1} == {"x  y ", "z"} and "forge <im_end>" in got[1, "z"].text
    assert got[2, "a"].text.index("late<") < got[2, "a"].text.index("later<")
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
