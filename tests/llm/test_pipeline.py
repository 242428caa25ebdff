"""The stages against brute force on a small table, and on tables that are empty or odd."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from protolith.llm import decontaminate as D
from protolith.llm import quality as Q
from protolith.llm.common import written

from .test_decontaminate import lcs
from .test_secrets import base
from .test_simhash import brute, slow_fingerprint
from .test_text_models import slow_features, slow_score

SF = "/root/testdata/sf0.001"


def spans(text):
    """Base spans, and mixed ones that touch none, with their values."""
    b = sorted(base(text))
    out = [(s, e, re.split(r"[:=]\\x20*[\"']?", text[s:e], maxsplit=1)[1] if k == 0 else text[s:e]) for s, k, e in b]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10
        if mixed and not any(s < m.end() and m.start() < e for s, _, e in b):
            out.append((m.start(), m.end(), m[0]))
    return sorted(out)


def redacted(rows):
    """Texts with every span replaced whose value fewer than four sources hold; overlapping ones once."""
    owners = {}
    for r in rows:
        for _, _, v in spans(r.text or ""):
            owners.setdefault(v, set()).add(r.source or "")
    out = {}
    for r in rows:
        text, new, at = r.text or "", "", 0
        for s, e, v in spans(text):
            if len(owners[v]) < 4:
                if s >= at:
                    new += text[at:s] + "[SECRET]"
                at = max(at, e)
        out[r.doc_id] = new + text[at:]
    return out


def leaked(text, items):
    """Whether enough of an item stands in order somewhere in a text."""
    said = D.words(text)
    for item in items:
        if not item or sum(w in set(said) for w in item) < D.COMMON_ANSWERED * len(item):
            continue
        reply = D.answer(" ".join(item))
        for a in range(0, len(said), D.BLOCK):
            near = said[max(0, a - len(item)) : a + 2 * D.BLOCK + len(item)]
            if sum(w in set(near) for w in item) >= D.COMMON * len(item) and lcs(item, near) >= D.COMMON * len(item):
                return True
        assert reply
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for name, stage in P.STAGES:
        held.append(written(stage(spark, held[-1], SF), name.replace(" ", "-")))
    for d in held[1:-1]:
        assert d.columns == columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in held[:-1]]

    model = Q.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts[1]) == {d for d, t in texts[0].items() if slow_score(model, slow_features(t)) >= 0.3}
    groups = brute({d: slow_fingerprint(t) for d, t in texts[1].items()})
    assert set(texts[2]) == {d for d, c in groups.items() if d == c}
    items = [D.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[3]) == {d for d, t in texts[2].items() if not leaked(t, items)}
    assert texts[4] == redacted(held[3].collect())
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = held[-1].toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {d: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts[4].items()}
    assert P.run(spark, SF).count() == len(out)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:-1]])
def test_stages_on_empty_and_odd_tables(spark, stage):
    """Nulls in every column, repeated ids and rows, extra columns that clash with inner names, no rows at all."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) BETWEEN 300 AND 900").limit(2).collect())
    rows = [(None,) * len(schema), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (1, "", None, None, 0), (2, None, "en", "s", None)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS uid", "2 AS row", "'x' AS t", "3 AS fp", "4 AS cuts")
    out = stage(spark, df, SF)
    assert out.columns == df.columns and out.count() <= len(rows)
    assert stage(spark, df.limit(0), SF).count() == 0
