import math

import numpy as np
import pytest

from protolith.llm import embeddings as M
from protolith.llm import queries


def brute(rows, threshold=0.98):
    """(links, component) of each row by all pairs."""
    ok = [lab is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    k = len(rows)
    link = np.zeros((k, k), bool)
    for a in range(k):
        for b in range(k):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                link[a, b] = unit[a] @ unit[b] >= threshold
    comp = [r[0] for r in rows]
    for _ in range(k):
        for a in range(k):
            for b in np.flatnonzero(link[a]):
                comp[a] = min((x for x in (comp[a], comp[b]) if x is not None), default=None)
    return sorted(((r[0], int(link[a].sum()), comp[a]) for a, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [3, 2048])
def test_join_matches_brute_force(spark, block):
    rng = np.random.RandomState(3)
    rows, k = [], 0
    for _ in range(12):
        center = rng.randn(8)
        for _ in range(rng.randint(1, 9)):
            rows.append((k, (center + 0.06 * rng.randn(8)).tolist(), int(rng.randint(2))))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, None, 0), (k + 3, [0.0] * 8, 0), (k + 4, [1.0, None], 0), (k + 5, [math.nan, 1.0], 0), (k + 6, [math.inf], 0), (k + 7, [1.0], None), (k + 8, [1.0], 5), (k + 9, [3.0], 5), (k + 10, [], 5), (k + 11, [1e300] * 8, 9), (k + 12, [1e-300] * 8, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS cell", "2 AS rep")
    got = M.near_duplicates(df, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(((r[0], *x) for r, x in zip(rows, expected(rows), strict=True)), key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert M.near_duplicates(df.limit(0)).count() == 0


def expected(rows):
    """Brute force on vectors scaled by their largest component, so that squares neither overflow nor vanish."""
    scaled = [(i, None if v is None else [x if x is None or not math.isfinite(x) or not x else x / max(abs(y) for y in v if y is not None and math.isfinite(y)) for x in v], lab) for i, v, lab in rows]
    by = {r[0]: r[1:] for r in brute(scaled)}
    return [by[r[0]] for r in rows]


def test_null_ids_as_roots_and_bridges(spark):
    """Vectors a small turn apart, so that only neighbours link."""
    turn = [[math.cos(0.15 * k), math.sin(0.15 * k)] for k in range(6)]
    for ids, want in (((4, None, 9, None, 2, 3), 2), ((None, 7, None, None, 8, 9), 7), ((None,) * 6, None)):
        rows = [(i, v, 1) for i, v in zip(ids, turn)] + [(50, [-1.0, 0.1], 1), (None, [0.1, -1.0], 1)]
        got = M.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        shown = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)
        links = (1, 2, 2, 2, 2, 1)
        assert shown == sorted([(i, n, want) for i, n in zip(ids, links)] + [(50, 0, 50), (None, 0, None)], key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.op3_embedding_join(spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_multiples_of_one_vector_all_link(spark):
    rng = np.random.RandomState(4)
    one = rng.randn(64)
    rows = [(k, (one * f).astype(np.float32).tolist(), 0) for k, f in enumerate(rng.uniform(0.1, 9, 300))]
    got = M.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.n_links, r.component_id) for r in got] == [(299, 0)] * 300
