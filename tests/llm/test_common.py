import os
import random

from protolith.llm.common import clear_written, connected_components, shared_dir, written


def brute(edges):
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, k) for k in range(5001, 5300)]
    loose = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)]
    for edges in (chain + star + loose + [(7, 7), (None, 3), (9, None)], [(2, 1)], []):
        df = spark.createDataFrame(edges, "u long, v long")
        rows = connected_components(df).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == brute(edges)
        place = f"{shared_dir(spark)}/protolith"
        assert not [x for x in os.listdir(place) if x.startswith("scratch")]  # the rounds leave nothing


def test_written_and_cleared(spark):
    df = written(spark.range(5).toDF("x"), "numbers")
    assert sorted(r.x for r in df.collect()) == [0, 1, 2, 3, 4] and "protolith/numbers-" in df.inputFiles()[0]
    place = df.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
    assert shared_dir(spark) in place and os.path.isdir(place)
    clear_written(spark)
    assert not os.path.exists(place)
