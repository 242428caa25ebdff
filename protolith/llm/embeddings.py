"""Embedding near-duplicates as an exact metric range join.

On unit vectors, cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). Pivots cut
the space into cells of nearest pivot. With q the home pivot of y, the function
(|z-p|^2 - |z-q|^2) / (2 |p-q|) has slope one, so by the triangle inequality y can lie
within r of a member of cell p only if its value at y is at most r: exactly
those cells get y as a guest. Each home vector then meets all its partners in
its own cell, cells are joined independently, and each link is counted once.

Large cells are joined in pairs of bounded blocks. A block sends out counts
and the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written
from .simhash import _union

#: Vectors of one block of a cell; vectors for each pivot, and the bounds of their number.
BLOCK, PER_PIVOT, PIVOTS = 2048, 1000, (8, 2048)
#: Guest cells of a vector, on average, up to which more pivots are worth their copies.
GUESTS = 8.0
SLACK = 1e-9
#: Least distance between pivots, so that rounding in (..) / (2 |p-q|) stays under the slack.
APART = 1e-3


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists, scaled to length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _cells(pivots: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[list[int]]]:
    """Home cell and guest cells of each row."""
    step = max(1, (1 << 21) // len(pivots))  # rows at once: three matrices of 16 MB
    if len(x) > step:
        parts = [_cells(pivots, x[k : k + step], radius) for k in range(0, len(x), step)]
        return np.concatenate([h for h, _ in parts]), [g for _, gs in parts for g in gs]
    near = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = near.argmin(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        over = (near - near[np.arange(len(x)), home][:, None]) / (2 * apart)
    guest = over <= radius + SLACK
    guest[np.arange(len(x)), home] = False
    return home, [np.nonzero(g)[0].tolist() for g in guest]


def _distinct(pivots: np.ndarray) -> np.ndarray:
    """The pivots without those that nearly equal an earlier one: multiples of one vector are distinct classes of one direction."""
    kept: list[int] = []
    for k, p in enumerate(pivots):
        if not kept or (pivots[kept] @ p).max() < 1 - APART**2 / 2:
            kept.append(k)
    return pivots[kept]


def _enough(pivots: np.ndarray, radius: float) -> np.ndarray:
    """The largest doubling of the pivots whose boundary copies stay few on the sample itself.

    Where vectors fill many dimensions evenly, cells have wide boundaries and more pivots only
    add copies; blocks then share out the larger cells. The result is exact for any choice.
    """
    n = PIVOTS[0]
    while 2 * n <= len(pivots):
        rest = pivots[2 * n :] if len(pivots) > 2 * n else pivots
        if np.mean([len(g) for g in _cells(pivots[: 2 * n], rest, radius)[1]]) > GUESTS:
            break
        n *= 2
    return pivots[:n]


def _join(t: pa.Table, threshold: float) -> pa.Table:
    """Counts and spanning links of one pair of blocks."""
    x = _unit(t.column("v").combine_chunks())
    uid, n = (t.column(c).to_numpy() for c in ("uid", "n"))
    home, other = t.column("home").to_numpy(), t.column("ref").to_numpy()
    h, r = np.nonzero(home)[0], np.nonzero(other)[0]
    s = x[h] @ x[r].T
    link = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) <= SLACK)
    if len(i):
        raw = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        link[i, j] = _exact(raw[h[i]], raw[r[j]]) >= threshold
    link &= uid[h][:, None] != uid[r][None, :]
    count = link @ n[r]
    i, j = np.nonzero(link)
    label = _union(np.arange(len(x)), h[i], r[j]) if len(i) else np.arange(len(x))
    child = np.nonzero(label != np.arange(len(x)))[0]
    some = np.nonzero(count)[0]
    a, b = len(some), len(child)
    return pa.table({
        "uid": pa.concat_arrays([pa.array(uid[h[some]]), pa.nulls(b, pa.int64())]),
        "n": pa.concat_arrays([pa.array(count[some]), pa.nulls(b, pa.int64())]),
        "u": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(uid[child])]),
        "v": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(uid[label[child]])]),
    })


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK) -> DataFrame:
    """Links of cosine >= ``threshold`` between vectors with equal labels.

    Returns per row ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable, its own included) and ``kept`` (``vec_id = component_id``).

    Rows with a null label, a null, empty or zero vector or a null or non-finite component link
    with nothing; so do vectors of different lengths. Equal vectors of a label are one
    class for the search and count as links of each other. A row without an id links like any other;
    its component is named by the smallest id in it, or null if it has none. Rows that repeat an id are vectors each. With
    ``label_col=None`` all rows may link. Other columns are not read; empty gives empty.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    v = F.col(vector_col).cast("array<double>")
    usable = label.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("ok"))
    rows = rows.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(7), "v", "label")})
    classes = written(
        rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )
    size = classes.count()
    wanted = min(max(PIVOTS[0], size // PER_PIVOT), PIVOTS[1])
    chosen: dict[int, list] = {}
    for r in classes.select("v").orderBy(F.xxhash64("k1", "k2"), "uid").limit(wanted).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    pivots = {d: _enough(_distinct(_unit(pa.array(p, pa.list_(pa.float64())))), radius) for d, p in chosen.items()}

    def assign(batches):
        for b in batches:
            column, dims = b.column("v"), b.column("v").value_lengths().to_numpy()
            home, guests = np.zeros(len(dims), np.int64), [[]] * len(dims)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                if d in pivots:
                    home[at], found = _cells(pivots[d], _unit(column.take(pa.array(at))), radius)
                    for k, g in zip(at, found, strict=True):
                        guests[k] = g
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(guests, pa.list_(pa.int32())), pa.array(dims, pa.int32())], names=[*b.schema.names, "cell", "guests", "dims"])

    schema = "uid long, n long, label string, v array<double>, cell int, guests array<int>, dims int"
    placed = written(classes.select("uid", "n", "label", "v").mapInArrow(assign, schema), "placed")
    cell = ["label", "dims", "cell"]
    homes = placed.groupBy(*cell).agg(F.count("*").alias("h"))
    guests = placed.select("label", "dims", F.explode("guests").alias("cell")).groupBy(*cell).agg(F.count("*").alias("g"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = written(
        homes.join(guests, cell, "left").select(*cell, blocks(F.col("h")).alias("nh"), blocks(F.col("h") + F.coalesce("g", F.lit(0))).alias("nr")), "cells"
    )
    members = placed.select("uid", "n", "v", "label", "dims", F.col("cell").alias("own"), F.explode(F.concat(F.array("cell"), "guests")).alias("cell"))
    pick = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    is_home = F.col("own") == F.col("cell")
    at = lambda i, j, home, ref: F.struct(i.alias("i"), j.alias("j"), home.alias("home"), ref.alias("ref"))
    no, yes = F.lit(False), F.lit(True)
    tasks = F.when((F.col("nh") == 1) & (F.col("nr") == 1), F.array(at(F.lit(0), F.lit(0), is_home, yes))).otherwise(
        F.concat(
            F.when(is_home, F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: at(pick("nh"), j, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,home:boolean,ref:boolean>>")),
            F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: at(i, pick("nr"), no, yes)),
        )
    )
    met = members.join(sizes, cell).select("uid", "n", "v", *cell, F.inline(tasks))
    found = written(met.groupBy(*cell, "i", "j").applyInArrow(lambda t: _join(t, threshold), "uid long, n long, u long, v long"), "found")
    parts = connected_components(found.where("u is not null").select("u", "v"))
    counts = found.where("uid is not null").groupBy("uid").agg(F.sum("n").alias("others"))
    grouped = written(
        classes.select("k1", "k2", "uid", "rep", F.col("n").alias("same")).join(counts, "uid", "left").join(parts, F.col("uid") == F.col("node"), "left")
        .select("k1", "k2", "rep", (F.coalesce("others", F.lit(0)) + F.col("same") - 1).alias("n_links"), "component"),
        "classes",
    )
    least = grouped.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    result = written(grouped.join(least, "component", "left").select("k1", "k2", "n_links", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")), "linked")
    linked = rows.where("ok").select("vec_id", "k1", "k2").join(result, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same for DuckDB, over all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON v.vec_id = comp.x LEFT JOIN n ON v.vec_id = n.x"""
