"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Base spans come from three patterns. Beside them, long mixed tokens are candidates.
The hash of every candidate value is counted over distinct repositories
(documents) and owners (sources): a value that several owners share is a widely copied
example; one that few own looks live. Live mixed tokens that no base span touches
are added as spans of kind ``owned``. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

# The patterns, and the kinds in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: Distinct owners from which a value counts as a widely copied example; distinct characters of a mixed token.
EXAMPLE_OWNERS, MIXED_CHARS = 4, 10

SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
#: Elements that a running total adds up at once; code points of a block when a text is cut.
STEP, BLOCK = 64, 4096


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside reads it."""
    return F.transform(F.array(value), body)[0]


_most, _fewest = (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))


def _running(values: Column, zero: int, merge) -> Column:
    """Running totals of an array of longs: of chunks first, then inside each chunk, so no step copies all that came before."""
    first = F.lit(zero).cast("bigint")

    def inside(chunks: Column, before: Column) -> Column:
        each = lambda c, j: F.transform(c, lambda _, i: merge(before[j], F.aggregate(F.slice(c, F.lit(1), i + 1), first, merge)))
        return F.flatten(F.transform(chunks, each))

    def chunked(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, first, merge))
        before = F.aggregate(totals, F.array(first), lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))
        return _let(before, lambda b: inside(chunks, b))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.transform(starts, lambda j: F.slice(v, j * STEP + 1, F.lit(STEP))), chunked))

    return _let(values, cut)


def _spans(text: Column, pattern: str, rank: int, value, keep) -> Column:
    """Leftmost non-overlapping matches in code points: running sums of the lengths of gaps and matches are the places. ``keep`` judges the value."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(w: Column) -> Column:
        steps = F.zip_with(F.slice(w["gaps"], F.lit(1), F.size(w["found"])), w["found"], lambda g, m: g + F.length(m))
        ends = _running(steps, 0, lambda a, b: a + b)
        one = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), value(m).alias("value"))
        return F.filter(F.zip_with(w["found"], ends, one), lambda x: keep(x["value"]))

    return F.when(text.rlike(pattern), _let(F.struct(gaps.alias("gaps"), found.alias("found")), placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, with their values. Runs of the ``access`` and ``hex`` characters are whole, so a least length in the pattern drops the same matches as a filter."""
    whole = lambda hit: hit
    secret = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    always = lambda hit: F.lit(True)
    return F.concat(
        _spans(text, ASSIGN, 0, secret, lambda found: F.length(found) >= 6),
        _spans(text, ACCESS, 1, whole, always),
        _spans(text, HEX, 2, whole, always),
    )


def mixed_spans(text: Column) -> Column:
    def keep(hit: Column) -> Column:
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= MIXED_CHARS)

    return _spans(text, MIXED, 3, lambda hit: hit, keep)


def _with_free(base: Column, mixed: Column) -> Column:
    """Base spans and the mixed ones that touch none of them, by start.

    By start, a mixed span touches a base span if one before it ends behind its start or the next one starts
    before its end: a running maximum and, backwards, a running minimum, in place of a look at every pair.
    """

    def marked(both: Column) -> Column:
        ends = _running(F.transform(both, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(-1)), -1, _most)
        far = (1 << 62) - 1
        starts = F.reverse(_running(F.reverse(F.transform(both, lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(far))), far, _fewest))
        around = F.zip_with(ends, starts, lambda e, n: F.struct(e.alias("e"), n.alias("n")))
        free = F.zip_with(both, around, lambda s, w: F.when((s["rank"] < 3) | ((w["e"] <= s["start"]) & (w["n"] >= s["end"])), s))
        return F.filter(free, lambda s: s.isNotNull())

    both = F.array_sort(F.concat(base, mixed))
    return F.when(F.size(mixed) == 0, F.array_sort(base)).when(F.size(base) == 0, mixed).otherwise(_let(both, marked))


def _ownership(found: DataFrame, owners: int) -> DataFrame:
    """``hash``, ``example``: whether at least ``owners`` owners hold the value. Counted in steps, so no value's rows meet in one task."""
    each = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).select("hash", "repos", "owners", (F.col("owners") >= owners).alias("example"))


def _candidates(rows: DataFrame) -> DataFrame:
    """``uid``, ``repo``, ``owner`` and the hashed ``spans`` of rows of ``uid``, ``repo``, ``owner`` and ``t``."""
    found = rows.withColumns({"base": base_spans(F.col("t")), "mixed": mixed_spans(F.col("t"))})
    hashed = F.transform(_with_free(F.col("base"), F.col("mixed")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    return found.select("uid", "repo", "owner", hashed.alias("spans"))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _judged(found: DataFrame, owners: int) -> DataFrame:
    """``uid``, ``spans`` in order, each with ``example``."""
    flat = written(found.where(F.size("spans") > 0).select("uid", "repo", "owner", F.inline("spans")), "candidates")
    verdict = written(_ownership(flat, owners), "owners")
    one = F.struct("start", "rank", "end", "example", "owners", "repos")
    return flat.join(verdict, "hash").groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Spans of secrets in every text.

    Returns per row ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the base
    spans as ``kind:start:end``, comma-joined), ``spans`` (those and the added ``owned`` ones), and the
    split by ownership: ``n_live`` and ``n_example`` spans, ``max_owners`` of any value found.

    Work in a text is near linear in its matches. Null and empty texts have no spans. Repeated rows are scanned each and count as one
    repository. Null owners are one owner. Other columns are not read; an empty table gives
    an empty result.
    """
    owner = _text(F.col(owner_col)) if owner_col else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("repo"), owner.alias("owner"), _text(F.col(text_col)).alias("t"))
    found = written(_candidates(rows), "scanned")
    judged = found.select("uid", "repo", F.size("spans").alias("size"))
    none = judged.where("size = 0").select("repo", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,example:boolean,owners:bigint,repos:bigint>>").alias("spans"))
    some = judged.where("size > 0").join(_judged(found, owners), "uid").select("repo", "spans")
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    of_kind = lambda k: count(lambda s: s["rank"] == k).alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    shown = F.filter("spans", lambda s: (s["rank"] < 3) | ~s["example"])
    return some.unionByName(none).select(
        F.col("repo").alias("doc_id"),
        *map(of_kind, range(3)),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(shown).alias("spans"),
        count(lambda s: ~s["example"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).alias("max_owners"),
    )


def _merged(spans: Column) -> Column:
    """Spans, by start, that overlap as one: a span opens a run if it starts at or behind all earlier ends."""

    def opened(v: Column) -> Column:
        return _let(_running(F.transform(v, lambda s: s["end"]), -1, _most), lambda ends: runs(v, ends))

    def runs(v: Column, ends: Column) -> Column:
        firsts = F.filter(F.transform(v, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        one = lambda f: lambda i, j: F.struct(v[i]["start"].alias("start"), F.when(j + 1 < F.size(f), F.get(ends, F.get(f, j + 1) - 1)).otherwise(F.element_at(ends, -1)).alias("end"))
        return _let(firsts, lambda f: F.transform(f, one(f)))

    return _let(spans, opened)


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with separate ``spans`` replaced by ``mark``. Pieces are cut from blocks, so that no cut walks the text from its start."""

    def joined(w: Column) -> Column:
        n = F.size(w["spans"])

        def piece(j: Column) -> Column:
            a = F.when(j == 0, F.lit(0).cast("bigint")).otherwise(F.get(w["spans"], j - 1)["end"])
            b = F.when(j == n, w["size"]).otherwise(F.get(w["spans"], j)["start"])
            return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: between(x["a"], x["b"]))

        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            at = (a % BLOCK + 1).cast("int")
            one = F.substring(F.get(w["blocks"], first), at, (b - a).cast("int"))
            more = F.concat(
                F.substring(F.get(w["blocks"], first), at, F.lit(BLOCK)),
                F.array_join(F.slice(w["blocks"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.substring(F.get(w["blocks"], last), F.lit(1), ((b - 1) % BLOCK + 1).cast("int")),
            )
            return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(more)

        return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(F.struct(blocks.alias("blocks"), spans.alias("spans"), F.length(text).cast("bigint").alias("size")), joined)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", owners: int = EXAMPLE_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each live-looking span replaced by ``mark``; widely copied examples stay as they are.

    Overlapping spans are replaced once. ``n_chars``, where it exists, follows the new text. All rows and
    columns are kept, null and repeated ids too; null texts stay null; an empty table stays empty. Only the spans of
    changed rows are joined back, broadcast while they are small.
    """
    rows = numbered(docs)
    field = lambda c: F.col("row").getField(c)
    owner = _text(field(owner_col)) if owner_col else F.lit("")
    found = written(_candidates(rows.select("uid", field(id_col).alias("repo"), owner.alias("owner"), _text(field(text_col)).alias("t"))), "scanned")
    live = _judged(found, owners).select("uid", F.filter("spans", lambda s: ~s["example"]).alias("spans")).where(F.size("spans") > 0)
    cuts = written(live.select("uid", _merged(F.col("spans")).alias("cuts")), "cuts")
    both = rows.join(cuts, "uid", "left").withColumn("new", F.when(F.col("cuts").isNull(), field(text_col)).otherwise(_replaced(field(text_col).cast("string"), F.col("cuts"), mark)))
    size = lambda c, t: F.when(F.col("cuts").isNull(), field(c)).otherwise(F.length("new").cast(t))
    return both.select(*(F.col("new").alias(c) if c == text_col else size(c, t).alias(c) if c == "n_chars" else field(c).alias(c) for c, t in docs.dtypes))


def oracle() -> str:
    """The same for DuckDB."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(f"SELECT uid, doc_id, owner, {k} AS kind, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}) AS h FROM d" for k, p in enumerate((ASSIGN, ACCESS, HEX, MIXED)))
    names = "['assign', 'access', 'hex', 'owned']"
    shown = f"{names}[kind + 1] || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
f AS (SELECT uid, doc_id, owner, kind, g, h, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
p AS (SELECT uid, doc_id, owner, kind, h[i] AS hit,
             CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM f),
v AS (SELECT *, a + length(hit) AS b, CASE WHEN kind = 0 THEN regexp_extract(hit, {quoted(ASSIGN)}, 2) ELSE hit END AS value FROM p),
k AS (SELECT * FROM v WHERE CASE kind WHEN 0 THEN length(value) >= 6
        WHEN 3 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND len(list_distinct(string_split(hit, ''))) >= {MIXED_CHARS} ELSE true END),
s AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k AS o WHERE o.uid = k.uid AND o.kind < 3 AND o.a < k.b AND k.a < o.b)),
w AS (SELECT value, count(DISTINCT owner) AS owners FROM s GROUP BY value),
x AS (SELECT s.*, owners, owners >= {EXAMPLE_OWNERS} AS example FROM s JOIN w ON s.value = w.value),
r AS (SELECT uid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             coalesce(string_agg({shown}, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '') AS base,
             coalesce(string_agg({shown}, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR NOT example), '') AS spans,
             count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example, max(owners) AS max_owners
      FROM x GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners
FROM d LEFT JOIN r ON d.uid = r.uid"""
