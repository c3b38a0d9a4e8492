"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents with the same set of sources form one pattern. Flow goes from the
patterns' tokens to their sources' quotas; the k-th use of a token costs k - 1,
so that repetition is spread as evenly as the quotas allow. Each pattern then
takes whole copies of all its documents, and one copy more of the first ones in
a seeded order, up to the flow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.shared import written

REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct sets of sources that the driver solves the flow for (a row each); more raise an error rather than being dropped.
MAX_PATTERNS = 250_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: Sequence[int], weights: Sequence[int], total: int, repeats: int = REPEATS) -> list[float]:
    """Shares of total by weight; a share stops at repeats times the source's size, and the others share the excess by weight."""
    caps = [repeats * n for n in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, heft = total, sum(weights)
    out = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if caps[i] * heft >= left * weights[i]:
            for j in order[at:]:
                out[j] = weights[j] * left / heft
            break
        out[i] = float(caps[i])
        left -= caps[i]
        heft -= weights[i]
    return out


def min_cost_flow(supply: Sequence[int], members: Sequence[Sequence[int]], demand: Sequence[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each of its sources: the largest flow, at the least cost of repetition.

    A path from the root costs what its first arc costs (the copy that the pattern offers), as all other arcs are free
    both ways. So successive cheapest paths are those of the first copies, then of the second ones, and so on, and each
    of these layers is a largest flow, found in blocking flows over shortest paths. A pattern that can't reach the
    sink in one layer can't in a later one either, so that only patterns used up offer their next copy.
    """
    sent: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    users: list[list[int]] = [[] for _ in demand]
    for i, m in enumerate(members):
        for j in m:
            users[j].append(i)
    room = [int(d) for d in demand]
    for _ in range(repeats):
        left = list(supply)
        while True:
            # distance from the sink: odd for sources, even for patterns (whose flow a source can send back)
            far_s = [1 if r > 0 else 0 for r in room]
            far_p = [0] * len(supply)
            edge = [j for j, r in enumerate(room) if r > 0]
            reached = False
            while edge and not reached:
                found = []
                for j in edge:
                    for i in users[j]:
                        if not far_p[i]:
                            far_p[i] = far_s[j] + 1
                            found.append(i)
                reached = any(left[i] for i in found)
                edge = []
                for i in found:
                    for j, n in sent[i].items():
                        if n and not far_s[j]:
                            far_s[j] = far_p[i] + 1
                            edge.append(j)
            if not reached:
                break
            at_p, at_s = [0] * len(supply), [0] * len(demand)
            for start in [i for i, n in enumerate(left) if n and far_p[i]]:
                while left[start] and (path := _path(start, members, users, sent, room, far_p, far_s, at_p, at_s)):
                    amount = min(left[start], room[path[-1]], *(sent[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)))
                    for k in range(0, len(path) - 1, 2):
                        sent[path[k]][path[k + 1]] += amount
                        if k:
                            sent[path[k]][path[k - 1]] -= amount
                    room[path[-1]] -= amount
                    left[start] -= amount
    return [{j: n for j, n in x.items() if n} for x in sent]


def _path(start: int, members: Sequence[Sequence[int]], users: list[list[int]], sent: list[dict[int, int]], room: list[int], far_p: list[int], far_s: list[int], at_p: list[int], at_s: list[int]) -> list[int] | None:
    """The next path pattern, source, pattern, ... that falls by one at each step; at_p and at_s are how far arcs were tried."""
    path = [start]
    while True:
        here = path[-1]
        if len(path) % 2:  # at a pattern
            while at_p[here] < len(members[here]):
                j = members[here][at_p[here]]
                if far_s[j] and far_s[j] == far_p[here] - 1:
                    break
                at_p[here] += 1
            else:
                path.pop()
                if not path:
                    return None
                at_s[path[-1]] += 1
                continue
            path.append(j)
        else:  # at a source
            if far_s[here] == 1:
                if room[here] > 0:
                    return path
            else:
                while at_s[here] < len(users[here]):
                    i = users[here][at_s[here]]
                    if far_p[i] and far_p[i] == far_s[here] - 1 and sent[i].get(here, 0) > 0:
                        break
                    at_s[here] += 1
                else:
                    i = -1
                if i >= 0 and at_s[here] < len(users[here]):
                    path.append(i)
                    continue
            path.pop()
            at_p[path[-1]] += 1


def mix(docs: DataFrame, sources: str = "sources", weights: Sequence[int] = (5, 2, 1), repeats: int = REPEATS, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """The columns carry of docs, and doc_id, sources, size, source_size, target, taken of every row of docs.

    docs: doc_id, size (tokens; null or negative: 0) and an array of the
    sources that the document belongs to. A null array or an empty one is the
    source null. Sources, by code point and null last, weigh weights,
    repeating; they share the size of all documents. source_size and target are
    sums over the document's sources. taken is a multiple of size, at most
    repeats times it. Equal seeds give equal results; the order is that of
    md5(doc_id:seed), then of size (rows that agree in both are alike). Without
    any token all targets are 0. Repeated rows and null ids count like any other; other columns than carry are dropped.
    """
    spark = docs.sparkSession
    of = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.col(sources)).otherwise(F.array(F.lit(None).cast("string")))))
    sized = docs.select(*carry, "doc_id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"), of.alias("sources"))
    sized = written(sized.withColumn("pattern", F.to_json("sources")), "sizes")
    # a wholly null array of one is written as [null] by to_json, a source "null" as ["null"]
    patterns = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns.sort(key=lambda r: r.pattern)
    names = sorted({x for r in patterns for x in r.sources}, key=lambda x: (x is None, (x or "").encode()))
    place = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for x in r.sources:
            sizes[place[x]] += r.n
    heft = [weights[i % len(weights)] for i in range(len(names))]
    targets = [round(t, 6) for t in quotas(sizes, heft, sum(r.n for r in patterns), repeats)]
    flow = min_cost_flow([r.n for r in patterns], [[place[x] for x in r.sources] for r in patterns], [int(t) for t in targets], repeats)
    plan = []
    for r, f in zip(patterns, flow, strict=True):
        whole, rest = divmod(sum(f.values()), r.n) if r.n else (0, 0)
        plan.append((r.pattern, sum(sizes[place[x]] for x in r.sources), float(sum(targets[place[x]] for x in r.sources)), whole, rest))
    table = F.broadcast(spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long, rest long"))  # MAX_PATTERNS rows at most

    ordered = sized.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))).withColumn("bucket", F.substring("key", 1, 3))
    # sums of 4096 buckets for a pattern tell the one bucket in which the extra copies end
    sums = ordered.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.withColumn("before", F.coalesce("before", F.lit(0))).join(table.select("pattern", "rest"), "pattern")
    last = sums.where("before < rest and before + n > rest").select("pattern", F.col("bucket").alias("last"), "before")
    full = sums.where("before + n <= rest").groupBy("pattern").agg(F.max("bucket").alias("full"))
    ends = table.join(last, "pattern", "left").join(full, "pattern", "left")
    rows = ordered.join(F.broadcast(ends), "pattern")
    inside = F.col("last").isNotNull() & (F.col("bucket") == F.col("last"))
    order = Window.partitionBy("pattern").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(inside).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("more", (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("long"))
    sure = rows.where(~inside).withColumn("more", F.coalesce(F.col("bucket") <= F.col("full"), F.lit(False)).cast("long"))
    return sure.unionByName(cut).select(*carry, "doc_id", "sources", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))


#: The SQL of op8: documents have one source each, so that a pattern's flow is its source's target.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS w, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM sources
), stepped AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS money,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS heft
  FROM weighed WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), met AS (
  SELECT *, cap * heft >= money * w AS open FROM stepped
), level AS (
  SELECT arg_min(money, (CAST(cap AS DOUBLE) / w, i)) AS money, arg_min(heft, (CAST(cap AS DOUBLE) / w, i)) AS heft FROM met WHERE open
), quota AS (
  SELECT m.source, m.source_size, round(CASE WHEN open THEN CAST(m.w * l.money AS DOUBLE) / CAST(l.heft AS DOUBLE) ELSE CAST(cap AS DOUBLE) END, 6) AS target FROM met m, level l
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) % source_size ELSE 0 END AS rest FROM quota
), ordered AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ordered
"""
