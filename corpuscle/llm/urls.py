"""URL filters: stated host and path rules, and association rules mined from labelled URLs.

Spark's FP-growth finds the frequent combinations of URL tokens and labels.
A combination becomes a rule for a label if its support and confidence are high
enough and no part of it says the same as surely. A URL is matched through an
inverted index that lists each rule under the rarest of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "\x01"  # begins the item that stands for a label
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE = 0.002, 0.8
#: The most tokens of a rule. With the support it bounds the number of combinations, whatever the number of rows: those of a URL by the support.
MAX_TOKENS = 4
#: Host labels (from the right) and path parts (from the left) that become tokens with their place; deeper ones are tokens without it.
HOST_TOKENS, PATH_TOKENS = 4, 3


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null and where :// is missing."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. Equally long ones count in their order."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: all labels of its host by place from the right, all parts of its path, all keys of its query. Parts with a digit become one token."""
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = lambda x: F.when(x.rlike("[0-9]"), F.lit("#")).otherwise(x)
    from_host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.when(i < HOST_TOKENS, i.cast("string")).otherwise("+"), F.lit(":"), plain(x)))
    from_path = F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.when(i < PATH_TOKENS, i.cast("string")).otherwise("+"), F.lit(":"), plain(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(from_host), from_path, keys))


@dataclass(frozen=True)
class Rule:
    items: frozenset[str]
    verdict: str
    support: int
    confidence: float


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[list[Rule], dict[str, str]]:
    """Rules from labelled (array column tokens, string column label), the surest first; ties by support, length and tokens.

    Frequent tokens that always occur together count as one, named by the first of them (the second result names it for the
    others): so that a long run of them isn't mined in all its parts. Rows without tokens or label don't count; no rows give no rules.
    """
    rows = labelled.where("label is not null and size(tokens) > 0").select("tokens", F.concat(F.lit(LABEL), "label").alias("label")).persist()
    try:
        n = rows.count()
        if not n:
            return [], {}
        each = rows.withColumn("row", F.monotonically_increasing_id()).select(F.xxhash64("row").alias("row"), F.explode("tokens").alias("token"))
        kinds = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("row").alias("rows")).where(F.col("n") >= support * n)
        kinds = kinds.groupBy("n", "rows").agg(F.array_sort(F.collect_list("token")).alias("t")).where("size(t) > 1").select("t").collect()  # frequent tokens: those of a URL by the support
        twins = {x: r.t[0] for r in kinds for x in r.t[1:]}
        alone = F.array_except("tokens", F.array(*map(F.lit, sorted(twins)))) if twins else F.col("tokens")
        items = rows.select(F.concat(alone, F.array("label")).alias("items"))
        found = FPGrowth(itemsCol="items", minSupport=support, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(items).freqItemsets
        taken = found.where(F.size("items") <= MAX_TOKENS + F.exists("items", lambda x: x.startswith(LABEL)).cast("int")).collect()
    finally:
        rows.unpersist()
    return rules_of({frozenset(r["items"]): r.freq for r in taken}, confidence), twins


def rules_of(freq: dict[frozenset[str], int], confidence: float) -> list[Rule]:
    """The pruned rules of frequent combinations: only one label on the right, and nothing that a part of the left side says as surely."""
    made: dict[tuple[str, frozenset[str]], Rule] = {}
    for items, n in sorted(freq.items(), key=lambda x: len(x[0])):
        labels = [x for x in items if x.startswith(LABEL)]
        left = items - set(labels)
        if len(labels) != 1 or not left or n / freq[left] < confidence:
            continue
        rule = Rule(left, labels[0][1:], n, n / freq[left])
        smaller = (made.get((rule.verdict, left - {x})) for x in left) if len(left) > 1 else ()
        # a part that was pruned itself has a part that says it as surely
        if any(r and r.confidence >= rule.confidence for r in smaller):
            made[rule.verdict, left] = next(r for x in left if (r := made.get((rule.verdict, left - {x}))) and r.confidence >= rule.confidence)
        else:
            made[rule.verdict, left] = rule
    kept = {r for r in made.values()}
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, len(r.items), sorted(r.items), r.verdict))


class Index:
    """Rules by the rarest of their tokens."""

    def __init__(self, rules: Sequence[Rule], twins: dict[str, str] | None = None) -> None:
        self.rules, self.twins = rules, twins or {}
        seen: dict[str, int] = {}
        for r in rules:
            for x in r.items:
                seen[x] = seen.get(x, 0) + 1
        self.lists: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.lists.setdefault(min(r.items, key=lambda x: (seen[x], x)), []).append(i)

    def match(self, items: Sequence[str]) -> Rule | None:
        """The first rule, in their order, all of whose tokens occur."""
        have = {self.twins.get(x, x) for x in items}
        hits = (next((i for i in self.lists.get(x, ()) if self.rules[i].items <= have), None) for x in have)
        best = min((i for i in hits if i is not None), default=None)
        return None if best is None else self.rules[best]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined of every row of pages (page_id, url).

    A stated rule decides where one fits. The URLs it decides are the labelled
    ones from which association rules are mined; the first of those that matches
    decides the others, else default does. mined is the matching rule's tokens (null: none). A null or malformed URL
    has an empty host and path, no rule and the default. URLs count in all their length: each label, part and key is a
    token. Repeated rows stay; other columns, of any name, are dropped.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", stated_rule(F.col("host"), F.col("path"), rules).alias("stated"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    learned = mine(rows.where("stated is not null").select("tokens", F.col("stated.verdict").alias("label")), support, confidence)
    state = pages.sparkSession.sparkContext.broadcast(learned)  # bounded by support and MAX_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*state.value)
        known: dict[tuple[str, ...], tuple[str, str | None]] = {}
        for batch in batches:
            verdicts, mined = [], []
            for stated, items in zip(column(batch, "verdict").to_pylist(), column(batch, "tokens").to_pylist(), strict=True):
                if stated is not None:
                    verdicts.append(stated), mined.append(None)
                    continue
                key = tuple(items)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    rule = index.match(items)
                    known[key] = (rule.verdict, " ".join(sorted(rule.items))) if rule else (default, None)
                verdicts.append(known[key][0]), mined.append(known[key][1])
            cols = [column(batch, x) for x in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(verdicts, pa.string()), pa.array(mined, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    flat = rows.select("page_id", "host", "path", F.col("stated.rule").alias("rule"), F.col("stated.verdict").alias("verdict"), "tokens")
    return flat.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string")
