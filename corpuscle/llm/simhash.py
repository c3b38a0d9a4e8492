"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, so that
neighbours differ in few bits. Runs of neighbours form the nodes of a tree; a
node holds the bits that all below it share, of which those its parent holds
already are masked out. A search adds up the differing shared bits on its way
down and drops a whole group once they exceed the limit.

On a cluster the upper nodes are ranges of Gray rank, cut from the counts of
2**PREFIX leading patterns (a table of fixed size). A fingerprint travels to
the ranges whose leading patterns lie within the limit, and is compared in
each with the tree of that range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import column, connected, one_of_each, tidy, written

SEED, SHINGLE, PREFIX, FANOUT = 42, 3, 16, 8
#: Ranges of Gray rank (there are fewer when they would hold under LEAST_ROWS fingerprints, and more when they
#: would hold over RANGE_ROWS). A range is never cut inside a leading pattern.
RANGES, LEAST_ROWS, RANGE_ROWS = 64, 100, 50_000
#: Couples of fingerprint and node that are looked at together.
FRONTIER = 2_000_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64 majority bits over the hashes of the word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    runs = zip(*(words[k:] for k in range(size)), strict=False)
    n = len(words) - size + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fp) of every row; fp is the fingerprint as a signed long, digest a hash of the text. A null text counts as empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), size) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "digest"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, fp long")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The position in the reflected Gray code."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_prefix(fp: Column) -> Column:
    """The leading PREFIX bits of the Gray rank; they depend on as many leading bits of fp alone."""
    x = F.shiftrightunsigned(fp, 64 - PREFIX)
    for shift in (1, 2, 4, 8):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.cast("int")


class GrayTree:
    """The hierarchical index over distinct fingerprints."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps[np.argsort(gray_rank(fps))]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # own mask and pattern of the nodes, leaves first
        both, any_ = self.fps, self.fps
        shared = [np.full(len(fps), ~np.uint64(0))]
        patterns = [self.fps]
        while len(both) > FANOUT:
            at = np.arange(0, len(both), FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
            shared.append(~(both ^ any_))
            patterns.append(both)
        for k, (mask, pattern) in enumerate(zip(shared, patterns, strict=True)):
            above = np.repeat(shared[k + 1], FANOUT)[: len(mask)] if k + 1 < len(shared) else np.uint64(0)
            self.levels.append((mask & ~above, pattern))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in queries, places in self.fps) of all couples with at most limit differing bits, in portions."""
        top = len(self.levels[-1][0])
        if not top:
            return
        step = max(1, FRONTIER // (top * 512))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            stack = [(len(self.levels) - 1, np.repeat(q, top), np.tile(np.arange(top), len(q)), np.zeros(len(q) * top, np.uint8))]
            while stack:
                level, qi, node, acc = stack.pop()
                if len(qi) > FRONTIER:
                    half = len(qi) // 2
                    stack += [(level, qi[:half], node[:half], acc[:half]), (level, qi[half:], node[half:], acc[half:])]
                    continue
                mask, pattern = self.levels[level]
                acc = acc + np.bitwise_count((queries[qi] ^ pattern[node]) & mask[node])
                ok = np.flatnonzero(acc <= limit)
                qi, node, acc = qi[ok], node[ok], acc[ok]
                if not level:
                    yield qi, node
                elif len(qi):
                    below = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    qi, acc = np.repeat(qi, FANOUT), np.repeat(acc, FANOUT)
                    real = below < len(self.levels[level - 1][0])
                    stack.append((level - 1, qi[real], below[real], acc[real]))


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i] in root, which holds for each element a smaller or equal one of its set."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if len(a):
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root])[0] != root[0] or (up != root).any():
                root[:] = up


def near_edges(fps: DataFrame, limit: int = 2) -> DataFrame:
    """Edges (a, b) between fingerprints that span the groups linked at limit or fewer differing bits.

    fps: distinct values in the column fp. Every pair within limit is found;
    of the links found in one range, a spanning forest goes on, so that a group
    of n near copies sends at most n edges from each range and not n * n.
    """
    keyed = fps.select("fp", gray_prefix(F.col("fp")).alias("prefix"))
    counts = np.zeros(1 << PREFIX, np.int64)
    for r in keyed.groupBy("prefix").count().toLocalIterator():  # 2**PREFIX rows at most
        counts[r.prefix] = r["count"]
    total = int(counts.sum())
    size = min(RANGE_ROWS, max(-(-total // RANGES), LEAST_ROWS))
    part_of = ((np.cumsum(counts) - counts) // size).astype(np.int32)  # by Gray rank: a range is a run of ranks
    ranks = np.arange(1 << PREFIX, dtype=np.uint64)
    code = ranks ^ (ranks >> np.uint64(1))
    by_code = np.empty(1 << PREFIX, np.int32)
    by_code[code] = part_of
    filled = np.zeros(1 << PREFIX, bool)
    filled[code] = counts > 0
    flips = [0, *(1 << i for i in range(PREFIX)), *(1 << i | 1 << j for i in range(PREFIX) for j in range(i))]
    if limit != 2:
        flips = [x for x in range(1 << PREFIX) if x.bit_count() <= limit]
    flips = np.array(flips)
    state = fps.sparkSession.sparkContext.broadcast((by_code, filled))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code, filled = state.value
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                own = (some.view(np.uint64) >> np.uint64(64 - PREFIX)).astype(np.int64)
                near = own[:, None] ^ flips
                part = np.where(filled[near], by_code[near], -1)
                part = np.where(part >= by_code[own][:, None], part, -1)  # each pair of ranges once
                part.sort(axis=1)
                first = np.concatenate([np.ones((len(some), 1), bool), part[:, 1:] != part[:, :-1]], axis=1) & (part >= 0)
                row, col = np.nonzero(first)
                to = part[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(some[row]), pa.array(to == by_code[own[row]])], ["part", "fp", "own"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        tree = GrayTree(fp[own])
        nodes = np.concatenate([tree.fps, fp[~own]])
        order = np.argsort(nodes.view(np.int64), kind="stable")  # roots are the smallest, as signed numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = np.arange(len(nodes))
        for q, found in tree.search(nodes, limit):
            join_roots(root, place[q], place[found])
        values = nodes[order].view(np.int64)
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": values[root[other]], "b": values[other]})

    routed = fps.select("fp").mapInArrow(route, "part int, fp long, own boolean")
    return routed.groupBy("part").applyInPandas(link, "a long, b long")


def groups(docs: DataFrame, limit: int = 2, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (columns doc_id and text; others are ignored).

    Rows link when their fingerprints differ in at most limit bits;
    component_id is the smallest doc_id that is reachable over links. A null
    text counts as empty; the fingerprint without words is zero and links like
    any other. Repeated rows stay; a null doc_id is never a component_id unless
    the whole component has none.
    """
    return _named(docs, limit, size).select("doc_id", "fp", "component_id")


def _named(docs: DataFrame, limit: int, size: int) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) of every row; root names its group, digest its text."""
    prints = written(fingerprints(docs, size), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected(near_edges(distinct, limit))
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "digest", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, limit: int = 2, size: int = SHINGLE) -> DataFrame:
    """The rows of docs with one document of each group: :func:`corpuscle.llm.shared.one_of_each`."""
    return one_of_each(docs, _named(docs, limit, size))
