"""Embedding near-duplicates by product quantisation.

Unit vectors go to inverted lists by their nearest coarse centroid; what
remains is coded by subspaces. A search probes every list that can hold a
vector within the limit: a vector of another list lies beyond the plane half-way
between the two centroids, so a list whose plane is farther off than the limit
holds none. In a list, distances come from a table of query and code words
(asymmetric); a candidate stays if the distance less the known coding error is
within the limit, and is then ranked by the exact cosine. So no link is lost.

Codes are made in the scan. Vectors travel with them to the blocks of lists, as
the exact cosine is taken where the candidates are found: candidates that left
the task would be all couples of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import column, connected, lowest, written
from corpuscle.llm.simhash import join_roots

#: Vectors that the centroids and code words are learned from (by hash of the id): a bounded sample.
SAMPLE = 10_000
#: Vectors of an inverted list, about, for the label of most vectors; and the most lists (their centroids go to every executor).
LIST_ROWS, MAX_LISTS = 300, 4_096
SUBSPACES, WORDS = 8, 32
#: Vectors of a list that one task holds at a time; longer lists are split, and each block meets each.
BLOCK = 4_096
SLACK = 1e-6


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, and whether each has one: zero and non-finite ones don't."""
    x = vectors.astype(np.float64)
    with np.errstate(all="ignore"):
        big = np.abs(x).max(axis=1, initial=0.0)
        ok = np.isfinite(big) & (big > 0)
        x = x / np.where(ok, big, 1.0)[:, None]
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    x[~ok] = 0
    return x, ok


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros: that changes no cosine of vectors of one length."""
    rows = vectors.to_numpy(zero_copy_only=False)
    if all(len(r) == width for r in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width), np.float32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids, from evenly spread rows of x on."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)[0]
        n = np.bincount(own, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        c = np.where((n > 0)[:, None], new / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (c * c).sum(axis=1) - 2 * (x @ c.T)
    own = d.argmin(axis=1)
    return own, d


@dataclass
class Quantizer:
    centroids: np.ndarray
    words: np.ndarray  # SUBSPACES x WORDS x width
    gaps: np.ndarray  # distances between centroids

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Quantizer:
        c = kmeans(x, lists)
        rest = x - c[nearest(x, c)[0]]
        width = -(-x.shape[1] // SUBSPACES)
        rest = np.pad(rest, ((0, 0), (0, width * SUBSPACES - x.shape[1])))
        words = np.stack([np.resize(kmeans(rest[:, s * width : (s + 1) * width], WORDS), (WORDS, width)) for s in range(SUBSPACES)])
        gaps = np.sqrt(np.maximum(0, (c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T))
        return Quantizer(c, words, gaps)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        width = self.words.shape[2]
        rest = np.pad(x - self.centroids[own], ((0, 0), (0, width * SUBSPACES - x.shape[1])))
        codes, left = np.empty((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
        for s in range(SUBSPACES):
            part = rest[:, s * width : (s + 1) * width]
            codes[:, s] = nearest(part, self.words[s])[0]
            left += ((part - self.words[s][codes[:, s]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists from the row's own on that can hold a vector within radius of the row: each pair of lists meets once."""
        d = nearest(x, self.centroids)[1]
        mine = d[np.arange(len(x)), own][:, None]
        gap = self.gaps[own]
        return np.nonzero((d - mine <= 2 * (radius + SLACK) * gap + SLACK) & (np.arange(d.shape[1]) >= own[:, None]))

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries from the coded vectors of list which."""
        width = self.words.shape[2]
        rest = np.pad(queries - self.centroids[which], ((0, 0), (0, width * SUBSPACES - queries.shape[1])))
        out = np.zeros((len(queries), len(codes)), np.float32)
        for s in range(SUBSPACES):
            part = rest[:, s * width : (s + 1) * width]
            table = (part * part).sum(axis=1)[:, None] + (self.words[s] ** 2).sum(axis=1) - 2 * part @ self.words[s].T
            out += table.astype(np.float32)[:, codes[:, s]]
        return out


def neighbours(q: Quantizer, which: int, queries: np.ndarray, base: np.ndarray, codes: np.ndarray, left: np.ndarray, cosine: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in queries, places in base) with at least cosine, in portions; base are unit vectors of list which, with their codes and what these leave out."""
    radius = np.sqrt(2 - 2 * cosine)
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        near = np.sqrt(np.maximum(q.distances(some, which, codes), 0)) - left <= radius + 1e-3
        i, j = np.nonzero(near)
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            ok = np.einsum("ij,ij->i", some[a], base[b]) >= cosine
            yield a[ok] + at, b[ok]


def links(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine,
    in double precision, is at least cosine. Null vectors, zero ones and those
    with a null or non-finite component link with nothing, nor do vectors of
    different lengths. n_links counts linked rows; equal vectors are compared
    once and counted as often as they occur. component_id is the smallest
    vec_id reachable; rows without a label or a usable vector are their own.
    Repeated rows (of the same id as well) link like different ones: a component is one of rows, not of ids.
    Other columns are dropped. All lengths and labels are handled by the same jobs.
    """
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(fine, F.lit(False)).alias("fine"))
    # vectors meet within a label and length only; a row for equal ones, whose number is kept with them in the table
    keyed = rows.where("fine").select("vec_id", F.concat_ws("/", F.size("embedding"), F.col("label").cast("string")).alias("label"), "embedding")
    distinct = keyed.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    singles = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if distinct.isEmpty():
        return singles
    counts, edges = _linked(distinct, cosine, sample)
    named = distinct.join(counts, "node", "left").join(connected(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    back = keyed.join(named, ["label", "embedding"])
    return back.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(singles)


def _linked(distinct: DataFrame, cosine: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(node, others: linked rows of other vectors) and spanning edges (a, b) of nodes, of distinct vectors (node, label, embedding, copies)."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))
    largest, total, width = sizes.agg(F.max("n"), F.sum("n"), F.max("width")).first()  # only vectors of one label meet
    some = lowest(distinct.select("embedding", "low", "node"), sample, total, "low", "node").select("embedding").toArrow()
    lists = max(1, min(MAX_LISTS, largest // LIST_ROWS, some.num_rows // 4))
    state = spark.sparkContext.broadcast(Quantizer.fit(unit(matrix(some["embedding"].combine_chunks(), width))[0], lists))
    radius = float(np.sqrt(2 - 2 * cosine))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = state.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = unit(matrix(column(part, "embedding"), width))[0]
                own = nearest(x, q.centroids)[0]
                codes, left = q.encode(x, own)
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("node", "label", "copies", "embedding")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], ["node", "label", "copies", "embedding", "list", "codes", "rest"])

    base = written(distinct.mapInArrow(assign, "node long, label string, copies long, embedding array<float>, list int, codes binary, rest double"), "lists")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = state.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = column(part, "list").to_numpy()
                row, to = q.probes(unit(matrix(column(part, "embedding"), width))[0], own, radius)
                yield pa.RecordBatch.from_arrays([*(column(part, c).take(pa.array(row)) for c in ("node", "label", "copies", "embedding")), pa.array(to.astype(np.int32)), pa.array(to == own[row])], ["node", "label", "copies", "embedding", "list", "home"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in probe(batches):
            n = batch.select(["label", "list"]).to_pandas().value_counts(["label", "list"]).reset_index(name="n")
            yield pa.RecordBatch.from_pandas(n.astype({"n": "int64", "list": "int32"}), preserve_index=False)

    # lists are split into blocks of stored vectors, and of queries by their own number, so that a task holds one block of each
    split = lambda n: F.ceil(n / BLOCK).cast("int")
    stored_n = base.groupBy("label", "list").agg(split(F.count("*")).alias("blocks"))
    asked_n = base.mapInArrow(visits, "label string, list int, n long").groupBy("label", "list").agg(split(F.sum("n")).alias("qblocks"))
    blocks = written(stored_n.join(asked_n, ["label", "list"]), "blocks")  # a list without vectors answers nothing
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = base.join(blocks, ["label", "list"]).withColumn("block", place("blocks")).withColumn("qblock", every("qblocks")).withColumn("stored", F.lit(True)).withColumn("home", F.lit(True))
    asked = base.mapInArrow(probe, "node long, label string, copies long, embedding array<float>, list int, home boolean").join(blocks, ["label", "list"])
    asked = asked.withColumn("qblock", place("qblocks")).withColumn("block", every("blocks")).withColumn("stored", F.lit(False)).withColumn("codes", F.lit(None).cast("binary")).withColumn("rest", F.lit(None).cast("double"))
    names = ["label", "list", "block", "qblock", "node", "copies", "embedding", "codes", "rest", "stored", "home"]
    both = stored.select(*names).unionByName(asked.select(*names))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        q = state.value
        is_stored = table["stored"].to_numpy()
        b, a = table.filter(pa.array(is_stored)), table.filter(pa.array(~is_stored))
        node_a, node_b = a["node"].to_numpy(), b["node"].to_numpy()
        copies_a, copies_b, home = a["copies"].to_numpy(), b["copies"].to_numpy(), a["home"].to_numpy()
        others, others_b = np.zeros(len(node_a), np.int64), np.zeros(len(node_b), np.int64)
        names, spot = np.unique(np.concatenate([node_a, node_b]), return_inverse=True)
        root = np.arange(len(names))
        if len(node_a) and len(node_b):
            x, y = (unit(matrix(t["embedding"].combine_chunks(), width))[0] for t in (a, b))
            codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(len(node_b), SUBSPACES)
            for i, j in neighbours(q, key[1].as_py(), x, y, codes, b["rest"].to_numpy(), cosine):
                differ = node_a[i] != node_b[j]
                i, j = i[differ], j[differ]
                others += np.bincount(i, copies_b[j], len(node_a)).astype(np.int64)
                away = ~home[i]  # vectors of one list meet both ways, those of two lists once
                others_b += np.bincount(j[away], copies_a[i[away]], len(node_b)).astype(np.int64)
                join_roots(root, spot[i], spot[len(node_a) + j])
        node, others = np.concatenate([node_a, node_b]), np.concatenate([others, others_b])
        found = np.flatnonzero(others)
        linked = np.flatnonzero(root != np.arange(len(names)))
        none = np.zeros(len(linked), np.int64)
        return pa.table({"node": np.concatenate([node[found], names[root[linked]]]), "others": np.concatenate([others[found], none]), "to": np.concatenate([np.zeros(len(found), np.int64), names[linked]]), "edge": np.arange(len(found) + len(linked)) >= len(found)})

    found = both.groupBy("label", "list", "block", "qblock").applyInArrow(compare, "node long, others long, to long, edge boolean")
    found = written(found, "links")
    counts = found.where("not edge").groupBy("node").agg(F.sum("others").alias("others"))
    return counts, found.where("edge").select(F.col("node").alias("a"), F.col("to").alias("b"))


#: The SQL of op6: every couple of a label, and the reach over links.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS n FROM embeddings
), fine AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS a, b.n AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.n <> b.n AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT n AS a, n AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT reach.a AS n, min(v.vec_id) AS component_id FROM reach JOIN v ON v.n = reach.b GROUP BY reach.a
), counted AS (
  SELECT a AS n, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN least USING (n) LEFT JOIN counted USING (n)
"""
