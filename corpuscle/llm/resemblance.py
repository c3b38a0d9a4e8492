"""Near-duplicates by the resemblance of word shingles: every couple at LEAST or more, and no other.

SimHash links and hubs join the large groups first; each link counts only after
the exact resemblance of the two texts has been taken. A prefix join then meets
all couples that are still apart: in one order of all shingles, two sets of
resemblance t share one of the first n - ceil(t * n) + 1 of each. Common
shingles, as a sample of documents tells, come last in that order; the others
are ordered by hash. The number of first shingles that two sets share bounds
their resemblance, so that whole texts are read again for few documents only.

A set whose first shingles reach the common ones has all its other shingles among
them. Two such sets that share none of those are as alike as their common
shingles at most, so that over a common shingle only the sets meet that can reach
LEAST with common shingles alone; the rest meet over the others or not at all.
Thus edited copies of one text, which a common shingle brings together by the
thousand, don't meet there once enough of them is their own.

Many edited copies of one text share most of their first shingles, so that they
would meet by the square of their number. The sets of such a crowd are compared
with one of them, the pivot B. Let D be the shingles that are in just one of a set
and B. Two sets x, y are alike if D(x) and D(y) differ in (|x| + |y|) / 9 places at
most. If |D(x)| + |D(y)| is no more than that, both are alike to B, and the link to
B joins them. Else they share enough of D(x) and D(y) for a prefix join over these,
which hold no shingle that the crowd has from B. Couples of one pivot meet there
alone, all others over their first shingles.

Sets that share a template or a part of a text meet too, and there are as many
couples of them as the square of their number. Each set has a sketch: the parity
of the number of its shingles in each of as many cells as it has shingles, by
hash. The cells in which two sketches differ are no more than the shingles that
are in one set alone, so that a couple with too many of them is not alike and
goes no further; of such couples hardly one is left. This is exact, for each
couple and at each shingle alike.

A long set with hardly a common shingle sends its FIRST shingles only. Of a
couple at LEAST or more, these share SEEN but with a chance of less than 1e-9
(binomial: of the first 32 of the union at most 30 % are in one set alone), which
is of the order of two shingles having one hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import column, connected, lowest, one_of_each, tidy, written
from corpuscle.llm.simhash import SEED, near_edges

#: Words of a shingle; least resemblance (shared shingles by all of both), as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Sets x, y have that resemblance if and only if BOTH * |x ^ y| <= GAP * (|x| + |y|).
GAP, BOTH = LEAST[1] - LEAST[0], LEAST[0] + LEAST[1]
#: Documents of the sample, and how many of them hold a common shingle at least. This is an order only: no couple depends on it.
SAMPLE, COMMON = 10_000, 4
#: First shingles of a long set, the share of its shingles that must not be common for that, and how many of them two such sets must share.
FIRST, RARE, SEEN = 32, 0.85, 6
#: Cells of a sketch at most (256 bytes). Couples of sets beyond about twice as many shingles pass it; no result depends on it.
CELLS = 2048
#: Couples that are looked at together, and words of 64 cells of their sketches (8 MB).
COUPLES, CELLS_AT_ONCE = 1_000_000, 1 << 20
#: Couples a group beyond which the likeliest ones go first, and how often that is done at most; sets beyond which a crowd has a pivot. No result depends on any.
CROWD, ROUNDS = 8, 1
#: Shingles of the sets that a task keeps while it compares (32 MB), but for a larger set.
KEPT = 1 << 22
#: The filter of documents whose sets are read again has 2**BLOOM_BITS bits (2 MB). Those that it takes by mistake go in the join after it.
BLOOM_BITS = 24


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; words as in simhash.fingerprint, fewer than size of them are one shingle."""
    return np.unique(_hashes(text, size))


def _hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = zip(*(words[k:] for k in range(size)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(words) - size + 1)


def _fingerprint(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of as many cells as there are shingles, or up to twice as many (64 to CELLS, a power of two), by the low bits."""
    cells = min(CELLS, max(64, 1 << (len(grams) - 1).bit_length())) if len(grams) else 64
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class Sketches:
    """The sketches of rows, as their column has them."""

    def __init__(self, rows: pa.ChunkedArray) -> None:
        bodies = pa.concat_arrays(rows.cast(pa.large_binary()).chunks)
        at = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
        self.words = np.frombuffer(bodies.buffers()[2], np.uint64)
        self.start, self.size = at[:-1] // 8, np.diff(at) // 8

    def folded(self, at: np.ndarray, size: int) -> np.ndarray:
        """The sketches of the rows at, in size words each, which none has less of: cells of one remainder are one cell."""
        out = np.zeros((len(at), size), np.uint64)
        for k in range(0, int(self.size[at].max(initial=0)), size):
            some = np.flatnonzero(self.size[at] > k)
            out[some] ^= self.words[self.start[at[some]][:, None] + np.arange(k, k + size)]
        return out

    def differ(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """In how many cells the rows differ, by the smaller sketch: as many shingles at least are in one of the two sets alone."""
        out, size = np.zeros(len(left), np.int64), np.minimum(self.size[left], self.size[right])
        for n in np.unique(size):
            same = np.flatnonzero(size == n)
            for lo in range(0, len(same), max(1, CELLS_AT_ONCE // int(n))):
                some = same[lo : lo + max(1, CELLS_AT_ONCE // int(n))]
                out[some] = np.bitwise_count(self.folded(left[some], int(n)) ^ self.folded(right[some], int(n))).sum(axis=1, dtype=np.int64)
        return out


def prefix(grams: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, bool, int]:
    """The first shingles of the set, in the order of all: ascending, the common ones last; whether they end at FIRST; how many of the set are common."""
    last = common[np.searchsorted(common, grams).clip(max=len(common) - 1)] == grams if len(common) else np.zeros(len(grams), bool)
    enough = len(grams) - -(-LEAST[0] * len(grams) // LEAST[1]) + 1
    rare = grams[~last]
    if enough > FIRST and len(rare) >= RARE * len(grams):
        return rare[:FIRST], True, len(grams) - len(rare)
    return np.concatenate([rare, grams[last]])[:enough], False, len(grams) - len(rare)


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that COMMON of SAMPLE documents hold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in column(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["gram"])

    some = lowest(docs.select(F.xxhash64("text").alias("digest"), "doc_id"), SAMPLE, docs.count(), "doc_id", "digest")
    texts = docs.withColumn("digest", F.xxhash64("text")).join(F.broadcast(some.select("digest").distinct()), "digest", "left_semi").select("digest", "text").dropDuplicates(["digest"])
    found = texts.select("text").mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.gram for r in found.select("gram").toLocalIterator()], np.int64).view(np.uint64))


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, key, n, fp, grams, short, c, sketch): key names the set of shingles, n is its size, c of them are common, grams are its first ones, short whether they end at FIRST."""
    state = docs.sparkSession.sparkContext.broadcast(_common(docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = state.value
        for batch in batches:
            keys, sizes, fps, firsts, short, commons, sketches = [], [], [], [], [], [], []
            for t in column(batch, "text"):
                h = _hashes(t.as_py(), WORDS)
                grams = np.unique(h)
                keys.append(_key(grams))
                sizes.append(len(grams))
                fps.append(_fingerprint(h))
                some, ends, c = prefix(grams, common) if len(grams) else (grams, False, 0)
                firsts.append(some.view(np.int64))
                short.append(ends)
                commons.append(c)
                sketches.append(sketch(grams))
            at = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "digest"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists, pa.array(short, pa.bool_()), pa.array(commons, pa.int32()), pa.array(sketches, pa.binary())], ["doc_id", "digest", "key", "n", "fp", "grams", "short", "c", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, key long, n int, fp long, grams array<long>, short boolean, c int, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """All rows in the order of gram, n and key, without repeated ones, and where a gram's run starts."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return None
    rows = pa.Table.from_batches(batches)
    gram, n, key = (rows[c].to_numpy() for c in ("gram", "n", "key"))
    order = np.lexsort((key, n, gram))
    gram, key = gram[order], key[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])
    rows, gram = rows.take(pa.array(order[new])), gram[new]
    return rows, np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))


@tidy
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with another of the same gram whose size allows the resemblance; hub, hub_n: the smallest key of the gram's run."""
    if found := _runs(batches):
        rows, start = found
        gram, n, key, short, c, common = (rows[x].to_numpy() for x in ("gram", "n", "key", "short", "c", "common"))
        near = (gram[1:] == gram[:-1]) & (LEAST[1] * n[:-1].astype(np.int64) >= LEAST[0] * n[1:].astype(np.int64))
        keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        by_key = np.lexsort((key, gram))[start]
        hub = np.repeat(by_key, np.diff(np.append(start, len(gram))))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, key, n, short, c, common, key[hub], n[hub], short[hub])], ["gram", "key", "n", "short", "c", "common", "hub", "hub_n", "hub_short"])


@tidy
def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, votes): the group that has most rows of a gram's run (ties: the smallest), and in how many runs of the set it has."""
    found = _runs(batches)
    if not found:
        return
    rows, start = found
    key, root = rows["key"].to_numpy(), rows["root"].to_numpy()
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    order = np.lexsort((root, run))
    new = np.flatnonzero(np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (root[order][1:] != root[order][:-1])]))
    size, where = np.diff(np.append(new, len(order))), order[new]
    best = np.lexsort((-size, run[where]))  # stable: roots ascend
    label = root[where[best[np.concatenate([[True], np.diff(run[where][best]) > 0])]]][run]
    order = np.lexsort((label, key))
    key, label = key[order], label[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])]))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[new], label[new], np.diff(np.append(new, len(key))))], ["key", "label", "votes"])


def _pivots(known: DataFrame, parts: int) -> DataFrame:
    """(key, pivot) of the sets of crowds: those that meet most with one group, and of these the one with the largest share of common shingles. No result depends on the choice."""
    votes = known.repartition(parts, "gram").mapInArrow(_votes, "key long, label long, votes long").groupBy("key", "label").agg(F.sum("votes").alias("votes"))
    label = votes.groupBy("key").agg(F.max(F.struct("votes", F.bitwise_not("label").alias("label"))).alias("m")).select("key", F.bitwise_not("m.label").alias("label"), "m.votes")
    sets = known.groupBy("key").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("root").alias("root"))
    label = written(label.join(sets, "key").where(F.col("votes") >= F.least(F.col("n") / 40, F.lit(8))), "labels")
    pivot = label.groupBy("label").agg(F.count("*").alias("many"), F.max(F.struct((F.col("root") == F.col("label")).alias("own"), (F.col("c") / F.col("n")).alias("share"), "key")).alias("m")).where(F.col("many") > CROWD)
    return written(label.join(pivot.select("label", F.col("m.key").alias("pivot")), "label").select("key", "pivot"), "pivots")


@tidy
def _apart_from_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """D of each set, those shingles first that the pivot doesn't have, as (pivot, gram, key, n, d, place, far, probe); d is the size of D, far whether the pivot isn't alike.

    A couple that no two links to the pivot join has a far set y, and shares more than (|D(x)| + (|B| - |x|) / 9) / 2 of D(x)
    and no less than |D(x)| - |x| / 4. The first shared one is in the places that this leaves, of both if both are far. Those
    after are sent by far sets alone (probe), for a near set's first ones to meet. Sets whose D is more than half of their
    size aren't of the crowd: they have no rows, and meet all others over their first shingles.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    last, base = None, np.zeros(0, np.uint64)
    names = ["pivot", "gram", "key", "n", "d", "place", "far", "probe"]
    for batch in batches:
        made: list[list[np.ndarray]] = [[] for _ in names]
        for key, pivot, x, y in zip(*(column(batch, c) for c in ("a", "b", "x", "y")), strict=True):
            if pivot.as_py() != last:
                last, base = pivot.as_py(), shingles(unpack(y.as_py()).decode())
            own = shingles(unpack(x.as_py()).decode())
            grams = np.concatenate([np.setdiff1d(own, base, True), np.setdiff1d(base, own, True)]).view(np.int64)
            d, n = len(grams), len(own)
            if 2 * d > n:
                continue
            far = BOTH * d > GAP * (n + len(base))
            shared = max((BOTH * d + GAP * (len(base) - n)) // (2 * BOTH) + 1, d - GAP * n // LEAST[0])
            some = d if far else d - shared + 1
            place = np.arange(some, dtype=np.int32)
            one = lambda v, t=np.int64, some=some: np.full(some, v, t)
            for to, value in zip(made, (one(last), grams[:some], one(key.as_py()), one(n, np.int32), one(d, np.int32), place, one(far, bool), place > d - shared), strict=True):
                to.append(value)
        if any(len(x) for x in made[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names)


@tidy
def _meet_in_crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Couples (a, b) of one pivot and of different groups that share one of the first of D and have enough after it; times: how many they share here."""
    batches = [pa.RecordBatch.from_arrays([*b.drop_columns(["gram"]).columns, pa.array(column(b, "gram").to_numpy() ^ (column(b, "pivot").to_numpy() * np.int64(0x9E3779B97F4A7C1)))], [*(c for c in b.schema.names if c != "gram"), "gram"]) for b in batches]
    found = _runs(batches)
    if not found:
        return
    rows, start = found
    n, d, place, key, root = (rows[x].to_numpy().astype(np.int64) for x in ("n", "d", "place", "key", "root"))
    far, probe = rows["far"].to_numpy(), rows["probe"].to_numpy()
    end = np.repeat(np.append(start[1:], len(n)), np.diff(np.append(start, len(n))))
    for left, right in _met(start, root, end):
        ok = (~probe[left] & ~probe[right] & (far[left] | far[right])) | (probe[left] & ~far[right]) | (probe[right] & ~far[left])
        left, right = left[ok], right[ok]
        total = BOTH * (d[left] + d[right]) - GAP * (n[left] + n[right])  # 2 * BOTH times what they share at least
        ok = (2 * BOTH * (d[left] - place[left]) >= total) & (2 * BOTH * (d[right] - place[right]) >= total)
        left, right = left[ok], right[ok]
        a, b = np.minimum(key[left], key[right]), np.maximum(key[left], key[right])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], np.diff(np.append(new, len(a))))], ["a", "b", "times"])


def _windows(start: np.ndarray, n: np.ndarray, c: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each row the first of its run that is too large for it. Rows are in the order of n within the runs, which begin at start."""
    most = LEAST[1] * n // LEAST[0]
    most = np.where(common, np.minimum(most, (LEAST[0] + LEAST[1]) * c // LEAST[0] - n), most)  # over a common shingle: as large as c allows
    high = np.arange(len(n)) + 1
    for s, e in zip(start, np.append(start[1:], len(n)), strict=True):
        high[s:e] = np.maximum(high[s:e], s + np.searchsorted(n[s:e], most[s:e], "right"))
    return high


def _met(start: np.ndarray, root: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right): places of the couples of a row and one after it in its window that are of different groups, in portions.

    The rows of each run's largest group meet the others alone: copies of one text would meet by the square of their number.
    """
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(root))))
    order = np.lexsort((root, run))
    new = np.flatnonzero(np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (root[order][1:] != root[order][:-1])]))
    size, where = np.diff(np.append(new, len(order))), order[new]
    largest = np.lexsort((size, run[where]))[np.append(np.flatnonzero(np.diff(run[where])), len(where) - 1)]  # new is in the order of runs
    minor = np.flatnonzero(root != root[where[largest]][run])
    of_minor = np.zeros(len(root), bool)
    of_minor[minor] = True
    for lefts, rights in ((minor, np.arange(len(root))), (np.flatnonzero(~of_minor), minor)):
        low, to = np.searchsorted(rights, lefts, "right"), np.searchsorted(rights, high[lefts])
        ends = np.cumsum(np.maximum(to - low, 0))
        done = 0
        while done < len(lefts):
            before = ends[done - 1] if done else 0
            till = max(done + 1, int(np.searchsorted(ends, before + COUPLES, "right")))
            count = np.diff(ends[done:till], prepend=before)
            left = np.repeat(lefts[done:till], count)
            right = rights[np.repeat(low[done:till], count) + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)]
            apart = root[left] != root[right]
            yield left[apart], right[apart]
            done = till


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Couples (a, b) of different groups and not of one pivot that share a gram and whose sizes allow the resemblance; times: how many they share here, c: the common shingles of the set with fewer.

    Over a common gram only couples meet that can have the resemblance by their common shingles alone, and over any only those whose sketches leave it possible.
    """
    found = _runs(batches)
    if not found:
        return
    rows, start = found
    n, key, root, short, c, pivot = (rows[x].to_numpy().astype(np.int64) for x in ("n", "key", "root", "short", "c", "pivot"))
    common, crowd = rows["common"].to_numpy(), rows["crowd"].to_numpy()
    sketches = Sketches(rows["sketch"])
    group = 2 * np.unique(np.where(crowd, pivot, root), return_inverse=True)[1] + crowd
    for left, right in _met(start, group, _windows(start, n, c, common)):
        c_of = np.minimum(c[left], c[right])
        ok = (root[left] != root[right]) & (~common[left] | (c_of * (LEAST[0] + LEAST[1]) >= (n[left] + n[right]) * LEAST[0]))
        left, right, c_of = left[ok], right[ok], c_of[ok]
        ok = BOTH * sketches.differ(left, right) <= GAP * (n[left] + n[right])
        left, right, c_of = left[ok], right[ok], c_of[ok]
        a, b = np.minimum(key[left], key[right]), np.maximum(key[left], key[right])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
        times = np.diff(np.append(new, len(a)))
        one = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], n[left[one]], n[right[one]], short[left[one]] + short[right[one]], c_of[one], times)], ["a", "b", "small", "large", "short", "c", "times"])


def _possible(couples: DataFrame) -> DataFrame:
    """The couples (a, b, times) whose resemblance can reach LEAST; couples has their sizes small and large, how many of the two are short, c, and times for the first shingles that they share.

    All shared shingles up to the end of the one whole prefix that ends first are in both; past it, that set has no more
    than the rest of the larger one. Short prefixes bound nothing, but share SEEN of their shingles (two with one short: 2).
    Where c common shingles alone don't reach LEAST, times has no common shingles if both prefixes hold some: then they
    hold all others, and the couple shares times + c at most.
    """
    summed = couples.groupBy("a", "b", "small", "large", "short", "c").agg(F.sum("times").alias("times"))
    rest = F.ceil(F.lit(LEAST[0]) * F.col("large") / LEAST[1] - F.lit(1e-6)) - 1
    whole = (F.col("times") + rest) * (LEAST[0] + LEAST[1]) >= (F.col("small") + F.col("large")) * LEAST[0]
    reach = lambda shared: shared * (LEAST[0] + LEAST[1]) >= (F.col("small") + F.col("large")) * LEAST[0]
    whole = whole | (~reach(F.col("c")) & reach(F.col("times") + F.col("c")))
    return summed.where(F.when(F.col("short") == 2, F.col("times") >= SEEN).when(F.col("short") == 1, F.col("times") >= 2).otherwise(whole)).select("a", "b", "times")


def _texts(docs: DataFrame, one: DataFrame, couples: DataFrame) -> DataFrame:
    """(key, body): the compressed text of one document of each key in couples. Only these texts are shuffled; a filter of fixed size picks them in the scan."""
    needed = written(one.join(couples.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key"), "needed")
    mask = (1 << BLOOM_BITS) - 1

    def places(digest: np.ndarray) -> np.ndarray:
        return np.stack([digest & mask, digest >> BLOOM_BITS & mask])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        for batch in batches:
            at = places(batch.column(0).to_numpy()).ravel()
            np.bitwise_or.at(filled, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(filled[word].view(np.int64))], ["word", "bits"])

    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    for r in needed.select("digest").mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # 2**(BLOOM_BITS - 6) rows at most
        bloom[r.word] = np.array(r.bits, np.int64).view(np.uint64)
    state = docs.sparkSession.sparkContext.broadcast(bloom)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, schema = state.value, pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("body", pa.binary())])
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = places(column(batch, "digest").to_numpy())
            hit = np.flatnonzero(((bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0))
            for some in np.array_split(hit, -(-len(hit) // 500) or 1):
                part = batch.take(pa.array(some))
                bodies = pa.array([pack((t.as_py() or "").encode()) for t in column(part, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "digest"), bodies], schema=schema)

    found = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, body binary")
    read = found.join(needed, "digest").where(F.col("doc_id").eqNullSafe(F.col("one_id"))).select("key", "body").dropDuplicates(["key"])
    return written(read, "texts", "uncompressed")


@tidy
def _resemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The couples whose texts have the resemblance; the last sets are kept, as one of a large group comes often."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[int, np.ndarray] = {}
    held = 0

    def grams(key: int, body: pa.Scalar) -> np.ndarray:
        nonlocal held
        if key not in known:
            some = shingles(unpack(body.as_py()).decode())
            if held + len(some) > KEPT:
                known.clear()
                held = 0
            known[key] = some
            held += len(some)
        return known[key]

    for batch in batches:
        a, b = column(batch, "a").to_numpy(), column(batch, "b").to_numpy()
        ok = np.zeros(len(a), bool)
        for k, (i, j, x, y) in enumerate(zip(a.tolist(), b.tolist(), column(batch, "x"), column(batch, "y"), strict=True)):
            x, y = grams(i, x), grams(j, y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[k] = both * (LEAST[0] + LEAST[1]) >= (len(x) + len(y)) * LEAST[0]
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _with_texts(couples: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = texts.select(F.col("key").alias("a"), F.col("body").alias("x")), texts.select(F.col("key").alias("b"), F.col("body").alias("y"))
    return couples.join(a, "a").join(b, "b").select("a", "b", "x", "y")


def _alike(couples: DataFrame, texts: DataFrame) -> DataFrame:
    """The couples (a, b) whose sets have the resemblance."""
    return _with_texts(couples, texts).mapInArrow(_resemble, "a long, b long")


def _joined(apart: DataFrame, texts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots (node, root) after all links among the couples apart (a, b, times) have joined those of edges.

    Where groups are large, many couples would tell the same: while there are more than CROWD couples a group, two of each
    group go first, the one that shares most and the one with the smallest other group. Couples whose groups these join need no
    look. All others are looked at in the end.
    """
    for last in [*[False] * ROUNDS, True]:
        for c in ("a", "b"):
            apart = apart.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        apart = written(apart.where("root_a != root_b").select("a", "b", "times", "root_a", "root_b"), "apart")
        sides = [apart.select(F.col(own).alias("root"), F.col(other).alias("other"), "times", "a", "b") for own, other in (("root_a", "root_b"), ("root_b", "root_a"))]
        best = sides[0].unionByName(sides[1]).groupBy("root").agg(F.max(F.struct("times", -F.col("other"), "a", "b")).alias("most"), F.min(F.struct("other", -F.col("times"), "a", "b")).alias("low"))
        first = written(best.select(F.explode(F.array(F.struct("most.a", "most.b"), F.struct("low.a", "low.b"))).alias("c")).select("c.*").distinct(), "first")
        last = last or apart.count() <= CROWD * first.count()
        edges = edges.unionByName(written(_alike(apart if last else first, texts), "alike"))
        roots = connected(edges)
        if last:
            return roots
        apart = apart.join(first, ["a", "b"], "left_anti").select("a", "b", "times")
    raise AssertionError


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs (columns doc_id and text; others are ignored).

    Rows link at a resemblance of LEAST or more; component_id is the smallest
    doc_id that is reachable over links. Texts without words (null ones too) are
    one group. Repeated rows stay; a null doc_id is never a component_id unless
    the whole component has none.
    """
    return _named(docs).select("doc_id", "component_id")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, root, component_id) of every row; root names its group, digest its text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = written(_prints(docs), "prints")
    keys = written(prints.groupBy("key").agg(F.min("doc_id").alias("low"), F.min(F.struct("digest", "doc_id")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "sets")
    one = keys.select("key", F.col("one.digest").alias("digest"), F.col("one.doc_id").alias("one_id"))

    first = prints.join(one, ["key", "digest"]).where(F.col("doc_id").eqNullSafe(F.col("one_id")))
    grams = first.select("key", "n", "short", "c", F.posexplode("grams").alias("place", "gram")).withColumn("common", F.col("place") >= F.col("n") - F.col("c")).drop("place")
    shared = written(grams.repartition(parts, "gram").mapInArrow(_shared, "gram long, key long, n int, short boolean, c int, common boolean, hub long, hub_n int, hub_short boolean"), "shared")

    by_print = written(keys.where("n > 0").groupBy("fp").agg(F.min("key").alias("head")), "heads")
    same = keys.where("n > 0").join(by_print, "fp").select(F.col("head").alias("u"), F.col("key").alias("v"))
    tree = near_edges(by_print.select("fp"))
    linked = tree.join(by_print.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(by_print.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b").select("u", "v")
    small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    hubs = shared.where((F.col("hub") != F.col("key")) & (large * LEAST[0] <= small * LEAST[1]))
    hubs = _possible(hubs.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b"), small.alias("small"), large.alias("large"), (F.col("short").cast("int") + F.col("hub_short").cast("int")).alias("short"), large.alias("c"), F.lit(1).alias("times")))
    hubs = hubs.select("a", "b")
    proposed = same.unionByName(linked).where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    tried = written(proposed.unionByName(hubs).distinct(), "tried")
    edges = written(_alike(tried, _texts(docs, one, tried)), "alike")

    roots = connected(edges)
    known = lambda: shared.select("gram", "key", "n", "short", "c", "common").join(roots.withColumnRenamed("node", "key"), "key", "left").select("gram", "key", "n", "short", "c", "common", F.coalesce("root", "key").alias("root"))
    crowds = _pivots(known(), parts)
    to_pivot = crowds.where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    differ = written(_with_texts(to_pivot, _texts(docs, one, to_pivot)).mapInArrow(_apart_from_pivot, "pivot long, gram long, key long, n int, d int, place int, far boolean, probe boolean"), "differ")
    edges = edges.unionByName(differ.where("place = 0 and not far").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
    roots = connected(edges)
    in_crowd = differ.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    in_crowd = in_crowd.repartition(parts, "pivot", "gram").mapInArrow(_meet_in_crowd, "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
    members = differ.where("place = 0").select("key", "pivot")
    members = members.unionByName(members.select(F.col("pivot").alias("key"), "pivot").distinct())
    dealt = known().join(keys.select("key", "sketch"), "key").join(members, "key", "left").withColumn("crowd", F.col("pivot").isNotNull()).withColumn("pivot", F.coalesce("pivot", "key"))
    apart = _possible(dealt.repartition(parts, "gram").mapInArrow(_meet, "a long, b long, small long, large long, short long, c long, times long"))
    apart = written(apart.unionByName(in_crowd).join(tried, ["a", "b"], "left_anti"), "apart")
    roots = _joined(apart, _texts(docs, one, apart), edges, roots)

    named = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("key", "root", "component_id")
    return prints.select("doc_id", "digest", "key").join(named, "key", "left").select("doc_id", "digest", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each group: :func:`corpuscle.llm.shared.one_of_each`."""
    return one_of_each(docs, _named(docs))
