"""Language identification of mixed texts.

A language is a distribution over hashed character trigrams. A word's
likelihood under a language is the product over its trigrams, tempered because
neighbouring trigrams overlap. Expectation-maximisation over a document's words
estimates the proportions of its languages; languages are added one at a time
while the log-likelihood grows by more than a penalty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.shared import column, slices, tidy

BUCKETS = 1 << 16
#: Labelled documents of a language that are learned from, about: a bounded sample by hash of the id.
SAMPLE = 1_500
#: Share of the trigrams' log-likelihood that counts (each letter is part of three trigrams).
TEMPER = 1 / 3
#: A further language must raise the log-likelihood by PENALTY * ln(words + 1).
PENALTY = 2.0
SLICE = 1_500_000

_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 27 + 128)
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams ending at each byte, and the class of each byte (0: no letter)."""
    c = _CLASS[np.frombuffer(data, np.uint8)]
    h = c * _A
    h[1:] += c[:-1] * _B
    h[2:] += np.where(c[1:-1] > 0, c[:-2], 0).astype(np.uint32) * _C  # a word's first trigrams reach to its start only
    h ^= h >> np.uint32(15)
    return (h * _A >> np.uint32(16)).astype(np.int32), c


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x BUCKETS: log-likelihoods

    @staticmethod
    def fit(counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        seen = np.array([counts[x] for x in languages], np.float64).reshape(len(languages), BUCKETS)
        p = (seen + 0.2) / (seen.sum(axis=1, keepdims=True) + 0.2 * BUCKETS)
        return Model(languages, (np.log(p) * TEMPER).astype(np.float32))


def mixture(logs: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """Language places, their proportions, and the log-likelihood, of a document.

    logs: languages x words. The languages grow from the best one; a language
    is tried only if the slope of the log-likelihood at proportion 0 exceeds the
    penalty (it bounds the gain, as the log-likelihood is concave).
    """
    n = logs.shape[1]
    penalty = PENALTY * np.log(n + 1)
    peak = logs.max(axis=0)
    like = np.exp(logs - peak)
    chosen = [int(np.argmax(logs.sum(axis=1)))]
    share = np.ones(1)
    mix = np.maximum(like[chosen[0]], 1e-30)
    value = float(np.log(mix).sum())
    while len(chosen) < len(like):
        slope = (like / mix).sum(axis=1) - n
        slope[chosen] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= penalty:
            break
        some = [*chosen, k]
        own = np.maximum(like[some], 1e-30)
        pi = np.append(share * 0.9, 0.1)
        now = value
        for _ in range(40):
            joint = own * pi[:, None]
            total = joint.sum(axis=0)
            last, now = now, float(np.log(total).sum())
            pi = (joint / total).mean(axis=1)
            if abs(now - last) < 1e-4 * n and _ > 2:
                break
        mix2 = pi @ own
        now = float(np.log(mix2).sum())
        if now - value <= penalty:
            break
        chosen, share, mix, value = some, pi, mix2, now
    return chosen, share, value + float(peak.sum())


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
    """Of each text the main language, its score, and all languages with their proportions."""
    k = len(model.languages)
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    langs: list[list[str]] = [[] for _ in texts]
    parts: list[list[float]] = [[] for _ in texts]
    low = [(t or "").lower() for t in texts]
    has = [any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t)) for t in low]
    data = [t.encode() if h else b"" for t, h in zip(low, has, strict=True)]
    for lo, hi in slices([len(x) + 1 for x in data], SLICE):
        joined = b" ".join(data[lo:hi]) + b" "
        grams, c = trigrams(joined)
        letter = c > 0
        starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        if not len(starts) or not k:
            continue
        at = np.flatnonzero(letter)
        first = np.searchsorted(at, starts)
        picked = grams[at]
        words = np.array([np.add.reduceat(row[picked], first) for row in model.table])
        ends = np.cumsum([len(x) + 1 for x in data[lo:hi]])
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        full = np.flatnonzero(np.diff(bounds))
        sums = np.array([np.add.reduceat(w.astype(np.float64), bounds[:-1][full]) for w in words])
        best = sums.argmax(axis=0)
        n = np.diff(bounds)[full]
        top = words[np.repeat(best, n), np.arange(words.shape[1])]
        slope = np.array([np.add.reduceat(np.exp(np.minimum(w - top, 60.0)), bounds[:-1][full]) for w in words]) - n
        slope[best, np.arange(len(full))] = -np.inf
        mixed = (slope > PENALTY * np.log(n + 1)).any(axis=0)
        for j, d in enumerate(full):
            i = lo + int(d)
            if mixed[j]:
                chosen, share, _ = mixture(words[:, bounds[d] : bounds[d + 1]].astype(np.float64))
            else:
                chosen, share = [int(best[j])], np.ones(1)
            order = np.argsort(-share, kind="stable")
            main = chosen[int(order[0])]
            sure = 1 / np.exp(np.minimum(sums[:, j] - sums[main, j], 50.0)).sum() if len(chosen) == 1 else 1.0
            pred[i], score[i] = model.languages[main], float(min(1.0, share[order[0]] * sure))
            langs[i] = [model.languages[chosen[int(x)]] for x in order]
            parts[i] = [float(share[x]) for x in order]
    for i, h in enumerate(has):
        if h and pred[i] == "und" and k:  # letters of no known class
            pred[i], langs[i], parts[i], score[i] = model.languages[0], [model.languages[0]], [1.0], 1.0 / k
    return pred, score, langs, parts


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id, as text, leaves the remainder part; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text, lang): about sample documents of each language, chosen by hash of the id, are counted on the executors.

    All languages are learned; the model grows with their number (256 kB each goes to every executor), not with the
    rows. Rows without language or text teach nothing, repeated ones count as often as they occur, null ids as one id.
    Without a labelled row the model has no language, and every text is und. Other columns are ignored.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    table = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in sizes.items()], "_lang string, _share double")
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = labelled.join(F.broadcast(table), F.col("lang") == F.col("_lang")).where(unit < F.col("_share")).select("lang", "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                grams, c = trigrams(text.lower().encode())
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(grams[c > 0], minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    rows = some.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # BUCKETS cells at most
    for r in rows.toLocalIterator():
        n = counts[r.lang] = np.zeros(BUCKETS, np.int64)
        cells = np.array(r.cells, np.int64)
        n[cells[:, 0]] = cells[:, 1]
    return Model.fit(counts)


def identify(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns carry, and lang_pred, score, languages, proportions (after prefix), of every row of docs.

    Only the whole text is looked at. A null text, and one without a letter,
    gets und, score 0 and empty lists; every row stays, repeated ones too.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)
    carry, names = list(carry), [prefix + x for x in ("lang_pred", "score", "languages", "proportions")]
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType()))
    schema = T.StructType([*docs.select(*carry).schema, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                pred, score, langs, parts = predict(state.value, column(part, "text").to_pylist())
                found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in carry), *found], [*carry, *names])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def crc_mod(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts
