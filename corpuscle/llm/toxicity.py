"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Two words are alike in the measure in which they share subsequences of three
characters, the gaps of which cost a factor GAP for each character left out;
word bounds count as characters. So an insult keeps its likeness when characters
are inserted or left out. With landmarks the kernel becomes a linear map, and
the machine over it one weight for each triple of characters: a word of any
length is scored by adding up the weights of its triples.

It learns from the words of labelled documents, not from whole sentences: the
positive words are witnesses, which stand after many different words in toxic
documents and hardly in clean ones; the clean ones are those of clean documents. A document's
score is a logistic function of its most toxic words' values and its length. So
an insult of several harmless words isn't seen, but runs of single letters are
one word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.shared import column, lowest, release, tidy, written

LETTERS, REACH, GAP = 32, 3, 0.6
#: Labelled documents that are learned from, by hash of the id: a bounded sample.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3_000, 12_000
#: Landmarks, and how many clean words the machines are trained on: frequent and sampled ones, and those nearest to insults.
LANDMARKS, OTHERS, HARD = 320, 6_000, 3_000
#: Sharpness of the exponential over the kernel, limit of decision values, and how many words decide on a document.
SHARP, BOUND, TOP = 6.0, 1.5, 3
#: Log-likelihood ratio (G2) from which a word is a witness.
EVIDENCE = 18.0
#: Words kept with their scores in a worker.
CACHE = 200_000
#: Words, and rows of a matrix, that are worked on together: the driver trains, so it holds one matrix of all words and parts of others.
PART = 512

_LEET = str.maketrans("013457", "oieast")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.*_-]{1,3}[^\W\d_]){3,}(?!\w)")


def letters(word: str) -> str:
    """A word's letters, lower-cased; digits among letters count as those they look like."""
    w = word.lower()
    if not w.isalpha():
        if any(map(str.isdigit, w)) and any(map(str.isalpha, w)):
            w = w.translate(_LEET)
        w = "".join(filter(str.isalpha, w))
    return w


def words_of(text: str) -> set[str]:
    """The distinct words, split at white space, and each run of single letters as one word."""
    found = set(text.split())
    for m in _SPACED.finditer(text):
        found.add("".join(filter(str.isalpha, m[0])))
    return found


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, each between bounds (0), as places in the alphabet; and each one's word."""
    joined = ("\0" + "\0\0".join(words) + "\0").encode("utf-32-le")
    c = np.frombuffer(joined, np.uint32)
    out = np.where((c >= 97) & (c <= 122), c - 96, np.where(c == 0, 0, 27 + c % 5)).astype(np.int64)
    return out, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)


def triples(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, triple, weight) of all subsequences of three characters with at most REACH from one to the next."""
    c, w = _codes(words)
    n = len(c)
    for a in range(1, REACH + 1):
        for b in range(1, REACH + 1):
            if n <= a + b:
                continue
            inside = np.flatnonzero(w[: n - a - b] == w[a + b :])
            yield w[inside], (c[inside] * LETTERS + c[inside + a]) * LETTERS + c[inside + a + b], GAP ** (a + b - 2)


def sums(words: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """Normed sum of the weights of each word's triples."""
    out, norm = np.zeros(len(words)), np.zeros(len(words))
    for w, t, g in triples(words):
        out += np.bincount(w, weights[t] * g, len(words))
        norm += np.bincount(w, minlength=len(words)) * g * g
    return out / np.sqrt(np.maximum(norm, 1e-9))


def vectors(words: Sequence[str]) -> np.ndarray:
    """The kernel's features of few words, of length 1: len(words) x LETTERS**3."""
    out = np.zeros((len(words), LETTERS**3), np.float32)
    for w, t, g in triples(words):
        np.add.at(out, (w, t), np.float32(g))
    return out / np.sqrt(np.maximum((out * out).sum(axis=1), 1e-9))[:, None]


def lengths(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the words' features: as :func:`sums` norms them (as if no triple occurred twice), and as they are."""
    plain = np.zeros(len(words))
    keys, weights = [], []
    for w, t, g in triples(words):
        plain += np.bincount(w, minlength=len(words)) * g * g
        keys.append(w * LETTERS**3 + t)
        weights.append(np.full(len(w), g))
    if not keys or not sum(map(len, keys)):
        return np.full(len(words), 1e-4), np.full(len(words), 1e-4)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(weights))
    real = np.bincount(key // LETTERS**3, total * total, len(words))
    return np.sqrt(np.maximum(plain, 1e-9)), np.sqrt(np.maximum(real, 1e-9))


def against(words: Sequence[str], marks: np.ndarray) -> np.ndarray:
    """The sums of words' triples over landmarks, whose vectors are the columns of marks; not normed."""
    out = np.zeros((len(words), marks.shape[1]))
    for w, t, g in triples(words):
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[w[first]] += np.add.reduceat(marks[t], first, axis=0) * g
    return out


def kernel(words: Sequence[str], marks: np.ndarray, real: bool) -> np.ndarray:
    """The kernel of words with landmarks, normed by one or the other length."""
    out = np.empty((len(words), marks.shape[1]))
    for i in range(0, len(words), PART):
        some = words[i : i + PART]
        out[i : i + PART] = against(some, marks) / lengths(some)[int(real)][:, None]
    return out


def mapped(words: Sequence[str], marks: np.ndarray, real: bool, root: np.ndarray, sharp: float | None = None) -> np.ndarray:
    """The kernel of words with landmarks (its exponential, if sharp is given) times root, and a last column of ones."""
    out = np.ones((len(words), root.shape[1] + 1))
    for i in range(0, len(words), PART):
        k = kernel(words[i : i + PART], marks, real)
        out[i : i + PART, :-1] = (k if sharp is None else np.exp(sharp * (k - 1))) @ root
    return out


@dataclass
class Model:
    """Words pass a linear machine first (weights, bias; those under floor are calm), then one over the kernel's exponential with landmarks."""

    weights: np.ndarray  # of the triples
    bias: float
    floor: float = 0.0
    marks: tuple[str, ...] = ()  # the landmarks; their vectors are made anew in each process, as they are large
    beta: np.ndarray | None = None
    bias2: float = -1.0
    final: np.ndarray | None = None  # the document's logistic weights

    def decide(self, words: Sequence[str]) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        first = sums(words, self.weights) + self.bias
        out = np.full(len(words), -BOUND)
        if self.marks:
            marks = columns(self.marks)
            near = np.flatnonzero(first >= self.floor)
            for at in range(0, len(near), 1024):
                some = near[at : at + 1024]
                k = np.exp(SHARP * (kernel([words[i] for i in some], marks, True) - 1))
                out[some] = np.clip(k @ self.beta + self.bias2, -BOUND, BOUND)
        return out

    def document(self, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Probabilities, from each document's TOP highest decision values and number of words."""
        return 1 / (1 + np.exp(-np.clip(features(values, n_words) @ self.final, -30, 30)))

    @staticmethod
    def empty() -> Model:
        return Model(np.zeros(LETTERS**3), -1.0, final=np.array([-5.0, *[0.0] * (TOP + 1)]))


def features(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(values), 1)), values, np.log1p(n_words)[:, None]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(reg), x.T @ (weight * (y - p)) - reg * beta)
        beta = beta + step * min(1.0, 3.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps; the last column of x is the constant."""
    beta = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-9

    def loss(b: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x @ b)) ** 2).sum() + (reg * b * b).sum())

    now = loss(beta)
    for _ in range(30):
        slack = 1 - y * (x @ beta)
        on = slack > 0
        grad, bend = 2 * reg * beta, 2 * np.diag(reg)
        for i in range(0, len(x), PART):
            at = i + np.flatnonzero(on[i : i + PART])
            xs, ws = x[at], weight[at]
            grad -= 2 * xs.T @ (ws * y[at] * slack[at])
            bend += 2 * (xs * ws[:, None]).T @ xs
        step = np.linalg.solve(bend, grad)
        size = 1.0
        while size > 1e-4 and (then := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9 * max(1.0, now):
            break
        beta, now = beta - size * step, then
    return beta[:-1], float(beta[-1])


def bent(word: str, seed: int) -> list[str]:
    """A word with a character inserted, one doubled, and one left out, in some places."""
    if len(word) < 4:
        return []
    rng = np.random.default_rng([seed, len(word)])
    at = rng.integers(1, len(word), 8).tolist()
    out = [word[:i] + chr(97 + int(rng.integers(26))) + word[i:] for i in at[:5]]
    return [*out, *(word[:i] + word[i - 1] + word[i:] for i in at[5:7]), *([word[: at[7]] + word[at[7] + 1 :]] if len(word) > 6 else [])]


def pick(x: list, n: int) -> list:
    return x if len(x) <= n else [x[i] for i in np.linspace(0, len(x) - 1, n).astype(int)]


def landmarks(toxic: list[str], clean: list[str]) -> tuple[str, ...]:
    marks = pick(toxic, LANDMARKS // 2)
    return (*marks, *pick(clean, LANDMARKS - len(marks)))


def spread(marks: tuple[str, ...]) -> np.ndarray:
    """The landmarks' vectors as columns (42 MB)."""
    out = np.empty((LETTERS**3, len(marks)), np.float32)
    for i in range(0, len(marks), 32):
        out[:, i : i + 32] = vectors(marks[i : i + 32]).T
    return out


columns = lru_cache(maxsize=1)(spread)


def nystroem(kernel: np.ndarray) -> np.ndarray:
    """The inverse square root of the landmarks' kernel, over the directions that single precision tells from noise."""
    val, vec = np.linalg.eigh(kernel)
    sure = val > 1e-4 * val.max()
    return vec[:, sure] / np.sqrt(val[sure])


def fit_linear(toxic: list[str], clean: list[str]) -> Model:
    """The first machine, from witnesses and clean words (as letters): it lets the witnesses and their bent forms pass."""
    bends = sorted({b for i, w in enumerate(toxic) for b in bent(w, i)} - set(clean) - set(toxic))
    z = spread(landmarks(toxic, clean))
    root = nystroem((z.T @ z).astype(np.float64))
    much = lambda some: (lambda short, real: real > 2 * short)(*lengths(some))  # noqa: E731  runs of one letter outweigh all others
    clean = [w for i in range(0, len(clean), PART) for w, out in zip(clean[i : i + PART], much(clean[i : i + PART]), strict=True) if not out]
    words = toxic + bends + clean
    n = len(toxic) + len(bends)
    y = np.where(np.arange(len(words)) < n, 1.0, -1.0)
    weight = np.where(y > 0, 1.0 / n, 1.0 / len(clean)) * len(words) / 2
    beta, bias = machine(mapped(words, z, False, root), y, weight)
    at_marks = root @ beta
    model = Model(np.concatenate([z[i : i + 4096] @ at_marks for i in range(0, len(z), 4096)]), bias)  # in double precision, and so in parts
    model.floor = float(np.quantile(sums(toxic + bends, model.weights) + bias, 0.02)) - 0.25
    return model


def fit_sharp(model: Model, toxic: dict[str, int], calm: dict[str, int]) -> None:
    """The second machine, from witnesses and the clean words nearest to them, with counts of documents."""
    bad, good = list(toxic), sorted(calm, key=lambda w: (-calm[w], w))
    bends = sorted({b for i, w in enumerate(bad) for b in bent(w, i)} - set(calm) - set(toxic))
    marks = landmarks(bad, good)
    words = bad + bends + good
    z = spread(marks)
    root = nystroem(np.exp(SHARP * ((z.T @ z).astype(np.float64) - 1)))
    y = np.array([1.0] * (len(bad) + len(bends)) + [-1.0] * len(good))
    weight = np.array([math.sqrt(toxic[w]) for w in bad] + [0.3] * len(bends) + [math.sqrt(calm[w]) for w in good])
    beta, model.bias2 = machine(mapped(words, z, True, root, SHARP), y, weight, 1e-2)
    model.marks, model.beta = marks, root @ beta


def score_words(model: Model, words: set[str], known: dict[str, float]) -> None:
    """Adds the decision values of new words to known."""
    new = [w for w in words if w not in known]
    if new:
        plain = [letters(w) for w in new]
        known.update(zip(new, np.where([bool(p) for p in plain], model.decide(plain), -BOUND).tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    The given numbers of toxic and clean labels, by hash of the id, choose the documents; a
    document with labels of both kinds counts as toxic, and of an id's texts the least one is learned from. Without toxic or clean
    documents, or without a witness, the model finds nothing toxic.
    """
    spark = docs.sparkSession
    per = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in per.groupBy("toxic").count().collect()}
    some = lowest(per.where("toxic = 1"), toxic_sample, total.get(1, 0), "doc_id").unionByName(lowest(per.where("toxic = 0"), clean_sample, total.get(0, 0), "doc_id"))
    taken = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")  # at most as many labels as asked for
    taken = written(taken.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")

    @tidy
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, the word before its first place) of each toxic document, so that copies of a document are one context; (word, null, count) over a task's clean ones."""
        clean: dict[str, int] = {}
        plain: dict[str, str] = {}
        for batch in batches:
            rows: list[tuple[str, str]] = []
            for text, toxic in zip(column(batch, "text"), column(batch, "toxic").to_pylist(), strict=True):
                text = text.as_py()
                if len(plain) > CACHE:
                    plain.clear()
                if toxic:
                    seq = [plain.get(w) or plain.setdefault(w, letters(w)) for w in text.split()]
                    first = {w: "" for w in map(letters, words_of(text) - set(text.split()))}
                    for before, w in zip(["", *seq], seq, strict=False):
                        first.setdefault(w, before)
                    rows += first.items()
                else:
                    for w in {plain.get(w) or plain.setdefault(w, letters(w)) for w in words_of(text)}:
                        clean[w] = clean.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([0] * len(rows), pa.int64())], ["word", "before", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()), pa.array([None] * len(clean), pa.string()), pa.array(clean.values(), pa.int64())], ["word", "before", "n"])

    met = taken.mapInArrow(contexts, "word string, before string, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    words = written(met.groupBy("word").agg(F.count("before").alias("toxic"), F.sum("n").alias("clean")).where("word != ''"), "words")
    n = {r.toxic: r["count"] for r in taken.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model.empty()
    share = n_toxic / (n_toxic + n_clean)
    a, b = F.least(F.col("toxic"), F.lit(n_toxic)).cast("double"), F.col("clean").cast("double")
    g2 = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    strong = words.where("toxic >= 3").withColumn("g2", g2).where((F.col("g2") >= EVIDENCE) & (b <= 0.1 * a * (1 - share) / share))
    toxic = {r.word: r.toxic for r in strong.orderBy(F.desc("g2"), "word").collect()}  # words of the sample of documents, which is of bounded size
    calm = words.where("clean > 0").where(~F.col("word").isin(list(toxic)))
    clean = [r.word for r in calm.orderBy(F.desc("clean"), "word").limit(OTHERS // 3).collect()]
    clean += [r.word for r in calm.orderBy(F.xxhash64("word"), "word").limit(OTHERS).collect()]
    if not toxic or not clean:
        return Model.empty()
    model = fit_linear(sorted(toxic), sorted(set(clean)))
    near = dict(hardest(calm, model, HARD))
    model = fit_linear(sorted(toxic), sorted({*clean, *near}))
    fit_sharp(model, toxic, dict(hardest(calm, model, HARD)))
    values = np.array([(r.toxic, r.n_words, *r.values) for r in decided(taken, model, ["toxic"]).collect()], np.float64)  # one row for each sampled label
    y = (values[:, 0] == 1).astype(float)
    weight = np.where(y > 0, total[1] / n_toxic, total[0] / n_clean)
    model.final = logistic(features(values[:, 2:], values[:, 1]), y, weight / weight.mean())
    release()
    return model


def decided(docs: DataFrame, model: Model, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns kept of docs, and word, n_words and values: the decisive word, the count of distinct words and the TOP highest decision values."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(kept)
    schema = T.StructType([*docs.select(*kept).schema, T.StructField("word", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, n, values in _decide(state.value, batches):
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in kept), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(values, pa.list_(pa.float64()))], [*kept, "word", "n_words", "values"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def _decide(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[int], list[list[float]]]]:
    """Parts of batches with their rows' decisive words, numbers of words and TOP values."""
    known: dict[str, float] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [words_of(t.as_py() or "") for t in column(part, "text")]
            if len(known) > CACHE:
                known.clear()
            score_words(model, set().union(*sets), known)
            words, values = [], []
            for s in sets:
                top: dict[str, tuple[float, str]] = {}
                for w in sorted(w for w in s if known[w] > -BOUND):
                    top.setdefault(letters(w), (known[w], w))
                best = sorted(top.values(), key=lambda x: (-x[0], x[1]))[:TOP]
                words.append(best[0][1] if best else None)
                values.append([*(x[0] for x in best), *[-BOUND] * (TOP - len(best))])
            yield part, words, [len(s) for s in sets], values


def hardest(words: DataFrame, model: Model, n: int) -> list[tuple[str, int]]:
    """The n words that the first machine holds most toxic, with their counts of clean documents."""
    state = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = sums(column(batch, "word").to_pylist(), state.value.weights)
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "clean"), pa.array(value)], ["word", "clean", "value"])

    found = words.select("word", "clean").mapInArrow(run, "word string, clean long, value double")
    return [(r.word, r.clean) for r in found.orderBy(F.desc("value"), "word").limit(n).collect()]


def score(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns carry, and score (0 to 1), predicted (1 from 0.5 on) and the decisive word (after prefix), of every row of docs.

    The whole text counts. A null text, or one without letters, scores like a
    text of no insult. Repeated rows and null ids stay.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + x for x in ("score", "predicted", "word")]
    carry = list(carry)
    schema = T.StructType([*docs.select(*carry).schema, *(T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.StringType()), strict=True))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, n, values in _decide(state.value, batches):
            p = state.value.document(np.array(values, np.float64).reshape(-1, TOP), np.array(n, np.float64))
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in carry), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(words, pa.string())], [*carry, *names])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
