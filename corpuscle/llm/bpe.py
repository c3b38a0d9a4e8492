"""BPE encoding and decoding with a given byte-level vocabulary.

Merges are taken from a priority queue of ranks over a doubly linked list of
symbols; a queue entry whose symbols have changed since is stale and skipped.
Decoding concatenates the byte strings of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuscle.llm.shared import column, memories, tidy

#: Words, and pre-tokens, kept with their ids in a worker.
CACHE = 200_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """What was worked out before, up to CACHE entries.

    A full memory takes no more (the frequent entries came first), and starts
    anew when it has missed twice as often as it has entries.
    """

    def __init__(self, work: Callable[[str], tuple[int, ...]]) -> None:
        self.work, self.missed = work, 0

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.work(key)
        if len(self) < CACHE:
            if len(key) <= 64:
                self[key] = ids
        else:
            self.missed += 1
            if self.missed > 2 * CACHE:
                self.clear()
                self.missed = 0
        return ids


class ByteBPE:
    """Encoder and decoder for a tokenizer file of the byte-level kind."""

    def __init__(self, source: str) -> None:
        """source: the JSON text of the tokenizer file."""
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space or normalizer is supported")
        vocab = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        couples = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # (left id, right id), as one int: rank and the id of the joined symbol
        self.merges = {vocab[x] << 20 | vocab[y]: (rank, vocab[x + y]) for rank, (x, y) in enumerate(couples)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with word or space options aren't supported")
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.added_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(SPLIT).findall
        self.inner_space = re.compile(r"\s (?!\S)").search
        self.cache = Known(lambda word: self.merge(word.encode()))
        self.words = Known(lambda word: self.chunk(f" {word}"))

    def forget(self) -> None:
        """Empties the memories, when another operator's task begins in this worker."""
        for known in (self.cache, self.words):
            known.clear()
            known.missed = 0

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = [*map(self.byte_id.__getitem__, data)]
        n = len(ids)
        if n == 1:
            return (ids[0],)
        merges = self.merges.get
        # an entry is rank and left position in one int; ties go to the leftmost
        heap = [got[0] << 32 | i for i, got in enumerate(map(merges, [x << 20 | y for x, y in pairwise(ids)])) if got is not None]
        if not heap:
            return tuple(ids)
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            left = ids[i]
            if left < 0:
                continue
            j = after[i]
            if j >= n:
                continue
            got = merges(left << 20 | ids[j])
            if got is None or got[0] != top >> 32:
                continue  # stale: one of the two has changed since
            ids[i] = new = got[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = merges(new << 20 | ids[k])
                if got is not None:
                    push(heap, got[0] << 32 | i)
            h = before[i]
            if h >= 0:
                got = merges(ids[h] << 20 | new)
                if got is not None:
                    push(heap, got[0] << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def chunk(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))

    def plain(self, text: str) -> Iterable[int]:
        """The ids of text without added tokens.

        A space begins a pre-token if it doesn't stand inside or at the end of
        a run of white space, so that text falls apart at its spaces and words
        met before needn't be split again.
        """
        if self.inner_space(text):
            return chain.from_iterable(map(self.cache.__getitem__, self.split(text)))
        words = text.split(" ")
        head = self.chunk(words[0])
        del words[0]
        return chain(head, chain.from_iterable(map(self.words.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        if self.added_re is None or not any(t in text for t in self.added):
            return list(self.plain(text))
        out: list[int] = []
        for part in self.added_re.split(text):
            out += (self.added[part],) if part in self.added else self.plain(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[int, ByteBPE] = {}


def tokenizer(source: str) -> ByteBPE:
    """The tokenizer of a file's text; a worker process builds it once."""
    key = hash(source)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(source)
    memories[__name__] = _made[key].forget
    return _made[key]


def read_spec(path: str) -> str:
    """The text of a tokenizer file that lies on the driver; it is of bounded size and goes to the executors with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column out: the token ids of each whole text (null: as empty).

    Every row stays, with all its columns; a column named like out is replaced.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*kept).schema, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(source.value)
        for batch in batches:
            texts = column(batch, text).to_pylist()
            ids = pa.array([bpe.encode(t or "") for t in texts], pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with the column out: the text of each list of ids (null: empty)."""
    source = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*kept).schema, T.StructField(out, T.StringType(), False)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(source.value)
        for batch in batches:
            texts = pa.array([bpe.decode(x or ()) for x in column(batch, ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: it is encoded, and decoded again from the ids.

    A null text counts as empty (no token); repeated rows and null ids stay; other columns are dropped.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(source.value)
        strings = bpe.strings.__getitem__
        names = {i: str(i) for i in bpe.strings}.__getitem__
        for batch in batches:
            n, enc, dec = [], [], []
            for t in column(batch, "text"):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                enc.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                raw = b"".join(map(strings, ids))
                dec.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
