"""Media columns: payloads as content-defined chunks that are stored once.

A gear hash rolls over the payload's bytes; where its high bits are zero, a
chunk ends. Digests of chunks are counted with Spark: a chunk that occurs once
stays with its payload, one that occurs more often is stored once, under its
digest. An ordered list of digests rebuilds each payload, which is verified
chunk by chunk.

Bytes move as little as possible: only the shared chunks, and the payloads that
hold some, are shuffled. Which digests are shared is told to the scan by a Bloom
filter of fixed size; a digest that it takes for shared by mistake is stored as
a shared one, which changes nothing in the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import column, slices, written

BLOCK = 64
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16_384
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, np.uint32)
#: The filter has 2**BLOOM_BITS bits (2 MB).
BLOOM_BITS, BLOOM_HASHES = 24, 4
SLICE = 4_000_000


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zeros up to a positive multiple of BLOCK, and the length without them."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks.

    The hash at a byte depends on the 32 bytes up to it: each contributes its
    gear value, shifted by its distance. It is built by doubling.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, at = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while end - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if end - at >= MIN_CHUNK:
            ends.append(end)
            at = end
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    return ends if ends and ends[-1] == n else [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _places(digests: np.ndarray) -> np.ndarray:
    """The bits of the filter for digests (rows of 32 bytes)."""
    return digests.view("<u4")[:, :BLOOM_HASHES] & np.uint32((1 << BLOOM_BITS) - 1)


def _scan(docs: DataFrame) -> DataFrame:
    """digest, n: how often each chunk occurs in a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            seen: dict[bytes, int] = {}
            for t in texts:
                for c in chunks(payload(t.as_py())[0]):
                    d = digest(c)
                    seen[d] = seen.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())], ["digest", "n"])

    return docs.select("text").mapInArrow(run, "digest binary, n long")


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A Bloom filter, as bytes, of the digests that occur more than once."""
    often = _scan(docs).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 32)
            at = _places(raw).ravel()
            np.bitwise_or.at(filled, at >> 6, np.uint64(1) << (at & np.uint32(63)).astype(np.uint64))
        word = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(filled[word].view(np.int64))], ["word", "bits"])

    words = often.mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    for r in words.toLocalIterator():  # 2**(BLOOM_BITS - 6) rows at most
        out[r.word] = np.array(r.bits, np.int64).view(np.uint64)
    return out


def store(docs: DataFrame) -> DataFrame:
    """The chunk store of docs, written to the shared folder: rows of two kinds.

    A pack (doc_id, payload digest, n_bytes, digests, own, bodies) holds a
    document's chunk list, and the compressed chunks that only it has (their places are in own).
    A chunk row (digest, body) holds a shared compressed chunk; a task writes each once,
    so that equal ones may repeat across tasks. A chunk is stored as the same bytes in either place.
    """
    state = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))
    schema = "doc_id long, payload binary, n_bytes long, digests array<binary>, own array<int>, bodies array<binary>, digest binary, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = state.value
        pack = zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            for lo, hi in slices(sizes, SLICE):
                rows: list[tuple] = []
                for i in range(lo, hi):
                    data, n = payload(texts[i].as_py())
                    parts = chunks(data)
                    keys = [digest(c) for c in parts]
                    at = _places(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32))
                    shared = ((filled[at >> 6] >> (at & np.uint32(63)).astype(np.uint64)) & np.uint64(1)).all(axis=1).tolist()
                    own = [k for k, s in enumerate(shared) if not s]
                    rows.append((ids[i].as_py(), digest(data), n, keys, own, [pack.compress(parts[k]) for k in own], None, None))
                    for k, s in enumerate(shared):
                        if s and keys[k] not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(keys[k])
                            rows.append((None, None, None, None, None, None, keys[k], pack.compress(parts[k])))
                types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "payload", "n_bytes", "digests", "own", "bodies", "digest", "body"])

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "chunks", "uncompressed")


def rebuilt(keys: list[bytes], stored: list[bytes]) -> bytes:
    """The payload of an ordered chunk list and its stored chunks; every chunk is checked against its digest."""
    unpack = zstandard.ZstdDecompressor()
    out = [unpack.decompress(b) for b in stored]
    if any(digest(c) != k for c, k in zip(out, keys, strict=True)):
        raise ValueError("a stored chunk doesn't have its digest")
    return b"".join(out)


def media(keys: list[bytes], stored: list[bytes]) -> bytes:
    """The stored form of one payload, as read: the chunk list (digests) after its length, then each stored chunk after its length."""
    return len(keys).to_bytes(4, "big") + b"".join(keys) + b"".join(len(b).to_bytes(4, "big") + b for b in stored)


def feature(data: bytes, n_chunks: int) -> str:
    """Figures of the samples: chunks, mean, deviation, entropy in bits, share of zeros."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    mean = float((n * np.arange(256)).sum()) / len(data)
    dev = (float((n * np.arange(256) ** 2).sum()) / len(data) - mean * mean) ** 0.5
    return f"chunks={n_chunks};mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};zeros={n[0] / len(data):.4f}"


_OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _values(keys: list[bytes], own: list[int], bodies: list[bytes], more: dict[int, bytes], want: bytes) -> tuple:
    found = dict(zip(own, bodies, strict=True)) | more
    stored = [found[k] for k in range(len(keys))]
    data = rebuilt(keys, stored)
    if digest(data) != want:
        raise ValueError("a rebuilt payload doesn't have its digest")
    form = media(keys, stored)
    return len(data), want.hex(), zlib.crc32(data[-BLOCK:]), len(form), hashlib.sha256(form).hexdigest(), feature(data, len(keys))


def _batch(first: list[list], values: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = [*first, *(list(x) for x in (zip(*values, strict=True) if values else [()] * 6))]
    types = [*types, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the read-back values of every row of docs (doc_id, text).

    A null text counts as empty: a payload of BLOCK zeros. Repeated rows and
    null ids stay. The values are computed from the bytes that the store gives
    back; a chunk or payload that lacks its digest raises an error. media_bytes and media_sha256 are of the bytes
    that are stored for the payload: its digests and its compressed chunks. Other columns, of any name, are dropped.
    """
    stored = store(docs)
    packs = stored.where("payload is not null").select("doc_id", "payload", "n_bytes", "digests", "own", "bodies")
    whole = F.size("own") == F.size("digests")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500).to_pylist()
                values = [_values(r["digests"], r["own"], r["bodies"], {}, r["payload"]) for r in rows]
                yield _batch([[r["doc_id"] for r in rows], [r["n_bytes"] for r in rows]], values, ["doc_id", "n_bytes"], [pa.int64(), pa.int64()])

    simple = packs.where(whole).mapInArrow(alone, f"doc_id long, n_bytes long, {_OUT}")

    mixed = packs.where(~whole)
    once = mixed.select("payload", "digests", "own", "bodies").dropDuplicates(["payload"])
    missing = once.select("payload", F.posexplode("digests").alias("pos", "digest"), "own").where(~F.array_contains("own", F.col("pos"))).drop("own")
    bodies = stored.where("digest is not null").select("digest", "body").dropDuplicates(["digest"])
    fetched = missing.join(bodies, "digest").groupBy("payload").agg(F.collect_list(F.struct("pos", "body")).alias("more"))  # one payload's chunks

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200).to_pylist()
                values = [_values(r["digests"], r["own"], r["bodies"], {x["pos"]: x["body"] for x in r["more"]}, r["payload"]) for r in rows]
                yield _batch([[r["payload"] for r in rows]], values, ["payload"], [pa.binary()])

    read = once.join(fetched, "payload").mapInArrow(filled, f"payload binary, {_OUT}")
    again = mixed.select("doc_id", "n_bytes", "payload").join(read, "payload").drop("payload")
    return simple.unionByName(again)
