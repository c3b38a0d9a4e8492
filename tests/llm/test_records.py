"""URL filters, near-duplicates of vectors and texts, media chunks, mixing, licences, the pipeline."""

import hashlib
import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuscle.llm import licenses, media, mixing, pq, resemblance, shared, simhash, urls
from corpuscle.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    return got


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert len(against_sql(spark, name)) == (500 if name.startswith("op6") else 200)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    root = np.arange(2000)
    simhash.join_roots(root, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r.node: r.root for r in shared.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: int(root[n]) for n in nodes}
    assert shared.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lowest_is_exact(spark):
    rows = spark.range(0, 50_000, 1, 20).toDF("k")
    for n in (1, 100, 3_000, 60_000):
        want = [r.k for r in rows.orderBy(F.xxhash64("k"), "k").limit(n).collect()]
        assert [r.k for r in shared.lowest(rows, n, 50_000, "k").collect()] == want
    assert shared.lowest(rows.where("false"), 5, 0, "k").count() == 0


def brute_print(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_query(spark):
    rows = queries()["op9_simhash"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in docs.items()}
    ids = sorted(prints)
    root = np.arange(max(ids) + 1)
    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            simhash.join_roots(root, np.array([a]), np.array([b]))
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == root[r.doc_id]


def test_gray_tree_finds_all_couples():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)), np.array([0, 1, 3, 7, (1 << 64) - 1], np.uint64)]))
    for limit in (0, 2, 4):
        tree = simhash.GrayTree(fps)
        got = {(int(fps[q]), int(tree.fps[n])) for qs, ns in tree.search(fps, limit) for q, n in zip(qs, ns, strict=True)}
        want = {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= limit}
        assert got == want
    assert list(simhash.GrayTree(fps[:0]).search(fps, 2)) == []
    ranks = simhash.gray_rank(simhash.GrayTree(fps).fps)
    assert (ranks[1:] > ranks[:-1]).all()


def test_simhash_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_ROWS", 5)
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    fps = np.unique(np.concatenate([base, *(base ^ (np.int64(1) << rng.integers(0, 63, 60)) for _ in range(6))]))
    root = np.arange(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count((fps ^ fps[i]).view(np.uint64)) <= 2)
        simhash.join_roots(root, np.full(len(j), i), j)
    edges = simhash.near_edges(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    got = {r.node: r.root for r in shared.connected(edges).collect()}
    assert all(got.get(int(f), int(f)) == int(fps[root[i]]) for i, f in enumerate(fps))


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.groups(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[6].component_id == 5
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert simhash.groups(none).count() == 0 and simhash.deduplicated(none).count() == 0


def brute_links(rows, cosine):
    out, root = {}, {}
    good = []
    for k, (_, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        good.append((k, x / np.sqrt((x * x).sum()), label))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = [0] * len(rows)
    for (a, x, la), (b, y, lb) in itertools.combinations(good, 2):
        if la == lb and len(x) == len(y) and float(x @ y) >= cosine:
            n[a] += 1
            n[b] += 1
            parent[find(a)] = find(b)
    for k, r in enumerate(rows):
        root.setdefault(find(k), []).append(r[0])
    for k, r in enumerate(rows):
        out.setdefault(r[0], []).append((n[k], min(x for x in root[find(k)] if x is not None) if any(x is not None for x in root[find(k)]) else None))
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST_ROWS", 30)
    monkeypatch.setattr(pq, "BLOCK", 25)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(300):
        v = (centres[k % 12] + 0.09 * rng.normal(size=16)).astype(np.float32).tolist()
        rows.append((k, v, k % 12 // 4))
    rows += [(400, rows[3][1], 0), (401, rows[3][1], 0), (402, rows[3][1], None), (403, None, 1), (404, [0.0] * 16, 1), (405, [float("nan")] * 16, 1), (406, [*rows[5][1][:15], None], 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [float("inf")] + [0.0] * 15, 1), (410, [], 1), (411, (np.array(rows[3][1]) * 3).tolist(), 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in pq.links(df).collect()}
    want = brute_links([(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in rows], 0.98)
    assert len(got) == len(rows)
    for k, r in got.items():
        assert (r.n_links, r.component_id) == want[k][0], k
        assert r.kept == (r.component_id == k)
    assert pq.links(df.where("false")).count() == 0 and pq.links(df.where("label is null")).count() == 1


def test_links_of_repeated_ids_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(5, [1.0, 0.0, 0.1], 0), (3, [1.0, 0.0, 0.11], 0), (5, [0.0, 1.0, 0.0], 0), (8, [0.0, 0.0, 2.0, 0.0], 0), (9, [0.0, 0.0, 1.0, 0.0], 0)]
    rows += [(100 + k, [*map(float, rng.normal(size=2 + k % 1200))], 1) for k in range(1300)]  # over a thousand lengths
    got = {}
    for r in pq.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert sorted(got[5]) == [(0, 5, True), (1, 3, False)] and got[3] == [(1, 3, True)] and got[9] == [(1, 8, False)]
    assert sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").toPandas()
    got = queries()["op6_embedding_dedup"](spark, f"/root/testdata/sf{sf}").toPandas().set_index("vec_id")
    x = np.stack(rows["embedding"]).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label, ids = rows["label"].to_numpy(), rows["vec_id"].to_numpy()
    near = ((x @ x.T) >= 0.98) & (label[:, None] == label)
    want = near.sum(axis=1) - 1
    found = got.loc[ids, "n_links"].to_numpy()
    assert len(got) == len(rows) and (found <= want).all()
    assert found.sum() >= 0.9 * want.sum()
    root = np.arange(len(ids))
    a, b = np.nonzero(near)
    simhash.join_roots(root, a, b)
    lowest = {r: ids[root == r].min() for r in np.unique(root)}
    assert (got.loc[ids, "component_id"].to_numpy() == [lowest[r] for r in root]).all()


def test_media_values_by_hand(spark, odd, none):
    got = media.features(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].n_bytes == 0 and by[1].payload_bytes == 64 and by[1].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() == by[2].payload_sha256
    assert by[1].tail_crc32 == zlib.crc32(bytes(64))
    assert [x for x in by[5]][1:] == [x for x in by[6]][1:]
    assert media.features(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in media.features(docs).collect():
        data, n = media.payload(text[r.doc_id])
        parts = media.chunks(data)
        stored = [zstandard.ZstdCompressor(level=3).compress(c) for c in parts]
        form = len(parts).to_bytes(4, "big") + b"".join(hashlib.sha256(c).digest() for c in parts) + b"".join(len(x).to_bytes(4, "big") + x for x in stored)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), media.feature(data, len(parts)))


def test_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 200_000, np.uint8).tobytes()
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(media.MIN_CHUNK <= len(p) <= media.MAX_CHUNK for p in parts[:-1])
    h, slow = 0, []
    for b in data[:5000]:
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        slow.append(h >> (32 - media.MASK_BITS) == 0)
    at, ends = 0, []
    for k, cut in enumerate(slow):
        if cut and k + 1 - at >= media.MIN_CHUNK:
            ends.append(k + 1)
            at = k + 1
    assert [e for e in media.cuts(data) if e <= 5000] == ends
    moved = media.chunks(b"xyz" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert media.cuts(b"") == [0] and media.cuts(bytes(100_000))[0] <= media.MAX_CHUNK
    with pytest.raises(ValueError):
        media.rebuilt([b"0" * 32], [zstandard.ZstdCompressor().compress(b"a")])


def test_quotas():
    got = mixing.quotas([100, 10, 1000], [5, 2, 1], 1110)
    assert got == pytest.approx([300, 30, 780]) and sum(got) == pytest.approx(1110)
    assert mixing.quotas([5], [1], 5) == [5] and mixing.quotas([0, 10], [5, 2], 10) == [0, 10]
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 7).tolist()
        w = [5, 2, 1, 5, 2, 1, 5]
        t = mixing.quotas(sizes, w, sum(sizes))
        open_, left = set(range(7)), float(sum(sizes))
        want = [0.0] * 7
        while True:
            share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
            over = [i for i in open_ if share[i] > 3 * sizes[i]]
            if not over:
                for i in open_:
                    want[i] = share[i]
                break
            for i in over:
                want[i] = 3.0 * sizes[i]
                left -= want[i]
                open_.remove(i)
            if not open_:
                break
        assert t == pytest.approx(want)


def test_flow_spreads_repetition():
    # pattern 0 serves only source 0, pattern 1 both, pattern 2 only source 1
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [25, 5])
    used = [sum(f.values()) for f in flow]
    assert flow[0].get(0, 0) + flow[1].get(0, 0) == 25 and flow[1].get(1, 0) + flow[2].get(1, 0) == 5
    cost = sum(max(0, u - 10) + max(0, u - 20) for u in used)
    best = min(sum(max(0, u - 10) + max(0, u - 20) for u in (a, 25 - a + b, 5 - b)) for a in range(26) for b in range(6) if a <= 30 and 25 - a + b <= 30)
    assert cost == best


def test_mix_overlapping_and_odd(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(1, 40)), [["a"], ["a", "b"], ["b", "b"], [None], []][int(rng.integers(5))]) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    got = mixing.mix(df).collect()
    assert len(got) == 2000 and all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] for r in got)
    total = sum(r.taken for r in got)
    assert abs(total - sum(r[1] for r in rows)) < 200
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    sized = odd.select("doc_id", mixing.word_count().alias("size"), F.array("source").alias("sources"), "extra")
    assert mixing.mix(sized).count() == odd.count()
    empty = none.select("doc_id", mixing.word_count().alias("size"), F.array("source").alias("sources"))
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(sized.where("size = 0")).collect()} == {0}


def test_mix_meets_targets(spark):
    got = queries()["op8_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    by = got.groupby(["target", "source_size"])["taken"].sum().reset_index()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert all(abs(r.taken - r.target) <= max(2000, 0.05 * r.target) for r in by.itertuples() if r.target > 0)


def test_url_parts(spark):
    cases = [("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://example.com/en/", "example.com", "/en/", "example.com/en/", "block"), ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"), ("http://a.net/esx", "a.net", "/esx", None, None), ("a.com/x", "", "", None, None), (None, "", "", None, None), ("http://x.com", "x.com", "", None, None), ("http://x.com?q=/", "x.com", "", None, None), ("http://notcom/", "notcom", "/", None, None), ("http://com/a://b", "com", "/a://b", "com/", "allow"), ("://", "", "", None, None), ("http://ÄX.com/É", "Äx.com", "/É", "com/", "allow"), ("", "", "", None, None)]
    df = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df.where("false")).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        items = sorted({f"t{int(x)}" for x in rng.integers(0, 7, 4)})
        rows.append((items, "block" if "t1" in items and "t2" in items or rng.random() < 0.05 else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got, twins = urls.mine(df, 0.01, 0.8)
    assert not twins
    freq = {}
    for items, label in rows:
        for n in range(1, len(items) + 1):
            for c in itertools.combinations(items, n):
                for x in (frozenset(c), frozenset({*c, urls.LABEL + label})):
                    freq[x] = freq.get(x, 0) + 1
    freq = {k: n for k, n in freq.items() if n >= 0.01 * len(rows)}
    assert got == urls.rules_of(freq, 0.8)
    assert any(r.items == {"t1", "t2"} and r.verdict == "block" for r in got)
    index = urls.Index(got)
    for items, _ in rows:
        assert index.match(items) == next((r for r in got if r.items <= set(items)), None)
    assert urls.mine(df.where("false")) == ([], {})
    # forty tokens that always occur together, and a long path, are mined in no time and lose nothing
    long = [f"q:k{k:02d}" for k in range(40)]
    more = spark.createDataFrame([(long + ["h0:com"], "block")] * 50 + [(["h0:com", f"p0:x{k % 7}"], "allow") for k in range(60)], "tokens array<string>, label string")
    rules, twins = urls.mine(more)
    assert set(twins) == set(long[1:]) and urls.Index(rules, twins).match(["q:k33"]).verdict == "block" and urls.Index(rules, twins).match(["p0:x3"]).verdict == "allow"


def test_url_query_equals_brute_force(spark):
    """Verdicts from the text of the URLs alone: combinations counted one by one, rules without their index."""
    import re
    from urllib.parse import urlsplit

    rng = np.random.default_rng(5)
    pool = [f"http://{a}{b}.{c}/{d}/{e}/{f}/deep/part/{g}?k={g}&{d}=1#x" for a in ("www.", "a.b.c.d.e.", "") for b in ("example", "site") for c in ("com", "net", "org") for d in ("en", "fr", "shop") for e in ("x", "cart") for f in ("1", "item") for g in ("q", "7")]
    rows = [(k, pool[int(rng.integers(len(pool)))]) for k in range(600)]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def parts(url):
        u = urlsplit(url)
        out = {("h", i if i < 4 else "+", "#" if re.search("[0-9]", x) else x) for i, x in enumerate(reversed(u.netloc.split(".")))}
        out |= {("p", i if i < 3 else "+", "#" if re.search("[0-9]", x) else x) for i, x in enumerate(filter(None, u.path.split("/")))}
        return out | {("q", x.split("=")[0]) for x in u.query.split("&") if x}

    stated, sets = {}, {}
    for k, url in rows:
        u = urlsplit(url)
        fits = [r for r in rules if (u.netloc == r[1] or u.netloc.endswith("." + r[1])) and u.path.startswith(r[2])]
        stated[k] = max(fits, key=lambda r: len(r[1] + r[2])) if fits else None
        sets[k] = parts(url)
    known = [(sets[k], s[0]) for k, s in stated.items() if s]
    least, found = 0.002 * len(known), []
    for size in range(1, 3):  # no single label or couple can be beaten by a longer one in these URLs
        for c in {c for s, _ in known for c in itertools.combinations(sorted(s, key=str), size)}:
            labels = [v for s, v in known if set(c) <= s]
            for v in set(labels):
                if labels.count(v) >= least and labels.count(v) >= 0.8 * len(labels):
                    found.append((labels.count(v) / len(labels), labels.count(v), size, v, set(c)))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for k, s in stated.items():
        if s:
            assert got[k].verdict == s[0] and got[k].rule == s[1] + s[2]
            continue
        hits = [f for f in found if f[4] <= sets[k]]
        assert got[k].rule is None
        if hits:
            best = max(f[:2] for f in hits)
            assert got[k].verdict in {f[3] for f in hits if f[:2] == best}


def wrapped(words, width):
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def test_licenses_odd(spark, odd, none):
    rng = np.random.default_rng(7)
    prose = [f"word{int(x)}" for x in rng.integers(0, 500, 900)]
    mit, gpl = licenses.TEMPLATES["MIT"].split(), open(f"{licenses.TEXTS}/GPL-3.txt").read()
    more = [(20, "Prose.\nReleased under the MIT License.\nmore"), (21, licenses.TEMPLATES["ISC"].replace("fee", "charge")), (22, "released under\nthe MIT license"), (None, "All rights reserved."), (23, "All rights reserved.\nALL RIGHTS RESERVED"), (23, "All rights reserved.\nALL RIGHTS RESERVED"), (24, wrapped(mit, 10) + "\n" + wrapped(prose, 12)), (25, " ".join(prose[:300] + mit[:100] + ["odd", "words"] + mit[104:] + prose[300:])), (26, "Copyright 2024 Acme Inc. All rights reserved."), (27, " ".join(prose) + " Licensed under CC BY 4.0."), (28, wrapped(prose, 9) + gpl + wrapped(prose, 9)), (29, " ".join(prose)), (30, "licence"), (31, wrapped(mit, 9) + "\n" + wrapped(licenses.TEMPLATES["ISC"].split(), 9) + "\n" + wrapped(mit, 11))]
    got = {r.doc_id: r for r in licenses.documents(spark.createDataFrame([(*r, "z") for r in more], "doc_id long, text string, license string")).collect()}
    assert got[20].license == "MIT-notice" and got[20].dice == 1.0 and got[21].license == "ISC" and 0.9 < got[21].dice < 1
    assert got[22].license == "MIT-notice" and got[None].license is None and got[23].license == "all-rights-reserved"
    assert got[24].license == "MIT" and got[24].dice == 1.0 and got[25].license == "MIT" and 0.9 < got[25].dice < 1
    assert got[26].license == "all-rights-reserved" and got[27].license == "CC-BY-4.0-notice" and got[28].license == "GPL-3.0" and got[28].dice > 0.99
    assert got[29].license is None and got[30].license is None and {"MIT", "ISC"} <= set(got[31].licenses.split(","))
    assert {r.license for r in licenses.documents(odd).collect()} == {None} and licenses.documents(none).count() == 0
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        licenses.scan(df, {"x": "word"})
    plan = licenses.documents(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute_licenses(text, templates, least):
    """licence -> the best coefficient over lines, the whole text and every window of a template's size."""
    lines = [licenses.normal_words(x) for x in text.lower().split("\n")]
    best = {}
    for k, words in licenses.templates_of(templates).items():
        want = Counter(zip(words, words[1:], strict=False))
        m = sum(want.values())
        segments = [list(zip(x, x[1:], strict=False)) for x in [*lines, [w for x in lines for w in x]]]
        whole = segments[-1]
        segments += [whole[max(s, 0) : s + m] for s in range(1 - m, len(whole))]
        dice = max((2 * (Counter(x) & want).total() / (len(x) + m) for x in segments), default=0)
        if dice >= least:
            best[k.split("#")[0]] = max(dice, best.get(k.split("#")[0], 0))
    return best


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(12)]
    made = {f"t{k}": " ".join(rng.choice(words, n)) for k, n in enumerate((2, 3, 5, 9, 17, 40))} | {"MIT": licenses.TEMPLATES["MIT"], "MIT-notice": licenses.TEMPLATES["MIT-notice"], "MIT-notice#2": licenses.TEMPLATES["MIT-notice#2"]}
    mit = licenses.TEMPLATES["MIT"].split()
    parts = [mit[k : k + 14] for k in range(0, len(mit), 14)]
    texts = ["Released under the MIT", "so it is released\nunder the mit", "a " * 30 + " ".join(w for p in parts[::-1] for w in p), " ".join(mit).replace("ermission", "ermit").replace("opyright", "laim").replace("ARRANT", "ORD")]
    for k, t in enumerate([*made.values()] * 4):
        w = t.split()
        at = int(rng.integers(0, len(w)))
        w = w[at:] + w[:at] if k % 2 else [x for x in w if rng.random() > 0.1]
        w = [*rng.choice(words, rng.integers(0, 30)), *w, *rng.choice(words, rng.integers(0, 30))]
        texts.append(" ".join(x + ("\n" if rng.random() < 0.1 else "") for x in w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(k, name): round(d, 9) for k, t in enumerate(texts) for name, d in brute_licenses(t, made, 0.8).items()}
    assert {(0, "MIT-notice"), (1, "MIT-notice"), (2, "MIT"), (3, "MIT")} <= set(want) and len(want) > 30
    assert {(r.doc_id, r.license): round(r.dice, 9) for r in licenses.scan(df, made).collect()} == want
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    got = con.execute(licenses.sql(made)).fetchall()
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in got if r[4]) == sorted(tuple(r) for r in licenses.documents(df, made).collect() if r.n_licenses)
    assert {r[0]: r[3] for r in got} == {k: ",".join(sorted(n for j, n in want if j == k)) for k in range(len(texts))}


def test_pipeline_on_small_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step, seen = docs, [docs.count()]
    for k, (_, f) in enumerate(cp.STAGES):
        step = shared.written(f(spark, step, SF), f"t{k}")
        seen.append(step.count())
        if k < len(cp.STAGES) - 1:
            assert step.columns == docs.columns
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] and seen[1] >= 0.97 * seen[0] and seen[-1] == seen[-2] > 0
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, step.collect()))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, copies int, copy int, size long, _key string, _digest long, score double, predicted int"


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    more = [(None, plain[3][1] + " tail", "en", "src1", 5), (None, "words of no id at all here", "en", None, 5), (7_000, None, "en", "src1", 0), (7_001, "", "en", "src1", 0), (7_002, "the first of two unlike texts of one id", "en", "src1", 9), (7_002, "another thing and of that the one which is here", "en", "src1", 9), (7_003, "the and of that thing repeated as it is", "en", "src2", 9), (7_003, "the and of that thing repeated as it is", "en", "src2", 9), (7_004, "words " * 30_000, "en", "src2", 9)]
    odd = spark.createDataFrame([(*r, 1, 2, 3, "k", 4, 0.5, 1) for r in plain + more], CLASHING)
    step, seen = odd, []
    for k, (_, f) in enumerate(cp.STAGES):
        before, step = step, shared.written(f(spark, step, SF), f"o{k}")
        seen.append(step.collect())
        if k < len(cp.STAGES) - 1:
            assert step.columns == odd.columns
            assert {tuple(r) for r in seen[-1]} <= {tuple(r) for r in before.collect()}
    language, _, alone, mixed, _ = seen
    assert len([r for r in language if r.doc_id == 7_003]) == 2 and not [r for r in language if r.doc_id in (7_000, 7_001)]
    assert len([r for r in alone if r.doc_id == 7_003]) == 1 and len([r for r in alone if r.doc_id == 7_002]) == 2
    assert [r.text for r in alone if r.doc_id is None] == ["words of no id at all here"] or len([r for r in alone if r.doc_id is None]) == 2
    assert len(mixed) == len(seen[4])
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    by = {}
    for r in alone:
        by.setdefault(r.source, [[], 0])[0].append(r)
    for r in mixed:
        by[r.source][1] += words([r])
    heft = [(5, 2, 1)[k % 3] for k in range(len(by))]
    names = sorted(by, key=lambda x: (x is None, x or ""))
    targets = mixing.quotas([words(by[n][0]) for n in names], heft, words(alone))
    for n, t in zip(names, targets, strict=True):
        assert abs(by[n][1] - t) <= max(words([r]) for r in by[n][0])
    empty = odd.where("false")
    for _, f in cp.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_near_duplicates_of_one_id(spark):
    rows = [(5, "one text of this id and its words are these"), (5, "quite another text that shares nothing with it at all"), (5, "one text of this id and its words are these"), (6, "one text of this id and its words are these"), (None, "quite another text that shares nothing with it at all"), (None, None), (9, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    for module in (resemblance, simhash):
        got = sorted((r.doc_id, r.text) for r in module.deduplicated(df).collect())
        assert got == sorted([(5, rows[0][1]), (5, rows[1][1]), (9, "")])


def brute_groups(docs):
    """doc_id -> smallest doc_id over links of resemblance 0.8 of five-word shingles, all couples; and the number of linked couples of different sets."""
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    root, links = np.arange(max(ids) + 1), 0
    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            links += x != y
            simhash.join_roots(root, np.array([a]), np.array([b]))
    return {k: int(root[k]) for k in ids}, links


def test_near_duplicate_stage_equals_brute_force(spark, monkeypatch):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    made, far = {}, 0
    for k in range(40):  # copies with changed words, of 20 to 300 words, and a line that all hold
        base = [*"one line that every text of these does hold".split(), *rng.choice(words, rng.integers(20, 600))]
        for c in range(5):
            text = list(base)
            for at in rng.integers(9, len(base), 0 if c == 0 else max(1, len(base) * c // 90)):
                text[at] = f"new{rng.integers(1_000_000)}"
            made[100_000 + 5 * k + c] = " ".join(text)
        far += (simhash.fingerprint(made[100_000 + 5 * k], 5) ^ simhash.fingerprint(made[100_001 + 5 * k], 5)).bit_count() > 2
    assert far > 10
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    want, links = brute_groups({r.doc_id: r.text for r in both.collect()})
    assert links > 40
    monkeypatch.setattr(resemblance, "COUPLES", 500)
    for common, first, crowd in ((4, 32, 0), (10**9, 10**9, 8), (10**9, 32, 8)):  # neither the order of shingles, the short prefixes nor the couples that go first change a group
        monkeypatch.setattr(resemblance, "CROWD", crowd)
        monkeypatch.setattr(resemblance, "COMMON", common)
        monkeypatch.setattr(resemblance, "FIRST", first)
        got = {r.doc_id: r.component_id for r in resemblance.groups(both).collect()}
        assert got == want
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, both, SF).collect()) == sorted({*want.values()})


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Edited copies of one text, most of them not alike, don't meet by the square of their number."""
    rng = np.random.default_rng(5)
    made = {}
    for base, copies in ((150, 240), (90, 60)):
        words = [f"v{int(x)}" for x in rng.integers(0, 400, base)]
        for c in range(copies):
            text = list(words)
            for at in rng.integers(0, base - 8, c % 7):
                text[at : at + 1] = [[f"v{rng.integers(400)}"], [], [f"v{rng.integers(400)}", text[at]]][int(rng.integers(3))]
            made[len(made)] = " ".join(text)
    made |= {len(made) + k: " ".join([*made[k].split()[:100], *(f"u{k}_{j}" for j in range(k))]) for k in range(60)}
    want, links = brute_groups(made)
    assert links > 1000 and len({*want.values()}) > 60
    looked = []
    joined = resemblance._joined
    monkeypatch.setattr(resemblance, "_joined", lambda apart, *more: looked.append(apart.count()) or joined(apart, *more))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in resemblance.groups(df).collect()} == want
    assert looked[0] < 1000, looked


def test_sketches_bound_the_difference(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(resemblance, "CELLS_AT_ONCE", 40)  # several portions
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 2, 63, 64, 65, 90, 128, 129, 700, 1023, 2100, 5000, 8000)]
    sets += [np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.choice(pool, len(x) // 20)])) for x in sets]
    rows = pa.chunked_array([[resemblance.sketch(x) for x in some] for some in (sets[:5], sets[5:])], pa.binary())
    left, right = (x.ravel() for x in np.indices((len(sets), len(sets))))
    differ = resemblance.Sketches(rows).differ(left, right)
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)])
    assert (differ <= apart).all() and ((apart - differ) % 2 == 0).all() and (differ[left == right] == 0).all()
    assert (differ > 0.3 * np.minimum(apart, 2048))[(apart > 20) & (np.abs(left - right) == 13)].all()


def test_sharers_of_a_part_do_not_meet(spark, monkeypatch):
    """Texts that share about half of their words, as one template has them, are no candidates; near copies among them are found."""
    rng = np.random.default_rng(9)
    made = {}
    for _ in range(2):
        part = [f"p{int(x)}" for x in rng.integers(0, 5000, 120)]
        for _ in range(100):
            made[len(made)] = " ".join([*part, *(f"o{int(x)}" for x in rng.integers(0, 10**6, 60))])
        for k in range(40):  # near copies: two places changed
            text = made[len(made) - 1 - int(rng.integers(60))].split()
            text[130 + k], text[5] = "here", f"there{k}"
            made[len(made)] = " ".join(text)
    want, links = brute_groups(made)
    assert links >= 80 and 200 <= len({*want.values()}) < 280
    monkeypatch.setattr(resemblance, "COMMON", 10**9)
    monkeypatch.setattr(resemblance, "FIRST", 10**9)
    met = []
    possible = resemblance._possible
    monkeypatch.setattr(resemblance, "_possible", lambda couples: met.append(couples.count()) or possible(couples))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in resemblance.groups(df).collect()} == want
    assert met[-1] < 2000, met


def test_resemblance_odd_rows(spark, odd, none):
    got = resemblance.groups(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[6].component_id == 5
    kept = resemblance.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert resemblance.groups(none).count() == 0 and resemblance.deduplicated(none).count() == 0
