"""Language ID, toxicity, BPE, main text."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bpe, html, langid, toxicity
from corpuscle.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.01"


def test_language_accuracy_and_contract(spark):
    got = queries()["op1_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (langid.crc_mod(r.doc_id, 4) == 2) for r in rows) and len(out) > 100
    assert np.mean([r.lang == r.lang_pred for r in out if r.lang]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_finds_both_languages():
    words = {"en": "the of and that with thing ingly tion onthe", "de": "der und die ein schlich heit keit ung"}
    counts = {k: np.bincount(langid.trigrams(v.encode() * 40)[0], minlength=langid.BUCKETS) for k, v in words.items()}
    model = langid.Model.fit(counts)
    text = (words["en"] + " ") * 6 + (words["de"] + " ") * 2
    pred, score, langs, parts = langid.predict(model, [text, words["de"], "1234", None])
    assert pred == ["en", "de", "und", "und"] and langs[0] == ["en", "de"] and 0.6 < parts[0][0] < 0.95
    assert sum(parts[0]) == pytest.approx(1) and langs[1] == ["de"] and score[2:] == [0.0, 0.0]


def test_language_odd_rows(spark, odd, none):
    model = langid.train(odd)
    assert model.languages == ["en"]  # the only text of xx has no letter
    got = langid.identify(odd, model, ["doc_id", "extra", "score"], "p_").collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert [by[k].p_lang_pred for k in (1, 2, 3, 7)] == ["und"] * 4 and by[4].p_lang_pred == "en" and by[4].score == 0.5
    assert by[8].p_lang_pred == "en"
    assert langid.train(none).languages == [] and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries()["op5_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.predicted == (r.score >= 0.5) for r in got.values())
    out = [(got[k].predicted, v) for k, v in labels.items() if k in got and got[k].held_out]
    clean = [p for p, v in out if v == 0]
    assert np.mean(clean) < 0.05
    known = [(got[k].predicted, v) for k, v in labels.items() if k in got and not got[k].held_out]
    assert np.mean([p for p, v in known if v == 1]) > 0.6


def test_toxicity_tolerates_gaps():
    toxic = {"idiot": 60, "stupid": 55, "moron": 50, "pathetic": 40, "scum": 40}
    clean = ["thing", "ononthe", "there", "andering", "station", "students", "motion", "patient", "study", "morning", "onion", "riot", "idea", "scan", "stump", "tidy"]
    model = toxicity.fit_linear(sorted(toxic), clean)
    toxicity.fit_sharp(model, toxic, {w: 20 for w in clean})
    bad = ["idiot", "i-d-i-o-t", "idxiot", "iddiot", "st.upid", "stupiid", "M0RON", "pathettic"]
    value = dict(zip(bad + clean, model.decide([toxicity.letters(w) for w in bad + clean]), strict=True))
    assert all(value[w] > 0 for w in bad) and all(value[w] < 0 for w in clean), value
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_training_holds_little_memory():
    """The driver trains: beside the landmarks (42 MB) and one matrix of the words (25 MB) it holds parts only, and keeps nothing of them."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, rng.integers(3, 12)))
    bad = sorted({word() for _ in range(150)})
    good = sorted({word() for _ in range(9000)} - set(bad))
    toxicity.columns.cache_clear()
    tracemalloc.start()
    model = toxicity.fit_linear(bad, good)
    toxicity.fit_sharp(model, {w: 20 for w in bad}, {w: 20 for w in good[:3000]})
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100e6 and kept < 10e6, (peak, kept)
    x = toxicity.mapped(bad, toxicity.spread(model.marks), True, np.eye(len(model.marks)), toxicity.SHARP)
    assert np.allclose(x[:, :-1] @ model.beta + model.bias2, (np.exp(toxicity.SHARP * (toxicity.kernel(bad, toxicity.columns(model.marks), True) - 1))) @ model.beta + model.bias2)


def test_kernel_equals_brute_force():
    words = ["thth", "idiot", "a", "óóó", "banana"]

    def phi(w):
        s, out = f"^{w}$", {}
        for i in range(len(s)):
            for j in range(i + 1, min(i + 1 + toxicity.REACH, len(s))):
                for k in range(j + 1, min(j + 1 + toxicity.REACH, len(s))):
                    key = s[i].replace("$", "^") + s[j].replace("$", "^") + s[k].replace("$", "^")
                    out[key] = out.get(key, 0) + toxicity.GAP ** (k - i - 2)
        return out

    f = [phi(w) for w in words]
    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    want = [[dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) for b in f] for a in f]
    got = toxicity.kernel(words, np.ascontiguousarray(toxicity.vectors(words).T), True)
    assert np.allclose(got, want, atol=1e-5)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and not any(r.predicted for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels.where("false")).marks == ()


def test_bpe_equals_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation(), lib.no_padding()
    mine = bpe.ByteBPE(bpe.read_spec(tokenizer_path()))
    rng = np.random.default_rng(5)
    texts = ["", " ", "a  b", "<|endoftext|>x<|endoftext|>", "I'll don't 's", "\u00a0\u2003 \n\n x ", "aaaa" * 300, "é日本😀", "x \n  y \t\t", "end  "]
    texts += ["".join(rng.choice(list("  \n\tab1,.é\u00a0'st<|>endoftx"), 40)) for _ in range(800)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 200").fetchall()]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(t) == e.ids, t
        assert mine.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False) == t
    mine.forget()
    assert mine.encode("again and again") == lib.encode("again and again", add_special_tokens=False).ids
    ids = bpe.encode(odd, tokenizer_path())
    back = bpe.decode(ids.withColumn("was", F.coalesce("text", F.lit(""))), tokenizer_path(), out="back")
    assert back.where("was != back").count() == 0 and back.count() == odd.count()


def test_bpe_query(spark, odd, none):
    import hashlib

    rows = {r.doc_id: r for r in bpe.digests(odd, tokenizer_path()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == empty == rows[2].decoded_sha256
    assert bpe.digests(none, tokenizer_path()).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>
<div id="cookie-banner"><p>We use cookies.</p><button>OK</button></div><header><h1>Site</h1><nav><ul><li><a href=/a>Home</a></li></ul></nav></header>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text &lt;here&gt;.</p><!-- no --><p>Second part of it.<div class="ad">Buy this now!</div><p>Third &eacute; part.</article>
<aside class=sidebar><p>Related text that is long enough to look real.</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot. Truly.</p></div></section>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2020 All.</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE, html.model().ready()) == "Head & line\n\nFirst bold text <here>.\n\nSecond part of it.\n\nThird é part."
    assert html.main_text(None, html.model()) == "" == html.main_text("", html.model()) == html.main_text("<script>x</script>", html.model().ready())


@pytest.mark.parametrize("page, text", [("<article><p>Short one.</p></article>", "Short one."), ("<article>This is a long sentence that stands alone in its article. It goes on.<ul><li>x</li></ul><table><tr><td>1</td></tr></table></article>", "This is a long sentence that stands alone in its article. It goes on.\n\nx\n\n1"), ("<article><noscript><p>Some fallback sentence for readers.</p></noscript><object>Another fallback text.</object></article>", "Some fallback sentence for readers.\n\nAnother fallback text."), ("plain text only without any tag at all.", "plain text only without any tag at all."), ("<p>para one is here.<p>para two.", "para one is here.\n\npara two.")])
def test_short_and_bare_articles(page, text):
    assert html.main_text(page, html.model().ready()) == text


@pytest.mark.parametrize("page", ["<a " * 333_333, '<a "' * 250_000, "<div>" * 200_000, "<div>x" * 166_000, "<b>" * 1000 + "<div>" * 200_000, "<!--" * 250_000, "<script>" * 125_000, "&#" + "9" * 1_000_000 + ";", "<" * 1_000_000, "<p>" * 100_000 + "</div>" * 100_000, "<a x='\"'>\"" * 90_000, "<h1>" * 300 + "<p>x" * 200_000])
def test_hostile_pages_take_linear_time(page):
    import time

    def took(p):
        began = time.process_time()
        html.blocks(p)
        return time.process_time() - began

    half, whole = took(page[: len(page) // 2]), took(page)
    assert whole < 12 and whole < 4 * half + 0.5


def test_field_on_held_out_pages():
    crf = html.model().ready()
    right = total = 0
    for page in html.labelled_pages(100, seed=1234):
        for y, b in zip(crf.viterbi(html.sequence(page)), page, strict=True):
            right += y == b.label
            total += 1
    assert right / total > 0.96


def test_viterbi_equals_brute_force():
    import itertools

    crf = html.model().ready()
    page = html.labelled_pages(3, seed=8)[2][:9]
    rows = html.sequence(page)

    def value(y):
        out = crf.start[y[0]] + sum(crf.emit[list(r)].sum() for r, k in zip(rows, y, strict=True) if k)
        return out + sum(crf.step[a, b] for a, b in itertools.pairwise(y))

    best = max(itertools.product((0, 1), repeat=len(rows)), key=value)
    assert value(crf.viterbi(rows)) == pytest.approx(value(best))


def test_main_text_query(spark):
    import html as entities
    import re

    def truth(h):
        h = re.sub(r"(?s)</article>.*$", "", re.sub(r"(?s)^.*?<article>", "", h))
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"</?b>", "", h.replace("<br>", " ")))
        return "\n\n".join(x for x in (re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in parts) if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries()["op2_main_text"](spark, SF).collect()}
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got.values())
    assert np.mean([got[k].text == v for k, v in want.items()]) > 0.98
    odd = spark.createDataFrame([(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "x<p>" + "y " * 200_000, "c"), (2, "u", "<a <b>> & &amp &#0; &#x110000;", "c")], "page_id long, url string, html string, text string")
    assert html.extract(odd).count() == 4
