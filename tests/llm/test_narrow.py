"""License scans, URL filters, quality statistics and packing against plain versions."""

import json
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("weald.llm")

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, docs
from weald.llm import licenses, packing, quality, trees, urls


def test_license_scan_counts_every_place(spark):
    rows = {(r["doc_id"], r["n_words"], len(r["spans"])) for r in licenses.scan_licenses(docs(spark)).collect()}
    expected = {(i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))) for i, t in DOCS}
    assert {r[:2] for r in rows} == expected
    assert {r[2] for r in rows if r[0] == 4} == {2}  # base phrase and the notice
    assert {r[2] for r in rows if r[0] == 5} == {500}
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_full_texts_are_accepted_with_other_names(spark):
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
    in the documentation and/or other materials provided with the distribution. * Neither the name of {} may be used to endorse or promote
    products derived from this software without specific prior written permission."""
    end = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
    OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
    IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
    OF THE POSSIBILITY OF SUCH DAMAGE."""
    whole = bsd + end
    texts = [(1, whole.format("Some Body nor the names of its contributors")), (2, whole.format("x").replace("retain", "keep")), (4, bsd.format("x")), (3, "This is free and unencumbered software released into the public domain.")]
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {1: {"bsd-3-clause"}, 2: set(), 3: {"unlicense"}, 4: set()}  # the disclaimer is mandatory


def test_template_markup():
    a = licenses.Automaton.of("copyright <<var:1-3>> all <<opt>>of the<</opt>> rights <<opt>>are <<opt>>hereby<</opt>> reserved<</opt>>")
    run = lambda s: a.matches(s.encode().split())
    assert run("x copyright a b all rights y") == [(1, 6)]
    assert run("copyright a all of the rights are hereby reserved") == [(0, 9)]
    assert run("copyright all rights") == []  # the replaceable region needs a word
    assert run("copyright a b c d all rights") == []
    assert run("copyright a all of rights") == []  # mandatory wording differs
    with pytest.raises(ValueError):
        licenses.Automaton.of("<<opt>>only optional<</opt>>")


@given(st.lists(st.sampled_from("gnu general public license apache mit cc by licensed under the released version 3 2 0 4 nc".split()), max_size=40))
@settings(max_examples=200, deadline=None)
def test_automata_agree_with_regular_expressions(words):
    joined = " " + " ".join(words) + " "
    for template in licenses.TEMPLATES.values():
        found = licenses.Automaton.of(template).matches([w.encode() for w in words])
        assert bool(found) == bool(re.search(licenses.template_regex(template), joined))


def test_urls(spark):
    given_ = [
        (1, "http://A.Example.COM/en/7x?q#f"), (2, "http://example.com/en/6"), (3, "ftp://x.net/de/8"), (4, "http://example.net/de/81"), (5, "http://w.org/es/"), (6, "no url"), (7, None), (8, ""),
        (9, "http://com/en/"), (10, "http://notexample.com/en"), (11, "http://spam-farm.xy.org/a"), (11, "http://spam-farm.xy.org/a"), (None, "http://x.org?y=http://z"), (12, "http://farmspam.org/a"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in given_], "page_id bigint, url string, host string")
    got = sorted(tuple(r) for r in urls.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect() if r["page_id"] is not None)
    assert got[0] == (1, "a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [r[3] for r in got[1:5]] == ["com/en/", "net/de/", "example.net/de/8", "org/es/"]
    assert got[5] == (6, "", "", None, "allow") and got[6][1:3] == ("", "")
    assert got[8][3] == "com/en/" and got[9][4] == "allow"
    assert [r[4] for r in got[10:13]] == ["block", "block", "allow"]
    assert urls.filter_urls(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from("ads banner casino farm spam login porn tag feed tracker a - . / : ? # phpsessid =".split()), max_size=12))
@settings(max_examples=200, deadline=None)
def test_index_finds_what_trying_every_rule_finds(parts):
    url = "http://" + "".join(parts)
    for counts in ({}, {"ads": 5, "spam": 9, "tag": 1}):
        plain = next((p.name for p in urls.PATTERNS if re.search(p.regex, url)), None)
        assert urls.RarestTokenIndex(urls.PATTERNS, counts).match(url) == plain


LIST = """! a comment
||ads.example.com^
||spam*farm.net^
/banner/*/click|
|http://tracker.
&session=
.com/promo/
"""


def test_block_list_lines():
    found = {p.name: p for p in map(urls.pattern_of, LIST.splitlines()) if p}
    assert len(found) == 6
    hit = lambda name, url: bool(re.search(found[name].regex, url))
    assert hit("||ads.example.com^", "https://x.ads.example.com/a") and hit("||ads.example.com^", "https://ads.example.com")
    assert not hit("||ads.example.com^", "https://badads.example.com/") and not hit("||ads.example.com^", "https://ads.example.community/")
    assert hit("/banner/*/click|", "http://a/banner/b/c/click") and not hit("/banner/*/click|", "http://a/banner/b/clicks")
    assert hit("|http://tracker.", "http://tracker.a") and not hit("|http://tracker.", "https://tracker.a")
    assert found["||spam*farm.net^"].tokens == ("net",) and found["&session="].tokens == ("session",)
    for bad in ("@@||a.com^", "||a.com^$script", "a.com##.ad", "*abc*", "//"):
        with pytest.raises(ValueError):
            urls.pattern_of(bad)


def test_thousands_of_patterns(spark, tmp_path):
    """The index gives what trying every rule gives, and tries few of them."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    shapes = ("||{}.{}.com^", "/{}/{}/", "?{}={}&", "/{}/*/{}|", "||{}-{}.net^")
    lines = [rng.choice(shapes).format(*rng.sample(words, 2)) for _ in range(3000)]
    (tmp_path / "list.txt").write_text("! list\n" + "\n".join(lines))
    patterns = urls.read_patterns(spark, str(tmp_path / "list.txt"))
    assert [p.name for p in patterns] == lines
    rows = [(i, f"https://{rng.choice(words)}{rng.choice('.-')}{rng.choice(words)}.{rng.choice(['com', 'net'])}/" + "/".join(rng.choices(words, k=4)) + f"?{rng.choice(words)}={rng.choice(words)}&") for i in range(300)]
    rows += [(300 + i, re.sub(r"[|^*]", "", line).join(("http://x.org", ""))) for i, line in enumerate(lines[:200])] + [(600, "http://" + "a" * 200_000 + "/x"), (601, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r["page_id"]: r["pattern"] for r in urls.filter_urls(df, rules=(), patterns=patterns).collect()}
    compiled = [(p.name, re.compile(p.regex)) for p in patterns]
    assert got == {i: next((n for n, c in compiled if c.search(u or "")), None) for i, u in rows}
    assert sum(v is not None for v in got.values()) > 50
    index = urls.RarestTokenIndex(patterns, urls.token_counts(df, "url", (t for p in patterns for t in p.tokens)))
    assert max(map(len, index.under.values())) < len(patterns) / 50


def brute_repeats(words):
    from collections import Counter

    c = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if c[w] > 1 for k in range(3)})


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_statistics_and_verdicts(spark):
    model = trees.train(np.random.default_rng(0).random((200, 12)), np.arange(200) % 2.0, {})
    got = quality.judge_quality(docs(spark), model, 0.0)
    assert got.count() == len(DOCS)
    for i, n, chars, symbols, dup, rep, failed, score, kept in (tuple(r) for r in got.collect()):
        for j, t in DOCS:
            if i == j and i not in (None, 4):
                words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
                lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
                assert (n, chars, symbols, dup, rep) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(words))
                assert failed == (n < 50 or 100 * rep > 50 * n) and 0 <= score <= 1 and kept == (not failed)
    assert quality.judge_quality(docs(spark, []), model, 0.5).count() == 0


def test_quality_model_separates_and_is_monotonic(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 12))
    y = ((x[:, 2] < 0.5) ^ (rng.random(600) < 0.05)).astype(float)
    model = trees.train(x, y, {2: -1, 3: -1})
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.92
    for j in (2, 3):
        probe = np.repeat(rng.random((20, 1, 12)), 50, axis=1)
        probe[:, :, j] = np.linspace(0, 1, 50)
        assert (np.diff(model.margin(probe.reshape(-1, 12)).reshape(20, 50), axis=1) <= 1e-12).all()
    assert 0 < trees.train(x[:0], y[:0], {}).score(x)[0] < 1


def test_fit_without_labels_keeps_all(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model, threshold = quality.fit(docs(spark), labels)
    assert threshold == 0.0 and (model.score(np.zeros((3, 12))) >= threshold).all()


@given(st.lists(st.integers(0, 70), max_size=25), st.sampled_from([8, 16]))
@settings(max_examples=200, deadline=None)
def test_packing_keeps_every_token_once(lengths, capacity):
    sequences = packing.pack_lengths(lengths, capacity)
    seen = sorted((i, s + k) for q in sequences for i, s, n in q for k in range(n))
    assert seen == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert all(0 < sum(n for _, _, n in q) <= capacity for q in sequences)
    rest = [n % capacity for n in lengths if n % capacity]  # nothing else is cut
    assert sorted(n for q in sequences for _, _, n in q if n < capacity) == sorted(rest)
    assert len(sequences) <= sum(n // capacity for n in lengths) + min(len(rest), 2 * -(-sum(rest) // capacity))


def test_padding_of_a_full_group():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6.5, 1, 300).astype(int) + 1, 20_000).tolist()
    sequences = packing.pack_lengths(lengths)
    assert sum(lengths) > 0.95 * packing.CAPACITY * len(sequences)


def test_many_tiny_items_stay_small():
    import time
    import tracemalloc

    lengths = [1] * (packing.CAPACITY * packing.GROUP_WINDOWS)
    tracemalloc.start()
    begun = time.perf_counter()
    sequences = packing.pack_lengths(lengths)
    seconds, most = time.perf_counter() - begun, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sequences) <= packing.GROUP_WINDOWS + 4 and sorted(i for x in sequences for i, _, _ in x) == list(range(len(lengths)))
    assert most < 150e6 and seconds < 20  # much of it is what tracing takes


def test_differencing_is_nearly_equal():
    rng = np.random.default_rng(2)
    sizes = rng.integers(50, 500, 400).tolist()
    sets = packing.differencing(sizes, 40)
    assert sorted(i for s in sets for i in s) == list(range(400))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) < 0.02 * np.mean(sums)
    assert packing.differencing([], 3) == [[], [], []]


def test_packing_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    pieces = packing.pack_documents(docs(spark).coalesce(2), P.path("word_bpe_49k.json"), capacity=64).collect()
    at = {}
    for r in pieces:
        at.setdefault((r["sequence_id"]), []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 64
    for i, text in DOCS:
        if i not in (4, None):
            ids = b"".join(r["ids"] for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]))
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.pack_documents(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0
    got = packing.digest(packing.pack_documents(docs(spark, DOCS[3:4]), P.path("word_bpe_49k.json"))).collect()
    assert got[0]["ids_crc32"] == zlib.crc32(np.array([*t.encode(DOCS[3][1], add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_cached_ids_are_the_tokenizers(spark):
    """Every distinct word of a table, and awkward pieces, by rank or not."""
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    definition = open(P.path("word_bpe_49k.json")).read()
    plain = Tokenizer.from_str(definition)
    plain.encode_special_tokens = True
    table = packing.rank_table(definition)
    assert 0.9 < table[2][table[1] > 0].mean() <= 1
    cached = packing.CachedTokenizer(definition, table)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    vocabulary = [t.replace("</w>", "") for t in json.loads(definition)["model"]["vocab"]]
    texts += [" ".join(vocabulary), " ".join(a + b for a, b in zip(vocabulary, vocabulary[1:] + vocabulary[:1])), "É'S,'s İX Σας ſ ﬁ a\u0301b. x\u0301! ½ ２", "\x1cа\xa0б\u2003c"]
    for got, text in zip(cached.ids(pa.array(texts)), texts):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids
