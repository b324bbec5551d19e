"""Language ID, encoding, packing, sharding, URL filters, HTML extraction and the pipeline."""

import hashlib
import itertools
import os
import random
import time
import zlib
from array import array
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pinion.llm import op05_language_id as lid
from pinion.llm import op07_sharding as shards
from pinion.llm import registry
from pinion.llm.bpe import Encoder, Lexicon, Vocabulary, compile_lexicon
from pinion.llm.op01_url_filter import RULES, build_cascade, split_rule, url_filter
from pinion.llm.op06_line_dedup import normal
from pinion.llm.op08_packing import TextIds, best_fit_packing
from pinion.llm.op09_bpe import build_lexicon, decode_column, default_vocabulary, digests, encode_column, frequent_words
from pinion.llm.op10_html import extract, html_extraction
from pinion.llm.packing import best_fit, fillings, lower_bound, pack
from tests.llm.test_similarity import brute_jaccard, unite

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

# --- url filter ----------------------------------------------------------------------------------------------------------


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    fits = []
    for rule in RULES:
        h, p = split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append(rule)
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES.get(rule, "allow")


def test_urls_equal_the_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "https://a.Example.com/en/71?x#y", "https://example.com/en/8", "http://xcom/en/1", "http://m.example.net/de/80", "http://net/de/", "http://b.net/de", "http://org/es/é", "http://x.org?/es/", "http://a.b.c.d.com/en/9/en/", "ftp://é.com/en/1", "http://com.:80/en/"]
    rows = [(i, u, "x") for i, u in enumerate(urls * 2)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: judged(u) for i, u, _ in rows}
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_are_the_contracts(spark, tmp_path):
    """The contract's list is written out here: RULES and the SQL may not vouch for themselves."""
    contract = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = [f"http://{sub}{host}{path}{more}" for host, path, _ in contract for sub in ("", "a.b.") for more in ("", "1?x")]
    want = [(f"{host}{path}", action) for host, path, action in contract for _ in range(4)]
    urls += ["http://example.net/de/7", "http://example.net/de/81", "http://example.com/en/8", "http://net/de", "http://xnet.de/de/", None]
    want += [("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    for got in (registry.QUERIES["op1_url_filter"](spark, str(tmp_path)), url_filter(pages)):
        assert [(r["rule"], r["verdict"]) for r in sorted(got.collect(), key=lambda r: r["page_id"])] == want


def test_urls_with_clashing_columns_and_odd_rows(spark):
    long = "http://a.example.com/en/" + "x" * 200_000
    rows = [("http://a.com/en/1", "clash", "h"), (None, "http://a.com/en/1", None), (long, "", "h"), (long, "", "h"), ("no scheme", None, None)]
    df = spark.createDataFrame(rows, "address string, url string, host string")
    got = url_filter(df, url_col="address")
    assert got.columns == ["address", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        host, path, rule, verdict = judged(r["address"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert sorted((r["address"] or "") for r in got.collect()) == sorted((a or "") for a, _, _ in rows)
    assert url_filter(df.limit(0), url_col="address").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(63) for _ in range(6000)]
    listed = set(keys[:500])
    one = lambda k: spark.createDataFrame([(x,) for x in k], "h long").repartition(3)
    c = build_cascade(one(listed), one(keys))
    got = c.contains(np.array(keys, np.uint64))
    assert [bool(g) for g in got] == [k in listed for k in keys] and len(c.levels) > 1
    none = build_cascade(one([]), one(keys[:50]))
    assert not none.contains(np.array(keys[:50], np.uint64)).any()


# --- language id ---------------------------------------------------------------------------------------------------------


def test_gradients_are_right(monkeypatch):
    monkeypatch.setattr(lid, "F32", np.float64)
    net = lid.start(["a", "b", "c"], 4, 3)
    for name in ("w", "u", "v", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = np.random.default_rng(0).integers(97, 101, (6, 5)).astype(np.uint8)
    y, real = np.array([0, 1, 2, 0, 1]), np.ones((6, 5), bool)
    real[5, 2] = False
    _, grads = lid.gradients(net, x, y, real)
    for p, g in zip(net.params(), grads, strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:4]:
            at, old = np.unravel_index(i, p.shape), p.ravel()[i]
            p[at] = old + 1e-5
            up = lid.gradients(net, x, y, real)[0]
            p[at] = old - 1e-5
            down = lid.gradients(net, x, y, real)[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = lid.fit(docs.where(f"NOT {lid.HELD_OUT}"))
    out = lid.language_id(docs.where(lid.HELD_OUT), net).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_inputs(spark):
    rng = random.Random(0)
    labelled = [(i, " ".join(rng.choice(("the and of", "der die und")[i % 2].split()) for _ in range(20)), ("en", "de")[i % 2]) for i in range(60)]
    net = lid.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the of and the"), (4, "the of and the"), (None, "und die der"), (6, "der und die " * 30000)]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lid.language_id(spark.createDataFrame(rows, DOC).withColumn("score", F.lit("x")), net).collect()]
    assert [(i, v) for i, v, _ in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "de")]
    assert [s for _, v, s in got if v == "und"] == [0.0] * 3
    empty = lid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert lid.predict(empty, ["the"])[0] == ["und"]


def test_fit_learns_rare_languages_from_whole_texts(spark, monkeypatch):
    """Null texts take no places, a language of few rows is learned beside one of many, and long texts count over their length."""
    rows = [(i, None, "en") for i in range(40)] + [(100 + i, f"the plain words of number {i}", "en") for i in range(60)] + [(300 + i, f"здесь слова {i}", "ru") for i in range(3)]
    rows += [(900, "1 " * 3000 + "ñandú según también " * 20, "es")] + [(901, "only this row, many times", "en")] * 50 + [(902, "no label", None), (None, "", "xx")]
    seen = []
    monkeypatch.setattr(lid, "train", lambda texts, labels: seen.append(sorted(zip(labels, texts, strict=True))))
    monkeypatch.setattr(lid, "SAMPLE_CHARS", 30 * 1024)
    for order in (rows, rows[::-1]):
        lid.fit(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3), rows=30)
    assert seen[0] == seen[1]
    by = Counter(lang for lang, _ in seen[0])
    assert by == {"en": 10, "es": 4, "ru": 3} and any("ñandú" in t for lang, t in seen[0] if lang == "es")


# --- encoding ------------------------------------------------------------------------------------------------------------

ODD = ["", "a", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|", "it's we'll I'D 'S", "ΑΣ ΟΔΟΣ Σ", "İstanbul ẞ ﬁ ƁB", "été Å", "漢字 かな 한글", "a\x1cb\x1d\x85c\xa0d e​f", "１２３ ٣٤ ½ ²", "\U0001f600😀👍🏽", "don’t “q” — €5 …", "\x00\x01\x7f\xad", "ǅ ǲ ŉ ß SS", "...!!!???", "a" * 500, "  　 x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_encoder_equals_the_library(library):
    v = Vocabulary(default_vocabulary())
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 127), *range(160, 600), 0x2019, 0x20AC, 0x301, 0x3B1, 0x3A3, 0x4E00)]
    texts = ODD + [f"a{chr(c)}B{chr(c)}{chr(c)}1" for c in range(0x2FF)] + ["".join(rng.choice(pool) for _ in range(40)) for _ in range(300)]
    words = sorted({w for t in texts[::2] for p, s in v.segments(t) if s is None for w in v.words(p)})
    lexicon = Lexicon(compile_lexicon({w.encode(): v.merge(v.level(w)) for w in words}))
    for e in (Encoder(v), Encoder(v, lexicon)):
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            got, decoded = e.encode(t)
            assert list(array("I", got)) == ids and decoded == library.decode(ids, skip_special_tokens=False), repr(t)
    raw = TextIds(default_vocabulary())
    assert [list(array("I", raw.encode(t))) for t in [None, *texts]] == [[], *(library.encode(t, add_special_tokens=False).ids for t in texts)]


def test_rare_words_are_merged_on_numbers():
    """As pair by pair on strings, and in three quarters of that time at most."""
    v = Vocabulary(default_vocabulary())
    ranks = {p: i for i, p in enumerate(v.pairs)}

    def merged(word):
        parts, rank, none = list(word), ranks.get, 1 << 60
        parts[-1] += v.end
        found = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found and (best := min(found)) < none:
            at = found.index(best)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at:
                found[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(found):
                found[at] = rank((parts[at], parts[at + 1]), none)
        return [v.vocab[p] for p in parts if p in v.vocab]

    rng = random.Random(5)
    bits = ["the", "ou", "aa", "a", "ing", "ciones", "un", "ß", "é", "9", "!", "中", "'", "keit", "ll"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 8))).encode() for _ in range(30_000)] + [bytes([b]) for b in range(256)]
    levels = ["".join([v.bytes[b] for b in w]) for w in words]
    v.merge_bytes(b"a")
    took = {}
    for name, f, given in (("strings", merged, levels), ("numbers", v.merge_bytes, words)) * 2:
        start = time.process_time()
        out = [f(w) for w in given]
        took[name] = min(time.process_time() - start, took.get(name, (9e9,))[0]), out
    assert took["numbers"][1] == took["strings"][1] == [v.merge(w) for w in levels]
    assert v.merge("") == v.merge_bytes(b"") == [] and v.merge("\n") == merged("\n") == []
    assert took["numbers"][0] < 0.75 * took["strings"][0], [x[0] for x in took.values()]


def test_words_are_remembered_once(monkeypatch):
    """A word that stands alone takes no second place of the bounded memory, and is known beside punctuation."""
    made = Counter()
    monkeypatch.setattr(Encoder, "word", lambda _, w: made.update([w]) or (b"1234", w))
    e = Encoder(Vocabulary(default_vocabulary()))
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(26**4 - 10_000)]
    for at in range(0, len(words), 1000):
        e.encode(" ".join(words[at : at + 1000]))
    e.encode(" ".join(words[:5000]))
    assert e.encode(f"({words[0]}) {words[1]},")[1] == f"( {words[0]} ) {words[1]} ,"
    assert max(made.values()) == 1
    assert len(e.known) + len(e.known.old) <= 700_000


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "", "stops"])}
    data = compile_lexicon(words)
    lexicon = Lexicon(data)
    assert all(lexicon.find(w) == array("I", ids).tobytes() for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"ta", b"tapss", b"x", b"stopp"))
    assert len(lexicon.first) - 1 == 7  # of 19 in a trie: ta and to, p and ps are shared
    assert Lexicon(compile_lexicon({})).find(b"a") is None


def test_encoding_by_spark(spark, library):
    vocabulary = default_vocabulary()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat on the mat"] * 5 + ODD)] + [(99, None)], DOC).repartition(3)
    words = frequent_words(docs, vocabulary)
    assert b"the" in words and words[0] == b"the"
    lexicon = build_lexicon(spark, words, vocabulary)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in digests(docs, vocabulary, lexicon).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    both = decode_column(encode_column(docs, vocabulary, lexicon).withColumnRenamed("decoded", "first"), vocabulary).collect()
    assert all(r["first"] == r["decoded"] for r in both) and len(both) == 24
    assert digests(docs.limit(0), vocabulary, None).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------------


def least_bins(items, capacity):
    """By exhaustive search."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_pieces_that_come_once_displace_none_that_recur():
    """1.4 million lookups among which a hundred pieces recur seldom; each is encoded anew at most when it was not known yet."""
    made = Counter()
    e = TextIds(default_vocabulary())
    real = e.known.make
    e.known.make = lambda c: made.update([c]) or (real(c) if len(c) > 4 else b"1234")
    recurring, base = [f"again{n}" for n in range(100)], "abcdefghijklmnopqrstuvwxyz0123456789"
    for c in (*recurring, *recurring):
        e.encode(c)
    once = ("".join(base[n // 36**k % 36] for k in range(4)) for n in range(36**4))
    for _ in range(7):
        e.encode(" ".join(itertools.islice(once, 200_000)))
        e.encode(" ".join(recurring))
    assert max(made[c] for c in recurring) == 1
    assert len(e.known) + len(e.known.old) + len(e.known.waiting) <= 300_000


def test_packing_is_complete_and_optimal_on_small_cases():
    rng = random.Random(6)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = Counter(items)
        plan, got = pack(dict(counts), 20), Counter()
        for f, n in plan:
            assert sum(f) <= 20
            for k in f:
                got[k] += n
        bins = sum(n for _, n in plan)
        assert got == counts and bins == least_bins(items, 20) >= lower_bound(counts, 20)
        assert bins <= sum(n for _, n in best_fit(counts, 20))
    assert pack({}, 9) == [] and sum(n for _, n in pack({1: 10**9, 5: 10**8}, 9)) == lower_bound({1: 10**9, 5: 10**8}, 9)


def bins_of(counts, capacity):
    plan, got = pack(dict(counts), capacity), Counter()
    for f, n in plan:
        assert sum(f) <= capacity
        for k in f:
            got[k] += n
    assert got == Counter(counts)
    return sum(n for _, n in plan)


def test_packing_equals_exhaustive_search():
    rng = random.Random(7)
    for _ in range(120):
        items = [rng.randint(8, 70) if rng.random() < 0.8 else rng.randint(1, 100) for _ in range(rng.randint(8, 14))]
        assert bins_of(Counter(items), 100) == least_bins(sorted(items, reverse=True), 100)


def test_packing_of_many_small_items_and_of_exact_triplets():
    assert bins_of({1: 3000}, 2048) == 2 and bins_of({1: 10**9, 2048: 5}, 2048) == 5 + -(-(10**9) // 2048)
    assert bins_of({k: 1 for k in range(1, 2049)}, 2048) == 1025
    rng = random.Random(0)
    for n, most in ((30, 31), (200, 203), (1000, 1010)):
        wide, narrow = [], []
        for _ in range(n):
            a, b = sorted(rng.sample(range(1, 2048), 2))
            wide += [a, b - a, 2048 - b]
            a = rng.randint(778, 1003)  # no two of them fill a bin, so every bin takes three
            b = rng.randint(512, (2048 - a) // 2)
            narrow += [a, b, 2048 - a - b]
        assert n <= bins_of(Counter(wide), 2048) <= most and n <= bins_of(Counter(narrow), 2048) <= most


def test_fillings_are_undominated_and_complete():
    """Against all maximal fillings of small histograms: a filling is missing only if an undominated one replaces it."""
    rng = random.Random(2)
    for _ in range(60):
        counts = dict(Counter(rng.randint(3, 30) for _ in range(8)))
        first = max(counts)
        got = set(fillings(counts, 40, lambda: 40))
        items = sorted((Counter(counts) - Counter([first])).elements(), reverse=True)
        every = {tuple(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= 40 - first}
        assert {f[1:] for f in got} <= every and got
        for c in every - {f[1:] for f in got}:
            spare, room = Counter(items) - Counter(c), 40 - first - sum(c)
            subsets = [s for n in range(len(c) + 1) for s in itertools.combinations(c, n)]
            assert any(sum(s) <= x <= sum(s) + room and s != (x,) for s in subsets for x in spare)


def test_packing_many_null_texts(spark):
    out = best_fit_packing(spark.createDataFrame([(None, None)] * 1500 + [(7, None)] * 1500, DOC), default_vocabulary(), capacity=100).collect()
    assert len(out) == 3000 and len({r["sequence_id"] for r in out}) == 30 and len({(r["sequence_id"], r["offset"]) for r in out}) == 3000


def test_packed_documents(spark, library):
    texts = ["", None, "one two three", "x " * 5000, "a b", "a b", *(f"word{i} " * (i % 90) for i in range(150))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    out = best_fit_packing(spark.createDataFrame(docs, DOC).repartition(3).withColumn("length", F.lit("clash")), default_vocabulary(), capacity=256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    by_doc, by_bin = {}, {}
    for r in out:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in by_doc.items():
        assert [p for p, _, _ in sorted(parts)] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(ids[i])
        assert all(n == 256 for _, _, n in sorted(parts)[:-1])
    assert by_doc.keys() == ids.keys()
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 256
    assert len(by_bin) <= -(-sum(map(len, ids.values())) // 256) + 1
    assert best_fit_packing(spark.createDataFrame([], DOC), default_vocabulary()).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------------


def smallest_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, a = (low + high) // 2, 1, 0
        for s in sizes:
            n, a = (n + 1, s) if a + s > mid else (n, a + s)
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize(("n", "step", "segments"), [(1, 12, 65536), (5, 12, 65536), (2500, 4, 65536), (1500, 3, 300)])
def test_capacity_is_minimal(spark, monkeypatch, n, step, segments):
    monkeypatch.setattr(shards, "STEP", step)
    monkeypatch.setattr(shards, "SEGMENTS", segments)
    rng = random.Random(n)
    groups = sorted({rng.getrandbits(62): rng.choice([9, 20, 300, 4000, rng.randint(9, 5000)]) for _ in range(n)}.items())
    capacity, firsts = shards.minimax_cuts(spark.createDataFrame(groups, "u long, size long").repartition(3), 24)
    loads = Counter()
    for u, size in groups:
        loads[sum(u >= f for f in firsts)] += size
    assert capacity == smallest_capacity([s for _, s in groups], 24) == max(loads.values()) and len(firsts) < 24


def test_a_large_group_opens_few_nodes(spark, monkeypatch):
    """One group of 2 MB among 100,000 small ones: rows at the driver and ranges in a plan stay within their bounds."""
    groups = spark.range(100_000).selectExpr("shiftrightunsigned(xxhash64(id), 2) AS u", "200 + pmod(hash(id), 900) AS size").union(spark.sql("SELECT shiftrightunsigned(xxhash64(-1L), 2), 2000000L"))
    groups = groups.selectExpr("u", "CAST(size AS BIGINT) AS size").cache()
    seen, opened = [], shards.to_open
    monkeypatch.setattr(shards, "to_open", lambda nodes, wanted: seen.append((len(nodes), opened(nodes, wanted))) or seen[-1][1])
    capacity, firsts = shards.minimax_cuts(groups, 24)
    rows = sorted((r["u"], r["size"]) for r in groups.collect())
    assert capacity == smallest_capacity([s for _, s in rows], 24) and len(firsts) == 23
    assert len(seen) <= 4 and all(n <= 80_000 and len(runs) <= shards.RUNS for n, runs in seen)


def test_shards(spark):
    rng = random.Random(3)
    texts = ["hot text " * 30] * 150 + [None, None, ""] + [f"é{i} " * rng.randrange(60) for i in range(400)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "z", 1)]
    out = shards.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    text = {i: t for i, t, _ in rows}
    place, loads, slots = {}, Counter(), {}
    for r in out:
        t = text[r["doc_id"]]
        data = (t or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == (None if t is None else zlib.crc32(data))
        assert place.setdefault(t, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) == set(range(24))
    hot = place[texts[0]]
    others = [n for s, n in loads.items() if s != hot]
    assert max(others) < 1.6 * sum(others) / 23  # the hot group alone fills a shard, the others are even
    assert shards.minimax_shards(spark.createDataFrame([], DOC)).count() == 0


PROSE = "A first sentence stands here, with some words. Then another one follows; it is longer, and ends."
# --- html ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>var x='</p>';</script>", ""),
        ("just text <b>bold</b>", "just text bold"),
        ("<p>a < b &lt; c&nbsp;&amp;d &#233;&eacute", "a < b < c &d éé"),
        ("<article><h1>T</h1><p><b>One.<br><p>Two   x\n y.</article><footer>&copy; me</footer>", "T\nOne.\nTwo x y."),
        (
            "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie-notice'>We use cookies, accept.</div><main><article>"
            "<header><h1>Big &amp; News</h1><p>By me</p></header><p>First, with <a href=x>a link</a> inside.<p>Second para.<ul><li>one<li>two</ul><aside>Side note.</aside><form>Search <input></form></article>"
            "<section id=comments><h2>Comments</h2><p>Great article, thanks a lot, really!</p></section></main><div class=sidebar><p>Hot</p></div><footer>(c)</footer></body></html>",
            "Big & News\nFirst, with a link inside.\nSecond para.\none\ntwo",
        ),
        ("<div id=content><h1>Title</h1><p>Some text here, with marks. And more.</p><div>More text, yes; really.</div><div class='share-buttons'>Share</div></div><ul><li><a href=a>Link one</a><li><a href=b>Link two</a></ul>", "Title\nSome text here, with marks. And more.\nMore text, yes; really."),
        ("<!-- <p>no</p> --><div class=ad>Buy now!</div><table><tr><td>cell one.<td>cell two.</table>", "cell one.\ncell two."),
        *(
            (page % f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><p>Short.</p>", f"Title\n{PROSE}\n{PROSE}\nShort.")
            for page in (
                "<div class='page-widget'>%s</div>",
                "<div id='search-results'>%s</div>",
                "<form action=x><input type=hidden>%s<input type=submit></form>",
                "<article>%s<div>Subscribe to us</div></article>",
                "<article>%s<section class=comments><h2>Comments</h2><p>I like it, really; so much!</p></section></article>",
                "<div class=a1><ul><li><a href=/>Home</a><li><a href=/b>News of today</a></ul></div><div class=b2>We use cookies, accept them.</div><div class=c3>%s</div><div class=d4><h3>Say it</h3><div class=e5><p>Great article!</p></div><div class=e5><p>No, sorry.</p></div></div>",
                "<ul><li><a href=/>Home</a><li><a href=/b>News of today</a></ul><div>We use cookies.</div>%s<div><div><p>Great article, thanks!</p></div></div>",
            )
        ),
        (f"<article><p>{PROSE}</p><ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul><p>{PROSE}</p></article>", f"{PROSE}\nRef one\nRef two\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section id=discussion><h2>Discussion</h2><p>{PROSE}</p></section></article>", f"{PROSE}\nDiscussion\n{PROSE}"),
        (f"<aside><p>{PROSE}</p></aside>", PROSE),
    ],
)
def test_extracts(html, text):
    assert extract(html) == text


class Article(HTMLParser):
    """The article's blocks by a parser of its own: headings and paragraphs between the article's tags."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        self.blocks += [""] if tag in ("p", "h1") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        self.blocks += [""] if tag in ("p", "h1") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.on else ""


def test_html_equals_the_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction(pages).collect()}
    for r in pages.collect():
        a = Article()
        a.feed(r["html"] or "")
        a.close()
        assert got[r["page_id"]] == "\n".join(x for b in a.blocks if (x := " ".join(b.split())))


def test_html_takes_linear_time():
    for html in ("<b>" * 20_000 + "</i>" * 20_000 + "x", "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "x", "<b>" * 20_000 + "<h1>t</h1>" * 20_000, "<div>" * 3000 + "<p>x y. z</p>" * 3000):
        began = time.perf_counter()
        extract(html)
        assert time.perf_counter() - began < 3


def test_html_odd_inputs(spark):
    long = "<article>" + "<p>A sentence, and more.</p>" * 20000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, long, 2), (None, "u", "<p>x", 3), (4, "u", "<div>" * 3000 + "deep", 4)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    assert got[1] == ("", 0) and got[None] == ("x", 1) and got[4] == ("deep", 4) and got[2][1] == 20000 * 22 - 1 + 0
    assert html_extraction(spark.createDataFrame([], "page_id long, html string")).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_without_labels(spark):
    rows = [(1, "words of a text", None, "s", 15), (2, None, None, "s", 0), (3, "123 456", None, "s", 7), (4, "\u6f22\u5b57", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()} == {1, 4}


def brute_lines(docs):
    """Rows (id, text) -> texts without the lines that go, by comparing all pairs of lines."""
    first = {}
    for i, text in sorted(docs):
        for p, x in enumerate(text.split("\n")):
            if normal(x):
                first.setdefault(normal(x), (i, p))
    lines = list(first)
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = unite(range(len(lines)), links)
    keep = {}
    for n, x in enumerate(lines):
        keep[root[n]] = min(keep.get(root[n], (1 << 60, 0)), first[x])
    of = {x: keep[root[n]] for n, x in enumerate(lines)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not normal(x) or of[normal(x)] == (i, p)) for i, t in docs}


def test_pipeline_equals_brute_force(spark, library):
    rng = random.Random(21)
    word = lambda: rng.choice("alder birch cedar maple olive poplar walnut willow hazel linden".split()) + str(rng.randrange(300))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(14) for _ in range(4)]
    texts = ["\n".join([line(12), rng.choice(shared), line(9)]) for _ in range(30)]
    for t in texts[:8]:  # near copies in lines that are too different, and in lines that are near
        w = t.replace("\n", " ").split()
        w[3] = "changed"
        texts += [" ".join(w), t[:-1] + "z"]
    texts += [shared[0], "123 456", None, "\n\n" + shared[1], texts[0]]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", "fr"]), "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs
    want = {i: t for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        if name == "line_dedup":
            left = brute_lines(list(want.items()))
            want = {i: t for i, t in left.items() if t == want[i] or t.strip()}
            assert {r["doc_id"]: r["n_chars"] for r in now.collect()} == {i: len(t) for i, t in want.items()}
        if name == "ngram_jaccard":
            want = {i: want[i] for i, (_, root) in brute_jaccard(list(want.items())).items() if i == root}
        assert {r["doc_id"]: r["text"] for r in now.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {r["doc_id"]: r["length"] for r in packed} == tokens and len({r["sequence_id"] for r in packed}) == -(-sum(tokens.values()) // 2048)


def test_pipeline_stages_on_odd_inputs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, component_id int, n_dropped string"
    copy = "one two three four five six seven eight"
    rows = [(1, copy, "en", "s", 5, "x", 1, "y")] * 2 + [(1, "another text with an id that is taken", "en", "s", 5, "x", 1, "y"), (None, copy, "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1, "y"), (3, copy + " " + copy * 3000, None, "s", 0, "x", 1, "y"), (4, "\u6f22" * 3, "zh", "s", 3, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        assert out.columns == corpus_pipeline.COLUMNS or name == "best_fit_packing"
        assert stage(spark, docs.limit(0), "").count() == 0
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got) if name != "best_fit_packing" else []
        if name == "language_id":
            assert [i for i, _ in texts] == [0, 1, 1, 1, 3, 4]
        if name == "line_dedup":
            assert len(texts) == 8
        if name == "ngram_jaccard":
            assert [i for i, _ in texts] == [0, 1, 1, 2, 3, 4] and sum(t == copy for _, t in texts) == 1
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in got) == 8


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    out = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(out.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in out.select(*columns).fetchall())


@needs_data
def test_pipeline_stages(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, docs.head()["text"] + " tail", "fr", "s", 1)], docs.schema)
    docs = docs.union(extra)
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept
        if name == "language_id":
            assert kept - now == {10**6, 10**6 + 1}
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == kept
    assert sum(r["length"] for r in packed) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
