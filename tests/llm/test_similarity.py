"""Jaccard join, line dedup, embedding dedup and nearest neighbours against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pinion.llm import common, linking
from pinion.llm.bloom import Bloom, fill
from pinion.llm.common import CLEANUP, char_shingle_set, cut, join_hot, shingle_set, words
from pinion.llm.components import components
from pinion.llm.linking import UPPER, block_links, each, signature_blobs
from pinion.llm.op02_ngram_jaccard import Bands, ngram_jaccard_join, signatures
from pinion.llm.op02_ngram_jaccard import sign as sign_documents
from pinion.llm.op03_embedding_dedup import LEAF, Blocks, embedding_dedup, near
from pinion.llm.op04_ann_forest import Forest, ann_search
from pinion.llm.op06_line_dedup import NONE, ODD, PROBES, WIDTH, borrowed, hashes32, line_dedup, line_ids, line_sets, minima, normal, normals, occurrences, sign

DOC = "doc_id long, text string"


def unite(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = unite(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def near_copies(rng, n, length, most):
    """A text and copies of it with a few words replaced."""
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def jaccard_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for length in (3, 5, 6, 8, 9, 12, 20, 40, 90, 200):
        for _ in range(3):
            texts += near_copies(rng, 6, length, 4)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {t}" for t in near_copies(rng, 12, 70, 9)]  # one passage in many texts
    texts += ["", "   \n\t", "one", "ONE", "two words", "a b c d e", "A B c d E", texts[5], texts[5], " ".join(texts[:20]) * 40]
    rng.shuffle(texts)
    docs = list(enumerate(texts)) + [(10_000, None)]
    got = jaccard_rows(ngram_jaccard_join(spark.createDataFrame(docs, DOC).repartition(4)))
    assert got == brute_jaccard(docs)


def test_jaccard_of_one_large_group(spark):
    rng = random.Random(5)
    docs = list(enumerate(near_copies(rng, 150, 60, 4) + ["same words in this text here"] * 80))
    assert jaccard_rows(ngram_jaccard_join(spark.createDataFrame(docs, DOC).repartition(3))) == brute_jaccard(docs)


def test_jaccard_odd_inputs(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a b c d e f", 7, "n"), (1, "a b c d e f", 7, "n"), (None, "a b c d e f", None, None), (3, "a b c d e f", 1, None), (4, None, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long, n_shingles string")
    got = sorted(map(tuple, ngram_jaccard_join(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (4, 0, 4)], key=repr)


def test_similar_sets_share_enough_signatures():
    """The pigeonhole promise, on random pairs just above the threshold, for the smallest sizes too."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 60)) if rng.random() < 0.8 else int(rng.integers(60, 600))
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 8, dtype=np.uint64))
        pool = pool[rng.permutation(len(pool))]
        a = pool[:n]
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.concatenate([a[drop:], pool[n : n + int(rng.integers(0, n // 9 + 1))]])
        inter = len(np.intersect1d(a, b))
        if len(b) == 0 or 100 * inter < 80 * len(np.union1d(a, b)) or inter == len(a) == len(b):
            continue
        at, sig, need = signatures([np.sort(a), np.sort(b)])
        mine, yours = ({int(s): int(n) for s, n in zip(sig[at == i], need[at == i], strict=True)} for i in (0, 1))
        common = [(mine[s], yours[s]) for s in mine.keys() & yours.keys() if min(mine[s], yours[s]) < UPPER]
        assert len(common) >= max(1, *(max(x % UPPER, y % UPPER) for x, y in common))


def test_jaccard_of_repeated_ids(spark):
    """Rows that share an id keep the links of their own texts, whatever their order."""
    rng = random.Random(8)
    a, b = near_copies(rng, 1, 60, 1), near_copies(rng, 1, 60, 1)
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, " ".join(f"z{k}" for k in range(30)))]
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["component_id"]) for r in ngram_jaccard_join(spark.createDataFrame(order, DOC)).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_bytes_a_signature_hold_over_part_counts(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(300))) for i in range(2000)], DOC).coalesce(1)
    per = []
    for parts in (16, 4096):
        rows = signature_blobs(docs, sign_documents, parts).select(F.expr("sum(40 + length(keys) + length(sigs) + length(needs))"), F.sum(F.length("needs"))).head()
        per.append(rows[0] / rows[1])
    assert per[1] < 1.1 * per[0]


def test_bands_cover_all_partners():
    b = Bands(80, 5000)
    for s in range(1, 4000):
        i = int(b.of(np.array([s]))[0])
        assert int(b.of(np.array([s * 100 // 80]))[0]) in (i, i + 1)


def test_blocks_find_links():
    texts = near_copies(random.Random(1), 30, 40, 3)
    both = pa.table({"key": [5] * 62 + [1, 1], "id": [*range(31)] * 2 + [100, 101], "text": texts * 2 + ["a b", "a b"], "left": [True] * 31 + [False] * 31 + [True, False]})
    found = block_links(both, each(shingle_set), 80).to_pylist()
    assert {"center": 100, "member": 101} in found
    root = unite(range(31), [(r["center"], r["member"]) for r in found if r["center"] < 100])
    assert {i: r for i, r in root.items()} == {i: r for i, (_, r) in brute_jaccard(list(enumerate(texts))).items()}


@pytest.mark.parametrize("finish", [0, 10, 10**6])
def test_components(spark, finish):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long"), finish).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == unite({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "src long, dst long"), finish).count() == 0


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)] + [(99, 1000)], "k long, v long")
    values = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 99").withColumn("w", F.col("k") * 10)
    got = sorted(tuple(r) for r in join_hot(rows, values, "k", "n", 301).select("k", "v", "w").collect())
    assert got == sorted((k, i, 10 * k) for k, i in ((i % 7 if i % 3 else 0, i) for i in range(300)))


def test_verification_deals_a_large_centre_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(linking, "VERIFIED", 3)
    texts = [f"a b c d e f w{i}" for i in range(12)]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(1, 2)], "center long, member long").coalesce(1)
    found = linking.verified(pairs, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), each(shingle_set))
    got = {(r["center"], r["member"]): (r["inter"], r["union"]) for r in found.collect()}
    one = [shingle_set(t) for t in texts]
    assert got == {(a, b): (len(np.intersect1d(one[a], one[b])), len(np.union1d(one[a], one[b]))) for a, b in [(0, i) for i in range(1, 12)] + [(1, 2)]}


def test_bloom(spark):
    rng = np.random.default_rng(0)
    inside, outside = rng.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    f = fill(spark.createDataFrame([(int(x),) for x in inside], "h long").repartition(3), Bloom.sized(3000, 0.01))
    assert f.contains(inside).all() and f.contains(outside).mean() < 0.03


# --- lines ---------------------------------------------------------------------------------------------------------------


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    base = [" ".join(word() for _ in range(20)) for _ in range(30)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(4):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w) if rng.random() < 0.8 else "  ".join(w).upper())
        docs.append((i, "\n".join([*lines, "Short.", ""])))
    occurrences = [(i, p, normal(x)) for i, t in docs for p, x in enumerate(t.split("\n")) if normal(x)]
    distinct = sorted({n for _, _, n in occurrences})
    sets = [char_shingle_set(n, WIDTH) for n in distinct]
    links = []
    for a in range(len(distinct)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                links.append((a, b))
    root = unite(range(len(distinct)), links)
    of = {n: root[k] for k, n in enumerate(distinct)}
    first = {}
    for i, p, n in occurrences:
        first.setdefault(of[n], (i, p))
    gone = {(i, p) for i, p, n in occurrences if first[of[n]] != (i, p)}
    expected = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, DOC).repartition(3)).collect()}
    assert got == expected and gone


def test_line_signatures_have_high_recall():
    rng = random.Random(0)
    hit = total = 0
    for _ in range(400):
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)]
        v = list(w)
        v[rng.randrange(30)] = "qqqqqq"
        a, b = " ".join(w), " ".join(v)
        x, y = char_shingle_set(a, WIDTH), char_shingle_set(b, WIDTH)
        k = len(np.intersect1d(x, y))
        if k >= 0.8 * (len(x) + len(y) - k):
            s = sign([a, b])[1].reshape(2, -1)
            hit, total = hit + bool((s[0] == s[1]).any()), total + 1
    assert total > 300 and hit >= 0.99 * total


@pytest.mark.parametrize(("length", "changed"), [(50, 1), (75, 1), (75, 3), (100, 3)])
def test_lines_with_one_change_are_near(spark, length, changed):
    """One character, or a word of three letters, is another one in the middle of the line."""
    rng = random.Random(length)
    docs = []
    for i in range(0, 100, 2):
        line = "".join(" " if k % 4 == 0 else rng.choice("abcdefghijklmnop") for k in range(1, length + 1)).rstrip().ljust(length, "x")
        at = length // 8 * 4
        docs += [(i, line), (i + 1, line[:at] + "z" * changed + line[at + changed :])]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, DOC).repartition(3)).collect()}
    assert got == {i: "" if i % 2 else t for i, t in docs}


def test_short_and_unspaced_lines_take_part(spark):
    rng = random.Random(3)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))
    near = han[:40] + "\u9fa5" + han[41:]
    rows = [(1, f"{han}\nles.\n\na b"), (2, f"Les.\n{near}\nmore"), (3, "les.\n A  B\n"), (4, "les"), (5, "\n \n")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("more", 2), 3: ("", 2), 4: ("les", 0), 5: ("\n \n", 0)}


def test_normals_are_those_of_each_line():
    assert ODD == [c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"]
    rng = random.Random(8)
    texts = ["".join(rng.choice("aÄИ中b \n" + odd) for _ in range(rng.randrange(12))) for odd in ("", " ", "\t\r\x1c", "\x85\xa0\u2028\u3000", "x", "xyzxyzxyz") for _ in range(500)]
    assert all(normals(t) == [normal(x) for x in t.split("\n")] for t in texts if t) and normals(None) == normals("") == []


def test_empty_bins_borrow_without_a_probe_each():
    """The same minima as probing bin by bin, which short lines make long, in less than half the time."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 4, 6, 7, 9, 12, 20]))) for _ in range(3000)] + ["a line of its own kind, " * k for k in (2, 9, 300)]
    lines += ["".join(rng.choice("abcdefghijklm ") for _ in range(n)) for n in range(20, 400)]
    out = minima(lines)

    def probed(out):
        empty, full, k, bins = np.flatnonzero(out == NONE), out.copy(), 0, len(PROBES)
        while len(empty) and k < bins:
            b = empty % bins
            out[empty] = found = full[empty - b + PROBES[b, k]]
            empty, k = empty[found == NONE], k + 1
        return out

    took = {}
    for f in (probed, borrowed):
        copies, start = [out.copy() for _ in range(3)], time.process_time()
        got = [f(c) for c in copies]
        took[f] = time.process_time() - start, got[0]
    assert (took[probed][1] == took[borrowed][1]).all() and (took[borrowed][1] != NONE).all()
    assert took[borrowed][0] < took[probed][0] / 2


def test_hashes_of_shingles_are_32_bits_and_fill_bins_evenly():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz \u00e9\u4e2d\U0001f600", k=60_000))
    h = hashes32(text)
    assert h.dtype == np.uint32 and len(h) == len(text) - WIDTH + 1
    assert hashes32("x" + text)[1:].tolist() == h.tolist()  # a shingle's hash depends on nothing around it
    assert len(np.unique(h)) >= len({text[i : i + WIDTH] for i in range(len(h))}) - 5
    n = np.bincount(((h >> np.uint32(16)) * np.uint32(150)) >> np.uint32(16), minlength=150)
    assert len(n) == 150 and n.min() > 300 and n.max() < 500  # 400 each


def test_lines_of_a_document_are_one_row(spark):
    rows = [(1, 10, "A b\n\n c\na B"), (2, 20, ""), (3, 30, " \n"), (4, 40, "x")]
    got = {r["id"]: (r["row"], r["lines"]) for r in occurrences(spark.createDataFrame(rows, "id long, row long, text string")).collect()}
    ab, c, x = line_ids(["a b", "c", "x"]).tolist()
    assert got == {1: (10, [ab, None, c, ab]), 2: (20, []), 3: (30, [None, None]), 4: (40, [x])}


def test_line_sets_of_a_batch_are_those_of_each_line():
    rng = random.Random(12)
    lines = ["".join(rng.choice("ab cd") for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 400]))) for _ in range(200)] + ["long words " * 30_000, "x"]
    many, one = line_sets(lines), [char_shingle_set(x, WIDTH) for x in lines]
    assert [len(s) for s in many] == [len(s) for s in one]
    for a, b in zip(range(200), range(1, 201), strict=True):
        if min(len(lines[a]), len(lines[b])) >= WIDTH:
            assert len(np.intersect1d(many[a], many[b])) == len(np.intersect1d(one[a], one[b]))


def test_rows_that_share_an_id_lose_only_repeated_lines(spark):
    rows = [(1, "the only line of its kind here\nsecond line of the first row"), (1, "second line of the first row\nquite another line, kept"), (1, "quite another line, kept"), (2, "one more line that is unique")]
    got = sorted(r["text"] for r in line_dedup(spark.createDataFrame(rows, DOC)).collect())
    lines = sorted(x for t in got for x in t.split("\n") if x)
    assert lines == sorted({x for _, t in rows for x in t.split("\n")})
    twice = line_dedup(spark.createDataFrame([(5, "same line of both rows")] * 2 + [(6, "same line of both rows")], DOC)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in twice) == [(5, 0), (5, 0), (6, 1)]


def test_lines_odd_inputs(spark):
    line = "this is a line that is long enough to count"
    rows = [(1, None, "k"), (2, "", None), (3, f"{line}\n{line}", "a"), (4, line.upper(), "b"), (None, line, "c"), (5, ("x y z " * 40000) + "\n" + line, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup(df).collect()}
    assert got == {1: (None, 0), 2: ("", 0), 3: (line, 1), 4: ("", 1), None: (line, 0), 5: ("x y z " * 40000, 1)}
    assert line_dedup(df.limit(0)).count() == 0


# --- vectors -------------------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>"


def clustered(rng, n, d):
    x = rng.normal(size=(n, d))
    for i in range(0, n, 3):
        x[i + 1 : i + 3] = x[i] + rng.normal(size=(len(x[i + 1 : i + 3]), d)) * rng.choice([0.01, 0.2, 0.33])
    return x.astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("d", [1, 3, 16, 64])
def test_embedding_links_equal_brute_force(spark, d):
    x = clustered(np.random.default_rng(d), 240, d)
    x[7] = x[3]
    x[11] = x[3] * 2  # the same direction
    a = cosines(x) >= 0.95
    np.fill_diagonal(a, False)
    root = unite(range(240), zip(*np.nonzero(a), strict=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(spark.createDataFrame(rows, VEC).repartition(3)).collect()}
    assert got == {i: (int(a[i].sum()), root[i], root[i] == i) for i in range(240)}


def test_pigeonhole_holds():
    rng = np.random.default_rng(1)
    b = Blocks(64, 0.95)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=x.shape) * 0.32 * np.linalg.norm(x, axis=1, keepdims=True) / 8
    u, v = b.rotated(x), b.rotated(y)
    near = (u * v).sum(1) >= 0.95
    some = np.zeros(300, bool)
    for (lo, hi), share in zip(b.spans, b.budget, strict=True):
        some |= ((u[:, lo:hi] - v[:, lo:hi]) ** 2).sum(1) <= share
    assert near.sum() > 50 and some[near].all()
    for k in range(len(b.spans)):  # every visitor within the radius comes to the home cell
        rows, cell, home = b.cells(np.concatenate([u, v]), k)
        at = {int(r): int(c) for r, c, h in zip(rows, cell, home, strict=True) if h}
        visits = set(zip(rows.tolist(), cell.tolist(), strict=True))
        lo, hi = b.spans[k]
        for i in np.flatnonzero(((u[:, lo:hi] - v[:, lo:hi]) ** 2).sum(1) <= b.budget[k]):
            assert (i + 300, at[int(i)]) in visits


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], None), (3, None, "c"), (4, [0.0, 0.0], "d"), (5, [nan, 1.0], "e"), (6, [inf, 1.0], "f"), (7, [1.0, None], "g"), (None, [1.0, 0.0], "h"), (8, [], "i"), (9, [0.0, 1.0, 1.0], "j"), (10, [1.0, 0.0], "k")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")


def test_boxes_rule_out_most_pairs_of_a_block_and_no_near_one():
    b = Blocks(64, 0.95)
    y = b.rotated(np.random.default_rng(3).normal(size=(8192, 64)))[:, : b.spans[0][1]].astype(np.float32)
    y[1::4] = y[::4] + np.float32(0.02)  # pairs that are near
    homes, visitors, most = np.arange(0, 8192, 2), np.arange(8192), b.budget[0]
    tested, found = 0, set()
    for hs, vs in near(y, homes, visitors, most):
        assert len(hs) <= LEAF
        tested += len(hs) * len(vs)
        found |= {(int(h), int(v)) for h in hs for v in vs[((y[vs] - y[h]) ** 2).sum(1) <= most]}
    assert tested < 0.5 * len(homes) * len(visitors)
    assert found == {(int(h), int(v)) for h in homes for v in np.flatnonzero(((y - y[h]) ** 2).sum(1) <= most)}
    assert len(found) > 3 * len(homes) // 2 - 1
    assert not list(near(y, homes[:0], visitors, most)) and not list(near(y, homes, visitors[:0], most))


def test_embedding_dedup_odd_inputs(spark):
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup(odd_vectors(spark)).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), None: (None, None, None)}
    assert embedding_dedup(odd_vectors(spark).limit(0)).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in embedding_dedup(spark.createDataFrame(order, VEC)).collect())
        assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_search_of_many_queries(spark):
    """More queries than one batch holds, against blocks that each index their rows once."""
    x = np.random.default_rng(6).normal(size=(1300, 6))
    s = cosines(x)
    np.fill_diagonal(s, -2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(3)
    got = {}
    for r in ann_search(df, df, k=2, share=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert len(got) == 1300 and all([got[q][1], got[q][2]] == np.lexsort((np.arange(1300), -s[q]))[:2].tolist() for q in range(1300))


def test_search_recall_of_evenly_spread_vectors(spark):
    x = np.random.default_rng(4).normal(size=(3000, 64))
    s = cosines(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(3)
    got = ann_search(df, df.where(F.col("vec_id") % 50 == 0)).collect()
    np.fill_diagonal(s, -2)
    hits = sum(r["vec_id"] in set(np.argsort(-s[r["query_id"]])[:5].tolist()) for r in got)
    assert len(got) == 300 and hits >= 0.9 * 300


def test_search_recall_and_order(spark):
    x = clustered(np.random.default_rng(9), 1500, 32)
    s = cosines(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(3)
    got = ann_search(df, df.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()
    hits = 0
    for q in range(0, 1500, 50):
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in [r["vec_id"] for r in own]
        assert all(abs(r["score"] - s[q, r["vec_id"]]) < 1e-12 for r in own)
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        row = s[q].copy()
        row[q] = -2
        hits += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(1500), -row))[:5].tolist()))
    assert hits >= 0.9 * 5 * 30


def test_search_ties_and_odd_inputs(spark):
    same = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [2.0, 1.0 + i / 100]) for i in range(20)]
    df = spark.createDataFrame(same, VEC)
    got = ann_search(df, df.where("vec_id = 100"), share=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] and len({r["score"] for r in got}) == 1
    odd = odd_vectors(spark)
    got = [(r["query_id"], r["vec_id"]) for r in ann_search(odd, odd).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2), (1, 10), (2, 1), (2, 10), (10, 1), (10, 2)]
    assert ann_search(odd.limit(0), odd).count() == 0 and ann_search(odd, odd.limit(0)).count() == 0


def test_forest_reaches_every_row():
    x = np.random.default_rng(0).normal(size=(700, 8))
    f = Forest(x, 1, trees=3, leaf=40)
    assert len(f.candidates((x[:1] @ f.planes.T - f.bounds)[0], 700)) == 700
    assert len(Forest(np.ones((500, 4)), 1, trees=2, leaf=10).leaves) == 2


def test_cut_leaves_no_shuffle_behind(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {b.toString() for b in map(blocks.getAllBlocks().apply, range(blocks.getAllBlocks().size()))}
    shuffles = lambda: {n for n in names() if n.startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = cut(counts)  # counts is still referred to, so that no collected garbage explains it
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert kept.join(counts, ["k", "count"]).count() == kept.count() == 7
    assert spark.conf.get(CLEANUP, None) == setting
