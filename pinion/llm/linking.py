"""From signatures to the components of all verified links, for sets of hashed shingles.

Sets that share a signature form a bucket. Per bucket every member is verified against the bucket's least id and,
where that left several components, against its member with the most links (both linear in the bucket). Pairs that
are already in one component need no test. What remains are a component's bucket mates outside it: these are counted
against all its bucket mates over postings, in blocks of bounded size, and only links leave a block. No pair that shares a
bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinion.llm.common import U64, cut, mix, small, unique
from pinion.llm.components import components

#: texts -> (per signature the place of its text; signatures; per text the 64-bit key of its set, or None where ids name the
#: sets; per signature a byte, or None: how many signatures at least the set shares with a linked partner, 127 at most, plus
#: UPPER where the set is in the upper one of the two size bands that the signature is for)
Signer = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
UPPER = 128
BLOB = "r int, keys binary, sigs binary, needs binary"
STAR = "bucket long, center long, member long, times long, proper long, size long, need int, own int, center_own int"
#: Bytes of a signature that are sent; those before them are implied by its part.
SENT = 6
#: Texts of one side of a block.
BLOCK = 1024
#: Pairs of one centre that one task verifies, about.
VERIFIED = 2000


def slices(texts: list, most_chars: int) -> Iterator[slice]:
    """Consecutive slices of at most most_chars characters (a longer text stands alone)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most_chars:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that end at `ends`, without a copy."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def signature_blobs(docs: DataFrame, sign: Signer, parts: int, split: Callable | None = None) -> DataFrame:
    """(id, text) -> packed arrays of signatures, dealt into `parts` by the signature's leading bits.

    15 bytes a signature (its last 48 bits, the set's key, its need) and a row header per part and batch: batches grow with the
    number of parts, so that a header stays small beside what it heads. split(ids, texts) may turn rows into others before
    they are signed. A signer without keys says that ids name the sets.
    """
    most_chars = min(16_000_000, max(2_000_000, 600 * parts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            all_ids, all_texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for s in slices(all_texts, most_chars):
                ids, texts = all_ids[s], all_texts[s]
                if split:
                    ids, texts = split(ids, texts)
                at, sig, key, need = sign(list(texts))
                if not len(sig):
                    continue
                part = ((sig >> U64(32)) * U64(parts)) >> U64(32)
                by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # short numbers are sorted by radix
                part, of = part[by], (ids if key is None else key).astype(np.int64)
                need = np.ones(len(sig), np.uint8) if need is None else need[by]
                low = np.ascontiguousarray(sig[by].view(np.uint8).reshape(-1, 8)[:, :SENT])
                ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
                columns = [pa.array(part[ends - 1].astype(np.int32)), binaries(of[at[by]], ends * 8), binaries(low, ends * SENT), binaries(need, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["r", "keys", "sigs", "needs"])

    return docs.mapInArrow(emit, BLOB)


def stars_of(t: pa.Table) -> pa.Table:
    """The buckets of one part: a row for each member beside the centre, which has the least key. Each list of members comes
    once, with the number of its buckets (times), how many of them say that the pair may be linked (proper), its members with the
    centre (size), how many it must share to be linked (need), and how many the member and the centre must share with any partner."""
    keys, sigs, needs = (np.frombuffer(b"".join(t.column(c).to_pylist()), w) for c, w in (("keys", np.int64), ("sigs", np.uint8), ("needs", np.uint8)))
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :SENT] = sigs.reshape(-1, SENT)
    sigs = wide.view(U64).ravel()
    order = np.argsort(sigs, kind="stable")
    s = sigs[order]
    same = s[1:] == s[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    s, at = s[keep], order[keep]
    order = np.lexsort((keys[at], s))
    s, at = s[order], at[order]
    k = keys[at]
    if len(s):
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])  # copies of a set count once
        s, k, at = s[first], k[first], at[first]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(s)))
    chosen = size > 1
    if chosen.any():
        chosen &= np.minimum.reduceat(needs[at], start) < UPPER  # else no pair of it may be linked by this band
    if not chosen.any():
        return pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith("int") else pa.int64()) for c in STAR.split(", ")})
    name = mix(np.add.reduceat(mix(k.astype(U64)), start) + size.astype(U64))
    _, once, of, times = np.unique(np.where(chosen, name, U64(0)), return_index=True, return_inverse=True, return_counts=True)
    last = np.zeros(len(start), bool)
    last[once] = True
    chosen &= last
    member = np.repeat(chosen, size)
    member[start] = False
    spread = lambda v: np.repeat(v, size)[member]
    x, c, times = needs[at[member]], needs[at[spread(start)]], spread(times[of])
    proper = (x < UPPER) | (c < UPPER)
    need = np.maximum(x % UPPER, c % UPPER).astype(np.int32)
    rows = (spread(name).astype(np.int64), spread(k[start]), k[member], times, times * proper, spread(size), need, (x % UPPER).astype(np.int32), (c % UPPER).astype(np.int32))
    return pa.table({c.split()[0]: pa.array(v) for c, v in zip(STAR.split(", "), rows, strict=True)})


def each(shingles: Callable[[str], np.ndarray]) -> Callable[[list[str]], list[np.ndarray]]:
    """Sets of several texts by a function of one text."""
    return lambda texts: [shingles(t) for t in texts]


def verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """(center, member) -> with the exact sizes of intersection and union of their sets. pairs: from a checkpoint.

    A centre of many pairs is dealt over as many tasks as that takes, each with a copy of its text; such centres are few.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            names = list(dict.fromkeys([*a, *b]))
            of = dict(zip(names, sets(names), strict=True))
            inter, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            for n, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = of[x], of[y]
                both = np.concatenate([x, y])
                both.sort()
                inter[n] = np.count_nonzero(both[1:] == both[:-1])
                union[n] = len(both) - inter[n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter), pa.array(union)], names=["center", "member", "inter", "union"])

    one = texts.select(F.col("id").alias("member"), F.col("text").alias("b"))
    two = texts.select(F.col("id").alias("center"), F.col("text").alias("a"))
    many = cut(pairs.groupBy("center").agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("salts")).where("salts > 1"))
    on = ["center"]
    if not many.isEmpty():
        on = ["center", "salt"]
        pairs = pairs.join(many, "center", "left").select("center", "member", F.expr("CASE WHEN salts > 1 THEN pmod(xxhash64(member), salts) ELSE 0 END").cast("int").alias("salt"))
        two = two.join(many, "center", "left").select("center", "a", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"))
    rows = one.join(pairs.hint("shuffle_hash"), "member").join(two, on).select("center", "member", "a", "b")
    return rows.mapInArrow(measure, "center long, member long, inter long, union long")


def block_links(t: pa.Table, sets_of: Callable[[list[str]], list[np.ndarray]], percent: int) -> pa.Table:
    """Links between the left and the right rows of each key, by counting common shingles over postings. Of a key's links a
    spanning forest is returned, which says as much."""
    t = t.sort_by("key")
    key, ids, left = t.column("key").to_numpy(), t.column("id").to_numpy(), t.column("left").to_numpy()
    texts = t.column("text").to_pylist()
    kept: list[tuple[int, int]] = []
    own, at = np.unique(ids, return_index=True)
    of = dict(zip(own.tolist(), sets_of([texts[i] for i in at]), strict=True))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
        right = np.flatnonzero(~left[a:b]) + a
        sets = [of[i] for i in ids[right].tolist()]
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, U64)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
        posted, ends = flat[first], np.append(first[1:], len(flat))
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        for i in np.flatnonzero(left[a:b]) + a:
            me = int(ids[i])
            x = of[me]
            k = np.searchsorted(posted, x)
            k = k[: np.searchsorted(k, len(posted))]  # sorted, as x is
            k = k[posted[k] == x[: len(k)]]
            lo = first[k]
            n = ends[k] - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(100 * inter >= percent * (len(x) + size - inter)):
                you = int(ids[right[j]])
                if you != me and (u := find(me)) != (v := find(you)):
                    root[max(u, v)] = min(u, v)
                    kept.append((min(me, you), max(me, you)))
    return pa.table({"center": pa.array([u for u, _ in kept], pa.int64()), "member": pa.array([v for _, v in kept], pa.int64())})


def linked_components(
    blobs: DataFrame, fetch: Callable[[DataFrame], DataFrame], shingles: Callable[[str], np.ndarray], percent: int, sets: Callable[[list[str]], list[np.ndarray]] | None = None
) -> DataFrame:
    """(id, component) of every key that has a link: 100 * |A & B| >= percent * |A | B|.

    fetch(ids) returns (id, text) of at least these keys, one row each. sets, if given, makes the sets of many texts at once.
    """
    stars = blobs.groupBy("r").applyInArrow(stars_of, STAR).groupBy("bucket", "member")
    stars = cut(stars.agg(F.first("center").alias("center"), F.sum("times").alias("times"), F.sum("proper").alias("proper"), *(F.first(n).alias(n) for n in ("size", "need", "own", "center_own"))))
    pairs = stars.where("proper > 0").groupBy("center", "member").agg(F.sum("proper").alias("times"), F.min("need").alias("need"))
    pairs = cut(pairs.where("times >= need").select("center", "member"))
    # a set that shares fewer signatures with all others together than it must with a linked one needs no text: its pairs drop out
    ids = stars.select(F.col("member").alias("id"), "own", "times").union(stars.select("center", "center_own", "times"))
    ids = cut(ids.groupBy("id").agg(F.sum("times").alias("times"), F.min("own").alias("own")).where("times >= own").select("id"))
    texts = cut(fetch(ids).join(unique(ids), "id", "left_semi"))
    is_link = f"100 * inter >= {percent} * union"

    def test(pairs: DataFrame) -> DataFrame:
        return cut(verified(pairs, texts, sets or each(shingles)).select("center", "member", F.expr(is_link).alias("linked")))

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        found = links.where("linked").select(F.col("member").alias("src"), F.col("center").alias("dst"))
        return labels if found.isEmpty() else components(found.union(labels.select(F.col("id").alias("src"), F.col("component").alias("dst"))))

    first = test(pairs)
    labels = components(first.where("linked").select(F.col("member").alias("src"), F.col("center").alias("dst")))
    # members of the buckets that hold more than one component, with their distances to the centre
    large = stars.where("size > 2").select("bucket", "center", "member")  # two members have been tested, or cannot be linked
    every = large.withColumnRenamed("member", "id").union(large.select("bucket", "center", F.col("center").alias("id")).distinct())

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(unique(labels), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    every = cut(labelled(every, labels))
    mixed = every.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    mixed = mixed.where("a <> b").select("bucket")
    # a second star around the member with the most links so far: the source of a group of copies links them all
    linked = first.where("linked")
    degree = linked.select(F.col("member").alias("id")).union(linked.select("center")).groupBy("id").agg(F.count("*").alias("degree"))
    open_ = cut(every.join(unique(mixed), "bucket").join(unique(degree), "id", "left"))
    hub = open_.groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("id")).alias("less"), "label")).alias("m"))
    hub = hub.select("bucket", (-F.col("m.less")).alias("hub"), F.col("m.label").alias("hub_label"))
    open_ = cut(open_.drop("degree").join(unique(hub), "bucket"))
    key = [F.least("id", "hub").alias("center"), F.greatest("id", "hub").alias("member")]
    second = test(cut(open_.where("label <> hub_label").select(*key).distinct().join(first.select("center", "member"), ["center", "member"], "left_anti")))
    labels = merged(labels, second)
    # what is left: per component, the members of its open buckets that lie outside it, against all members, in blocks
    at = cut(labelled(open_.where("id <> center AND id <> hub").select("bucket", "id", "hub"), labels))  # those two are tested with all
    mixed = at.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("of_hub"))
    at = at.join(unique(mixed), "bucket").join(unique(of_hub), "hub", "left")
    at = at.select(F.coalesce("of_hub", "hub").alias("key"), "id", (F.col("label") != F.coalesce("of_hub", "hub")).alias("outside")).distinct()
    sizes = at.groupBy("key").agg(F.count_if("outside").alias("out"), F.count("*").alias("all")).where("out > 0")
    sizes = sizes.select("key", F.ceil(F.col("out") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cols"))
    at = cut(at.join(unique(sizes), "key").withColumn("h", F.xxhash64("id")))
    bins = max(1, -(-at.count() // BLOCK))  # small keys share a task's group; the blocks of a large one are groups of their own
    left = at.where("outside").select("key", "id", F.lit(True).alias("left"), F.expr("pmod(h, rows)").alias("row"), F.explode(F.expr("sequence(0L, cols - 1L)")).alias("col"))
    right = at.select("key", "id", F.lit(False).alias("left"), F.explode(F.expr("sequence(0L, rows - 1L)")).alias("row"), F.expr("pmod(h, cols)").alias("col"))
    blocks = left.union(right).join(texts, "id").groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "row", "col")
    found = cut(blocks.applyInArrow(lambda t: block_links(t, sets or each(shingles), percent), "center long, member long"))
    return merged(labels, found.withColumn("linked", F.lit(True)))
