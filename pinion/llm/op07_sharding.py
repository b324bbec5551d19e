"""Sharding by minimax contiguous partition, with DataFrame operations only.

Equal texts are one atomic group. Groups larger than an even share get a shard each; the others are ordered by their hash
and cut into contiguous shards so that the largest shard is as small as possible: the driver binary-searches the smallest feasible capacity and checks each one greedily.
It never sees all groups: the hash space is a trie whose nodes carry sums, greedy checks over whole nodes bound the
capacity from both sides (a node as one block; a node as divisible at will), and only nodes in which a cut can fall are
opened further, as at most RUNS ranges of the hash and SEGMENTS rows at a time, until both bounds agree. The shard of a row is
then an expression on its hash, and slots are counted in hashed sub-groups of rows, so that a hot group is no single task.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.llm.common import cut, table

SHARDS, OVERHEAD = 24, 8
#: Bits of the hash that order the groups, bits per opening of the trie, and most rows that the driver holds at once.
BITS, STEP, SEGMENTS = 62, 12, 65_536
#: Ranges of the hash that one opening reads.
RUNS = 50
#: Rows that one task numbers, about.
NUMBERED = 50_000


@dataclass(frozen=True)
class Node:
    """Groups whose hash lies in [low, low + width): their sum, the largest of them and how many they are."""

    low: int
    width: int
    total: int
    largest: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.width == 1


def greedy(nodes: list[Node], ends: list[int], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Where greedy filling cuts: prefix sums (divisible) or node indexes; None if more than `shards` shards are needed."""
    cuts, at, i = [], 0, 0
    for _ in range(shards):
        if ends and at >= ends[-1] or i >= len(nodes):
            break
        if divisible:
            reach = at + capacity
            k = bisect_right(ends, reach)  # nodes that fit as a whole
            if k < len(nodes) and nodes[k].atomic:
                reach = ends[k - 1] if k else 0
            if reach <= at:
                return None
            at = min(reach, ends[-1])
            cuts.append(at)
        else:
            k = bisect_right(ends, (ends[i - 1] if i else 0) + capacity)
            if k <= i:
                return None
            i = k
            cuts.append(k)
    done = (at >= ends[-1]) if divisible else i >= len(nodes)
    return cuts if done else None


def smallest(nodes: list[Node], ends: list[int], low: int, high: int, shards: int, divisible: bool) -> int:
    """Binary search of the smallest feasible capacity in [low, high]; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        if greedy(nodes, ends, mid, shards, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def windows(nodes: list[Node], ends: list[int], low: int, high: int, shards: int) -> list[range]:
    """For each cut, the nodes in which greedy filling can make it with any capacity from low to high.

    Filling with `high` as if nodes were divisible cuts last. Filling with `low` cuts first: within a node no further back than
    its largest group, and never before the node itself.
    """
    out, first, last = [], 0, 0
    for _ in range(shards):
        if first >= ends[-1]:
            break
        i = bisect_right(ends, first + low)
        begin = ends[i - 1] if i else 0
        if i < len(nodes):
            first = begin if nodes[i].atomic else max(begin, first + low - nodes[i].largest)
        else:
            first = ends[-1]
        last = min(last + high, ends[-1])
        out.append(range(bisect_right(ends, first), min(bisect_right(ends, last), len(nodes) - 1) + 1))
    return out


def to_open(nodes: list[Node], wanted: list[range]) -> list[list[int]]:
    """Runs of nodes to be opened next, all of the width of the heaviest one that is wanted. Runs hold nothing else but atomic
    nodes; what is over RUNS of them, or half of SEGMENTS nodes, waits for another turn."""
    inside = sorted({m for w in wanted for m in w if not nodes[m].atomic}) or [m for m, n in enumerate(nodes) if not n.atomic]
    width = nodes[max(inside, key=lambda m: nodes[m].total)].width
    runs: list[list[int]] = []
    for m in [m for m in inside if nodes[m].width == width][: SEGMENTS // 2]:
        if runs and all(nodes[g].atomic for g in range(runs[-1][-1] + 1, m)):
            runs[-1].append(m)
        else:
            runs.append([m])
    runs.sort(key=lambda r: -sum(nodes[m].total for m in r))
    return runs[:RUNS]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(u, size) per group, u in [0, 2^BITS) -> the smallest capacity, and the first hash of each shard but the first."""

    def opened(ranges: list[tuple[int, int]], width: int) -> list[Node]:
        rows = groups
        if ranges:
            rows = groups.where(reduce(or_, (F.col("u").between(a, b) for a, b in ranges)))
        rows = rows.groupBy((F.col("u") - F.pmod("u", F.lit(width))).alias("low"))
        rows = rows.agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.count("*").alias("groups"), F.min("u").alias("first"))
        return [Node(r["first"] if r["groups"] == 1 else r["low"], 1 if r["groups"] == 1 else width, r["total"], r["largest"], r["groups"]) for r in rows.collect()]

    nodes = sorted(opened([], 1 << (BITS - STEP)), key=lambda n: n.low)
    if not nodes:
        return 0, []
    while True:
        ends = list(accumulate(n.total for n in nodes))
        floor = max(max(n.largest for n in nodes), -(-ends[-1] // shards))
        high = smallest(nodes, ends, floor, ends[-1], shards, False)
        low = smallest(nodes, ends, floor, high, shards, True)
        if low == high:
            cuts = greedy(nodes, ends, high, shards, False)
            return high, [nodes[k].low for k in cuts[:-1]]
        runs = to_open(nodes, windows(nodes, ends, low, high, shards))
        count, width = sum(map(len, runs)), nodes[runs[0][0]].width
        bits = min(STEP, max(1, (SEGMENTS // count).bit_length() - 1))
        if sum(nodes[m].groups for r in runs for m in r) <= SEGMENTS:
            bits = BITS  # few enough to see each group
        new = opened([(nodes[r[0]].low, nodes[r[-1]].low + width - 1) for r in runs], max(1, width >> bits))
        gone = {m for r in runs for m in range(r[0], r[-1] + 1)}
        nodes = sorted([n for m, n in enumerate(nodes) if m not in gone] + new, key=lambda n: n.low)


def giants(groups: DataFrame, shards: int) -> list[int]:
    """Groups larger than the even share of what is left: they come first in the order, each with a shard of its own."""
    total = groups.agg(F.sum("size")).head()[0] or 0
    found = []
    for r in groups.orderBy(F.desc("size"), "u").limit(shards - 1).collect():
        if r["size"] * (shards - len(found)) <= total:
            break
        found.append(r["u"])
        total -= r["size"]
    return found


def numbered(rows: DataFrame, by: str, order: list[str], total: int, groups: int) -> DataFrame:
    """rows with slot: gapless numbers from 0 within each value of `by`, counted in hashed sub-groups."""
    subs = max(1, -(-total // (NUMBERED * groups)) * 4)
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64(*order), F.lit(subs)))
    sizes = rows.groupBy(by, "__sub").agg(F.count("*").alias("n"))
    before = W.partitionBy(by).orderBy("__sub").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(by, "__sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(by, "__sub").orderBy(*order))
    return rows.withColumn("__own", own).join(sizes, [by, "__sub"]).withColumn("slot", F.col("__own") - 1 + F.col("__before")).drop("__own", "__before", "__sub")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes are UTF-8 bytes plus OVERHEAD; null texts have no bytes, no checksum and are one group. Documents of equal text
    share a shard, whatever their number, and the null texts too; ties of size go by hash. Repeated rows get a slot each, and
    so do rows with a null id. Very long texts are sized whole. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    text = F.col(text_col).cast("string")
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("\x00")), text.isNull()), 64 - BITS)
    rows = docs.select(F.col(id_col).alias("id"), (text_bytes(text) + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), u.alias("u"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    groups = cut(rows.groupBy("u").agg(F.sum("size").alias("size")))
    alone = giants(groups, shards)
    _, firsts = minimax_cuts(groups.where(~F.col("u").isin(alone)) if alone else groups, shards - len(alone))
    shard = F.lit(len(alone))
    for first in firsts:
        shard = shard + (F.col("u") >= first).cast("int")
    for k, u in enumerate(alone):
        shard = F.when(F.col("u") == u, k).otherwise(shard)
    out = numbered(rows.withColumn("shard", shard), "shard", ["row"], rows.count(), shards)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))
