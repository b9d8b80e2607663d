"""SimHash near-dedup with BK-trees.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints become one
   node, combined before the shuffle.
2. Nodes are dealt to shards: the 64 bits are cut into blocks, and two fingerprints that
   differ in at most ``radius`` bits agree in all but ``radius`` of them, so each node goes to
   the shard of every choice of blocks. All pairs in reach meet in some shard.
3. Each shard builds a BK-tree: children hang on the edge of their integer Hamming distance
   to the parent. All members search it together and follow only edges within the radius of
   their own distance. A shard of too many rows (a block value that many texts share) is cut
   into parts; each part's tree is sent to every other part of the shard.
4. A shard reports links to the least member of each group that it found, never all pairs;
   components of these links, over all shards, are the groups.

A tree reaches its queries by the shuffle on the shard, not by a broadcast: a broadcast
passes through the driver, and all trees together are the fingerprints of all documents.

Cases: null text = empty text, whose fingerprint is zero and is linked like others; null ids
are rows like others, but never name a group unless it has no other; repeated rows and ties
share a fingerprint; very long texts are hashed in chunks; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from souk.llm.common import map_texts, numbered, save, sized
from souk.llm.graph import components

SHARD = 2048  # nodes of a shard, about
LEAF = 48  # nodes that a tree no longer splits
CHUNK = 100_000  # hashes whose bits are counted at once


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text in UTF-8 over shingles of words, repeats included."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space parts words
    if not words:
        return 0
    if len(words) <= shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at:at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: dict[str, str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    return map_texts(docs, text_col, keep, "fp bigint", lambda texts: [
        pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), pa.int64())])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BkTree:
    """BK-tree over distinct fingerprints: a pivot, and below it a tree for each distance of
    the others from it; up to LEAF fingerprints stay together."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        self.points = points
        self.index = np.arange(len(points)) if index is None else index
        self.edges: list[tuple[int, BkTree]] = []
        if len(self.index) > LEAF:
            self.pivot, rest = self.index[0], self.index[1:]
            away = distance(points[rest], points[self.pivot])
            order = np.argsort(away, kind="stable")
            rest, away = rest[order], away[order]
            at, first = np.unique(away, return_index=True)
            self.edges = [(int(k), BkTree(points, part)) for k, part in zip(at, np.split(rest, first[1:]))]
            self.index = self.index[:0]

    def search(self, queries: np.ndarray, who: np.ndarray, radius: int, found) -> None:
        """Call ``found(which queries, which points)`` for all pairs within the radius."""
        if not self.edges:
            for at in range(0, len(who), 4096):
                near = distance(queries[who[at:at + 4096], None], self.points[None, self.index]) <= radius
                q, p = np.nonzero(near)
                if len(q):
                    found(who[at + q], self.index[p])
            return
        away = distance(queries[who], self.points[self.pivot]).astype(np.int16)
        hit = who[away <= radius]
        if len(hit):
            found(hit, np.full(len(hit), self.pivot))
        for k, child in self.edges:
            follow = who[np.abs(away - k) <= radius]
            if len(follow):
                child.search(queries, follow, radius, found)


class Groups:
    """Groups of linked places, by minimum labels; links are folded in as they come."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > 1_000_000:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            label = self.label
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, label[a], low)
                np.minimum.at(new, label[b], low)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
            self.label, self.held, self.size = label, [], 0
        return self.label


def shard_links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links (a, b) of one shard, or of two of its parts (side 0: tree, side 1: queries), to
    the least member of each group."""
    own = np.unique(pdf["fp"].to_numpy(np.int64))
    tree_side = np.unique(pdf["fp"][pdf["side"] == 0].to_numpy(np.int64))
    other = np.unique(pdf["fp"][pdf["side"] == 1].to_numpy(np.int64))
    points, queries = tree_side.view(np.uint64), (other if len(other) else tree_side).view(np.uint64)
    groups = Groups(len(own))
    of_point, of_query = np.searchsorted(own, points.view(np.int64)), np.searchsorted(own, queries.view(np.int64))
    # The pivot is the first; a fixed shuffle keeps trees even for any values.
    mixed = np.argsort(points * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    BkTree(points, mixed).search(queries, np.arange(len(queries)), radius,
                                 lambda q, p: groups.link(of_query[q], of_point[p]))
    label = groups.fold()
    away = np.nonzero(label != np.arange(len(own)))[0]
    return pd.DataFrame({"a": own[away], "b": own[label[away]]})


def block_masks(nodes: int, radius: int) -> list[int]:
    """Masks of the choices of blocks: the fewest blocks whose choices have enough values
    to deal ``nodes`` nodes to shards evenly."""
    for blocks in range(radius + 1, 2 * radius + 2):
        if (64 // blocks) * (blocks - radius) >= max(1, nodes // SHARD).bit_length():
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all nodes (fp) within ``radius`` bits of each other."""
    n = nodes.count()
    masks = block_masks(n, radius)
    shards = max(1, n * len(masks) // shard)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value"))
                               for i, m in enumerate(masks)))).alias("k")
    dealt = (nodes.select("fp", keys)
             .select("fp", F.pmod(F.xxhash64("k.choice", "k.value"), F.lit(shards)).alias("shard")))
    # Shards of too many rows are cut into parts; each pair of parts is a task of its own.
    large = save(dealt.groupBy("shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > 3 * shard)
                 .select("shard", F.ceil(F.col("rows") / (2 * shard)).alias("parts")), "simhash-large")
    dealt = dealt.join(sized(large), "shard", "left")
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
    tasks = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(
            F.least(p, part).alias("i"), F.greatest(p, part).alias("j"), F.when(p < part, 1).otherwise(0).alias("side"))))
    spread = dealt.select("fp", "shard", F.explode(tasks).alias("t")).select("fp", "shard", "t.i", "t.j", "t.side")
    return spread.groupBy("shard", "i", "j").applyInPandas(lambda pdf: shard_links(pdf, radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint: a name of
    its group, and the least doc_id that can be reached over links of at most ``radius`` bits."""
    rows = save(with_fingerprints(docs, {id_col: "doc_id"}, text_col, shingle), "simhash-rows")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    roots = components(save(near_links(nodes, radius), "simhash-links"))
    member = save(nodes.join(roots, nodes["fp"] == roots["node"], "left")
                  .select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "simhash-members")
    named = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, save(member.join(named, "root").select("fp", "root", "component_id"), "simhash-components")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    rows, groups = near_groups(docs, **options)
    return rows.join(groups, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                     radius: int = 3) -> DataFrame:
    """One row of each group of ``docs``, that with the least id; columns as they are. Rows
    that go are subtracted by id and fingerprint, so that texts need no shuffle where few go."""
    found, groups = near_groups(docs, id_col, text_col, shingle=shingle, radius=radius)
    found = save(found.join(groups, "fp").select(F.col("doc_id").alias("id"), F.col("fp").alias("print"), "root",
                                                 F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "simhash-found")
    gone = save(found.filter("NOT stays").select("id", "print").distinct(), "simhash-gone")
    # Rows that share the least id with a group-mate (repeated rows): one of them stays.
    many = found.filter("stays").groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    again = save(found.filter("stays").join(many, "root").select("id", "print", "root").distinct(), "simhash-again")
    plain, name = numbered(docs)
    rows = with_fingerprints(plain, {c: c for c in plain.columns}, name[text_col], shingle)
    same = F.col(name[id_col]).eqNullSafe(F.col("id")) & (F.col("fp") == F.col("print"))
    rows = rows.join(sized(gone), same, "left_anti")
    if again.count():
        first = rows.join(sized(again), same).dropDuplicates(["root"]).select(plain.columns)
        rows = rows.join(sized(again), same, "left_anti").select(plain.columns).unionByName(first)
    return rows.select(plain.columns).toDF(*docs.columns)
