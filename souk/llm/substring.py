"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Words are lower case, parted by white space. Units of a text, as ranges of its words:

* paragraphs: its lines of ``LINE`` words or more; a text of fewer words is one as a whole;
* seeds: runs of ``SEED`` words at places chosen by their own words alone (winnowing: of
  ``SEED`` runs in turn, the one of the least hash), so that any ``2 * SEED - 1`` words in a
  row hold a whole seed, wherever they stand and whatever their punctuation is.

1. One pass over the texts writes a row for each: hashes of its words, paragraphs, seeds.
2. Paragraphs of ``LINE`` words get MinHash signatures over word shingles, cut into bands;
   ``tune_bands`` chooses the fewest bands that miss less than a thousandth of the pairs at
   the threshold. Equal paragraphs are one node. Nodes that collide in a band are compared
   pair by pair by their exact shingle sets, except pairs that links already connect; a
   bucket of many nodes is cut into parts, whose pairs are tasks of their own, so no link is
   lost and no task is unbounded. Components of the links are clusters of near paragraphs;
   equal ones without a link are clusters, too.
3. Passages inside paragraphs: seeds are counted by their hash, combined before the shuffle. Of
   a seed that several documents have, the one with the least id is the keeper, and each other
   one is compared with it only: around their common seeds both texts are followed word by
   word, over edits of a few words, and the ranges found are a passage if they hold ``LEAST``
   words and their exact Jaccard similarity reaches the threshold, or else their equal parts
   of ``LEAST`` words.
4. In each cluster, and of each passage, the document with the least id keeps its words; the
   others lose theirs.

Cases: null text = empty text, without units; null ids neither keep nor lose a passage; rows
with one id are one document, which doesn't repeat itself, and each row has its own ranges;
very long lines are one paragraph; an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from souk.llm.common import Memo, bounded_batches, ready, save, sized
from souk.llm.graph import components

LEAST = 25  # words of a passage inside paragraphs, at least
LINE = 12  # words of a line that is a paragraph, at least
SEED = 16
SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BUCKET = 256  # nodes of a bucket that are compared in one go
CHAIN_GAP, CHAIN_DRIFT = 64, 16  # words between two seeds of one passage, and of difference in their distance, at most
REACH = 64  # words around the outermost seeds that are looked at
EDIT, RESUME = 4, 5  # words of an edit inside a passage, at most, and equal words after it, at least


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.3) -> tuple[int, int]:
    """(bands, rows) with the fewest bands such that a pair at the threshold collides with
    probability ``recall`` and a pair at a quarter of it with at most ``stray``."""
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if 1 - (1 - (threshold / 4) ** rows) ** bands <= stray:
            return bands, rows
    raise ValueError("no number of bands fits")


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers, so that all bits count."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding(f: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """f (minimum or maximum) of every ``size`` values in a row."""
    done = 1
    while done * 2 <= size:
        x, done = f(x[:-done], x[done:]), done * 2
    return f(x[:len(x) - size + done], x[size - done:])


def winnowed(x: np.ndarray, size: int) -> np.ndarray:
    """Places of the values that are the least of some ``size`` values in a row, equal ones
    included; at most ``size`` apart."""
    if len(x) < size:
        return np.zeros(0, np.int64)
    edge = np.zeros(size - 1, np.uint64)
    return np.nonzero(sliding(np.maximum, np.concatenate([edge, sliding(np.minimum, x, size), edge]), size) == x)[0]


UNITS = ("n_words int, codes binary, paragraphs array<struct<start:int,words:int,h1:bigint,h2:bigint,bands:array<bigint>>>, "
         "seeds array<struct<start:int,hash:bigint>>")


class Units:
    """Finds the units of texts."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(11)
        self.odd = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)

    def words(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their codes, and the ends of the lines as numbers of words."""
        lines = [x.split() for x in text.lower().split(b"\n")]
        words = list(chain.from_iterable(lines))
        codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        return words, codes, np.cumsum([len(x) for x in lines])

    def paragraphs(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts >= LINE
        return starts[long], ends[long]

    def seeds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the seeds."""
        n = len(codes) - SEED + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        runs = mixed(rolled(codes, SEED))
        starts = winnowed(runs, SEED) if n >= SEED else np.array([int(np.argmin(runs))])
        return starts, runs[starts].view(np.int64)

    def signatures(self, shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys of the bands (a row for each paragraph)."""
        all_of = np.append(shingles, np.uint64(2**64 - 1))
        at = np.stack([starts, ends - SHINGLE + 1], 1).ravel()
        least = np.minimum.reduceat(mixed(all_of * self.odd[:, None]), at, axis=1)[:, ::2].T
        keys = np.zeros((len(starts), self.bands), np.uint64)
        for r in range(self.rows):
            keys = mixed(keys * np.uint64(3) + least[:, r::self.rows])
        return (keys ^ np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words with these 64-bit codes."""
    done, out, factor = 1, codes, 0x9E3779B97F4A7C15
    while 2 * done <= size:  # runs twice as long
        out = out[:-done] * np.uint64(factor) + out[done:]
        done, factor = 2 * done, factor * factor % 2**64
    for k in range(done, size):
        n = len(out) - 1
        out = out[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    return out


def shingles_of(codes: np.ndarray) -> np.ndarray:
    """Hashes of all shingles; of fewer words, none."""
    return mixed(rolled(codes, SHINGLE)) if len(codes) >= SHINGLE else np.zeros(0, np.uint64)


def short(codes: np.ndarray) -> bytes:
    """32 bits of each word's code: enough to follow two texts that share a seed."""
    return (codes >> np.uint64(32)).astype("<u4").tobytes()


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_words, codes, paragraphs, seeds) for each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, none = Units(bands, rows), np.zeros(0, np.int64)
        for b in batches:
            sizes, codes_of, first, last, digests, bands_of, counts, seeds = [], [], [none], [none], [], [none], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words, codes, ends = finder.words(text or b"")
                sizes.append(len(words))
                codes_of.append(short(codes))
                starts, to = finder.paragraphs(ends)
                if len(starts):
                    bands_of.append(finder.signatures(shingles_of(codes), starts, to).ravel())
                elif 0 < len(words) < LINE:
                    starts, to = np.zeros(1, np.int64), np.array([len(words)])
                first.append(starts)
                last.append(to)
                counts.append((len(starts), bands if len(words) >= LINE else 0))
                digests += [xxh3_128_digest(b" ".join(words[s:e])) for s, e in zip(starts.tolist(), to.tolist())]
                seeds.append(finder.seeds(codes))
            start, end = np.concatenate(first), np.concatenate(last)
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            keys = np.cumsum([0, *(k for n, k in counts for _ in range(n))])
            lines = pa.StructArray.from_arrays(
                [pa.array(start, pa.int32()), pa.array(end - start, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]),
                 pa.ListArray.from_arrays(pa.array(keys, pa.int32()), pa.array(np.concatenate(bands_of), pa.int64()))],
                ["start", "words", "h1", "h2", "bands"])
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *(a for a, _ in seeds)]), pa.int32()),
                                               pa.array(np.concatenate([none, *(x for _, x in seeds)]), pa.int64())], ["start", "hash"])
            ends_of = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(codes_of, pa.binary()),
                 pa.ListArray.from_arrays(ends_of(n for n, _ in counts), lines),
                 pa.ListArray.from_arrays(ends_of(len(a) for a, _ in seeds), flat)], ["doc_id", "n_words", "codes", "paragraphs", "seeds"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {UNITS}")


def verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (a, b) of one task's buckets: pairs of a bucket (of different sides, where the
    task compares two parts) whose exact Jaccard similarity reaches the threshold. Pairs
    that earlier links connect are skipped."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    codes = {n: c for n, c in zip(pdf["node"], pdf["codes"])}
    sets = Memo(lambda n: frozenset(shingles_of(np.frombuffer(codes[n], "<u4").astype(np.uint64)).tolist()), lambda n: True)
    out = []
    buckets: dict[int, tuple[list[int], list[int]]] = {}
    for key, side, node in zip(pdf["key"].tolist(), pdf["side"].tolist(), pdf["node"].tolist()):
        buckets.setdefault(key, ([], []))[side].append(node)
    for one, two in buckets.values():
        for i, a in enumerate(one):
            for b in two or one[i + 1:]:
                if a != b and find(a) != find(b):
                    x, y = sets[a], sets[b]
                    if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                        both = len(x & y)
                        if both >= threshold * (len(x) + len(y) - both):
                            root[find(a)] = find(b)
                            out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def part_of(codes: str, start, words):
    """The codes of a range of words."""
    return F.col(codes).substr(start * 4 + 1, words * 4)


def near_links(base: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Verified links between nodes (h1) of lines (row, start, words, h1, bands) that collide
    in a key; ``base`` has the codes of rows."""
    keyed = lines.select(F.col("h1").alias("node"), F.explode("bands").alias("key"))
    # Buckets of two nodes or more; equal lines are combined before the shuffle.
    many = save(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                .filter("low < high").select("key"), "passage-buckets")
    members = save(keyed.join(sized(many), "key").distinct(), "passage-members")
    # Near lines collide in most bands: of buckets with the same nodes (their number and two 64-bit
    # digests of the set) one is compared.
    digest = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    alike = members.groupBy("key").agg(F.count("*").alias("n"), digest(1).alias("x"), digest(2).alias("y"))
    chosen = alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = save(members.join(chosen, "key"), "passage-buckets-of-nodes")
    # The codes of one line of each such node; the others hold the same words.
    wanted = (lines.join(sized(save(members.select(F.col("node").alias("h1")).distinct(), "passage-nodes")), "h1", "left_semi")
              .groupBy(F.col("h1").alias("node")).agg(F.min(F.struct("h2", "row", "start", "words")).alias("at")).select("node", "at.*"))
    codes = save(wanted.join(base.select("row", "codes"), "row")
                 .select("node", part_of("codes", F.col("start"), F.col("words")).alias("codes")), "passage-codes")
    shards = max(1, members.count() // 1000)
    parts = F.ceil(F.col("n") / BUCKET)
    part = F.pmod(F.xxhash64("node"), parts)
    small = F.array(F.struct(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")))
    large = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(
        F.col("key").alias("shard"), F.least(p, part).alias("i"), F.greatest(p, part).alias("j"), F.when(p < part, 1).otherwise(0).alias("side")))
    tasks = members.select("node", "key", F.explode(F.when(F.col("n") > BUCKET, large).otherwise(small)).alias("t"))
    return (tasks.join(codes, "node").select("node", "key", "codes", "t.*").groupBy("shard", "i", "j")
            .applyInPandas(lambda pdf: verified(pdf, threshold), "a bigint, b bigint"))


def chains(links: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Common seeds (start here, start there) in runs that may be one passage."""
    out: list[list[tuple[int, int]]] = []
    for a, b in sorted(links):
        for run in out[:-5:-1]:
            x, y = run[-1]
            if a - x <= CHAIN_GAP and 0 < b - y <= CHAIN_GAP and abs((a - x) - (b - y)) <= CHAIN_DRIFT:
                run.append((a, b))
                break
        else:
            out.append([(a, b)])
    return out


# Words that an edit takes on both sides: the fewest first, and about as many on each.
SKIPS = sorted(((a, b) for a in range(EDIT + 1) for b in range(EDIT + 1) if a + b), key=lambda s: (s[0] + s[1], abs(s[0] - s[1]), s))


def followed(x: np.ndarray, y: np.ndarray, i: int, j: int, step: int) -> list[tuple[int, int]]:
    """From place i of x and j of y on (``step`` 1) or back (-1): where equal words end, and
    further on, over each edit, where those after it end."""
    x, y, i, j = (x[::-1], y[::-1], len(x) - i, len(y) - j) if step < 0 else (x, y, i, j)
    ends = []
    while True:
        n = min(len(x) - i, len(y) - j)
        differ = np.nonzero(x[i:i + n] != y[j:j + n])[0]
        n = int(differ[0]) if len(differ) else n
        i, j = i + n, j + n
        ends.append((i, j))
        u, v = x[i:i + EDIT + RESUME].tolist(), y[j:j + EDIT + RESUME].tolist()
        for a, b in SKIPS:
            if a + RESUME <= len(u) and u[a:a + RESUME] == v[b:b + RESUME]:
                break
        else:
            return [(len(x) - a, len(y) - b) if step < 0 else (a, b) for a, b in ends]
        i, j = i + a, j + b


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    a, b = (set(shingles_of(z.astype(np.uint64)).tolist()) for z in (x, y))
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both) > 0


def aligned(x: np.ndarray, y: np.ndarray, links: list[tuple[int, int]], least: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """Passages (start, end, start there, end there) of x that y has, too, around common seeds."""
    out: list[tuple[int, int, int, int]] = []
    for run in chains(links):
        if any(a <= run[0][0] and run[-1][0] + SEED <= b and c <= run[0][1] <= d for a, b, c, d in out):
            continue
        left = followed(x, y, *run[0], -1)
        right = followed(x, y, run[-1][0] + SEED, run[-1][1] + SEED, 1)
        # The widest range that is similar enough; then narrower ones, down to the equal words
        # next to the outermost seeds.
        tries = [(a, b, c, d) for k in range(max(len(left), len(right)), 0, -1)
                 for (a, c), (b, d) in [(left[min(k, len(left)) - 1], right[min(k, len(right)) - 1])]]
        found = next((t for t in tries if t[1] - t[0] >= least and (np.array_equal(x[t[0]:t[1]], y[t[2]:t[3]])
                                                                    or similar(x[t[0]:t[1]], y[t[2]:t[3]], threshold))), None)
        if found:
            out.append(found)
            continue
        for a, b in run:  # equal parts
            (l, m), (r, s) = followed(x, y, a, b, -1)[0], followed(x, y, a + SEED, b + SEED, 1)[0]
            if r - l >= least:
                out.append((l, r, m, s))
    return sorted(set(out))


def common_passages(base: DataFrame, least: int, threshold: float) -> DataFrame:
    """(row, doc_id, start, end, keep_row, keep_id, keep_start, keep_end): passages around seeds
    that documents share with the keeper of the seed."""
    ready(base.sparkSession)
    known = base.filter("doc_id IS NOT NULL")
    seeds = known.select("doc_id", "row", F.explode("seeds").alias("s")).select("doc_id", "row", "s.*")
    kept = save(seeds.groupBy("hash").agg(F.min(F.struct("doc_id", "row", "start")).alias("k"), F.max("doc_id").alias("last"))
                .filter("k.doc_id < last").select("hash", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), F.col("k.start").alias("keep_start")), "passage-seeds")
    pairs = save(seeds.join(kept, "hash").filter("doc_id <> keep_id").groupBy("row", "doc_id", "keep_row", "keep_id").agg(
        F.collect_list(F.struct("start", "keep_start")).alias("links")), "passage-pairs")  # at most a text's seeds

    def window(start: str, codes: str):
        low = F.greatest(F.array_min(F.transform("links", lambda x: x[start])) - REACH, F.lit(0))
        high = F.array_max(F.transform("links", lambda x: x[start])) + SEED + REACH
        return low, part_of(codes, low, high - low)
    codes = base.select(F.col("row").alias("of"), "codes")
    for name, start, key in (("there", "keep_start", "keep_row"), ("here", "start", "row")):
        low, part = window(start, "codes")
        pairs = pairs.join(codes, F.col(key) == F.col("of")).select(*pairs.columns, low.alias(f"low_{name}"), part.alias(f"codes_{name}"))
    ids, kind = ["row", "doc_id", "keep_row", "keep_id"], base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, spans = [], []
            cols = [b.column(c).to_pylist() for c in ("links", "low_here", "codes_here", "low_there", "codes_there")]
            for i, (links, p, x, q, y) in enumerate(zip(*cols)):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                for a, e, c, d in aligned(x, y, [(r["start"] - p, r["keep_start"] - q) for r in links], least, threshold):
                    of.append(i)
                    spans.append((a + p, e + p, c + q, d + q))
            at = pa.array(of, pa.int32())
            ends = [pa.array(c, pa.int32()) for c in zip(*spans)] or [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ids), *ends], [*ids, "start", "end", "keep_start", "keep_end"])
    return pairs.mapInArrow(run, f"row bigint, doc_id {kind}, keep_row bigint, keep_id {kind}, start int, end int, keep_start int, keep_end int")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST,
             threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of all rows, and the repeated ranges of words: (row, doc_id, start,
    end, keep_id), where keep_id is the document that keeps the passage."""
    bands, rows = tune_bands(threshold)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = save(units(source, bands, rows).withColumn("row", F.monotonically_increasing_id()), "passage-units")
    lines = base.filter("doc_id IS NOT NULL").select("row", "doc_id", F.explode("paragraphs").alias("p")).select("row", "doc_id", "p.*")
    roots = save(components(save(near_links(base, lines, threshold), "passage-links")), "passage-roots")
    own = lines.select("row", "doc_id", "start", "words", "h1", "h2")
    near = save(own.join(sized(roots), F.col("h1") == F.col("node")).drop("node"), "passage-near")
    # A node is half a digest. Of lines with the same half and another rest only the least digest's
    # are meant, whose codes were compared.
    halves = near.groupBy("h1").agg(F.min("h2").alias("h2"))
    near = near.join(halves, ["h1", "h2"])
    keep = near.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).filter("keep_id < last").drop("last")
    equal = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).filter("keep_id < last").drop("last")
    equal = save(equal.join(sized(roots), F.col("h1") == F.col("node"), "left_anti"), "passage-equal")
    span = ["row", "doc_id", "start", (F.col("start") + F.col("words")).alias("end"), "keep_id"]
    whole = near.join(keep, "root").select(span).unionByName(own.join(equal, ["h1", "h2"]).select(span))
    inside = save(common_passages(base, least, threshold), "passage-inside")
    lost = inside.select("row", "doc_id", "start", "end", "keep_id")
    held = inside.select(F.col("keep_row").alias("row"), F.col("keep_id").alias("doc_id"), F.col("keep_start").alias("start"), F.col("keep_end").alias("end"), "keep_id")
    return base.select("row", "doc_id", "n_words"), whole.unionByName(lost).unionByName(held.distinct())


def merged(spans: DataFrame) -> DataFrame:
    """Ranges (row, start, end) with those that overlap or touch joined."""
    before = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.distinct().withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = opens.withColumn("n", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("n")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, repeated_words (in passages that
    other documents have too), removed_words (of these, in passages that another document
    keeps), removed (their ranges of words, start:end joined by commas) and keep_ids (the
    documents that keep them)."""
    rows, again = passages(docs, id_col, text_col, **options)
    again = save(again, "passage-ranges")
    size = F.sum(F.col("end") - F.col("start")).cast("long")
    every = merged(again.select("row", "start", "end")).groupBy("row").agg(size.alias("repeated_words"))
    gone = again.filter("doc_id > keep_id")
    ranges = merged(gone.select("row", "start", "end")).groupBy("row").agg(  # at most as many as a text has units
        size.alias("removed_words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    keepers = gone.groupBy("row").agg(F.sort_array(F.collect_set("keep_id")).alias("keep_ids"))
    each = every.join(ranges, "row", "left").join(keepers, "row", "left")
    none = F.lit(0).cast("long")
    return rows.join(each, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("repeated_words", none).alias("repeated_words"),
        F.coalesce("removed_words", none).alias("removed_words"),
        F.coalesce(F.array_join(F.transform("ranges", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("removed"),
        F.coalesce("keep_ids", F.array().cast(keepers.schema["keep_ids"].dataType)).alias("keep_ids"))
