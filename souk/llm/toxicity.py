"""Toxicity by subword bags.

A word is the bag of its character n-grams and itself, each hashed to a bucket with an
embedding; a text is the mean over its words (and a few neutral ones) of the means over their bags, and a linear
softmax on that mean tells toxic from clean. Embeddings and softmax are trained jointly in
numpy, so an unseen spelling of a word shares most of its vectors. As all of it is linear, a
trained model is one number for each bucket (the embedding's part of the two classes'
difference) and a bias, and a word's part of the score is found once for each spelling.

Of a word that occurs k times, the root of k counts, so that a text that repeats one odd
word isn't judged by it alone.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE`` of each class, chosen by
a hash of the id; scoring reads every whole text.

Cases: null text = empty text, which gets the bias alone; labels that are null are skipped;
labels for one id that contradict each other count as toxic; without labels of both classes
the score is the smoothed share of toxic labels; null ids are scored and, by remainder,
never held out; repeated rows are scored alike, and of several texts under one id the least
is trained on; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import map_texts, ready

SAMPLE = 2500  # labelled documents of each class to fit on, at most
BUCKETS = 1 << 18
GRAMS = (3, 6)  # from, to
PRIME = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 20_000  # words whose n-grams are hashed at once
DIM = 8
STEPS = 600
BATCH = 64
RATE = 0.2
LEAST_TEXTS = 8
SCALE = 100.0  # toxic words are few in a text: means are small
NEUTRAL = 50  # words without a say that each mean takes in: a single word doesn't make a short text toxic
THRESHOLD = 0.7


def letters(word: bytes) -> str:
    """A word in lower case and without what is no letter; without letters it stays."""
    text = word.decode(errors="replace").lower()
    return text if text.isalpha() else "".join(filter(str.isalpha, text)) or text


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the n-grams of all words, the word of each, and their number by word.
    The words stand between marks in one array of code points; an n-gram's hash grows
    from the one of n - 1 at the same place."""
    marked = [f"<{letters(w)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # to the end of the word
    hashed = np.zeros(len(codes), np.uint64)
    found = [np.array([zlib.crc32(w.encode()) % BUCKETS for w in marked], np.int64)]
    of = [np.arange(len(words))]
    for n in range(1, min(GRAMS[-1], len(codes)) + 1):
        hashed[:len(codes) - n + 1] = hashed[:len(codes) - n + 1] * PRIME + codes[n - 1:]
        if n >= GRAMS[0]:
            there = np.nonzero(left >= n)[0]
            found.append(((hashed[there] * PRIME) >> np.uint64(32)).astype(np.int64) % BUCKETS)
            of.append(word[there])
    return np.concatenate(found), np.concatenate(of), 1 + sum(np.maximum(sizes - n + 1, 0) for n in range(GRAMS[0], GRAMS[-1] + 1))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights): a text's mean over words of means over buckets."""
    words = Counter(text.split())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    found, of, sizes = grams(list(words))
    times = np.sqrt(np.fromiter(words.values(), np.float64, len(words)))
    own, where = np.unique(found, return_inverse=True)
    weight = np.bincount(where, (SCALE * times / (sizes * (times.sum() + NEUTRAL)))[of])
    return own, weight.astype(np.float32)


def fit(texts: list[bytes], toxic: np.ndarray, steps: int = STEPS, seed: int = 7) -> tuple[float, np.ndarray]:
    """(bias, one number for each bucket) of the log odds of a toxic text. Every step takes
    as many toxic as clean texts, drawn in turn, by Adagrad."""
    y = np.asarray(toxic, np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
        return (math.log(share / (1 - share)) if 0 < share < 1 else -30.0), np.zeros(BUCKETS, np.float32)
    bags = [bag(t) for t in texts]
    rng = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS, DIM), np.float32)  # a bucket that no text trains says nothing
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    base = np.zeros(2, np.float32)
    g_embed, g_soft, g_base = np.full(BUCKETS, 1e-4, np.float32), np.full_like(soft, 1e-4), np.full(2, 1e-4, np.float32)
    # Buckets of a few texts only say which text it is: they stay at zero.
    texts_of = np.bincount(np.concatenate([b for b, _ in bags]), minlength=BUCKETS)
    trained = texts_of >= LEAST_TEXTS
    bags = [(b[trained[b]], w[trained[b]]) for b, w in bags]
    sides = [np.nonzero(y == c)[0] for c in (0, 1)]
    turns = [np.concatenate([rng.permutation(s) for _ in range(-(-steps * BATCH // 2 // len(s)))]) for s in sides]
    for step in range(steps):
        rows = np.concatenate([t[step * BATCH // 2:(step + 1) * BATCH // 2] for t in turns])
        sizes = [len(bags[r][0]) for r in rows]
        of = np.concatenate([bags[r][0] for r in rows])
        weight = np.concatenate([bags[r][1] for r in rows])
        row = np.repeat(np.arange(len(rows)), sizes)
        used, place = np.unique(of, return_inverse=True)
        mean = np.stack([np.bincount(row, weight * embed[of, d], len(rows)) for d in range(DIM)], 1).astype(np.float32)
        z = mean @ soft + base
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p /= len(rows)
        back = p @ soft.T
        d_embed = np.stack([np.bincount(place, weight * back[row, d], len(used)) for d in range(DIM)], 1).astype(np.float32)
        d_soft, d_base = mean.T @ p, p.sum(0)
        g_embed[used] += (d_embed ** 2).mean(1)
        g_soft += d_soft ** 2
        g_base += d_base ** 2
        embed[used] -= RATE * d_embed / np.sqrt(g_embed[used])[:, None]
        soft -= RATE * d_soft / np.sqrt(g_soft)
        base -= RATE * d_base / np.sqrt(g_base)
    side = soft[:, 1] - soft[:, 0]
    return float(base[1] - base[0]), (SCALE * (embed @ side)).astype(np.float32)


def scores(texts: list[bytes], bias: float, weights: np.ndarray) -> list[float]:
    """Scores of texts by a fitted model; each spelling among them is looked at once."""
    counted = [Counter(t.split()) for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(counted)))}
    words = list(place)
    part = np.zeros(len(words))
    for at in range(0, len(words), CHUNK):
        found, of, sizes = grams(words[at:at + CHUNK])
        part[at:at + CHUNK] = np.bincount(of, weights[found], len(sizes)) / sizes
    out = []
    for c in counted:
        own = part[np.fromiter(map(place.__getitem__, c), np.int64, len(c))]
        times = np.sqrt(np.fromiter(c.values(), np.float64, len(c)))
        out.append(_share(bias + float(own @ times) / (float(times.sum()) + NEUTRAL)))
    return out


def _share(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """A model fitted, in one task, on at most ``sample`` labelled rows of each class that
    aren't held out, those with the least hashes of their ids."""
    ready(docs.sparkSession)
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("all", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        bias, weights = fit([t.encode() for t in pdf["text"]], pdf["toxic"].to_numpy())
        return pd.DataFrame({"bias": [bias], "weights": [weights.astype("<f4").tobytes()]})
    model = rows.groupBy("all").applyInPandas(run, "bias double, weights binary").collect()  # one row of a MB
    if not model:
        return fit([], np.zeros(0))
    return model[0]["bias"], np.frombuffer(model[0]["weights"], "<f4")


def score_documents(docs: DataFrame, model: tuple[float, np.ndarray], keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a MB, whatever the input
    return map_texts(docs, text_col, keep, "score double",
                     lambda texts: [pa.array(scores(texts, *shared.value), pa.float64())])


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    source = docs.select("doc_id", "text")
    scored = score_documents(source, train(source, labels, sample), {"doc_id": "doc_id"})
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
