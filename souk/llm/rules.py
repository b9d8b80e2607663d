"""Quality rules with risk-controlled thresholds.

Base rules reject short texts and texts that repeat themselves. Beyond them documents are
put in an order of badness, and a stratum rejects the worst ones as far as labelled holdouts
prove that few good documents go with them.

1. One labelled row in ``FIT``, chosen by a hash of its id, learns the order. For each metric
   (shares of symbols, repeated lines and repeated words, mean word length ...) and each cell
   of its range, the level is ten times the log of how much larger the share of bad rows
   beyond the cell is than that of good ones; a document's badness is the highest of its
   metrics' levels.
2. The other labelled rows calibrate. In each stratum the cutoffs are tested from the mildest
   level on: one is safe when the exact (Clopper-Pearson) upper bound of the share of good
   documents it rejects is at most ``risk``; testing stops at the first that fails
   (fixed-sequence testing, which needs no correction along the sequence). The order is
   fixed before these rows are looked at, so one sequence for a stratum spends the whole
   risk; across strata the error ``delta`` is divided by their number (Bonferroni).
3. Of the safe cutoffs the one is used that separates bad from good holdouts best. A stratum
   without enough labels gets no cutoff, so nothing is rejected there.

Cases: null text = empty text, which the base rules reject; null ids and repeated rows stay;
an empty table gives an empty result; labels that are null, or that contradict each other
for one id, count as not good; an empty label table leaves the base rules alone.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import map_texts, numbered, save, sized

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
SYMBOLS = b"#*$%&|<>"  # fixed values: the symbols that are counted
MARKS = b"#*$%&|<>!"
WHITE = b" \t\n\x0b\x0c\r"
STEPS = 200  # cells of a metric's range; a cutoff is a border between cells
LEVELS = 100  # of badness, beyond 0
FIT = 3
RISK, DELTA = 0.02, 0.05


def counts_of(text: bytes) -> tuple[int, ...]:
    """The counts COUNTS of one text in UTF-8."""
    words = text.split()  # on the six white characters of ASCII
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    bare = text.translate(None, WHITE)
    chars = len(bare.decode()) if not bare.isascii() else len(bare)
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    marks = len(bare) - len(bare.translate(None, MARKS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            many = {w for w, k in Counter(windows).items() if k > 1}
            end = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if w in many:
                    again += i + 3 - max(i, end)
                    end = i + 3
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return n, chars, symbols, len(lines) - len(set(lines)), again, len(lines), marks, upper


def _count_columns(texts: list[bytes]) -> list[pa.Array]:
    rows = [counts_of(t) for t in texts]
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]


def features(docs: DataFrame, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` ({column: new name}) and the counts for every row of ``docs``."""
    return map_texts(docs, text_col, keep, ", ".join(f"{c} bigint" for c in COUNTS), _count_columns)


def metrics() -> dict[str, Column]:
    """Metrics in [0, 1], high where a text is likely bad."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "symbols": F.least(F.col("n_symbols") / n, F.lit(1.0)),
        "marks": F.least(F.col("n_marks") / n, F.lit(1.0)),
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("n_upper") / n,
        "long_words": F.least(F.greatest(mean - 5, F.lit(0.0)) / 15, F.lit(1.0)),
        "short_words": F.least(F.greatest(5 - mean, F.lit(0.0)) / 5, F.lit(1.0)),
    }


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound for a share of which k of n are seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if binomial_cdf(k, n, p) > delta else (low, p)
    return high


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of the binomial distribution (n, p)."""
    if p <= 0 or p >= 1:
        return float(p <= 0)
    at = min(k, int((n + 1) * p))  # the largest term; the others relative to it, until they change nothing
    total = term = 1.0
    for i in range(at, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        if total + term == total:
            break
        total += term
    term = 1.0
    for i in range(at + 1, k + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        if total + term == total:
            break
        total += term
    log = math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1) + at * math.log(p) + (n - at) * math.log1p(-p)
    return min(1.0, math.exp(log) * total)


def safe_cutoff(good: dict[int, int], bad: dict[int, int], risk: float, delta: float, steps: int = STEPS) -> int | None:
    """Of the safe cutoffs c (rejecting the cells >= c), found by fixed-sequence testing from
    the mildest on, the one with the largest share of bad less share of good rejected (ties:
    the mildest); None if none is safe or none rejects a larger share of bad than of good."""
    n_good, n_bad = sum(good.values()), sum(bad.values())
    best, most, k, m = None, 0.0, 0, 0
    for c in range(steps, 0, -1):
        k, m = k + good.get(c, 0), m + bad.get(c, 0)
        if n_good == 0 or upper_bound(k, n_good, delta) > risk:
            break
        gain = m / n_bad - k / n_good if n_bad else 0.0
        if gain > most:
            best, most = c, gain
    return best


def levels_of(good: dict[int, int], bad: dict[int, int]) -> list[int]:
    """The level of each cell from the counts of good and bad rows by cell; levels never fall."""
    n_good, n_bad = sum(good.values()), sum(bad.values())
    g, b, out = 0, 0, []
    for c in range(STEPS, -1, -1):
        g, b = g + good.get(c, 0), b + bad.get(c, 0)
        ratio = ((b + 0.5) / (n_bad + 1.0)) / ((g + 0.5) / (n_good + 1.0))
        out.append(max(0, min(LEVELS, math.floor(10 * math.log(ratio)))) if b else 0)
    return list(accumulate(reversed(out), max))


def fits(id_col: Column) -> Column:
    """Whether a labelled row learns the order of badness (else it calibrates)."""
    return F.conv(F.substring(F.sha2(id_col.cast("string"), 256), 1, 8), 16, 10).cast("long") % FIT == 0


def badness(levels: dict[str, list[int]]) -> Column:
    """The highest level of a row's metrics."""
    return F.greatest(F.lit(0), *(F.element_at(F.lit(levels[m]), F.ceil(c * STEPS).cast("int") + 1) for m, c in metrics().items()))


def order_of_badness(rows: DataFrame) -> dict[str, list[int]]:
    """The levels of each metric's cells from rows (good, counts). The driver gets a count for
    each metric and cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.ceil(c * STEPS).cast("int").alias("cell"))
                                for m, c in metrics().items()))).alias("x")
    counted = rows.select("good", cells).groupBy("x.metric", "x.cell", "good").agg(F.count("*").alias("n")).collect()
    of = lambda m, good: {r["cell"]: r["n"] for r in counted if r["metric"] == m and r["good"] == good}
    return {m: levels_of(of(m, True), of(m, False)) for m in metrics()}


def cutoffs(rows: DataFrame, levels: dict[str, list[int]], risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff or null) from rows (stratum, good, counts): Spark counts rows by
    stratum and level, and calibrates the strata in groups of at most ``LEVELS`` counts."""
    counted = save(rows.groupBy("stratum", badness(levels).alias("level"))
                   .agg(F.sum(F.col("good").cast("long")).alias("n_good"),
                        F.sum((~F.col("good")).cast("long")).alias("n_bad")), "rule-levels")
    tests = max(1, counted.select("stratum").distinct().count())

    def calibrate(key, pdf):
        import pandas as pd
        cut = safe_cutoff(dict(zip(pdf.level, pdf.n_good)), dict(zip(pdf.level, pdf.n_bad)), risk, delta / tests, LEVELS)
        return pd.DataFrame({"stratum": [key[0]], "cutoff": [cut]}).astype({"cutoff": "float64"})
    return counted.groupBy("stratum").applyInPandas(calibrate, "stratum string, cutoff double")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _stratum(name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def learn(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[dict[str, list[int]], DataFrame]:
    """The order of badness, and the cutoffs (a row for each stratum with labels), from rows
    (doc_id, stratum, counts) and labels (doc_id, quality)."""
    known = labels.groupBy("doc_id").agg(
        F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good")).filter("doc_id IS NOT NULL")
    rows = save(feats.filter(~base_failed()).join(known, "doc_id"), "rule-holdouts")
    levels = order_of_badness(rows.filter(fits(F.col("doc_id"))))
    return levels, save(cutoffs(rows.filter(~fits(F.col("doc_id"))), levels, risk, delta), "rule-cutoffs")


def verdicts(feats: DataFrame, levels: dict[str, list[int]], limits: DataFrame) -> DataFrame:
    """``feats`` with base_failed and kept; ``limits`` has one row for each stratum."""
    over = F.coalesce(badness(levels) >= F.col("cutoff"), F.lit(False))
    return (feats.join(sized(limits, 10_000), "stratum", "left").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~over).drop("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str | None = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs``. Strata are the values of
    ``stratum_col`` (null: the stratum ''); without it all rows are one stratum."""
    source = docs.select(F.col(id_col).alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    feats = save(features(source, {"doc_id": "doc_id", "stratum": "stratum"}), "rule-features")
    return verdicts(feats, *learn(feats, labels, risk, delta)).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept", "stratum")


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stratum_col: str | None = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The kept rows of ``docs``, columns as they are. Cutoffs are learned on the labelled
    rows; the verdict is found beside each row, so nothing but cutoffs is joined."""
    source = docs.select(F.col(id_col).alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    ids = save(labels.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "rule-labelled")
    levels, limits = learn(features(source.join(sized(ids), "doc_id", "left_semi"), {"doc_id": "doc_id", "stratum": "stratum"}),
                           labels, risk, delta)
    rows, name = numbered(docs)
    feats = features(rows, {c: c for c in rows.columns}, name[text_col])
    stratum = _stratum(name[stratum_col] if stratum_col else None)
    out = verdicts(feats.withColumn("stratum", stratum), levels, limits).filter("kept")
    return out.select(*rows.columns).toDF(*docs.columns)
