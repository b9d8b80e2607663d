"""Quality classifier by hierarchical empirical Bayes.

1. Document evidence: each metric of a text (shares of symbols, repeats, capitals, ...) falls
   into a cell; over all labelled rows, Spark counts cells by label, and a text's evidence is
   the sum of the smoothed log ratios of its cells, damped because metrics overlap.
2. Site evidence: good and bad rows are summed by path (host and section) and by host, a
   labelled row as 1, an unlabelled one as ``SOFT`` split by its evidence. Sums are combined
   before the shuffle, so a hot host is one row from each task.
3. Shrinkage: the spread between hosts beyond chance (method of moments) gives the strength
   of the global prior; a host's posterior mean is pulled to the global mean by it, a path's
   to its host's posterior by the strength between paths. Sites with few rows stay near the
   level above.
4. A document's posterior odds are its evidence times the odds of its path.

``documents`` has no address; the query takes ``source`` for the host and ``lang`` for the
section below it.

Cases: null text = empty text; a null host or section is a site ''; null labels are no
labels, and labels of one id that contradict each other count as bad; without labels of
both kinds the evidence is 0 and every score is the prior 0.5; repeated rows and ties score
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm import rules
from souk.llm.common import save, sized

CELLS = 40  # cells of a metric's range
DAMP = 0.5
SOFT = 0.25  # what an unlabelled row counts for in its site
LIMIT = 20.0  # of the evidence's log odds
THRESHOLD = 0.5


def cells() -> dict[str, Column]:
    """The cell of each metric, from the counts of a text."""
    own = rules.metrics() | {"length": F.least(F.log2(F.col("n_words") + 1) / 20, F.lit(1.0))}
    return {m: F.least(F.ceil(c * CELLS), F.lit(CELLS)).cast("int") for m, c in own.items()}


def log_ratios(labelled: DataFrame) -> dict[str, list[float]]:
    """For each metric the log ratio, good to bad, of every cell, from rows (good, cells).
    The counts are at most metrics x (CELLS + 1) rows."""
    names = list(cells())
    counted = labelled.select("good", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).alias("cell")) for m in names))).alias("x"))
    rows = counted.groupBy("x.m", "x.cell").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")).collect()
    at = {(r["m"], r["cell"]): (r["g"], r["b"]) for r in rows}
    good = {m: sum(g for (k, _), (g, _) in at.items() if k == m) for m in names}
    bad = {m: sum(b for (k, _), (_, b) in at.items() if k == m) for m in names}
    def ratio(m: str, cell: int) -> float:
        g, b = at.get((m, cell), (0, 0))
        if not good[m] or not bad[m]:
            return 0.0
        # Smoothed towards no evidence: a cell's rows next to one row spread as the whole is.
        whole = good[m] + bad[m]
        return math.log((g + good[m] / whole) / good[m]) - math.log((b + bad[m] / whole) / bad[m])
    return {m: [ratio(m, c) for c in range(CELLS + 1)] for m in names}


def shrunk(sites: DataFrame, own: str, least: float = 0.5, most: float = 1000.0) -> Column:
    """Strength of the prior of sites (good, rows, prior mean ``own``), by the method of
    moments: prior variance is what squared deviations hold beyond binomial noise."""
    m = F.col(own)
    moved = sites.filter("rows > 0").agg(
        F.sum(F.col("rows") * F.pow(F.col("good") / F.col("rows") - m, 2)).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("rows") * m * (1 - m)).alias("whole"),
        F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if not moved["n"] or moved["rows"] <= moved["n"] or not moved["whole"]:
        return F.lit(most)
    # E(spread) = noise + (1 / (strength + 1)) * (whole - noise)
    share = (moved["spread"] - moved["noise"]) / max(1e-9, moved["whole"] - moved["noise"])
    return F.lit(min(most, max(least, 1 / share - 1)) if share > 0 else most)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", section_col: str = "lang") -> DataFrame:
    """(doc_id, host, section, evidence, host_posterior, path_posterior, score, predicted) for
    every row of ``docs``; evidence is in log odds, predicted is 1 for good."""
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), site(host_col).alias("host"), site(section_col).alias("section"), F.col(text_col).alias("text"))
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality") == 1).alias("good"))
    names = list(cells())
    rows = rules.features(source, {c: c for c in ("doc_id", "host", "section")})
    rows = save(rows.select("doc_id", "host", "section", *(c.alias(m) for m, c in cells().items())).join(known, "doc_id", "left"), "quality-rows")
    ratios = log_ratios(rows.filter("good IS NOT NULL"))
    total = F.lit(0.0)
    for m in names:
        total = total + F.get(F.array(*map(F.lit, ratios[m])), F.col(m))
    evidence = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), DAMP * total))
    share = rows.agg(F.avg(F.col("good").cast("int"))).first()[0]
    mean = min(0.99, max(0.01, share)) if share is not None else 0.5
    soft = 1 / (1 + F.exp(-(F.col("evidence") + math.log(mean / (1 - mean)))))
    weight = F.when(F.col("good").isNull(), SOFT).otherwise(1.0)
    rows = rows.withColumn("evidence", evidence)
    paths = save(rows.groupBy("host", "section").agg(
        F.sum(weight * F.coalesce(F.col("good").cast("double"), soft)).alias("good"), F.sum(weight).alias("rows")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("rows").alias("rows"))
    top = hosts.agg(F.sum("good"), F.sum("rows")).first()
    all_mean = (top[0] + 1) / (top[1] + 2) if top[1] else 0.5
    hosts = hosts.withColumn("prior", F.lit(all_mean))
    k = shrunk(hosts, "prior")
    hosts = save(hosts.select("host", ((k * F.col("prior") + F.col("good")) / (k + F.col("rows"))).alias("host_posterior")), "quality-hosts")
    paths = paths.join(hosts, "host")
    k = shrunk(paths, "host_posterior")
    paths = save(paths.select("host", "section", "host_posterior", ((k * F.col("host_posterior") + F.col("good")) / (k + F.col("rows"))).alias("path_posterior")), "quality-sites")
    odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) if share is not None else F.lit(0.0)
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    return (rows.join(sized(paths, 100_000), ["host", "section"]).withColumn("score", score)
            .select("doc_id", "host", "section", "evidence", "host_posterior", "path_posterior", "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
