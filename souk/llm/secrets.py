"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text.
The ledger (Parquet in a shared folder) holds one row for each blob and each batch of rule
versions it was scanned with, findings and their rule@version included, also where nothing was found. A scan takes
the blobs of the given paths, subtracts from all (blob, rule@version) pairs those in the
ledger, runs only what is left, each blob once however many paths hold it, appends to the
ledger, and joins the findings back to all paths.

Matches of a rule are leftmost and do not overlap. Their places follow from the text
between them: ``split`` and ``regexp_extract_all`` by one pattern give gaps and matches in
turn, whose lengths (code points) add up to the offsets, in time that grows with the
matches and the text, not with their squares.

Cases: null text = empty text, which has a blob like any other; null paths stay; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.arrays import before, let, parts
from souk.llm.common import numbered, save, scratch, sized, text_of

SPAN = "struct<kind:string,start:bigint,end:bigint>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java), then a match stays if ``group`` has ``least`` characters or more.
    ``hint``: a cheaper pattern that every text with a match also matches."""
    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# Base kinds. Greedy runs of at least n characters are the runs of one or more that are
# long enough, so n stands in the pattern of "access" and "hex"; in "assign" a short match
# uses up its text, so the length is tested after matching.
BASE = (
    Rule("assign", 1,
         r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
         r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"([Ww][Oo]?[Rr]?[Dd]|[Ee][Tt]|[Ee][Nn]|[Ee][Yy])" + r"""["']?\x20*[:=]""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
# Spans that this operator adds to the base kinds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
)
RULES = BASE + ADDED


def matches(text: Column, rule: Rule) -> Column:
    """The spans of one rule's matches in ``text``."""
    none = F.array().cast(f"array<{SPAN}>")
    pattern = F.lit(rule.pattern)
    found = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                     F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                     F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
                           F.length(x["part"]).alias("part")))

    def spans(all_found: Column) -> Column:
        sizes = F.transform(all_found, lambda x: (x["gap"] + F.coalesce(x["hit"], F.lit(0))).cast("long"))
        every = F.zip_with(all_found, before(sizes), lambda x, at: F.struct(
            F.lit(rule.kind).alias("kind"), (at + x["gap"]).alias("start"),
            (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("part")))
        # The last gap has no match after it: its part is null.
        return F.transform(F.filter(every, lambda x: x["part"] >= rule.least), lambda x: x.dropFields("part"))
    hint = F.contains(text, F.lit(rule.hint)) if rule.hint.replace("-", "").replace(" ", "").isalnum() else text.rlike(rule.hint)
    return F.when(hint, let(found, spans)).otherwise(none)


LEDGER = "blob binary, scanned array<string>, findings array<struct<kind:string,start:bigint,end:bigint,rule:string>>"


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared folder."""
    path = scratch(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan(docs: DataFrame, ledger: str, rules=RULES, path_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(path, blob, findings) for every row of ``docs`` (all versions of all paths), with the
    findings of ``rules``; the ledger is extended by the pairs that were unseen."""
    spark = docs.sparkSession
    ids = [r.id for r in rules]
    blob = F.unhex(F.sha2(text_of(text_col), 256))
    paths = save(docs.select(F.col(path_col).alias("path"), blob.alias("blob")), "secret-paths")
    # Unseen pairs, a row for each blob with the rules that are left for it.
    # Any path may stand for its blob; the smallest does. It may be there more than once.
    blobs = (paths.groupBy("blob", "path").agg(F.count("*").alias("n"))
             .groupBy("blob").agg(F.min(F.struct("path", "n")).alias("p")).select("blob", "p.path", "p.n"))
    seen = (spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("scanned").alias("rule"))
            .filter(F.col("rule").isin(ids)).groupBy("blob").agg(F.collect_set("rule").alias("seen")))
    wanted = F.array(*map(F.lit, ids))
    todo = save(blobs.join(seen, "blob", "left")
                .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
                .filter(F.size("todo") > 0).select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), "todo", "n"),
                "secret-todo")
    again = save(todo.filter("n > 1").select(F.col("__blob").alias("blob")), "secret-again")
    # The texts of those blobs: the rows that stand for one. If only few rows are copies or
    # seen, these are subtracted instead, so that texts need no shuffle.
    copies = save(paths.join(todo.select("__path", "__blob"),
                             paths["path"].eqNullSafe(todo["__path"]) & (paths["blob"] == todo["__blob"]),
                             "left_anti").distinct(), "secret-copies")
    texts = docs.select(F.col(path_col).alias("path"), text_of(text_col).alias("text"))
    same = lambda a, p, b: a["path"].eqNullSafe(p) & (F.unhex(F.sha2(a["text"], 256)) == b)
    if ledger_is_new(spark, ledger):
        lost = sized(copies)
        left = (texts.join(lost, same(texts, lost["path"], lost["blob"]), "left_anti")
                .select(F.unhex(F.sha2("text", 256)).alias("blob"), "text", wanted.alias("todo")))
    else:
        due = sized(todo)
        left = (texts.join(due, same(texts, due["__path"], due["__blob"]))
                .select(F.col("__blob").alias("blob"), "text", "todo"))
    if again.count():  # repeated rows of a path: one of them is scanned
        one = left.join(sized(again), "blob", "left_semi").dropDuplicates(["blob"])
        left = left.join(sized(again), "blob", "left_anti").unionByName(one)
    by = lambda r: lambda f: f.withField("rule", F.lit(r.id))
    runs = [F.transform(F.when(F.array_contains("todo", r.id), matches(F.col("text"), r)).otherwise(
        F.array().cast(f"array<{SPAN}>")), by(r)) for r in rules]
    (left.select("blob", F.col("todo").alias("scanned"), F.flatten(F.array(*runs)).alias("findings"))
     .write.mode("append").parquet(ledger))
    # Findings of the versions asked for. Rows of ledgers that don't name them: by the batch's.
    version = F.coalesce("f.rule", F.expr("filter(scanned, s -> startswith(s, concat(f.kind, '@')))[0]"))
    known = (spark.read.schema(LEDGER).parquet(ledger)
             .filter(F.size("findings") > 0)
             .select("blob", "scanned", F.explode(F.array_distinct("findings")).alias("f"))
             .filter(version.isin(ids)).select("blob", F.col("f").dropFields("rule").alias("f")).distinct()
             .groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings")))
    known = save(known, "secret-findings")
    return paths.join(sized(known, 50_000), "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def ledger_is_new(spark: SparkSession, ledger: str) -> bool:
    return spark.read.schema(LEDGER).parquet(ledger).limit(1).count() == 0


def ordered(findings: Column, rules=RULES) -> Column:
    """Spans by start, then kind in the order of ``rules``, then end."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    keyed = F.transform(findings, lambda f: F.struct(f["start"], order[f["kind"]].alias("order"), f["end"], f["kind"]))
    return F.transform(F.sort_array(keyed), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans, for every path."""
    base = [r.kind for r in BASE]
    spans = ordered(F.col("findings"))
    of = lambda kind: F.size(F.filter("spans", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), spans.alias("spans")).select(
        "doc_id", *map(of, base),
        F.sha2(joined(F.filter("spans", lambda f: f["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every found span, overlapping ones merged, replaced by ``mark``."""
    def cut(spans: Column) -> Column:
        reach = before(F.transform(spans, lambda f: f["end"]), F.greatest)  # the end of all spans before
        gaps = F.filter(F.zip_with(spans, reach, lambda f, at: F.struct(at.alias("start"), f["start"].alias("end"))),
                        lambda g: g["end"] >= g["start"])
        end = F.coalesce(F.array_max(F.transform(spans, lambda f: f["end"])), F.lit(0))
        return F.concat(F.array_join(F.transform(parts(text, gaps), lambda t: F.concat(t, F.lit(mark))), ""),
                        text.substr((end + 1).cast("int"), F.length(text)))
    return let(ordered(findings), cut)


def redact_documents(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
                     length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by a mark and ``length_col``, if there, following the
    new text. Findings belong to a text, so they are joined by its address."""
    found = save(scan(docs, ledger, rules, id_col, text_col).filter(F.size("findings") > 0)
                 .select("blob", "findings").dropDuplicates(["blob"]), "secret-found")
    rows, name = numbered(docs)
    text = name[text_col]
    out = rows.join(sized(found, 50_000), F.unhex(F.sha2(text_of(text), 256)) == F.col("blob"), "left")
    clean = F.col("findings").isNull()
    out = out.withColumn("new", F.when(clean, F.col(text)).otherwise(redacted(text_of(text), F.col("findings"))))
    cols = {text: F.col("new")}
    if length_col in name:
        size = name[length_col]
        cols[size] = F.when(clean, F.col(size)).otherwise(F.length("new").cast(rows.schema[size].dataType))
    return out.select(*(cols.get(c, F.col(c)) for c in rows.columns)).toDF(*docs.columns)
