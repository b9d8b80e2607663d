"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from souk.llm import sharding
from souk.llm.resample import BUCKETS, LEAST_WORDS, PERCENT, SEED
from souk.llm.rules import DELTA, FIT, LEVELS, RISK, STEPS
from souk.llm.secrets import BASE, RULES
from souk.llm.sharding import SHARDS

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (
  SELECT *, length(regexp_replace(role, '<(\\*)(/turn|turn|text|next)>', '<\\\1\2>', 'g')) AS role_len,
    length(regexp_replace(text, '<(\\*)(/turn|turn|text|next)>', '<\\\1\2>', 'g')) AS text_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + CASE WHEN same THEN 6 ELSE role_len + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256,
  CAST(0 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS chain
FROM d JOIN g USING (text)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op8() -> str:
    """Places of matches from the lengths of the texts between them."""
    parts = []
    for i, r in enumerate(RULES):
        p = _quoted(r.pattern)
        parts.append(f"""
SELECT doc_id, {i} AS o, {_quoted(r.kind)} AS kind, unnest(list_transform(range(1, len(hit) + 1), lambda k:
    {{'s': list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0),
      'n': length(hit[k]), 'part': length(part[k])}})) AS m, {r.least} AS least
FROM (SELECT doc_id, string_split_regex(text, {p}) AS gap, regexp_extract_all(text, {p}) AS hit,
        regexp_extract_all(text, {p}, {r.group}) AS part FROM d)""")
    counts = ", ".join(f"count(s.doc_id) FILTER (WHERE kind = {_quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    label = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, o, kind, CAST(m.s AS BIGINT) AS a, CAST(m.s + m.n AS BIGINT) AS b
      FROM ({' UNION ALL '.join(parts)}) WHERE m.part >= least)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({label}, ',' ORDER BY a, o, b) FILTER (WHERE o < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({label}, ',' ORDER BY a, o, b), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def _op6() -> str:
    """Counts; levels of cells from the rows that learn; then cutoffs on the others: one is safe
    if so few good holdouts beyond it are unlikely (at most delta over the number of strata)
    were the share at the limit; the safe ones reach from the mildest to the first that isn't."""
    whole = {"symbols": "least(n_symbols / words, 1.0)", "marks": "least(n_marks / words, 1.0)",
             "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / words", "capitals": "n_upper / words",
             "long_words": "least(greatest(word_chars / words - 5, 0.0) / 15, 1.0)",
             "short_words": "least(greatest(5 - word_chars / words, 0.0) / 5, 1.0)"}
    limit = f"CAST({RISK} AS DOUBLE)"
    cells = ", ".join(f"{{'metric': '{m}', 'cell': CAST(ceil(CAST({x} AS DOUBLE) * {STEPS}) AS INT)}}" for m, x in whole.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
per_word AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) AS n_symbols,
         sum(length(regexp_replace(word, '[^#*$%&|<>!]', '', 'g'))) AS n_marks,
         count(*) FILTER (WHERE regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]') AND strlen(word) > 1) AS n_upper
  FROM w GROUP BY r),
triples AS (
  SELECT a.r, a.pos, count(*) OVER (PARTITION BY a.r, a.word, b.word, c.word) AS times
  FROM w a JOIN w b ON b.r = a.r AND b.pos = a.pos + 1 JOIN w c ON c.r = a.r AND c.pos = a.pos + 2),
again AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM triples, range(3) x(k) WHERE times > 1 GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (
  SELECT d.r, doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_marks, 0) AS n_marks, coalesce(n_upper, 0) AS n_upper, coalesce(n_lines, 0) AS n_lines,
         greatest(coalesce(n_words, 0), 1) AS words
  FROM d LEFT JOIN per_word USING (r) LEFT JOIN again USING (r) LEFT JOIN lines USING (r)),
x AS (
  SELECT r, doc_id, stratum, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, unnest([{cells}], recursive := true) FROM f),
known AS (SELECT doc_id, min(coalesce(quality = 1, false)) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (
  SELECT x.*, good, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {FIT} = 0 AS fits
  FROM x JOIN known USING (doc_id) WHERE NOT base_failed),
fitted AS (
  SELECT metric, cell, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM labelled WHERE fits GROUP BY ALL),
beyond AS (
  SELECT metric, c, coalesce(sum(g) FILTER (WHERE cell >= c), 0) AS g, coalesce(sum(b) FILTER (WHERE cell >= c), 0) AS b,
         sum(g) AS all_g, sum(b) AS all_b
  FROM range(0, {STEPS + 1}) t(c), fitted GROUP BY metric, c),
levels AS (
  SELECT metric, c AS cell, max(CASE WHEN b = 0 THEN 0 ELSE greatest(0, least({LEVELS}, floor(10 * ln(
      ((b + 0.5::DOUBLE) / (all_b + 1.0::DOUBLE)) / ((g + 0.5::DOUBLE) / (all_g + 1.0::DOUBLE)))))) END) OVER (PARTITION BY metric ORDER BY c) AS level
  FROM beyond),
badness AS (SELECT r, max(coalesce(level, 0)) AS level FROM x LEFT JOIN levels USING (metric, cell) GROUP BY r),
held AS (
  SELECT stratum, level, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b
  FROM (SELECT DISTINCT r, stratum, good FROM labelled WHERE NOT fits) JOIN badness USING (r) GROUP BY ALL),
sizes AS (SELECT stratum, sum(g) AS n, sum(b) AS m FROM held GROUP BY ALL),
tried AS (
  SELECT stratum, c, n, m, coalesce(sum(g) FILTER (WHERE level >= c), 0) AS k, coalesce(sum(b) FILTER (WHERE level >= c), 0) AS j
  FROM range(1, {LEVELS + 1}) t(c), sizes JOIN held USING (stratum) GROUP BY ALL),
tested AS (
  SELECT *, bool_and(k < n AND k <= n * {limit} + 1 AND list_sum(list_transform(range(0, CAST(least(k, n * {limit} + 1) AS BIGINT) + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit}))))
      <= CAST({DELTA} AS DOUBLE) / (SELECT count(*) FROM sizes)) OVER (PARTITION BY stratum ORDER BY c DESC) AS safe
  FROM tried WHERE n > 0),
cut AS (
  SELECT stratum, arg_max(c, (j / m - k / n, c)) AS lowest
  FROM tested WHERE safe AND m > 0 AND j / m > k / n GROUP BY ALL),
bad AS (SELECT r FROM f JOIN badness USING (r) JOIN cut USING (stratum) WHERE level >= lowest)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r NOT IN (SELECT r FROM bad) AS kept, stratum
FROM f
"""


# The remainders of all bytes for CRC-32, by its rule, as one list t.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's bytes, where crc_table is in scope."""
    return (f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)")


def _op11() -> str:
    """Row by row: the least (cost, audit, repaired turns) for each state of the pattern."""
    some = lambda x, cost, edit, line="": f"{{'c': {x}.c + {cost}, 'a': {x}.a || {edit}, 't': {x}.t{line}}}"
    new = lambda x, role: some(x, 5, "'I'", f" || chr(10) || '{role}:'")
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    most = "{'c': 2000000000, 'a': '', 't': ''}"

    def grown(select: str, source: str) -> str:
        """``source`` with inserted turns: u, then a."""
        return (f"SELECT {select}, s0 AS i0, s1 AS i1, i2, least(s3, {new('i2', 'assistant')}) AS i3 FROM ("
                f"SELECT *, least(s2, {new('s0', 'user')}, {new('s1', 'user')}, {new('s3', 'user')}) AS i2 FROM {source})")

    def said(x: str, role: str) -> str:
        """The row kept, or given the role, after ``x``."""
        own = f"(c = '{role[0]}')"
        return (f"CASE WHEN ok THEN " + some(x, f"IF({own}, 0, 1) + cut", f"IF({own}, 'K', 'R')",
                f" || chr(10) || IF({own}, role, '{role}') || ':' || text") + f" ELSE {most} END")
    gone = lambda x: some(x, 2, "'D'")
    keep_s = "CASE WHEN ok AND c = 's' THEN " + some("i0", "cut", "'K'", " || chr(10) || role || ':' || text") + f" ELSE {most} END"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, IF(k = 4, 'user', role) AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
placed AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS c, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, nth,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM placed),
rated AS (SELECT *, fault IN (0, 3) AS ok, IF(fault = 3, 5, 0) AS cut FROM faulty),
run(conv_id, k, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {far}, {far}, {far} FROM conversations
  UNION ALL
  SELECT r.conv_id, i, {gone('i0')}, least({gone('i1')}, {keep_s}), least({gone('i2')}, {said('least(i0, i1, i3)', 'user')}),
         least({gone('i3')}, {said('i2', 'assistant')})
  FROM ({grown('conv_id, k', 'run')}) r JOIN rated ON rated.conv_id IS NOT DISTINCT FROM r.conv_id AND i = k + 1),
ended AS (SELECT conv_id, arg_max(least(i0, i3), k) AS best FROM ({grown('conv_id, k', 'run')}) GROUP BY conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE i > 1 AND (before || c) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rated GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN figures f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def _op12() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"unnest(regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"
    h = f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)"
    return f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, {words} FROM d),
x AS (SELECT {words} FROM benchmark),
buckets AS (SELECT word, {_crc32('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM w UNION SELECT word FROM x), crc_table),
s AS (SELECT bucket, count(*) AS s FROM w JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM x JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM w) + {BUCKETS}.0::DOUBLE)
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM x) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({h} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k, count(*) OVER () AS able FROM scored WHERE n >= {LEAST_WORDS})
SELECT doc_id, n AS n_features, weight, score, IF(k <= {PERCENT} * able // 100, k, NULL) AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def _op13() -> str:
    return f"""
WITH {CRC_TABLE},
b AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
             sha256('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled FROM documents, crc_table),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id NULLS FIRST, size, text_crc32) - 0.5::DOUBLE)
                / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST) - 1 AS place, count(*) OVER () // {SHARDS} AS q,
             count(*) OVER () % {SHARDS} AS m FROM f),
e AS (SELECT *, place < m * (q + 1) AS early, place - m * (q + 1) AS over, greatest(q, 1) AS least FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(IF(early, place // (q + 1), m + over // least) AS INTEGER) AS shard,
  CAST(IF(early, place % (q + 1), over % least) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM e
"""


ORACLE = {
    "op2_chat": OP2,
    "op6_quality_rules": _op6(),
    "op7_exact_dedup": OP7,
    "op8_secret_scan": _op8(),
    "op11_repair": _op11(),
    "op12_resample": _op12(),
    "op13_sharding": _op13(),
}
