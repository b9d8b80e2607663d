"""Repair of the structure of conversations, by bidirectional Dijkstra over the edit lattice.

A node of a conversation's lattice is (rows used, state); the states are those of the role
pattern ``(s?(ua)+)?``: nothing yet, after a system, user or assistant turn. Edges are edits:
keep a row (0), give it the role user or assistant (1), delete it (2), insert an empty turn
(5); rows that end without a mark cost 5 more unless deleted, blank and repeated rows can
only be deleted. From a node each edit leads to one other node at most.

1. Rows are sorted by (conversation, turn, role, text), dealt to tasks by ranges, and numbered;
   ``BLOCK`` numbers in a row are a block. So a hot conversation is many blocks, and a block
   holds many short conversations.
2. A conversation inside a block is solved there: two heaps grow from its start and from its
   ends until their least keys together exceed the best crossing, so that every crossing of
   least cost is finished; the edits are then read off from the start, always the
   ASCII-least that stays on a least path, which is the least concatenated audit.
3. The first and the last conversation of a block may go on in others. Such a piece is solved
   from each state to each; the pieces of a conversation are joined in order, for each state
   by the least (cost, audit). Two audits of one piece and cost that end in one state use
   the same number of rows, so neither is the beginning of the other and the lesser stays the
   lesser whatever follows. The rows of such conversations are then joined with their edits.

Cases: nulls in role, text and the key of the damage count as one space; a null conv_id is a
conversation of its own; null turns sort first; rows of one turn sort by role, then text;
repeated rows stay and are duplicates; a conversation without rows has an empty audit; an
empty table gives an empty result; other columns are ignored. A conversation's audit is one
string, so one task holds as many bytes as it has turns, and sixteen times that where it is
longer than a block; texts are never held for more than a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from souk.llm.common import ready, save

BLOCK = 4096  # rows; divides 2^33, so blocks don't cross tasks
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # fixed values: the costs of edits
WHITE = " \t\n\x0b\x0c\r"
NEXT = (2, 2, 3, 2)  # the state after the user or assistant turn that may follow
STATES = range(4)
# The states before a turn of a role, and the state after it.
INTO = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}


def blank(name: str) -> Column:
    """A column as a string; null counts as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows with faults put in by a hash of their key;
    dropped rows stay as marks with ``gone``."""
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = blank("text")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
                       (k == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def intact(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as they are, in the columns of ``damage``."""
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.lit(False).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated, 4 a row that is gone."""
    bare = F.rtrim("text", F.lit(WHITE))
    same = Window.partitionBy("conv_id", "gone", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    return rows.withColumn("again", F.row_number().over(same) > 1).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("gone"), 4).when(F.length(bare) == 0, 1).when(F.col("again"), 2)
        .when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"))


def code(role: str, fault: int) -> str:
    """A row as one letter: its role's initial (x: another), a capital if it is truncated, and
    "-" if it must be deleted."""
    if fault in (1, 2):
        return "-"
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return c.upper() if fault == 3 else c


def edits(c: str, q: int) -> list[tuple[str, int, int]]:
    """Edits (initial, cost, state after) that use a row with code ``c`` in state ``q``."""
    out = [("D", DELETE, q)]
    if c != "-":
        more = CUT if c.isupper() else 0
        before, after = INTO.get(c.lower(), ((), 0))
        if q in before:
            out.append(("K", KEEP + more, after))
        out.append(("R", REROLE + more, NEXT[q]))
    return out


def back_edits(c: str, q: int) -> list[tuple[int, int]]:
    """(cost, state before) of the edits that use a row with code ``c`` and end in ``q``."""
    out = [(DELETE, q)]
    if c != "-":
        more = CUT if c.isupper() else 0
        before, after = INTO.get(c.lower(), ((), 0))
        if q == after:
            out += [(KEEP + more, p) for p in before]
        out += [(REROLE + more, p) for p in STATES if NEXT[p] == q]
    return out


def solve(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows with these codes from the state ``start``
    to one of ``ends``, the ASCII-least audit among them; None if there is no way."""
    return _solve_short(codes, start, ends) if len(codes) <= 64 else _solve(codes, start, ends)


def _solve(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    n, none = len(codes), 1 << 60
    ahead, behind = {(0, start): 0}, {(n, q): 0 for q in ends}  # costs from the start, to an end
    heaps = [[(0, 0, start)], [(0, -n, q) for q in ends]]
    heapq.heapify(heaps[1])
    done: tuple[set, set] = (set(), set())
    best = none
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, q = heapq.heappop(heaps[side])
        i = abs(i)
        if (i, q) in done[side]:
            continue
        done[side].add((i, q))
        own, other = (ahead, behind) if side == 0 else (behind, ahead)
        best = min(best, cost + other.get((i, q), none))
        if side == 0:
            near = [(i, NEXT[q], INSERT)] + ([(i + 1, p, c) for _, c, p in edits(codes[i], q)] if i < n else [])
        else:
            near = [(i, p, INSERT) for p in STATES if NEXT[p] == q] + ([(i - 1, p, c) for c, p in back_edits(codes[i - 1], q)] if i else [])
        for j, p, c in near:
            if cost + c < own.get((j, p), none):
                own[j, p] = cost + c
                heapq.heappush(heaps[side], (cost + c, j if side == 0 else -j, p))
                best = min(best, cost + c + other.get((j, p), none))
    if best == none:
        return None
    # Every least path leaves the nodes that are done ahead by an edge into one done behind,
    # or ends among them. Nodes done ahead that lie on such a path:
    near = lambda i, q: [("I", i, NEXT[q], INSERT), *((e, i + 1, p, c) for e, c, p in (edits(codes[i], q) if i < n else ()))]

    def crosses(at: tuple[int, int], to: tuple[int, int], c: int) -> bool:
        return to in done[1] and ahead[at] + c + behind[to] == best
    live = {at for at in done[0] if (at[0] == n and at[1] in ends and ahead[at] == best)
            or any(crosses(at, (j, p), c) for _, j, p, c in near(*at))}
    todo = list(live)
    while todo:
        i, q = at = todo.pop()
        for j, p, c in [(i, p, INSERT) for p in STATES if NEXT[p] == q] + ([(i - 1, p, c) for c, p in back_edits(codes[i - 1], q)] if i else []):
            if (j, p) in done[0] and (j, p) not in live and ahead[j, p] + c == ahead[at]:
                live.add((j, p))
                todo.append((j, p))
    audit, at = [], (0, start)
    first = True  # still among the nodes done ahead
    while not (at[0] == n and at[1] in ends and (ahead.get(at) == best if first else behind[at] == 0)):
        for e, j, p, c in sorted(near(*at)):
            to = (j, p)
            if first and to in live and ahead[at] + c == ahead[to]:
                break
            if (crosses(at, to, c) if first else to in done[1] and behind[to] + c == behind[at]):
                first = False
                break
        audit.append(e)
        at = to
    return best, "".join(audit)


_solve_short = lru_cache(200_000)(_solve)  # short conversations have few different codes


def applied(rows: list[tuple[str, str]], start: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that the edits of ``audit`` leave."""
    q, i = start, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        if e == "K":
            role, text = rows[i]
            q = INTO[role[0]][1]
        else:
            role, q = ("assistant" if q == 2 else "user"), NEXT[q]
            text = "" if e == "I" else rows[i][1]
        yield role, text
        i += e != "I"


# Columns of the figures of a conversation, and of the pieces a block gives.
TEXT, NUMBER, YES = pa.string(), pa.int64(), pa.bool_()
FIGURES = {c: NUMBER for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": TEXT}
LINE = pa.struct([("role", TEXT), ("text", TEXT)])
WAY = pa.struct([("start", NUMBER), ("end", NUMBER), ("cost", NUMBER), ("audit", TEXT)])
PART = pa.struct([("at", NUMBER), ("size", NUMBER), ("start", NUMBER), ("audit", TEXT)])
PIECE = FIGURES | {"at": NUMBER, "whole": YES, "size": NUMBER, "turns": NUMBER, "first_turn": NUMBER, "last_turn": NUMBER,
                   "first_role": TEXT, "last_role": TEXT, "lines": pa.list_(LINE), "ways": pa.list_(WAY)}


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return last - first + 1 - turns if turns else 0


def _piece(at: list[int], turn: list, role: list[str], text: list[str], fault: list[int], whole: bool) -> dict:
    """The figures of a conversation, or of a part of it, from its rows in order."""
    here = [i for i, f in enumerate(fault) if f != 4]
    roles = [role[i] for i in here]
    known = [turn[i] for i in here if turn[i] is not None]
    first, last, turns = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
    codes = "".join(code(role[i], fault[i]) for i in here)
    out = dict(at=at[0], whole=whole, size=len(at), blank=sum(fault[i] == 1 for i in here), duplicate=sum(fault[i] == 2 for i in here),
               truncated=sum(fault[i] == 3 for i in here), illegal=_illegal(roles), gaps=_gaps(first, last, turns), turns=turns,
               first_turn=first, last_turn=last, first_role=roles[0] if roles else None, last_role=roles[-1] if roles else None)
    if whole:
        out["cost"], out["audit"] = solve(codes, 0, (0, 3))
        out["lines"] = [dict(role=r, text=t) for r, t in applied([(role[i], text[i]) for i in here], 0, out["audit"])]
    else:
        found = [(q, p, solve(codes, q, (p,))) for q in STATES for p in STATES]
        out["ways"] = [dict(start=q, end=p, cost=w[0], audit=w[1]) for q, p, w in found if w]
    return out


def joined(pieces: list[dict]) -> dict:
    """A conversation's figures from those of its pieces in order, and as ``parts`` the state
    before each piece and its part of the audit."""
    best = {0: (0, "", [])}  # state -> cost, audit, parts
    for x in pieces:
        after: dict = {}
        for w in x["ways"]:
            if w["start"] in best:
                cost, audit, parts = best[w["start"]]
                new = (cost + w["cost"], audit + w["audit"])
                if w["end"] not in after or new < after[w["end"]][:2]:
                    after[w["end"]] = (*new, [*parts, dict(at=x["at"], size=x["size"], start=w["start"], audit=w["audit"])])
        best = after
    cost, audit, parts = min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])
    illegal, turns, role, first, last = 0, 0, None, None, None
    for x in pieces:
        if x["first_role"] is not None:
            illegal += x["illegal"] + (role is not None and _illegal([role, x["first_role"]]))
            role = x["last_role"]
        if x["first_turn"] is not None:
            turns += x["turns"] - (last == x["first_turn"])
            first, last = x["first_turn"] if first is None else first, x["last_turn"]
    counts = {k: sum(x[k] for x in pieces) for k in ("blank", "duplicate", "truncated")}
    return dict(counts, gaps=_gaps(first, last, turns), illegal=illegal, cost=cost, audit=audit, parts=parts)


def _grouped(grouped, make, columns: dict, conv: str):
    """``make`` (Arrow tables to lists of rows) for each group, or pair of groups; rows have
    conv_id and ``columns``."""
    schema = pa.schema([("conv_id", TEXT if conv == "string" else NUMBER), *columns.items()])
    ddl = ", ".join(f"`{c}` {_ddl(t)}" for c, t in zip(schema.names, schema.types))
    if isinstance(grouped, PandasCogroupedOps):
        return grouped.applyInArrow(lambda a, b: pa.Table.from_pylist(make(a, b), schema=schema), ddl)
    return grouped.applyInArrow(lambda t: pa.Table.from_pylist(make(t), schema=schema), ddl)


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in t) + ">"
    return {TEXT: "string", NUMBER: "bigint", YES: "boolean"}[t]


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Repairs rows (conv_id, turn, role, text, gone) as ``damage`` and ``intact`` give them:

    * (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of every
      conversation; lines (its repaired turns) is null for those that cross a block's border,
    * whose turns are (conv_id, at, number, role, text), in the order of (at, number)."""
    if block < 1 or block & (block - 1):
        raise ValueError("a block must hold a power of two of rows")
    ready(rows.sparkSession)
    given = rows.schema["conv_id"].dataType.simpleString()
    conv = "bigint" if given in ("bigint", "int", "smallint", "tinyint") else "string"
    rows = rows.withColumns({"turn": F.col("turn").cast("long"), "conv_id": F.col("conv_id").cast(conv)})
    # Of equal rows the one that repeats none stands first.
    order = [*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")), (F.col("fault") == 2).asc()]
    placed = save(with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("at", F.monotonically_increasing_id())
                  .withColumn("block", F.floor(F.col("at") / block)), "repair-rows")

    def pieces_of(t: pa.Table) -> list[dict]:
        t = t.sort_by("at")
        cols = [t.column(c).to_pylist() for c in ("at", "turn", "role", "text", "fault")]
        ids, n = t.column("conv_id").to_pylist(), t.num_rows
        edges = [0, *(i for i in range(1, n) if ids[i] != ids[i - 1]), n]
        return [dict(_piece(*(c[a:b] for c in cols), whole=a > 0 and b < n), conv_id=ids[a]) for a, b in zip(edges, edges[1:])]
    pieces = save(_grouped(placed.groupBy("block"), pieces_of, PIECE, conv), "repair-pieces")

    def join_pieces(t: pa.Table) -> list[dict]:
        x = t.sort_by("at").to_pylist()
        return [dict(joined(x), conv_id=x[0]["conv_id"])]
    crossing = save(_grouped(pieces.filter("NOT whole").drop("lines").groupBy("conv_id"), join_pieces,
                             FIGURES | {"parts": pa.list_(PART)}, conv), "repair-joined")

    def lines_of(t: pa.Table, parts: pa.Table) -> list[dict]:
        rows, out = t.filter(pc.field("fault") != 4).sort_by("at").to_pylist(), []
        for x in parts.to_pylist():
            own = [(r["role"], r["text"]) for r in rows if x["at"] <= r["at"] < x["at"] + x["size"]]
            out += [dict(conv_id=x["conv_id"], at=x["at"], number=k, role=role, text=text)
                    for k, (role, text) in enumerate(applied(own, x["start"], x["audit"]))]
        return out
    parts = crossing.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.*").withColumn("block", F.floor(F.col("at") / block))
    there = placed.join(parts.select("block").distinct(), "block", "left_semi")
    turns = _grouped(there.groupBy("block").cogroup(parts.groupBy("block")), lines_of,
                     {"at": NUMBER, "number": NUMBER, "role": TEXT, "text": TEXT}, conv)
    columns = [F.col("conv_id").cast(given).alias("conv_id"), *FIGURES]
    none = F.lit(None).cast(pieces.schema["lines"].dataType).alias("lines")
    return (pieces.filter("whole").select(*columns, "lines").unionByName(crossing.select(*columns, none)),
            turns.withColumn("conv_id", F.col("conv_id").cast(given)))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from turns (conv_id, at, number, role, text): the turns of a
    conversation stream through one hash in order."""
    given = turns.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "at", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed, names = None, None, ["conv_id", "repaired_sha256"]
        for b in batches:
            done = []
            for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
                if hashed is not None and c == conv:
                    hashed.update(b"\n")
                else:
                    if hashed is not None:
                        done.append((conv, hashed.hexdigest()))
                    conv, hashed = c, sha256()
                hashed.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], b.schema.field("conv_id").type), pa.array([h for _, h in done], TEXT)], names)
            kind = b.schema.field("conv_id").type
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()], TEXT)], names)
    lines = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(run, f"conv_id {given}, repaired_sha256 string")


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Figures, audit and digest of the repaired turns for every conversation of rows
    (conv_id, turn, role, text, gone)."""
    found, turns = repair(rows, block)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    inside = found.filter("lines IS NOT NULL").withColumn("repaired_sha256", F.sha2(text, 256)).drop("lines")
    other = digests(turns).withColumnRenamed("conv_id", "of")
    nothing = F.sha2(F.lit(""), 256)
    crossing = found.filter("lines IS NULL").join(other, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", nothing)).drop("of", "lines")
    return inside.unionByName(crossing)
