"""Repair, resampling and sharding against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import messy
from conftest import SF
from souk.llm import repair, resample, sharding
from souk.llm.common import in_order, table
from souk.llm.queries import QUERIES

# Repair.


def cheapest(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault) by going through all states row by row."""
    pattern = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ())}

    def better(out, q, entry):
        if q not in out or entry[:2] < out[q][:2]:
            out[q] = entry

    def inserted(states):
        for _ in range(4):
            for q, (c, a, t) in list(states.items()):
                for role in ("user", "assistant"):
                    if role[0] in pattern[q]:
                        better(states, pattern[q][role[0]], (c + 5, a + "I", (*t, (role, ""))))
        return states
    for role, text, fault in rows:
        out = {}
        for q, (c, a, t) in inserted(best).items():
            better(out, q, (c + 2, a + "D", t))
            if fault in (0, 3):
                more = 5 * (fault == 3)
                if role[:1] in pattern[q]:
                    better(out, pattern[q][role[:1]], (c + more, a + "K", (*t, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in pattern[q]:
                        better(out, pattern[q][new[0]], (c + more + 1, a + "R", (*t, (new, text))))
        best = out
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def brute_repair(rows, damaged=True):
    convs, out = defaultdict(list), []
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = blank(role), blank(text)
        k = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20 if damaged else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, left = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest):
    rnd, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rnd.choice(["Yes.", "No!", "Why?  \t", "cut off", "", " \n", None, "é 中.", f"turn {turn}.", f"open {turn}", "a　", "x. "])
            out.append((rnd.choice([conv, conv, None]) if conv == 3 else conv, rnd.choice([turn, turn, turn, None, turn // 2]), role, text))
    return out


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [2, 16, 4096])
def test_repair(spark, block):
    """Small blocks: conversations are cut into pieces."""
    rows = conversations(1, 60, 24) + [(77, 0, "user", "x"), (78, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV + ", audit string")
    got = repair.report(repair.damage(df), block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)
    got = repair.report(repair.intact(df), block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows, damaged=False)


def test_repair_one_hot_conversation(spark):
    """Far longer than a block, with equal turns, and string ids."""
    rnd = random.Random(2)
    rows = [("hot", i // 3, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{i}.", f"t{i}", "Yes.", ""])) for i in range(3000)]
    rows += [("b", 0, "user", "Hi."), ("b", 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, CONV.replace("conv_id long", "conv_id string"))
    got = {r["conv_id"]: tuple(r) for r in repair.report(repair.damage(df), 256).collect()}
    assert sorted(got.values(), key=str) == brute_repair(rows)


def test_repair_empty_and_dropped(spark):
    assert repair.report(repair.damage(spark.createDataFrame([], CONV))).count() == 0
    dropped = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.report(repair.damage(spark.createDataFrame([(dropped, 0, "user", "x")], CONV))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_test_data(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_repair"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == brute_repair(rows)


def test_search_equals_row_by_row():
    """All short codes from every state, and long random ones."""
    of = {"s": ("system", 0), "u": ("user", 0), "a": ("assistant", 0), "x": ("tool", 0), "S": ("system", 3), "U": ("user", 3), "A": ("assistant", 3), "-": ("user", 1)}
    rnd = random.Random(4)
    codes = ["".join(c) for n in range(5) for c in itertools.product(of, repeat=n)] + ["".join(rnd.choices(list(of), k=rnd.randint(20, 90))) for _ in range(300)]
    for c in codes:
        assert repair.solve(c, 0, (0, 3)) == cheapest([(of[x][0], "", of[x][1]) for x in c])[:2], c


# Resampling.


def brute_resample(rows, target):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    docs = [(d, [bucket(w) for w in words(t)]) for d, t in rows]
    s, t = Counter(b for _, f in docs for b in f), Counter(bucket(w) for x in target for w in words(x))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)}
    out = []
    for i, (d, f) in enumerate(docs):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:10 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resample_messy(spark):
    rows = [(d, t) for d, t, *_ in messy.ROWS * 9]
    docs = messy.docs(spark, messy.ROWS * 9).withColumnRenamed("blob", "found")
    target = [messy.PASSAGE, None, "", "bridge é"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.report(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target)
    assert resample.report(messy.docs(spark, []), bench).count() == 0
    assert [r["rank"] for r in resample.report(messy.docs(spark, messy.ROWS[:2]), bench).collect()] == [None, None]
    drawn = resample.drawn_documents(docs, bench)
    assert drawn.columns == [*docs.columns, "rank"] and drawn.count() >= 1


@pytest.mark.parametrize("small", [1, 40])
def test_resample_test_data(spark, small):
    """With few keys at once the cutoff is narrowed over many rounds."""
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = resample.report(docs.repartition(7), bench, small=small).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in bench.collect()])


def test_cutoff_at_every_rank(spark):
    rnd = random.Random(8)
    keys = [(rnd.randint(-3, 3), rnd.choice([None, *range(40)]), i) for i in range(200)]
    df = spark.createDataFrame(keys, "score long, doc_id long, row long").repartition(5).cache()
    want = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0, k[2]))
    assert all(resample.cutoff(df, rank, 3) == want[rank - 1] for rank in (1, 2, 3, 50, 99, 100, 101, 180, 199, 200))


def test_features_of_longer_runs():
    n, found = resample.Features(1 << 20, 2).of("Ab c-d É9".encode())
    assert n == 4 and found.tolist() == [zlib.crc32(x.encode()) % (1 << 20) for x in ("ab", "c", "d", "É9", "ab c", "c d", "d É9")]


# Sharding.


def brute_shards(rows, shards=16):
    """Shard and slot of every row (doc_id, text, source), in the order of the interleaving."""
    strata = defaultdict(list)
    for d, t, s in rows:
        h = hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()
        raw = (t or "").encode()
        strata[s].append((h, d is not None, d or 0, len(raw) + 1, zlib.crc32(raw), d))
    mixed = []
    for s, own in strata.items():
        for r, x in enumerate(sorted(own)):
            mixed.append(((r + 0.5) / len(own), s is not None, s or "", x[5], x[3], x[4]))
    mixed.sort(key=lambda x: x[:3])
    out, at = [], 0
    for shard in range(shards):
        for slot in range(len(mixed) // shards + (shard < len(mixed) % shards)):
            *_, d, size, crc = mixed[at]
            out.append((d, size, crc, "rows", shard, slot, None))
            at += 1
    return sorted(out, key=str)


def test_shards(spark):
    for rows in (messy.ROWS * 5, messy.ROWS[:3], []):
        got = sharding.report(messy.docs(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute_shards([(r[0], r[1], r[3]) for r in rows])


def test_shards_match_the_mixture(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sharding.assign(docs).collect()
    per = Counter((r["stratum"], r["shard"]) for r in got)
    whole, sizes = Counter(r["stratum"] for r in got), Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    assert all(abs(per[s, k] - n / 16) < 2 for s, n in whole.items() for k in range(16))
    for k in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert sorted(map(tuple, QUERIES["op13_sharding"](spark, SF).collect()), key=str) == brute_shards(
        [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()])


def test_write_shards(spark, tmp_path):
    docs = messy.docs(spark).withColumnRenamed("key", "size")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert max(Counter(r["shard"] for r in back.collect()).values()) <= -(-len(messy.ROWS) // 4)


def test_in_order(spark):
    rows = [(random.Random(i).randint(0, 5), i) for i in range(500)]
    got = in_order(spark.createDataFrame(rows, "a long, b long").repartition(6), [F.col("a"), F.desc("b")], "test")
    assert [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r["place"] for r in got.collect()) == list(range(500))


# Learned quality rules.


def test_learned_rules_on_labels(spark):
    """On labelled test data cutoffs act in the strata, and the rows that calibrated them keep
    the bound: of the good ones at most the risk is rejected."""
    from souk.llm import rules
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = rules.judge(docs, labels).join(labels, "doc_id").select("stratum", "kept", "quality", rules.fits(F.col("doc_id")).alias("fits")).filter("NOT base_failed").collect()
    acting = {r["stratum"] for r in rows if not r["kept"]}
    assert acting
    for s in acting:
        good = [r["kept"] for r in rows if r["stratum"] == s and r["quality"] == 1 and not r["fits"]]
        bad = [r["kept"] for r in rows if r["stratum"] == s and r["quality"] == 0 and not r["fits"]]
        print(s, "good", len(good), "rejected", good.count(False), "bad", len(bad), "rejected", bad.count(False))
        assert good.count(False) <= 0.02 * len(good) and bad.count(False) > 0.3 * len(bad)
