import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F
from tallyloom.llm import chat_repair

ROWS = "conv_id long, turn long, role string, text string, cid string, at int"


def damaged(rows):
    """The contract's damage, row by row."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, *(" " if x is None else x for x in r[2:]))):
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def fault_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Row-by-row search over (place, state) for the least (cost, audit), which also gives the repaired rows."""
    best = {0: (0, "", [])}
    turn = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(5):
            for s, (c, a, o) in list(best.items()):
                role, to = turn[s]
                way = (c + 5, a + "I", [*o, f"{role}:"])
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}

        def put(s, way, after=after):
            if s not in after or way[:2] < after[s][:2]:
                after[s] = way

        for s, (c, a, o) in inserted(best).items():
            put(s, (c + 2, a + "D", o))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (s, role[:1]) in keeps:
                    put(keeps[s, role[:1]], (c + more, a + "K", [*o, f"{role}:{text}"]))
                put(turn[s][1], (c + 1 + more, a + "R", [*o, f"{turn[s][0]}:{text}"]))
        best = after
    return min((w for s, w in inserted(best).items() if s in (0, 3)), key=lambda w: w[:2])


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        held = damaged(rows)[conv]
        found, turns = fault_of(held), [t for t, _, _ in held if t is not None]
        cost, audit, lines = cheapest(held, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        out[conv] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r[0]: tuple(r)[1:] for r in chat_repair.op12_chat_repair(spark, str(tmp_path)).collect()}


def test_plans_of_runs_match_a_search_by_rows():
    rng = random.Random(12)
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    kinds = {0: None, 1: "truncated", 2: "blank"}
    for _ in range(1500):
        runs = [(rng.randrange(12), rng.choice([1, 1, 1, 2, 3, 5, 9])) for _ in range(rng.randrange(6))]
        symbols = [s for s, n in runs for _ in range(n)]
        cost, moves = chat_repair.plan(runs)
        rows = [(i, names[s // 3], str(i)) for i, s in enumerate(symbols)]
        want = cheapest(rows, [kinds[s % 3] for s in symbols])
        assert (cost, moves.translate(str.maketrans("uaUA", "IIRR"))) == want[:2], runs


def test_a_run_of_a_million_rows():
    cost, moves = chat_repair.plan([(chat_repair.symbol(0, 0), 1), (chat_repair.symbol(1, 0), 1_000_000), (chat_repair.symbol(2, 0), 1)])
    assert cost == 500_001 and len(moves) == 1_000_002 and moves.startswith("KDKA") and moves.endswith("K")


def test_query_matches_plain_python_over_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = chat_repair.op12_chat_repair(spark, data)
    assert dict(out.dtypes) == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == wanted(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    texts = ["Yes.", "No", "", " \n", None, "Why? ", "é. ", "x" * 30_000 + "!", "It ends. ", "\U0001f600."]
    roles = ["user", "assistant", "system", None, "", "tool", "ursula"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12), 30]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += rows[:50] + [(77, t, "user", "Same.") for t in range(200)] + [(78, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(300)]
    assert result(spark, tmp_path, rows) == wanted(rows)


def test_empty_dropped_and_clashing(spark, tmp_path):
    assert result(spark, tmp_path / "none", []) == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "Hello.", "x", 1), (kept, 0, "user", "Hello.", "y", 2)]
    got = result(spark, tmp_path / "two", rows, ROWS)
    assert got == wanted([r[:4] for r in rows]) and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_have_the_wanted_order(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    _, planned, whole = chat_repair.repair(chat_repair.damage(turns))
    said = whole.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new", "role"))), lambda r: F.left(r["role"], F.lit(1))), "").alias("initials"))
    assert said.filter(~F.col("initials").rlike("^s?(ua)+$")).count() == 0 and planned.filter("moves is null").count() == 0
