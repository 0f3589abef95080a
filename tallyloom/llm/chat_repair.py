"""Repair of conversation structure: rows become role and fault symbols, equal consecutive symbols collapse to runs, and a
min-plus transition over the states of the wanted role order is advanced by a run's binary powers; the cheapest edits
are unrolled from what each state still costs.

A conversation's symbols are planned in one task, one conversation at a time: the audit, a cell of the result, is as long.
Its texts never are: they are only numbered, joined with their edits and streamed in order through the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, small_batches, stash, table

#: States while reading role initials: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, PAIRED = range(4)
#: Roles by class; any other initial has no place and can only be changed or deleted.
INITIALS = "sua"
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRED, (PAIRED, "u"): USER}
#: The one of user and assistant that each state can take, and where it leads.
TURN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIRED), PAIRED: ("user", USER)}
CLEAN, TRUNCATED, GONE = range(3)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
INFINITE = 1 << 60
#: What each state costs at the end of a conversation: insertions until (s?(ua)+)? is met.
END = (0, 2 * INSERT_COST, INSERT_COST, 0)
Costs = tuple[int, int, int, int]


def symbol(initial: int, fault: int) -> int:
    """A role class (0 to 2 as INITIALS, 3 any other) and a fault as one small number."""
    return initial * 3 + fault


def _choices(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for one row, insertions aside, by ASCII order of the edits."""
    initial, fault = divmod(sym, 3)
    found = [("D", DELETE_COST, state)]
    if fault != GONE:
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        after = NEXT.get((state, INITIALS[initial])) if initial < 3 else None
        if after is not None:
            found.append(("K", KEEP_COST + more, after))
        found.append(("R", REROLE_COST + more, TURN[state][1]))
    return found


def _product(a: tuple[Costs, ...], b: tuple[Costs, ...]) -> tuple[Costs, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> tuple[Costs, ...]:
    """The min-plus transition of 2^k rows of one symbol, insertions before each row included."""
    if k:
        half = power(sym, k - 1)
        return _product(half, half)
    out = [[INFINITE] * 4 for _ in range(4)]
    for state in range(4):
        at, paid = state, 0
        for _ in range(4):  # more insertions only come back to a state that was passed
            for _, cost, after in _choices(sym, at):
                out[state][after] = min(out[state][after], paid + cost)
            at, paid = TURN[at][1], paid + INSERT_COST
    return tuple(tuple(r) for r in out)


def _before(sym: int, n: int, after: Costs) -> Costs:
    """What each state still costs before n rows of one symbol, given what it costs after them."""
    k = 0
    while n:
        if n & 1:
            m = power(sym, k)
            after = tuple(min(m[i][j] + after[j] for j in range(4)) for i in range(4))
        n, k = n >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 16)
def _moves(sym: int, state: int, after: Costs) -> tuple[str, int]:
    """The moves of one row and the state they lead to; only the differences in `after` matter, so calls repeat."""
    left, out = _before(sym, 1, after), ""
    while True:
        # The least edit in ASCII order that is still cheapest: D, I, K, R.
        role, turned = TURN[state]
        ways = [("I", INSERT_COST + left[turned], turned), *[(e, c + after[s], s) for e, c, s in _choices(sym, state)]]
        edit, _, to = min(w for w in ways if w[1] == left[state])
        out += role[0] if edit == "I" else role[0].upper() if edit == "R" else edit
        state = to
        if edit != "I":
            return out, state


def _unroll(sym: int, n: int, state: int, after: Costs, out: list[str]) -> int:
    """Append the moves of n rows of one symbol, halving the run until single rows are left; the state they lead to."""
    if n > 1:
        half = n // 2
        state = _unroll(sym, half, state, _before(sym, n - half, after), out)
        return _unroll(sym, n - half, state, after, out)
    least = min(after)
    moves, state = _moves(sym, state, tuple(c - least for c in after))
    out.append(moves)
    return state


def plan(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, moves) of the cheapest edits of a conversation's runs of (symbol, rows); of equal costs, the ASCII-least audit.

    A move is K or D for a row kept or deleted, U or A for one that becomes the user's or the assistant's, u or a for an
    inserted row; the audit reads R for the second and I for the third kind.
    """
    after = [END]
    for sym, n in reversed(runs):
        after.append(_before(sym, n, after[-1]))
    cost, state, out = after[-1][START], START, []
    for (sym, n), rest in zip(runs, reversed(after[:-1]), strict=True):
        state = _unroll(sym, n, state, rest, out)
    while END[state]:
        role, state = TURN[state]
        out.append(role[0])
    return cost, "".join(out)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, cid, turn, role, text, said, copy): the contract's damage of conversations' rows.

    By crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 sets
    the role to user. Nulls in conv_id, turn, role or text stand as one blank; cid is the conversation's id as text, said
    the text before damage and copy the number of the repetition, for the order of rows.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", word("conv_id").alias("cid"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    fate = F.crc32(F.encode(F.concat(F.col("cid"), F.lit(":"), word("turn")), "utf-8")) % 20
    hurt = rows.withColumn("fate", fate).filter("fate <> 0").withColumn("said", F.struct("role", "text"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "cid", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "said", copies.alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Each row with at (its place, from 1), initial, and fault: blank, duplicate, truncated or none.

    `rows` has cid, turn, role, text, said and copy. A conversation's rows are in order of turn (nulls first), then of
    the role and text before damage, then of the copy; rows equal in all of these stand for each other. Both windows
    need the rows by conversation only, so there is one shuffle; their sorts spill.
    """
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("cid").orderBy(F.col("turn").asc_nulls_first(), "said", "copy")).cast("long"))
    first = F.min("at").over(Window.partitionBy("cid", "role", "text"))
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    kind = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("at") > first, "duplicate").when(~tail.isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", kind).withColumn("initial", F.substring("role", 1, 1))


def _symbol() -> Column:
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(CLEAN)
    return (place * 3 + fault).cast("int")


def plans(rows: DataFrame) -> DataFrame:
    """(cid, cost, moves) for each conversation of `rows` (cid, at, initial, fault): see plan()."""
    names = ["cid", "cost", "moves"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid, runs = None, []
        for b in batches:
            out, ids, syms = [], b.cid.to_numpy(), b.sym.to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (syms[1:] != syms[:-1])]) if len(b) else np.zeros(0, int)
            for lo, hi in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                if ids[lo] != cid:
                    if cid is not None:
                        out.append((cid, *plan(runs)))
                    cid, runs = ids[lo], []
                if runs and runs[-1][0] == syms[lo]:
                    runs[-1] = (runs[-1][0], runs[-1][1] + int(hi - lo))
                else:
                    runs.append((int(syms[lo]), int(hi - lo)))
            yield pd.DataFrame(out, columns=names)
        if cid is not None:
            yield pd.DataFrame([(cid, *plan(runs))], columns=names)

    return rows.select("cid", "at", _symbol().alias("sym")).repartition("cid").sortWithinPartitions("cid", "at").mapInPandas(run, "cid string, cost long, moves string")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(cid, at, new, role, text): all rows after the repair, whose order is (at, new).

    An inserted row has an empty text and stands before the row of its `at`, or after the last one.
    """
    tokens = planned.select("cid", F.posexplode(F.regexp_extract_all("moves", F.lit("[ua]*[UAKD]|[ua]+$"), F.lit(0))).alias("place", "token")).filter("token <> 'D'")
    joined = tokens.withColumn("at", (F.col("place") + 1).cast("long")).join(rows.select("cid", "at", "role", "text"), ["cid", "at"], "left")
    each = joined.select("cid", "at", "role", "text", F.posexplode(F.split("token", "")).alias("new", "move")).filter("move not in ('', 'D')")
    role = F.when(F.lower("move") == "u", "user").when(F.lower("move") == "a", "assistant").otherwise(F.col("role"))
    return each.select("cid", "at", "new", role.alias("role"), F.when(F.col("move").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(whole: DataFrame) -> DataFrame:
    """(cid, repaired_sha256): one hash over each conversation's `role:text` lines, which stream through in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid, digest = None, hashlib.sha256()
        for b in batches:
            out = []
            for c, line in zip(b.cid, b.line, strict=True):
                if c != cid:
                    if cid is not None:
                        out.append((cid, digest.hexdigest()))
                    cid, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=["cid", "repaired_sha256"])
        if cid is not None:
            yield pd.DataFrame([(cid, digest.hexdigest())], columns=["cid", "repaired_sha256"])

    lines = whole.select("cid", "at", "new", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("cid").sortWithinPartitions("cid", "at", "new").mapInPandas(run, "cid string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their places and faults, plans, repaired rows) of conversations' rows as damage() gives them.

    The repaired roles' initials are (s?(ua)+)?; kept rows cost nothing, a role changed to user or assistant 1, a deleted
    row 2 (blank and duplicate rows have to go), an inserted one 5, and a truncated row that stays 5 more.

    Roles other than these three (empty ones too) have no place and are changed or deleted. Repeated rows and ties have
    the order of faults(); a very long text is compared and hashed whole; an empty table gives empty ones; columns
    other than the named ones are not read. Within one conversation all rows are numbered and streamed in one task,
    sorted with spills; what a task holds of it in Python is its runs and the string of its moves.
    """
    rows = stash(faults(turns))
    planned = stash(plans(rows))
    return rows, planned, repaired(rows, planned)


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's damage, faults, cheapest repair and digest of each conversation of `conversations`."""
    small_batches(spark)
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, planned, whole = repair(damage(given))
    beside = F.concat(F.lag("initial").over(Window.partitionBy("cid").orderBy("at")), "initial")
    count = lambda c: F.count(F.when(c, 1))
    counts = rows.withColumn("broken", ~beside.isin("su", "ua", "au")).groupBy("cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("broken")).alias("illegal"),
    )
    ids = given.select("conv_id").distinct().withColumn("cid", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    joined = ids.join(counts, "cid", "left").join(planned, "cid", "left").join(digests(whole), "cid", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.translate(F.coalesce("moves", F.lit("")), "uaUA", "IIRR")
    return joined.select("conv_id", *numbers, audit.alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
