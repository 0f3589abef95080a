"""Secret scans over a trigram inverted index: each rule's regular expression gives a Boolean query of trigrams, the
query's postings are intersected, and the candidates' whole texts are verified. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, text_of
from .pii import _ends, _let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has at least `least` characters.

    Patterns are written for both Java and Python; they should be linear (possessive repeats, no nested ones).
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]++", 16),
    # A run is one match, so a look behind may stand for "not inside a run that was too short".
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
#: Kinds that the method adds (public formats of keys).
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("url_login", r"://[^\x00-\x20:/@]++:[^\x00-\x20/@]++@"),
)

#: A query is a set of clauses, one of which must hold; a clause is a set of trigrams, all of which must occur.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
#: Sets of exact strings and clauses are given up (for something weaker, never stronger) beyond these sizes.
STRINGS, CLAUSES = 64, 32


def _least(clauses: Iterable[frozenset[str]]) -> Query:
    """Without clauses that hold only where another one holds."""
    some = set(clauses)
    return frozenset(c for c in some if not any(o < c for o in some))


def _both(a: Query, b: Query) -> Query:
    joined = _least(x | y for x in a for y in b)
    return joined if len(joined) <= CLAUSES else min(a, b, key=lambda q: (q == ANYTHING, len(q)))


def _either(some: Iterable[Query]) -> Query:
    joined = _least(c for q in some for c in q)
    return joined if len(joined) <= CLAUSES else ANYTHING


def _holds(strings: set[str]) -> Query:
    """What a text with one of these strings must hold."""
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _letters(members: list) -> set[str] | None:
    found = set()
    for op, value in members:
        if op is sre.LITERAL:
            found.add(value)
        elif op is sre.RANGE and value[1] - value[0] < STRINGS:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    folded = {chr(c).lower() for c in found}
    return folded if len(folded) <= 16 and all(c < 128 for c in found) else None


def _sequence(items: Iterable) -> tuple[set[str] | None, Query]:
    """Of a run of items: all strings it can match, if they are few, and the query that each match meets."""
    tails, query, whole = {""}, ANYTHING, True
    for op, value in items:
        strings, inner = _item(op, value)
        if strings is not None and len(tails) * len(strings) > STRINGS:
            query, tails, whole = _both(query, _holds(tails)), {t[-2:] for t in tails}, False
        if strings is not None and len(tails) * len(strings) <= STRINGS:
            tails = {t + s for t in tails for s in strings}
        else:
            query, tails, whole = _both(_both(query, _holds(tails)), inner if strings is None else _holds(strings)), {""}, False
    query = _both(query, _holds(tails))
    return (tails if whole else None), query


def _item(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return ({chr(value).lower()} if value < 128 else None), ANYTHING
    if op is sre.IN:
        return _letters(value), ANYTHING
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ANYTHING
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.ATOMIC_GROUP:
        return _sequence(value)
    if op is sre.BRANCH:
        ways = [_sequence(w) for w in value[1]]
        strings = None if any(s is None for s, _ in ways) else set().union(*[s for s, _ in ways])
        return (strings if strings is not None and len(strings) <= STRINGS else None), _either(q for _, q in ways)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, query = _sequence(body)
        if strings is not None and least == 0 and most == 1:
            return strings | {""}, ANYTHING
        if strings is not None and least == most <= 3 and len(strings) ** least <= STRINGS:
            out = {""}
            for _ in range(least):
                out = {o + s for o in out for s in strings}
            return out, _holds(out)
        return None, (query if least else ANYTHING)
    return None, ANYTHING


def trigram_query(pattern: str) -> Query:
    """The Boolean query of lower-case trigrams that every text with a match of `pattern` meets.

    An empty clause means that nothing is mandatory: such a rule has to look at every text.
    """
    return _sequence(_parser.parse(pattern))[1]


def postings(rows: DataFrame, trigrams: Iterable[str], key: str = "key", text: str = "text") -> DataFrame:
    """(trigram, key): the inverted index of the lower-cased whole texts, restricted to trigrams that some rule asks for.

    Equal keys give each posting once. Lower-casing may make more trigrams of A-Z than a text has, never fewer.
    """
    asked = F.array(*[F.lit(t) for t in sorted(trigrams)]) if trigrams else F.array().cast("array<string>")
    held = _let(F.lower(text_of(text)), lambda low: F.filter(asked, lambda t: F.contains(low, t)))
    return rows.select(F.explode(held).alias("trigram"), key).distinct()


def candidates(index: DataFrame, queries: dict[str, Query], key: str = "key") -> DataFrame:
    """(key, kinds): intersects the postings of each clause; `kinds` are those rules of `queries` that may match."""
    asked = [(kind, n, t, len(clause)) for kind, q in queries.items() for n, clause in enumerate(sorted(q, key=sorted)) for t in clause]
    clauses = index.sparkSession.createDataFrame(asked, "kind string, clause int, trigram string, size int")
    # The clauses are as many as the rules make, whatever the table holds.
    met = index.join(F.broadcast(clauses), "trigram").groupBy(key, "kind", "clause", "size").count().filter(F.col("count") == F.col("size"))
    return met.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _spans(rule: Rule, text: Column) -> Column:
    """A rule's matches in code points: each ends after all pieces up to its own and all matches so far."""

    def placed(cut: Column) -> Column:
        pieces, found = cut["pieces"], cut["found"]
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        rows = F.zip_with(_ends(sizes), found, lambda e, m: F.struct(F.lit(rule.kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
        long = F.filter(rows, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least) if rule.least else rows
        return F.transform(long, lambda s: s.dropFields("match"))

    cut = F.struct(F.split(text, rule.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(rule.pattern), _let(cut, placed)).otherwise(F.array().cast(SPANS))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs` and secrets: array of (kind, start, end), by start, then by the rules' order.

    Positions count code points of the whole text, the end exclusive. Matches of one rule do not overlap and are taken
    leftmost first; one that is too short is dropped and not retried. Rules with mandatory trigrams look only at the
    texts that the index names, the rest at all.

    A null or empty text has no secret; a null key is a row like another; repeated rows and ties each get their spans; a
    very long text is verified whole, in time linear in its length; an empty table gives an empty result; a column of the
    name secrets is replaced, others keep their names and values, whatever these are.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    row = F.xxhash64(F.col(key), F.col(text))
    found = docs.withColumn("secrets_key_", row)
    if indexed:
        index = stash(postings(docs.select(row.alias("secrets_key_"), F.col(text)), {t for q in indexed.values() for c in q for t in c}, "secrets_key_", text))
        named = candidates(index, indexed, "secrets_key_").withColumnRenamed("kinds", "secrets_kinds_")
        found = found.join(named, "secrets_key_", "left")
    spans = []
    for r in rules:
        at = _spans(r, text_of(text))
        spans.append(F.when(F.array_contains("secrets_kinds_", r.kind), at).otherwise(F.array().cast(SPANS)) if r.kind in indexed else at)
    place = {r.kind: i for i, r in enumerate(rules)}
    number = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    ordered = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), number[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.withColumn("secrets", F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"]))).select(*[c for c in docs.columns if c != "secrets"], "secrets")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and digests of secrets in `documents`, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    shown = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))


def _sql(rules: tuple[Rule, ...]) -> str:
    """The same in DuckDB: all texts are scanned by all rules, possessive repeats written as plain ones."""
    plain = lambda p: p.replace("++", "+").replace("*+", "*").replace("}+", "}").replace("(?<![0-9a-f])", "").replace("'", "''")
    each = " UNION ALL ".join(
        f"SELECT row, '{r.kind}' AS kind, {i} AS place, {r.least} AS least, {r.group} AS grp, regexp_split_to_array(t, '{plain(r.pattern)}') AS pieces,"
        f" regexp_extract_all(t, '{plain(r.pattern)}') AS found, regexp_extract_all(t, '{plain(r.pattern)}', {r.group}) AS parts FROM d"
        for i, r in enumerate(rules)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({each}),
parts AS (SELECT row, kind, place, least, generate_subscripts(found, 1) AS i, unnest(found) AS f, unnest(parts) AS g, unnest(pieces[:len(found)]) AS p FROM cut),
placed AS (SELECT *, sum(length(f) + length(p)) OVER (PARTITION BY row, kind ORDER BY i)::BIGINT AS stop FROM parts),
spans AS (SELECT row, kind, place, stop - length(f) AS start, kind || ':' || (stop - length(f)) || ':' || stop AS s FROM placed WHERE length(g) >= least)
SELECT any_value(doc_id) AS doc_id, {counts},
       sha256(coalesce(string_agg(s, ',' ORDER BY start, place) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, place), '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row
"""


OP13_SQL = _sql(BASE + MORE)
