"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Patterns use possessive repeats and look-behind, which match what the plain forms
match but neither back-track over long runs nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: A run that a pattern starts with is tried at its first character, or where the last match ended.
_START = r"(?:\G|(?<![{0}]))"
#: Characters of an account number by country, as the public registry of IBANs has them (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Country, check digits and groups of four, as many characters as the country's numbers have: what stands behind is not
    taken. Letters in either case."""
    rest = lambda n: r"(?:\x20?[A-Z0-9]{4}){%d}" % (n // 4) + (r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
    each = "|".join(f"(?:{'|'.join(countries.split())})[0-9]{{2}}{rest(n - 4)}" for n, countries in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{2}}[0-9]{{2}})(?i:{each})(?![A-Za-z0-9])"


#: kind -> (pattern, a text that every match holds). The first four are the contract's, in its order.
PATTERNS = {
    "email": (_START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (_START.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (_iban(), None),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-"),
}
BASE = ("email", "ip", "card", "phone")
#: Words that, near a span, speak for its kind (fixed values of this operator).
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "address"),
    "ip": ("ip", "address", "server", "host", "client", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "number"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "number"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security", "number"),
}
#: Score of a confirmed span before its surroundings are looked at, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.5}
BONUS, REACH = 0.2, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, blanks left out, has remainder 1 by the mod-97 rule."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.ltrim(p, F.lit("0")) == "", 0).otherwise(F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.upper(F.regexp_replace(found, " ", "")))
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches are numbered and placed in runs of this many, so that work grows with their number and not its square.
RUN = 256


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(sizes: Column) -> Column:
    """Running sums of an array of integers."""

    def sums(some: Column, start: Column) -> Column:
        added = F.aggregate(some, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(added, F.lit(2), F.size(some))

    def placed(part: Column) -> Column:
        totals = F.transform(part, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x))
        befores = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(F.zip_with(part, F.slice(befores, F.lit(1), F.size(part)), sums))

    starts = lambda n: F.sequence(F.lit(1), n, F.lit(RUN))
    return _let(sizes, lambda all_: _let(F.transform(starts(F.size(all_)), lambda at: F.slice(all_, at, F.lit(RUN))), placed))


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind: code points from the pieces between the matches, then checks and score.

    A match ends after all pieces up to its own and all matches so far. What stands within REACH characters of it
    is in the REACH pieces and matches on either side, as each match has two characters or more.
    """
    pattern, must = PATTERNS[kind]

    def confirmed(cut: Column) -> Column:
        pieces, found = cut["pieces"], cut["found"]
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        # Both ends of each piece and match: windows of REACH characters never reach from one end into the other.
        short = lambda x: F.when(F.length(x) > 2 * REACH, F.concat(F.left(x, F.lit(REACH)), F.right(x, F.lit(REACH)))).otherwise(x)
        sides = F.zip_with(F.transform(pieces, short), F.transform(found, short), lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        rows = F.zip_with(F.zip_with(_ends(sizes), found, lambda e, m: F.struct(e.alias("end"), m.alias("match"))), F.sequence(F.lit(0), F.size(found) - 1), lambda s, i: F.struct(s["end"].alias("end"), s["match"].alias("match"), i.alias("i")))
        return _let(sides, lambda beside: F.transform(F.filter(rows, lambda s: _valid(kind, s["match"])), lambda s: scored(beside, s)))

    def scored(beside: Column, s: Column) -> Column:
        first = F.greatest(s["i"] - REACH, F.lit(0))
        left = F.concat(F.array_join(F.transform(F.slice(beside, first + 1, s["i"] - first), lambda b: F.concat(b["piece"], b["match"])), ""), F.get(beside, s["i"])["piece"])
        right = F.array_join(F.transform(F.slice(beside, s["i"] + 2, F.lit(REACH)), lambda b: F.concat(b["piece"], F.coalesce(b["match"], F.lit("")))), "")
        near = F.lower(F.concat(F.right(left, F.lit(REACH)), F.lit(" "), F.left(right, F.lit(REACH))))
        words = F.split(near, r"[^a-z0-9-]+")
        bonus = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONTEXT[kind]])), BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), (s["end"] - F.length(s["match"])).alias("start"), s["end"].alias("end"), F.round(F.lit(PRIOR[kind]) + bonus, 3).alias("score"))

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    # Where no match is possible the expression is not evaluated at all.
    there = F.contains(text, F.lit(must)) if must else F.lit(True)
    return F.when(there & text.rlike(pattern), _let(cut, confirmed)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS), text: str = "text") -> DataFrame:
    """All rows and columns of `docs` and pii: array of (kind, start, end, score), by kind as listed, then start.

    Positions count code points of the whole text, the end exclusive. Matches of one kind do not overlap and
    are taken leftmost first; one that fails its check is dropped and not retried. A null or empty text has
    none; a column of the name pii is replaced; rows are independent of each other, so ties, repeated rows
    and empty tables need no rule. Work grows with a text's length and its number of spans, not their product.
    """
    whole = text_of(text)
    found = docs.withColumns({f"pii_{k}_": _spans(k, whole) for k in kinds})
    return found.withColumn("pii", F.concat(*[F.col(f"pii_{k}_") for k in kinds])).drop(*[f"pii_{k}_" for k in kinds])


def masked(found: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of find_pii() with every span that scores `least` or more replaced by its kind in brackets.

    Overlapping spans of different kinds are replaced once, by the kind of the first.
    """
    order = F.array_sort(F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, zero, step)
    return found.withColumn(text, F.when(F.size("pii") > 0, F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(F.col(text))))).otherwise(F.col(text)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and digests of personal data in `documents`, all spans and their scores."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    key = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, key), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", key), ",").alias("spans"), F.array_join(F.transform("pii", lambda s: F.format_string("%.3f", s["score"])), ",").alias("scores"))
