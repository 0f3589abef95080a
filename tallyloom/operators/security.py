"""Row-level security and masking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names and value patterns by kind of personal data (fixed values of this operator).
KINDS = {
    "email": (r"e-?mail", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    "ssn": (r"ssn|social.?sec", r"^\d{3}-\d{2}-\d{4}$"),
    "phone": (r"phone|mobile|fax|tel(_|$)", r"^(?!\d{1,3}(\.\d{1,3}){3}$)\+?[0-9][0-9 ().-]{7,}[0-9]$"),
    "name": (r"(first|last|full|customer|user|contact)_?name", None),
    "address": (r"address|street|zip|postal", None),
    "dob": (r"dob|birth", None),
    "card": (r"card|credit", r"^\d{4}([ -]?\d{4}){3}$"),
    "ip": (r"(^|_)ip(_|$)|ip_?addr", r"^\d{1,3}(\.\d{1,3}){3}$"),
    "passport": (r"passport", None),
    "national_id": (r"national_?id|tax_?id", None),
}


def allowed_values(df: DataFrame, mapping: DataFrame, user: str, column: str, user_column: str = "user", value_column: str = "value") -> DataFrame:
    """Only rows whose value the user is mapped to; without a mapping none."""
    mine = mapping.filter(F.col(user_column) == user).select(F.col(value_column).alias("\0v"))
    return df.join(mine, F.col(column) == F.col("\0v"), "left_semi")


def own_rows(df: DataFrame, column: str, user: str | None = None) -> DataFrame:
    return df.filter(F.col(column) == (F.current_user() if user is None else F.lit(user)))


def by_dimension(fact: DataFrame, dimension: DataFrame, keys: tuple[str, str], condition: Column) -> DataFrame:
    """Only rows whose dimension row meets a condition."""
    return fact.join(dimension.filter(condition), fact[keys[0]] == dimension[keys[1]], "left_semi")


def member_of(df: DataFrame, groups: DataFrame, user: str, group: str, condition: Column) -> DataFrame:
    """All rows for members of a group, else those that meet the condition."""
    flag = groups.filter((F.col("user") == user) & (F.col("group") == group)).agg((F.count(F.lit(1)) > 0).alias("\0in"))
    return df.crossJoin(flag).filter(F.col("\0in") | condition).drop("\0in")  # one row


def combine(roles: dict[str, str], how: str = "or") -> Column:
    """Roles' SQL predicates as one condition; predicates that are written alike count once. Without roles nothing is visible."""
    different = list(dict.fromkeys(" ".join(p.split()) for p in roles.values()))
    if not different:
        return F.lit(False)
    return reduce((lambda a, b: a | b) if how == "or" else (lambda a, b: a & b), [F.expr(f"({p})") for p in different])


def consolidate(roles: list[tuple[str, str, str, str]], how: str = "or") -> dict[str, dict[str, str]]:
    """Roles of several sources, each (source, role, table, SQL predicate), as {role: {table: predicate}}.

    Predicates of one role and table that are written alike count once; different ones are joined by or, by and, or, with
    "namespace", kept apart as roles `source.role`. A role of one name over several tables keeps a predicate for each.
    """
    if how not in ("or", "and", "namespace"):
        raise ValueError(how)
    found: dict[tuple[str, str], dict[str, list[str]]] = {}
    for source, role, table, predicate in roles:
        found.setdefault((role, table), {}).setdefault(" ".join(predicate.split()), []).append(source)
    apart = {role for (role, _), predicates in found.items() if how == "namespace" and len(predicates) > 1}
    out: dict[str, dict[str, str]] = {}
    for (role, table), predicates in found.items():
        if role in apart:
            for predicate, sources in predicates.items():
                for source in sources:
                    mine = out.setdefault(f"{source}.{role}", {})
                    mine[table] = f"{mine[table]} AND ({predicate})" if table in mine else f"({predicate})"
        else:
            out.setdefault(role, {})[table] = f" {how if how != 'namespace' else 'or'} ".join(f"({p})" for p in predicates)
    return out


def visible(df: DataFrame, table: str, roles: dict[str, dict[str, str]]) -> DataFrame:
    """(role, the row) for every role of consolidate() and row of a table that it sees, in one scan; a role without a
    predicate for the table sees all of it."""
    seen = F.array_compact(F.array(*[F.when(F.expr(tables.get(table, "true")), F.lit(role)) for role, tables in roles.items()]))
    return df.withColumn("role", F.explode(seen)).select("role", *[c for c in df.columns if c != "role"])


def propagate(fact: DataFrame, *filtered: tuple[DataFrame, str, str]) -> DataFrame:
    """Filters of dimensions passed on to the fact along its relationships."""
    for dim, fk, dk in filtered:
        fact = fact.join(dim, fact[fk] == dim[dk], "left_semi")
    return fact


def classify(df: DataFrame, share: float = 0.5) -> DataFrame:
    """(column, kind, by, share): personal data by column name, or by the share of values that look like it.

    All text columns and all rows are read once, in one aggregate.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    valued = {k: p for k, (_, p) in KINDS.items() if p}
    out = []
    for c in df.columns:
        out += [(c, k, "name", None) for k, (n, _) in KINDS.items() if re.search(n, c.lower())]
    named = df.sparkSession.createDataFrame(out, "column string, kind string, by string, share double")
    if not texts:
        return named
    rates = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.rlike(F.col(c), F.lit(p)).cast("int"))).alias(f"{i}|{k}") for i, c in enumerate(texts) for k, p in valued.items()])
    long = rates.unpivot([], rates.columns, "key", "share").filter(F.col("share") >= share)
    index = F.split_part("key", F.lit("|"), F.lit(1)).cast("int")
    found = long.select(F.array(*[F.lit(c) for c in texts])[index].alias("column"), F.split_part("key", F.lit("|"), F.lit(2)).alias("kind"), F.lit("value").alias("by"), "share")
    return named.unionByName(found)


def masked(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """By label: hash (SHA-256), mask (letters and digits), null, drop; other labels leave the column."""
    make = {"hash": lambda c: F.sha2(F.col(c).cast("string"), 256), "mask": lambda c: F.mask(F.col(c).cast("string")), "null": lambda c: F.lit(None).cast(df.schema[c].dataType)}
    return df.select(*[make[labels[c]](c).alias(c) if labels.get(c) in make else F.col(c) for c in df.columns if labels.get(c) != "drop"])
