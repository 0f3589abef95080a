"""Profiles, keys, drift, equivalence, fuzzy matching and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, rows, nulls, distinct, min, max) of every column, in one aggregate; min and max as text."""
    count = F.approx_count_distinct if approximate else lambda c: F.count_distinct(c)
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    aggs = [a for i, c in enumerate(plain) for a in (F.count_if(F.col(c).isNull()).cast("string").alias(f"{i}|nulls"), count(F.col(c)).cast("string").alias(f"{i}|distinct"), F.min(c).cast("string").alias(f"{i}|min"), F.max(c).cast("string").alias(f"{i}|max"))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    one = lambda i, c: F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"`{i}|{k}`").alias(k) for k in ("nulls", "distinct", "min", "max")])
    out = row.select(F.inline(F.array(*[one(i, c) for i, c in enumerate(plain)])))
    return out.withColumns({k: F.col(k).cast("long") for k in ("nulls", "distinct")})


def inclusion(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: distinct keys of either side, how many of the child's the parent lacks, and whether that makes a foreign key."""
    a = child.select(F.col(child_key).alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("\0a"))
    b = parent.select(F.col(parent_key).alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("\0b"))
    both = a.join(b, "k", "full").agg(F.count("\0a").alias("child_keys"), F.count("\0b").alias("parent_keys"), F.count_if(F.col("\0b").isNull()).alias("missing"), F.coalesce(F.max("\0b"), F.lit(0)).alias("\0most"))
    return both.select("child_keys", "parent_keys", "missing", ((F.col("missing") == 0) & (F.col("\0most") == 1)).alias("is_foreign_key"))


def _values(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(value, at): the different values of columns as text, each column by its place in the list; one scan a table."""
    place = {c: i for i, c in enumerate(columns)}
    each = [df.select(F.inline(F.array(*[F.struct(F.lit(place[t, c]).alias("at"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns if (t, c) in place]))) for t, df in tables.items() if any((t, c) in place for c in df.columns)]
    return reduce(DataFrame.unionAll, each).filter("value is not null").distinct()


def _shared_values(values: DataFrame) -> DataFrame:
    """(a, b, shared): how many different values each two columns share, and (a, a) how many one has.

    A value meets the columns that hold it, at most as many as there are, so no two tables are joined.
    """
    held = values.groupBy("value").agg(F.collect_set("at").alias("ats"))
    return held.select(F.explode("ats").alias("a"), "ats").select("a", F.explode("ats").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _overlaps(tables: dict[str, DataFrame], columns: list[tuple[str, str]], pairs: list[tuple[int, int]]) -> DataFrame:
    """(child, child_key, parent, parent_key, child_values, parent_values, shared) of listed pairs of columns, exactly."""
    spark = next(iter(tables.values())).sparkSession
    wanted = spark.createDataFrame(pairs, "a int, b int")  # from schemas or signatures, not from rows
    names = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(columns)], "i int, table string, column string")
    counts = _shared_values(_values(tables, columns))
    own = counts.filter("a = b")
    out = wanted.join(own.select("a", F.col("shared").alias("child_values")), "a", "left").join(own.select("b", F.col("shared").alias("parent_values")), "b", "left").join(counts, ["a", "b"], "left")
    out = out.join(names.select(F.col("i").alias("a"), F.col("table").alias("child"), F.col("column").alias("child_key")), "a").join(names.select(F.col("i").alias("b"), F.col("table").alias("parent"), F.col("column").alias("parent_key")), "b")
    return out.select("child", "child_key", "parent", "parent_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("child_values", "parent_values", "shared")])


def suggest_keys(tables: dict[str, DataFrame], suffixes: tuple[str, ...] = ("key", "id", "code")) -> DataFrame:
    """(child, child_key, parent, parent_key, overlap) for key columns of different tables whose names end alike.

    Candidates come from the schemas; the overlap is the share of the child's distinct values that the parent has. Each
    table is read once, however many candidates it has; values are compared as text.
    """
    tail = lambda c: c.lower().split("_", 1)[-1] if "_" in c else c.lower()
    keys = [(t, c) for t, df in tables.items() for c in df.columns if c.lower().endswith(suffixes)]
    pairs = [(i, j) for i, (t1, c1) in enumerate(keys) for j, (t2, c2) in enumerate(keys) if t1 != t2 and tail(c1) == tail(c2)]
    if not pairs:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "child string, child_key string, parent string, parent_key string, overlap double")
    return _overlaps(tables, keys, pairs).select("child", "child_key", "parent", "parent_key", F.try_divide("shared", "child_values").alias("overlap"))


def signatures(tables: dict[str, DataFrame], columns: list[tuple[str, str]], size: int = 64) -> DataFrame:
    """(at, signature): the MinHash signature of each column's different values, by one aggregate over all columns."""
    least = [F.min(F.xxhash64(F.lit(i), "value")).alias(f"h{i}") for i in range(size)]
    return _values(tables, columns).groupBy("at").agg(*least).select("at", F.array(*[F.col(f"h{i}") for i in range(size)]).alias("signature"))


def overlapping_columns(tables: dict[str, DataFrame], least: float = 0.5, bands: int = 64, rows: int = 1) -> DataFrame:
    """(child, child_key, parent, parent_key, child_values, parent_values, shared, jaccard) of columns of different tables,
    whatever their names, whose sets of values have a Jaccard index of `least` or more.

    Columns meet where a band of `rows` hashes of their signatures is equal: one with index j is missed with probability
    (1 - j^rows)^bands, under 1e-19 at 0.5. Only those that meet are counted exactly. Each table is read twice, however
    many columns there are. Nested columns are left out; of a pair, the column with fewer values is the child.
    """
    columns = [(t, c) for t, df in tables.items() for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary", "variant"))]
    found = signatures(tables, columns, bands * rows)
    banded = found.select("at", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.hash(F.slice("signature", i * rows + 1, F.lit(rows))))).alias("band", "hash"))
    met = banded.join(banded.withColumnRenamed("at", "other"), ["band", "hash"]).filter("at <> other").select("at", "other").distinct().collect()  # pairs of columns
    pairs = [(r.at, r.other) for r in met if columns[r.at][0] != columns[r.other][0]]
    counted = _overlaps(tables, columns, pairs).filter("child_values < parent_values or (child_values = parent_values and (child, child_key) < (parent, parent_key))")
    jaccard = F.try_divide(F.col("shared"), F.col("child_values") + F.col("parent_values") - F.col("shared"))
    return counted.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= least)


def jaccard_values(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """One row: shared and all different values of two columns, and their ratio."""
    both = a.select(F.col(x).alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(y).alias("v"), F.lit(2).alias("s"))).filter("v is not null")
    sides = both.groupBy("v").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return sides.agg(F.count_if(F.col("lo") < F.col("hi")).alias("shared"), F.count(F.lit(1)).alias("all_values")).withColumn("jaccard", F.try_divide("shared", "all_values"))


def jaccard_columns(a: DataFrame, b: DataFrame) -> float:
    """Of two tables' column names."""
    x, y = {c.lower() for c in a.columns}, {c.lower() for c in b.columns}
    return len(x & y) / max(len(x | y), 1)


def full_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A full join in which null keys meet null keys; the keys come once, first."""
    other = b.withColumnsRenamed({k: "\0key_" + k for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("\0key_" + k)) for k in keys], F.lit(True))
    rest = [c for df in (a, b) for c in df.columns if c not in keys]
    return a.join(other, same, "full").select(*[F.coalesce(k, "\0key_" + k).alias(k) for k in keys], *rest)


def equivalence(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """passed, failed or missing for every key, null keys included; values that are no numbers must be equal as text.

    Numbers of numeric types are compared as they are, texts as numbers where both read as numbers; expected and actual are shown as text.
    """
    side = lambda df, name, mark: df.select(*keys, F.col(value).cast("string").alias(name), F.col(value).try_cast("double").alias(mark + "n"), F.lit(True).alias(mark))
    both = full_null_safe(side(expected, "expected", "\0e"), side(actual, "actual", "\0a"), keys)
    x, y = F.col("\0en"), F.col("\0an")
    numeric = x.isNotNull() & y.isNotNull()
    near = F.when(numeric, F.when(x == 0, F.abs(y) <= tolerance).otherwise(F.abs(y - x) / F.abs(x) <= tolerance)).otherwise(F.col("expected").eqNullSafe(F.col("actual")))
    status = F.when(F.col("\0e").isNull() | F.col("\0a").isNull(), "missing").when(near, "passed").otherwise("failed")
    return both.select(*keys, "expected", "actual", status.alias("status"))


def equivalence_report(checked: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checked.agg(n("passed"), n("failed"), n("missing"), F.count(F.lit(1)).alias("total")).withColumn("overall", F.when((F.col("failed") == 0) & (F.col("missing") == 0), "passed").otherwise("failed"))


def content_hash(df: DataFrame) -> Column:
    """Order-free digest of all rows, repeated ones included."""
    return F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).cast("string")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, columns, rows, content) to be compared later."""
    one = [df.agg(F.lit(t).alias("table"), F.lit(len(df.columns)).alias("columns"), F.count(F.lit(1)).alias("rows"), content_hash(df).alias("content")) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, one)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (df.select("table", *[F.col(c).alias(f"{s}_{c}") for c in ("columns", "rows", "content")]) for s, df in (("old", before), ("new", after)))
    same = F.col("old_content").eqNullSafe(F.col("new_content")) & (F.col("old_columns") == F.col("new_columns")) & (F.col("old_rows") == F.col("new_rows"))
    status = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "table", "full").select("table", status.alias("status"), "old_rows", "new_rows")


def schema_table(tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, c, k) for t, df in tables.items() for c, k in df.dtypes], "table string, column string, type string")


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or of another type, from two schema tables."""
    a, b = before.withColumnRenamed("type", "old_type"), after.withColumnRenamed("type", "new_type")
    status = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type changed")
    return a.join(b, ["table", "column"], "full").select("table", "column", "old_type", "new_type", status.alias("status")).filter("status is not null")


def row_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with added, removed, modified or unchanged rows; a null key is a key."""
    digest = lambda df, n: df.select(*keys, F.xxhash64(*[F.col(c) for c in sorted(set(df.columns) - set(keys))], F.lit(0)).alias(n))
    both = full_null_safe(digest(before, "\0a"), digest(after, "\0b"), keys)
    status = F.when(F.col("\0a").isNull(), "added").when(F.col("\0b").isNull(), "removed").when(F.col("\0a") != F.col("\0b"), "modified").otherwise("unchanged")
    return both.select(*keys, status.alias("status"))


_BRACKETS = r"^[\[\]]+|[\[\]]+$"


def table_name(x: Column) -> Column:
    """A table's name without schema, brackets, case, blanks, underscores and hyphens; letters of all scripts stay."""
    bare = F.regexp_replace(F.trim(x), _BRACKETS, "")
    return F.translate(F.lower(F.regexp_replace(F.substring_index(bare, ".", -1), _BRACKETS, "")), "_- ", "")


def plain_name(x: Column) -> Column:
    """A name in lower case with underscores for blanks and hyphens."""
    return F.trim(F.translate(F.lower(x), " -", "__"))


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))).otherwise(F.array(x))


def characters(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, ""), lambda t: t != ""))


def _names(df: DataFrame, column: str, normal, name: str, short: str) -> DataFrame:
    """(name, normalised name) once each; what normalises to nothing is left out."""
    return df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn(short, normal(F.col(name))).filter(F.col(short) != "")


def _matches(left: DataFrame, right: DataFrame, tokens, score, threshold: float) -> DataFrame:
    """(ln, rn, score) of all pairs of normalised names with a common token that score `threshold`, by the Jaccard index
    of their tokens or as one is inside the other.

    Spellings that normalise alike are one name here. Sets that are alike share one of their rarest tokens, of which only
    as many are joined as the threshold asks for; a name inside another has its rarest token in common with it.
    """
    sides = [df.select(n).distinct().select(F.col(n).alias("n"), F.explode(tokens(F.col(n))).alias("token")) for df, n in ((left, "ln"), (right, "rn"))]
    counts = sides[0].select("token").unionAll(sides[1].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))

    def ranked(df: DataFrame, short: str) -> DataFrame:
        """Each name's tokens, rarest first; AQE broadcasts the counts where they are few and splits hot tokens where not."""
        sets = df.join(counts, "token").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("t"))
        return sets.select(F.col("n").alias(short + "n"), F.transform("t", lambda s: s["token"]).alias(short + "t"))

    l, r = ranked(sides[0], "l"), ranked(sides[1], "r")
    # Pairs outgrow names by far: few small partitions of names must not become few tasks.
    l = l.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ln")
    some = lambda t: F.slice(t, F.lit(1), (F.size(t) - F.ceil(F.size(t) * threshold - 1e-9) + 1).cast("int"))
    token = lambda df, what: df.withColumn("token", F.explode(what))
    rarest = lambda t: F.slice(t, 1, 1)
    common = F.array_intersect("lt", "rt")
    alike = token(l, some("lt")).join(token(r, some("rt")), "token").filter(F.size("rt").between(F.size("lt") * threshold - 1e-9, F.size("lt") / threshold + 1e-9))
    within = token(l, rarest("lt")).join(token(r, F.col("rt")), "token").filter(F.contains("rn", "ln"))
    around = token(l, F.col("lt")).join(token(r, rarest("rt")), "token").filter(F.contains("ln", "rn"))
    # A pair that is alike counts at its rarest common token only.
    once = alike.withColumn("common", common).filter(F.get("common", F.lit(0)) == F.col("token"))
    pairs = once.unionByName(within.unionByName(around).withColumn("common", common))
    scored = pairs.select("ln", "rn", score(F.size("common") / (F.size("lt") + F.size("rt") - F.size("common"))).cast("double").alias("score"))
    return scored.filter(F.col("score") >= threshold).distinct()


def fuzzy_match(a: DataFrame, x: str, b: DataFrame, y: str, threshold: float = 0.5) -> DataFrame:
    """(left, right, score) of table names at least `threshold` alike, see table_name().

    Equal normalised names score 1, one inside the other the ratio of lengths, others the Jaccard index of their
    bigrams. Names without a common bigram score 0, as do names that normalise to nothing.
    """
    inside = F.contains("ln", "rn") | F.contains("rn", "ln")
    score = lambda jaccard: F.when(F.col("ln") == F.col("rn"), 1.0).when(inside, F.least(F.length("ln"), F.length("rn")) / F.greatest(F.length("ln"), F.length("rn"))).otherwise(jaccard)
    left, right = _names(a, x, table_name, "left", "ln"), _names(b, y, table_name, "right", "rn")
    return left.join(_matches(left, right, bigrams, score, threshold), "ln").join(right, "rn").select("left", "right", "score")


def best_match(a: DataFrame, x: str, b: DataFrame, y: str, threshold: float = 0.7) -> DataFrame:
    """Each name's best partner, see plain_name(): 1 if equal, 0.8 if one is inside the other, else the Jaccard index of
    characters; of equally good ones the smallest. Names expand only once each has its partner."""
    score = lambda jaccard: F.when(F.col("ln") == F.col("rn"), 1.0).when(F.contains("ln", "rn") | F.contains("rn", "ln"), 0.8).otherwise(jaccard)
    left, right = _names(a, x, plain_name, "left", "ln"), _names(b, y, plain_name, "right", "rn")
    named = _matches(left, right, characters, score, threshold).join(right.groupBy("rn").agg(F.min("right").alias("right")), "rn")
    best = named.groupBy("ln").agg(F.min_by("right", F.struct(-F.col("score"), F.col("right"))).alias("right"), F.max("score").alias("score"))
    return left.join(best, "ln").select("left", "right", "score")


def fingerprint(x: Column) -> Column:
    """SHA-256 of the text in lower case with single blanks."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), 256)


def duplicate_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(fingerprint, copies, first key) of texts that occur more than once."""
    return df.groupBy(fingerprint(F.col(text)).alias("fingerprint")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key")).filter("copies > 1")
