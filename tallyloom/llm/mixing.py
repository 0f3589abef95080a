"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, text_of

#: The contract's weights, dealt to the sources in code-point order, null last.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target: `share` of the sum by weight, none above `most` x its source.

    The excess of capped sources is reshared by weight: a source is capped if its cap per weight is at or
    below the level at which the budget is spent, found by one pass in order of cap per weight. The table has a row
    per source and is sorted in one task: it is meant for up to some millions of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("budget", share * F.sum("source_size").over(every))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("place", F.row_number().over(by_cap))
    # In this order the first source that the level does not reach fixes it for all that follow.
    fixed = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(every)["level"]
    ranked = ranked.withColumn("fixed", fixed)
    return ranked.select("source", "source_size", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed") * F.col("weight"))).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone, so that reruns agree (52 bits of MD5)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


#: Width of the intervals in which a source's keys are counted, and rows of a cell cut from one.
STEP, CELL_ROWS = 0.125, 50_000


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", importance: Column | None = None, cell_rows: int = CELL_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its size in words, its source's size and target, and the words the mix takes of it.

    A row's expected copies are its source's target over its source's size, m, times its importance over the source's
    mean importance (by words; 1 for all if none is given). Where that would pass `most`, the source's spread
    around m is narrowed so that the largest is `most` and the sum stays. Whole copies are certain; the fraction
    left is its inclusion probability p. Rows are ranked by Pareto keys, log of (u/(1-u)) / (p/(1-p)), and taken
    from the smallest on until the source's target is met; the last one is taken in part. A row with nothing left
    to draw ranks behind all others, in order of u, and serves only if the rest falls short.

    No rows are sorted but those of one cell for each source: keys are counted in steps, crowded steps are cut
    evenly into cells of about `cell_rows` rows, the cells' sums tell in which one a target is met, and only a
    source's last key returns to the rows. So a source with a third of all rows is spread over many tasks,
    whatever its inclusion odds, and the columns in `keep` are never shuffled.

    Null texts have size 0 and take nothing; null sources form one source, last; null keys rank by their
    text; rows that tie with the last one share what is left by size, rounded; an empty table gives an empty result.
    Columns of other names are dropped unless listed in `keep`.
    """
    extra = [c for c in keep if c not in (key, source)]
    size = F.size(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))).cast("long")
    importance_ = F.coalesce(importance, F.lit(0.0)) if importance is not None else F.lit(1.0)
    # Extra columns travel as one, whatever their names.
    named = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.struct(*extra, F.lit(0).alias("\0")).alias("kept_"), F.when(F.col(key).isNull(), F.md5(text_of(text))).alias("other_"), importance_.cast("double").alias("weight_"))
    named = named.withColumn("u_", uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("other_")), seed)).drop("other_")
    light = stash(named.select("source", "size", "weight_", "u_", *([] if extra else ["doc_id"])))
    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("weight_") * F.col("size")).alias("weighted"), F.max("weight_").alias("greatest"))
    targets = source_targets(sums.select("source", "source_size"), weights, share, most)
    joined = targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "weighted", "greatest")
    mean, over = F.col("weighted") / F.col("source_size"), F.col("greatest") * F.col("source_size") / F.col("weighted") - 1
    m = F.col("target") / F.col("source_size")
    level = F.when(F.col("source_size") > 0, m).otherwise(0.0)
    spread = F.when((F.col("source_size") > 0) & (F.col("weighted") > 0), F.when(over > 0, F.least(m, (most - m) / over)).otherwise(m)).otherwise(0.0)
    per_source = stash(joined.select(F.col("source").alias("of_source"), "source_size", "target", level.alias("level"), spread.alias("spread"), F.when(F.col("weighted") > 0, mean).otherwise(1.0).alias("mean"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("source_no")))

    def ranked(rows: DataFrame) -> DataFrame:
        """Rows with their whole copies, what may be drawn, and the Pareto key."""
        found = rows.join(per_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        found = found.withColumn("x_", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("level") + F.col("spread") * (F.col("weight_") / F.col("mean") - 1))))
        found = found.withColumn("copies", F.floor("x_")).withColumn("p_", F.col("x_") - F.floor("x_"))
        drawn = F.ln(F.col("u_") / (1 - F.col("u_"))) - F.ln(F.col("p_") / (1 - F.col("p_")))
        found = found.withColumn("rank_", F.when(F.col("p_") > 0, drawn).otherwise(200 + F.col("u_")))
        return found.withColumn("more", F.when(F.col("copies") + 1 <= most, F.col("size")).otherwise(F.lit(0).cast("long")))

    keys = stash(ranked(light).select("source_no", "rank_", "more", (F.col("copies") * F.col("size")).alias("sure")))
    at = F.floor(F.col("rank_") / STEP)
    steps = keys.groupBy("source_no", at.alias("step_")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / cell_rows)).alias("cuts"))
    celled = keys.withColumn("step_", at).join(steps, ["source_no", "step_"]).withColumn("cell_", F.floor((F.col("rank_") / STEP - F.col("step_")) * F.col("cuts")))
    cells = celled.groupBy("source_no", "step_", "cell_").agg(F.sum("more").alias("cell_more"), F.sum("sure").alias("cell_sure"))
    every, on = Window.partitionBy("source_no"), Window.partitionBy("source_no").orderBy("step_", "cell_")
    placed = cells.withColumn("rest", F.sum("cell_sure").over(every)).withColumn("all_more", F.sum("cell_more").over(every)).withColumn("before", F.sum("cell_more").over(on) - F.col("cell_more"))
    placed = placed.join(per_source.select("source_no", "target"), "source_no").withColumn("rest", F.round("target").cast("long") - F.col("rest"))
    last = stash(placed.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("cell_more"))))
    within = celled.join(last.select("source_no", "step_", "cell_", "rest", "before"), ["source_no", "step_", "cell_"]).groupBy("source_no", "rank_").agg(F.sum("more").alias("tied"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    so_far = F.col("before") + F.sum("tied").over(Window.partitionBy("source_no").orderBy("rank_"))
    cut = within.withColumn("so_far", so_far).filter((F.col("so_far") >= F.col("rest")) & (F.col("so_far") - F.col("tied") < F.col("rest")))
    cut = cut.select("source_no", F.col("rank_").alias("cut_rank"), (F.col("rest") - F.col("so_far") + F.col("tied")).alias("cut_words"), "tied")
    # A source without such a cell takes all that may be drawn, or nothing.
    whole = placed.groupBy("source_no").agg(F.first("rest").alias("rest"), F.first("all_more").alias("all_more"))
    ends = stash(whole.join(cut, "source_no", "left").select(F.col("source_no").alias("end_no"), F.coalesce("cut_rank", F.when(F.col("rest") > 0, float("inf")).otherwise(float("-inf"))).alias("cut_rank"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"), F.greatest(F.coalesce("tied", F.lit(1)), F.lit(1)).alias("tied")))
    final = ranked(named if extra else light).join(ends, F.col("source_no") == F.col("end_no"))
    drawn = F.when(F.col("rank_") < F.col("cut_rank"), F.col("more")).when(F.col("rank_") == F.col("cut_rank"), F.round(F.col("cut_words") * F.col("more") / F.col("tied"))).otherwise(0)
    return final.withColumn("taken", (F.col("copies") * F.col("size") + drawn).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken", *[F.col(f"kept_.`{c}`") for c in extra])


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """Write the mix out: a row for each whole copy taken, and one cut after its first words for a part, white space kept."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    words, gaps = F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), F.split(text_of(text), WORD)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), part), F.slice(words, F.lit(1), part), lambda g, w: F.length(g) + F.length(w))
    prefix = F.when(part > 0, F.substring(F.col(text), F.lit(1), F.aggregate(sizes, F.lit(0), lambda a, n: a + n)))
    pieces = F.concat(F.array_repeat(F.col(text), whole), F.when(part > 0, F.array(prefix)).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn(text, F.explode(pieces))


def by_length(text: str = "text") -> Column:
    """Importance from 100 to 1000: longer texts are likelier to be drawn, very short ones least."""
    size = F.size(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)))
    return F.lit(100) + F.floor(900 * size / (size + 200))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of `documents`: 150 % of all words, weights 3, 1, 2, at most twice a source; odds by length."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, importance=by_length()).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3.0, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM s
), lim AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM w
), lev AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM lim
), fix AS (
  SELECT arg_min(level, place) AS fixed FROM lev WHERE level * weight < cap
), t AS (
  SELECT source, source_size, CASE WHEN fixed IS NULL THEN cap ELSE least(cap, fixed * weight) END AS target FROM lev, fix
), g AS (
  SELECT d.*, target, source_size, (100 + 900 * size // (size + 200))::DOUBLE AS weight_ FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, target / source_size::DOUBLE AS m, sum(weight_ * size) OVER s AS weighted, max(weight_) OVER s AS greatest FROM g WINDOW s AS (PARTITION BY source)
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN greatest(0.0, least(2.0, m + (CASE WHEN weighted > 0 THEN CASE WHEN greatest * source_size / weighted - 1 > 0 THEN least(m, (2.0 - m) / (greatest * source_size / weighted - 1)) ELSE m END ELSE 0 END)
           * (weight_ / (CASE WHEN weighted > 0 THEN weighted / source_size ELSE 1 END) - 1))) ELSE 0.0::DOUBLE END AS x,
         (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM b
), r AS (
  SELECT *, floor(x) AS copies, x - floor(x) AS p, CASE WHEN floor(x) + 1 <= 2 THEN size ELSE 0 END AS more FROM e
), k AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) ELSE 1e80 * (1 + u) END AS q FROM r
), c AS (
  SELECT *, sum(copies * size) OVER (PARTITION BY source) AS sure,
         sum(more) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - more AS before
  FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + least(more, greatest(0, CAST(round(target) AS BIGINT) - sure - before)) AS BIGINT) AS taken
FROM c
"""
