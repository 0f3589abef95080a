"""Line dedup by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, text_of

#: Near copies are sought among lines of at least this many characters; shorter ones must be equal.
MIN_CHARS = 20
#: Variants are made within blocks of this many characters whose surroundings agree.
BLOCK = 64


def _row(text: str | Column) -> Column:
    return F.xxhash64(text_of(text))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line_no, line): the lines of every whole text, trimmed, without blank ones. Line numbers start at 0.

    row is a hash of the whole text: it tells rows of one id apart.
    """
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), _row(text).alias("row"), F.posexplode(F.split(text_of(text), "\n")).alias("line_no", "line"))
    return cut.withColumn("line", F.trim("line")).filter("line <> ''")


def _ends(line: Column, n: Column) -> Column:
    """Hashes of a line's first and last block, whose length is a power of two of at most half the line.

    Two lines one edit apart share one of them: where the next shorter length has a smaller block, the
    smaller blocks are given too.
    """
    block = lambda m: F.expr(f"shiftleft(1, length(bin({m})) - 2)")
    both = lambda b: [F.xxhash64(F.lit("head"), b, F.substring(line, F.lit(1), b)), F.xxhash64(F.lit("tail"), b, F.substring(line, n - b + 1, b))]
    large, small = block("n"), block("n - 1")
    return F.when(large == small, F.array(*both(large))).otherwise(F.array(*both(large), *both(small)))


def _contexts(some: DataFrame) -> DataFrame:
    """Each line once for each of its blocks of BLOCK characters and each role in a pair, with the text of the block.

    Lines one edit apart agree outside one block: lines of one length with blocks cut alike ("same"), lines
    that differ by one in length if the longer one's block is longer by one ("long" and "short", one key).
    """
    line, n, start = F.col("line"), F.col("n"), F.col("start")

    def role(name: str, length: Column, kind: str, extra: int) -> Column:
        rest = F.substring(line, start + BLOCK + extra + 1, n)
        key = F.xxhash64(F.lit(kind), length, start, F.substring(line, F.lit(1), start), F.lit("|"), rest)
        return F.struct(F.lit(name).alias("role"), key.alias("context"), F.substring(line, start + 1, F.lit(BLOCK + extra)).alias("mid"))

    roles = F.array(role("same", n, "s", 0), role("short", n, "i", 0), role("long", n - 1, "i", 1))
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK))
    return some.withColumn("start", F.explode(starts)).select("at", "start", F.inline(roles))


def near_links(some: DataFrame) -> DataFrame:
    """(at, line, n) of different lines -> (at, of): each line's verified neighbours, one for each group it is in.

    Blocks whose surroundings another line shares emit their deletion variants as hashes: the block with one
    character left out and its position, and, for the shorter of two, the block itself. Blocks with equal
    variants at one position are one change apart from each other, so each is linked to the earliest only.
    """
    contexts = _contexts(some)
    counts = contexts.groupBy("context").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low <> high").select("context")
    near = contexts.join(counts, "context")
    mid, size = F.col("mid"), F.char_length("mid")
    without = lambda p: F.concat(F.substring(mid, F.lit(1), p - 1), F.substring(mid, p + 1, size))
    each = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda p: F.struct(F.xxhash64(without(p)).alias("variant"), p.alias("p")))
    kept = F.when(F.col("role") == "short", F.array(F.struct(F.xxhash64(mid).alias("variant"), F.lit(0).alias("p")))).otherwise(each)
    variants = near.select("context", "role", "at", "start", F.inline(kept)).withColumn("p", F.when(F.col("role") == "same", F.col("p")).otherwise(0)).distinct()
    group = Window.partitionBy("context", "variant", "p")
    least = variants.select("at", "start", "role", F.min("at").over(group).alias("least"), F.min(F.when(F.col("role") == "short", F.col("at"))).over(group).alias("short"), F.min(F.when(F.col("role") == "long", F.col("at"))).over(group).alias("long"))
    of = F.when(F.col("role") == "same", F.col("least")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    links = least.select("at", "start", "role", of.alias("of")).filter("of < at").distinct()
    pairs = links.join(some.select("at", "line", "n"), "at").join(some.select(F.col("at").alias("of"), F.col("line").alias("of_line"), F.col("n").alias("of_n")), "of")
    # Verification: equal before and after the block, and one edit inside it.
    part = lambda text, size: F.substring(text, F.col("start") + 1, F.col(size) - (F.least("n", "of_n") - F.least(F.least("n", "of_n"), F.col("start") + BLOCK)) - F.col("start"))
    tail = lambda text, size: F.substring(text, F.col(size) - (F.least("n", "of_n") - F.least(F.least("n", "of_n"), F.col("start") + BLOCK)) + 1, F.col(size))
    equal = (F.substring("line", F.lit(1), F.col("start")) == F.substring("of_line", F.lit(1), F.col("start"))) & (tail(F.col("line"), "n") == tail(F.col("of_line"), "of_n"))
    one = F.levenshtein(part(F.col("line"), "n"), part(F.col("of_line"), "of_n")) == 1
    return pairs.filter(equal & one).select("at", "of")


def near_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line that has an earlier copy: (doc_id, row, line_no, of_doc, of_line, distance).

    Lines are in order of (doc_id, row, line_no), a null doc_id first; row, a hash of the whole text, tells rows of one id apart. A line is a copy if an earlier one is equal to
    it or, both having `min_chars` characters or more, one edit away (a character changed, added or left out), which
    is a similarity of 0.95 or more; (of_doc, of_line) is such a line, equal ones first, then the earliest. The
    bound is one at every length: a line of 400 characters with two changes is kept, similar as it is.

    Equal lines are grouped by 128 hash bits and a length. Of the different lines, those that share their first
    or last block with another go on to the deletion-neighbourhood join of `near_links`; this filter loses none.
    Blank lines, null and empty texts have no lines here. Rows that repeat both id and text count as one document, so that
    repeated rows are not copies of each other; rows of one id with other texts are documents of their own. Other columns are
    not read.
    """
    lines = lines_of(docs, key, text).withColumn("n", F.char_length("line"))
    marked = lines.select(F.struct("doc_id", "row", "line_no").alias("at"), F.xxhash64("line").alias("h0"), F.xxhash64(F.lit(1), "line").alias("h1"), "n", F.when(F.col("n") >= min_chars, _ends(F.col("line"), F.col("n"))).alias("ends"))
    first = stash(marked.groupBy("h0", "h1", "n").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("ends").alias("ends")))
    ends = first.select("first", "h0", F.explode("ends").alias("end"))
    common = ends.groupBy("end").agg(F.min("h0").alias("low"), F.max("h0").alias("high")).filter("low <> high").select("end")
    wanted = ends.join(common, "end").select("first.doc_id", "first.row", "first.line_no").distinct()
    by_doc = wanted.groupBy("doc_id", "row").agg(F.collect_list("line_no").alias("wanted"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), _row(text).alias("row"), F.col(text).alias("text")).alias("d")
    same = (F.col("d.row") == F.col("w.row")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    cut = texts.join(by_doc.alias("w"), same).select("d.doc_id", "d.row", F.split(text_of("text"), "\n").alias("all"), F.explode("wanted").alias("line_no"))
    line = F.trim(F.get("all", "line_no"))
    some = cut.select(F.struct("doc_id", "row", "line_no").alias("at"), line.alias("line"), F.char_length(line).alias("n")).filter("line is not null").dropDuplicates(["at"])
    near = near_links(stash(some)).groupBy("at").agg(F.min("of").alias("of")).withColumnRenamed("at", "near_at")
    # A near copy's own copies are equal to it, so that they have an earlier line too.
    gone = first.join(near, F.col("first") == F.col("near_at"), "left").filter("of is not null or first < last").select("h0", "h1", "n", "first", "of")
    all_lines = marked.select("h0", "h1", "n", "at").join(gone, ["h0", "h1", "n"])
    again = F.col("at") != F.col("first")
    source = F.when(again, F.col("first")).otherwise(F.col("of"))
    found = all_lines.filter(again | F.col("of").isNotNull()).select("at", source.alias("of"), F.when(again, 0).otherwise(1).cast("long").alias("distance"))
    return found.select("at.doc_id", "at.row", "at.line_no", F.col("of.doc_id").alias("of_doc"), F.col("of.line_no").alias("of_line"), "distance")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of `docs`, the text without the lines that have an earlier copy, and three more columns.

    `lines_gone`, the number of lines left out; `lines_near`, how many of them were near copies only;
    `all_gone`, whether the text had lines that are not blank and none is left. Blank lines stay.
    Null texts stay null. See `near_lines` for what a copy is.
    """
    clash = {"lines_gone", "lines_near", "all_gone"} & set(docs.columns)
    found = near_lines(docs, key, text, min_chars).distinct()
    by_doc = found.groupBy(F.col("doc_id").alias("gone_doc"), F.col("row").alias("gone_row")).agg(F.array_sort(F.collect_set("line_no")).alias("gone_lines"), F.sum("distance").alias("gone_near"))
    same = (_row(text) == F.col("gone_row")) & F.col(key).cast("long").eqNullSafe(F.col("gone_doc"))
    rows = (docs.drop(*clash) if clash else docs).join(by_doc, same, "left")
    # One flag a line, up to the last that goes; joining leaves out nulls.
    befores = F.concat(F.array(F.lit(-1)), F.slice("gone_lines", F.lit(1), F.size("gone_lines") - 1))
    flags = F.flatten(F.zip_with("gone_lines", befores, lambda at, before: F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True)))))
    kept = F.array_join(F.zip_with(F.split(text, "\n"), flags, lambda line, gone: F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(line)), "\n")
    after = F.when(F.col("gone_lines").isNull(), F.col(text)).otherwise(kept)
    rows = rows.withColumn("after", after)
    out = [F.col("after").alias(c) if c == text else F.col(c) for c in docs.columns if c not in clash]
    return rows.select(*out, F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("lines_gone"), F.coalesce("gone_near", F.lit(0)).cast("long").alias("lines_near"), (F.col("gone_lines").isNotNull() & (F.trim(F.translate("after", "\n", " ")) == "")).alias("all_gone"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without the lines that have an earlier copy: per document its counts and the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_gone", "lines_near", "text")


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents
), t AS (
  SELECT doc_id, line_no, raw, trim(raw, ' ') AS line, doc_id * 1000000 + line_no AS place FROM l
), f AS (
  SELECT line, min(place) AS place, length(line) AS n FROM t WHERE line <> '' GROUP BY line
), h AS (
  SELECT *, n // 2 AS m FROM f WHERE n >= 20
), k AS (
  SELECT *, 'a' || (n // 2) || left(line, n // 2) AS k FROM h UNION ALL
  SELECT *, 'b' || (n // 2) || right(line, n - n // 2) AS k FROM h UNION ALL
  SELECT *, 'c' || n || left(line, n // 2) AS k FROM h UNION ALL
  SELECT *, 'c' || (n - 1) || left(line, (n - 1) // 2) AS k FROM h UNION ALL
  SELECT *, 'd' || n || right(line, n - n // 2) AS k FROM h UNION ALL
  SELECT *, 'd' || (n - 1) || right(line, n - 1 - (n - 1) // 2) AS k FROM h
), near AS (
  SELECT DISTINCT x.place FROM k x JOIN k y ON x.k = y.k AND x.place > y.place AND abs(x.n - y.n) <= 1 WHERE levenshtein(x.line, y.line) = 1
), g AS (
  SELECT t.*, t.line <> '' AND (t.place > f.place OR near.place IS NOT NULL) AS gone, t.line <> '' AND t.place = f.place AND near.place IS NOT NULL AS by_near
  FROM t LEFT JOIN f ON t.line = f.line LEFT JOIN near ON f.place = near.place AND t.place = f.place
)
SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS lines_gone, CAST(count(*) FILTER (WHERE by_near) AS BIGINT) AS lines_near,
       coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
FROM g GROUP BY doc_id
"""
