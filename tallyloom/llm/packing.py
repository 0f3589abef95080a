"""Packing documents into token windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, table

WINDOW = 4096
#: Lengths are planned in steps of this many tokens.
STEP = 16
#: Rows of a bin that are numbered in one task.
SALT_ROWS = 50_000
#: Each Python worker remembers the ids of short strings between blanks, up to about this many bytes.
REMEMBERED_BYTES, SHORT = 40 << 20, 64
#: What a remembered string takes besides its characters and ids.
ENTRY_BYTES = 200
#: Texts are encoded in runs of this many characters.
PART_CHARS = 1 << 20
#: How a tokenizer must normalize and split for strings between blanks to encode on their own (fixed values of its file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: A string of one id that stands between strings encoded in one call; strings that hold it are encoded alone.
BETWEEN = "|"


def _parts(text: str) -> list[str]:
    """A long text in runs of about PART_CHARS characters, cut at blanks, which no id crosses."""
    out, at = [], 0
    while len(text) - at > PART_CHARS and (cut := text.find(" ", at + PART_CHARS)) >= 0:
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


@cache
def _encoder(path: str):
    """texts -> the little-endian 32-bit ids of each, equal to encoding it as a whole."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    one = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    form = json.loads(tokenizer.to_str())
    between = one(BETWEEN)
    steps = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
    if form["normalizer"] != NORMALIZER or steps[:1] != [SPLITTER] or any(x.get("use_regex") or x.get("add_prefix_space") for x in steps[1:]) or len(between) != 4:
        return lambda texts: [one(t) for t in texts]
    mark = int.from_bytes(between, "little")
    # Printable ASCII passes the normalizer and the byte step as it is, so its pieces go to the model at once.
    plain_piece, model = re.compile("[a-z]+|[0-9]|[^a-z0-9]+").findall, tokenizer.model.tokenize
    as_bytes = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
    known: dict[str, bytes] = {}
    held = 0

    def learn(words: list[str]) -> dict[str, bytes]:
        """No alternative of the splitting pattern crosses a blank, so strings encode on their own."""
        found, other = {}, []
        for w in words:
            if w.isascii() and w.isprintable() and "'" not in w and BETWEEN not in w:
                found[w] = b"".join([as_bytes[x.id] for p in plain_piece(w.lower()) for x in model(p)])
            elif BETWEEN in w:
                found[w] = one(w)
            else:
                other.append(w)
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*(np.flatnonzero(ids == mark) * 4).tolist(), len(ids) * 4]
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                found[w] = raw[start:end]
                start = end + 4
        return found

    def run(texts: list[str]) -> list[bytes]:
        nonlocal known, held
        split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        there = set().union(*split)
        now = {w: known[w] for w in there if w in known}
        if new := [w for w in there if w not in now]:
            learned = learn(new)
            now.update(learned)
            short = {w: x for w, x in learned.items() if len(w) <= SHORT}
            known.update(short)
            held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)
            if held > REMEMBERED_BYTES:  # what these texts do not hold is forgotten
                known = {w: x for w, x in now.items() if len(w) <= SHORT}
                held = sum(map(len, known)) + sum(map(len, known.values())) + ENTRY_BYTES * len(known)
        get = now.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode(texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            if len(t) > PART_CHARS:
                out += run(some)
                out.append(b"".join(x for p in _parts(t) for x in run([p])))
                some, size = [], 0
                continue
            some.append(t)
            size += len(t)
            if size > PART_CHARS:
                out += run(some)
                some, size = [], 0
        return out + run(some)

    return encode


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts, append `end_id`, and cut each into full windows and one remainder.

    ids are little-endian unsigned 32-bit numbers. A null or empty text is the end id alone; repeated rows
    give repeated pieces; other columns are dropped, whatever their names; a null key stays null; a very long text
    is encoded in runs. Tokenizers that may join what blanks separate encode each text as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = _encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            owner, start, length, ids, total = [], [], [], [], []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                raw += tail
                n = len(raw) // 4
                for s in range(0, n, window):
                    owner.append(doc_id)
                    start.append(s)
                    length.append(min(window, n - s))
                    ids.append(raw[4 * s : 4 * (s + window)])
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (owner, start, length, total)]
            yield pa.RecordBatch.from_arrays([*longs[:3], pa.array(ids, pa.binary()), longs[3]], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _strategies(bins: int) -> np.ndarray:
    """Rows (a, i, b, j, c): i pieces of bin a, j of b and one of c fill a window of `bins` steps; 0 is none.

    Shallow: at most three different lengths, with a > b > c, any i and j at most 3. c takes what is left.
    """
    rows = [(bins, 1, 0, 0, 0)]
    for a in range(1, bins):
        for i in range(1, bins // a + 1):
            left = bins - i * a
            rows.append((a, i, 0, 0, min(left, a - 1)) if left else (a, i, 0, 0, 0))
            for b in range(1, min(left, a - 1) + 1):
                for j in range(1, min(3, left // b) + 1):
                    rest = left - j * b
                    if rest < b:
                        rows.append((a, i, b, j, rest))
    return np.array(rows, np.int64)


def nnls_counts(histogram: np.ndarray, table_: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 of the strategies with least squared error against the histogram (active set)."""
    bins = len(histogram) - 1
    a, i, b, j, c = table_.T
    third = (c > 0).astype(float)
    h = histogram.astype(float).copy()
    h[0] = 0

    def column(k: int) -> np.ndarray:
        out = np.zeros(bins + 1)
        np.add.at(out, [a[k], b[k], c[k]], [i[k], j[k], third[k]])
        out[0] = 0
        return out

    x, active = np.zeros(len(table_)), []
    matrix = np.zeros((bins + 1, 0))
    residual = h.copy()
    scale = 1e-9 * (1 + np.abs(h).max()) * bins
    for _ in range(rounds):
        residual[0] = 0
        gain = i * residual[a] + j * residual[b] + third * residual[c]
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= max(scale, 0.5):
            break
        active.append(best)
        matrix = np.column_stack([matrix, column(best)])
        while True:
            z = np.linalg.lstsq(matrix, h, rcond=None)[0]
            if (z > 0).all():
                break
            now = x[active]
            down = z <= 0
            step = np.min(np.where(down, now / np.maximum(now - z, 1e-300), np.inf))
            now = now + step * (z - now)
            now[down & (now <= 1e-9)] = 0
            x[active] = now
            keep = now > 0
            if keep.all():
                keep[int(np.argmin(now))] = False
            for k, stay in zip(active, keep, strict=True):
                if not stay:
                    x[k] = 0
            active = [k for k, stay in zip(active, keep, strict=True) if stay]
            matrix = matrix[:, keep]
            if not active:
                z = np.zeros(0)
                break
        x[active] = z
        residual = h - matrix @ z if active else h.copy()
    return x


def plan(histogram: dict[int, int], bins: int = WINDOW // STEP) -> list[tuple[list[tuple[int, int]], int]]:
    """[(bins with multiplicity, how many windows)] that use every piece of the histogram exactly once.

    Work depends on the number of bins only, not on the number of pieces: the NNLS counts are rounded down
    to what the histogram holds, and the residual histogram is packed greedily, largest first with best
    fit, each pattern repeated as often as its counts allow.
    """
    h = np.zeros(bins + 1, np.int64)
    for k, n in histogram.items():
        h[k] += n
    made: list[tuple[list[tuple[int, int]], int]] = []
    if h[bins]:
        made.append(([(bins, 1)], int(h[bins])))
        h[bins] = 0
    if h.any():
        table_ = _strategies(bins)
        counts = nnls_counts(h, table_)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 0.5:
                break
            a, i, b, j, c = table_[k].tolist()
            parts = [(x, n) for x, n in ((a, i), (b, j), (c, 1)) if x and n]
            n = min(int(np.floor(counts[k] + 0.5)), *(int(h[x]) // m for x, m in parts))
            if n > 0:
                made.append((parts, n))
                for x, m in parts:
                    h[x] -= m * n
    while h.any():
        left, parts, used = bins, [], np.zeros(bins + 1, np.int64)
        while left and (fit := np.flatnonzero(h[: left + 1] - used[: left + 1] > 0)).size:
            x = int(fit[-1])
            m = min(left // x, int(h[x] - used[x]))
            parts.append((x, m))
            used[x] += m
            left -= x * m
        n = min(int(h[x]) // m for x, m in parts)
        made.append((parts, n))
        h -= used * n
    return made


def pack(cut: DataFrame, window: int = WINDOW, step: int = STEP, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Give each piece (doc_id, start, length, ...) its sequence_id and offset; all other columns are kept.

    The histogram has window / step bins, so it and the plan are bounded and handled on the driver. A piece's
    number within its bin comes from its number within (bin, salt) plus the salt's start; a bin has a salt for each
    `salt_rows` pieces, so that one with a third of all pieces is spread. The plan's slots, a few thousand rows, are
    joined by that number. Lengths must be 1 to `window`. Pieces that are alike are interchangeable; an empty table
    gives an empty result; columns that this function adds replace those of the same name.
    """
    spark, bins = cut.sparkSession, window // step
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    base_rows = cut.select(F.struct(*kept).alias("kept_"), F.col("length").alias("length_"), F.ceil(F.col("length") / step).cast("int").alias("bin_"), F.xxhash64("doc_id", "start").alias("mixed_"))
    counts = {r.bin_: r.n for r in base_rows.groupBy("bin_").agg(F.count("*").alias("n")).collect()}
    slots, base, filled = [], 0, dict.fromkeys(counts, 0)
    for parts, n in plan(counts, bins):
        place = 0
        for x, m in parts:
            slots.append((x, filled[x], filled[x] + m * n, m, base, place))
            filled[x] += m * n
            place += m
        base += n
    planned = spark.createDataFrame(slots, "slot_bin int, first long, last long, per_window int, base long, place int")
    salts = F.element_at(F.array(*[F.lit(1 + counts.get(x, 0) // salt_rows) for x in range(1, bins + 1)]), F.col("bin_"))
    named = base_rows.withColumn("salt_", F.pmod("mixed_", salts))
    cells = named.groupBy("bin_", "salt_").agg(F.count("*").alias("n"))
    starts = cells.select("bin_", "salt_", (F.sum("n").over(Window.partitionBy("bin_").orderBy("salt_")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bin_", "salt_").orderBy("kept_.doc_id", "kept_.start")) - 1
    ranked = named.withColumn("number", number).join(starts, ["bin_", "salt_"]).withColumn("number", F.col("number") + F.col("before"))
    # Bounded: at most three slots a strategy and bin, whatever the input.
    hit = ranked.join(F.broadcast(planned), (F.col("bin_") == F.col("slot_bin")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    seat = F.col("number") - F.col("first")
    placed = hit.withColumn("sequence_id", F.col("base") + F.floor(seat / F.col("per_window"))).withColumn("seat", F.col("place") + seat % F.col("per_window"))
    by_seat = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(*[F.col(f"kept_.`{c}`") for c in kept], "sequence_id", (F.sum("length_").over(by_seat) - F.col("length_")).alias("offset"))


def packed(cut: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """pack() for pieces with their ids: the places are found on the rows without them, and the ids join last, shuffled once."""
    numbered = stash(cut.withColumn("piece_", F.monotonically_increasing_id()))
    light = pack(numbered.select("doc_id", "start", "length", "piece_"), window, step)
    places = light.select(F.col("piece_").alias("place_of"), "sequence_id", "offset")
    rest = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    return numbered.join(places, F.col("piece_") == F.col("place_of")).select(*rest, "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's packing of `documents`; ids stay in the pieces, and the query carries their CRC-32."""
    small_batches(spark)
    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(stash(digest))
