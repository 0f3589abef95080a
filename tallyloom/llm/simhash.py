"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, small_batches, stash, table, text_of
from .graph import connected_components

BITS, BLOCK, BLOCKS = 64, 16, 4
_CUT = re.compile(f"[{BLANKS}]+")


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text whose letters are already lower-cased; 0 if it has no word."""
    words = _CUT.sub(" ", text).strip(" ").split(" ") if text else []
    if words in ([], [""]):
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [" ".join(words)] if len(words) < width else [" ".join(x) for x in zip(*[words[i:] for i in range(width)], strict=False)]
    ones, n = np.zeros(BITS, np.int64), len(shingles)
    for i in range(0, n, 65536):
        h = np.fromiter((digest(s, seed) for s in shingles[i : i + 65536]), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.pandas_udf(run, "long")(ascii_lower(text_of(text))).alias("fp"))


def _bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set together (64 x 64), and the number of fingerprints: a bounded summary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = _bits(b.fp.to_numpy(np.int64)).astype(np.float32)
            both += bits.T @ bits
            n += len(b)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "both": both.ravel().astype(np.int64), "n": n})

    rows = fps.select("fp").mapInPandas(run, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        out[r.i, r.j], n = r.both, r.n
    return out, n


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8)).reshape(-1, BITS)


def grouped_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """Deal the 64 bits to four blocks of 16 so that correlated bits share a block."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, blocks = set(range(BITS)), []
    for _ in range(BLOCKS):
        block = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.remove(block[0])
        while len(block) < BLOCK:
            nxt = max(left, key=lambda b: (corr[b, block].sum(), -b))
            block.append(nxt)
            left.remove(nxt)
        blocks.append(block)
    return blocks


def _block_values(fp: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
    """(n, 4) values of the blocks, 16 bits each."""
    bits, weights = _bits(fp).astype(np.int64), 1 << np.arange(BLOCK, dtype=np.int64)
    return np.stack([bits[:, b] @ weights for b in blocks], axis=1)


def _shells(hist: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, 65536): how many fingerprints have a block value at exactly distance t of each value."""
    index = np.arange(hist.shape[0])
    near = lambda x: sum(x[index ^ (1 << b)] for b in range(BLOCK))
    out = [hist.astype(float), near(hist.astype(float))]
    for t in range(2, most + 1):  # a step from shell t-1 leads to t (t ways), back to t-2 (16-t+2 ways)
        out.append((near(out[t - 1]) - (BLOCK - t + 2) * out[t - 2]) / t)
    return np.maximum(np.stack(out[: most + 1]), 0)


def _within(shells: list[np.ndarray], values: np.ndarray, part: list[int], most: int, n: int) -> np.ndarray:
    """(rows, most + 1): estimated fingerprints within t of each row on the union of blocks `part`."""
    exact = np.zeros((len(values), most + 1))
    exact[:, 0] = n
    for k in part:
        share = shells[k][:, values[:, k]].T / max(n, 1)
        exact = np.stack([sum(exact[:, s] * share[:, t - s] for s in range(t + 1)) for t in range(most + 1)], axis=1)
    return np.cumsum(exact, axis=1)


def _balls(width: int, radius: int) -> list[int]:
    """Flip masks of at most `radius` of `width` bits."""
    out, level = [0], {0}
    for _ in range(radius):
        level = {m | 1 << b for m in level for b in range(width) if not m >> b & 1}
        out += sorted(level)
    return out


def _ball_size(width: int, radius: int) -> int:
    size, term = 0, 1
    for r in range(radius + 1):
        size += term
        term = term * (width - r) // (r + 1)
    return size


#: Ways to join the four blocks into partitions: few wide ones for many fingerprints, more narrow ones for few.
LAYOUTS = ([[0, 1], [2, 3]], [[0, 1], [2], [3]], [[0], [1], [2], [3]])
#: A probe is shuffled, a candidate is only compared.
PROBE_COST, CANDIDATE_COST = 1.0, 0.2


def thresholds(estimates: list[np.ndarray], widths: list[int], bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row one threshold for each partition, from -1 (not probed) up, with the least estimated cost.

    If the thresholds sum to bound - partitions + 1, every fingerprint within `bound` agrees with the row on
    some partition up to its threshold; dynamic programming over partitions and the sum spent so far.
    """
    rows, m = len(estimates[0]), len(widths)
    target = bound + 1  # thresholds + 1 sum to this
    best = np.full((rows, target + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for est, width in zip(estimates, widths, strict=True):
        price = np.concatenate([np.zeros((rows, 1)), PROBE_COST * np.array([_ball_size(width, t) for t in range(bound + 1)]) + CANDIDATE_COST * est], axis=1)
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
        for spent in range(target + 1):
            for t in range(spent + 1):
                cost = best[:, spent - t] + price[:, t]
                better = cost < new[:, spent]
                new[better, spent], pick[better, spent] = cost[better], t
        best, choice = new, [*choice, pick]
    out, spent = np.zeros((rows, m), np.int64), np.full(rows, target)
    for k in range(m - 1, -1, -1):
        out[:, k] = choice[k][np.arange(rows), spent]
        spent -= out[:, k]
    return out - 1, best[:, target]


def hamming_links(fps: DataFrame, bound: int = 3) -> DataFrame:
    """Distinct fingerprints (fp, rep) -> (u, v): reps of every two fingerprints that differ in 1 to `bound` bits.

    Exact: each fingerprint is indexed by its value on every partition and probes each partition within its own
    threshold; equal keys are joined and the whole distance verified. Only 64 x 64 bit counts and four histograms
    of 65,536 values leave the executors. The layout is the one with the least estimated cost.
    """
    spark = fps.sparkSession
    both, n = _bit_counts(fps)
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    blocks = grouped_bits(both, n)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _block_values(b.fp.to_numpy(np.int64), blocks)
            yield pd.DataFrame({"block": np.tile(np.arange(BLOCKS), len(v)), "value": v.ravel()})

    hist = np.zeros((BLOCKS, 1 << BLOCK))
    for r in fps.select("fp").mapInPandas(count, "block int, value int").groupBy("block", "value").count().collect():
        hist[r[0], r[1]] = r[2]
    shells = spark.sparkContext.broadcast([_shells(h, bound) for h in hist])  # 8 MB, whatever the input

    # The layout: estimated on the histograms' own mass, every value weighted by its count on its block.
    def price(layout: list[list[int]]) -> float:
        mean = [np.array([(h * s[t]).sum() / n for t in range(bound + 1)]) for h, s in zip(hist, shells.value, strict=True)]
        est = []
        for part in layout:
            exact = np.zeros(bound + 1)
            exact[0] = n
            for k in part:
                exact = np.array([sum(exact[s] * mean[k][t - s] / n for s in range(t + 1)) for t in range(bound + 1)])
            est.append(np.cumsum(exact)[None, :])
        return float(thresholds(est, [BLOCK * len(p) for p in layout], bound)[1][0])

    layout = min(LAYOUTS, key=price)
    widths = [BLOCK * len(p) for p in layout]

    def keyed(fp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values = _block_values(fp, blocks)
        return values, [sum(values[:, k] << (BLOCK * i) for i, k in enumerate(part)) for part in layout]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b.fp.to_numpy(np.int64)
            for p, value in enumerate(keyed(fp)[1]):
                yield pd.DataFrame({"part": p, "value": value, "fp_b": fp, "rep_b": b.rep.to_numpy()})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = {}
        for b in batches:
            fp, rep = b.fp.to_numpy(np.int64), b.rep.to_numpy()
            values, keys = keyed(fp)
            est = [_within(shells.value, values, part, bound, n) for part in layout]
            limit = thresholds(est, widths, bound)[0]
            for p, width in enumerate(widths):
                for t in range(bound + 1):
                    rows = np.flatnonzero(limit[:, p] == t)
                    flips = masks.setdefault((width, t), np.array(_balls(width, t), np.int64))
                    step = max(1, 100_000 // len(flips))
                    for i in range(0, len(rows), step):
                        r = rows[i : i + step]
                        yield pd.DataFrame({"part": p, "value": (keys[p][r][:, None] ^ flips).ravel(), "fp": np.repeat(fp[r], len(flips)), "rep": np.repeat(rep[r], len(flips))})

    indexed = fps.select("fp", "rep").mapInPandas(index, "part int, value long, fp_b long, rep_b long")
    probes = fps.select("fp", "rep").mapInPandas(probe, "part int, value long, fp long, rep long")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))).between(1, bound)
    pairs = probes.alias("q").join(indexed.alias("i"), (F.col("q.part") == F.col("i.part")) & (F.col("q.value") == F.col("i.value")) & near)
    return pairs.select(F.greatest("rep", "rep_b").alias("u"), F.least("rep", "rep_b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, bound: int = 3, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints at `bound` or fewer differing bits.

    component_id is the smallest doc_id that links can reach. Equal fingerprints are linked through their
    smallest doc_id, never in pairs; wordless and null texts have fingerprint 0 and are linked like any
    other. Repeated rows come back repeatedly, a null doc_id keeps its row and takes no part in choosing
    ids unless all have none; other columns are dropped; an empty table gives an empty result.
    """
    made = stash(fingerprints(docs, key, text, width))
    fps = stash(made.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(hamming_links(fps.filter("rep is not null"), bound))
    roots = fps.join(parts, fps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(roots, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's components of `documents`: 3-word shingles, three or fewer differing bits."""
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
