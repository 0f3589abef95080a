"""Embedding whitening by Jacobi-Davidson: the covariance is never formed; each product with it is one distributed pass of
centred products, correction equations are solved by MINRES on all open pairs at once, and Rayleigh-Ritz pairs are locked
until every residual is at double precision.

The driver holds a few dozen vectors as long as one embedding, never anything that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, small_batches, stash, table

SCALE, SHIFT = 64, 1_000_000
#: A residual is at double precision below this many units in the last place of the greatest eigenvalue, times sqrt(d).
ULPS = 16
#: Components whose variance is less than this share of the greatest are rounding noise and cannot be whitened.
NOISE = 1e-11
#: Numbers in one stored block of fit vectors; tasks that add up what all tasks before them found.
BLOCK_VALUES, ADDERS = 1 << 18, 8
#: Steps of MINRES for one correction while residuals are above ROUGH of the greatest eigenvalue, and after that; rounds
#: after which residuals that still do not fall raise an error.
EARLY, INNER, ROUGH, ROUNDS = 4, 12, 1e-2, 200
Product = Callable[[np.ndarray], np.ndarray]


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows whose vector is not null and has finite components only; x = floor(64 c) + 1000000 as longs.

    Vectors of another length than most have (the greater of two lengths that are as frequent), and those without
    components, take no part either.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False)))
    length = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    kept = rows.filter(F.size(vector) == (length[0].n if length else 0))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def fit_blocks(rows: DataFrame) -> DataFrame:
    """(n, body): each distinct x once, as blocks of rows of longs, in a written table that every pass reads again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b.x.to_list()).astype("<i8") if len(b) else np.zeros((0, 1), "<i8")
            step = max(1, BLOCK_VALUES // x.shape[1])
            parts = [x[i : i + step] for i in range(0, len(x), step)]
            yield pd.DataFrame({"n": [len(p) for p in parts], "body": [p.tobytes() for p in parts]})

    return stash(rows.select("x").distinct().mapInPandas(run, "n int, body binary"))


def summed(blocks: DataFrame, shape: tuple[int, ...], dtype: type, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of part(rows of longs): added up in each task, then in ADDERS tasks, then here.

    Doubles are added in extended precision, so the order of tasks and blocks shows in the last place at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, dtype)
        for b in batches:
            for n, body in zip(b.n, b.body, strict=True):
                total += part(np.frombuffer(body, "<i8").reshape(n, -1))
        yield pd.DataFrame({"total": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, dtype)
        for b in batches:
            for body in b.total:
                total += np.frombuffer(body, dtype).reshape(shape)
        yield pd.DataFrame({"total": [total.tobytes()]})

    sums = blocks.mapInPandas(run, "total binary").repartition(ADDERS).mapInPandas(add, "total binary").collect()
    return sum((np.frombuffer(r.total, dtype).reshape(shape) for r in sums), np.zeros(shape, dtype))


def minres(apply: Product, b: np.ndarray, steps: int = INNER, enough: float = 1e-3) -> np.ndarray:
    """Columns x with apply(x) near b, each by its own minimal residuals; one product serves all columns of a step."""
    safe = lambda n: np.where(n > 0, n, 1.0)
    x, old, w_old, w = (np.zeros_like(b) for _ in range(4))
    beta = first = np.linalg.norm(b, axis=0)
    v, eta = b / safe(beta), beta.copy()
    c_old = c = np.ones(b.shape[1])
    s_old = s = np.zeros(b.shape[1])
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        new = p - alpha * v - beta * old
        after = np.linalg.norm(new, axis=0)
        diagonal = c * alpha - c_old * s * beta
        length = np.hypot(diagonal, after)
        turn = np.where(length > 0, diagonal / safe(length), 1.0), np.where(length > 0, after / safe(length), 0.0)
        w_old, w = w, np.where(length > 0, (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe(length), 0.0)
        x = x + turn[0] * eta * w
        eta = -turn[1] * eta
        c_old, s_old, (c, s) = c, s, turn
        old, v, beta = v, new / safe(after), after
        if (np.abs(eta) <= enough * first).all():
            break
    return x


def _fresh(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what t adds to the orthonormal bases."""
    for _ in range(2):
        for q in bases:
            t = t - q @ (q.T @ t)
        norms = np.linalg.norm(t, axis=0)
        some = norms > 1e-10 * max(norms.max(initial=0.0), 1e-290)
        t = t[:, some] / norms[some]
        u, size, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, size > 1e-8]
    return t


def jacobi_davidson(product: Product, d: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, their unit eigenvectors (d x k), and their residuals, of a symmetric operator
    that is known by its product with d x m blocks only. Vectors point to where their greatest entry is positive.
    """
    k = min(k, d)
    width = min(d, k + max(4, k // 4))
    widest = min(d, 6 * width)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    image = product(basis)
    locked, values, residuals = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        open_ = k - len(values)
        rest = image[:, :open_] - basis[:, :open_] * theta[:open_]
        norms = np.linalg.norm(rest, axis=0)
        limit = ULPS * np.finfo(float).eps * np.sqrt(d) * max(abs(theta).max(), abs(values).max(initial=0.0))
        done = int(np.argmin(np.r_[norms <= limit, False]))
        locked, values, residuals = np.hstack([locked, basis[:, :done]]), np.r_[values, theta[:done]], np.r_[residuals, norms[:done]]
        basis, image = basis[:, done:], image[:, done:]
        if len(values) == k:
            break
        ritz, shift, rest = basis[:, : k - len(values)], theta[done : done + k - len(values)], rest[:, done:]
        bad = norms[done:] > limit
        ritz, shift, rest = ritz[:, bad], shift[bad], rest[:, bad]

        def held(t: np.ndarray, ritz: np.ndarray = ritz) -> np.ndarray:
            """Without the parts along locked vectors and each column's own Ritz vector."""
            for _ in range(2):
                t = t - locked @ (locked.T @ t)
                t = t - ritz * (ritz * t).sum(0)
            return t

        def corrected(t: np.ndarray, shift: np.ndarray = shift, held: Product = held) -> np.ndarray:
            t = held(t)
            return held(product(t) - shift * t)

        steps = EARLY if norms.max() > ROUGH * abs(theta).max() else INNER
        more = _fresh(minres(corrected, -held(rest), steps), locked, basis)
        if basis.shape[1] + more.shape[1] > widest:
            keep = max(k - len(values), min(basis.shape[1], widest - more.shape[1]))
            basis, image = basis[:, :keep], image[:, :keep]
        if more.shape[1]:
            basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
        else:
            # Nothing is left to add: rounding of earlier turns is all that keeps the residuals up.
            image = product(basis)
    else:
        raise RuntimeError(f"residuals did not fall below {limit}: {norms}")
    order = np.argsort(-values, kind="stable")
    values, locked, residuals = values[order], locked[:, order], residuals[order]
    signs = np.sign(locked[np.argmax(np.abs(locked), axis=0), np.arange(k)])
    return values, locked * np.where(signs == 0, 1.0, signs), residuals


@dataclass(frozen=True)
class Whitening:
    """n fit vectors with sums S; components (d x m) with variances by falling size; trace of the covariance; the greatest
    absolute entry of the whitened fit list's covariance minus the identity; residuals of the components."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray


def fit(rows: DataFrame, k: int = 16) -> Whitening:
    """Learn up to k components from quantised(): each distinct vector counts once, whatever the number of its copies."""
    blocks = fit_blocks(rows)
    head = blocks.agg(F.sum("n"), F.max(F.length("body") / F.col("n"))).first()
    n, d = int(head[0] or 0), int(head[1] or 0) // 8
    if not n:
        drop(blocks)
        return Whitening(0, np.zeros(d, np.int64), np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, np.zeros(0))
    sums = summed(blocks, (d,), np.int64, lambda x: x.sum(0))
    # n x - S is an exact integer: nothing of a small spread around a large mean is rounded away.
    centred = lambda x: (n * x - sums) / n

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ b)

        return (summed(blocks, b.shape, np.longdouble, part) / n).astype(float)

    trace = float(summed(blocks, (), np.longdouble, lambda x: np.square(centred(x)).sum()) / n)
    values, vectors, residuals = jacobi_davidson(product, d, k)
    real = values > NOISE * max(values.max(), 0.0)
    values, vectors, residuals = values[real], vectors[:, real], residuals[real]
    scaled = vectors / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ scaled
        return z.T @ z

    error = np.abs(summed(blocks, (len(values), len(values)), np.longdouble, spread) / n - np.eye(len(values))).max(initial=0.0)
    drop(blocks)
    return Whitening(n, sums, vectors, values, trace, float(error), residuals)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each row of quantised() and component, numbered from 1 by falling variance.

    deviation is the exact sum over dimensions of (n x - S)^2; whitened the centred vector's projection over the square root
    of the variance; explained the variance over the trace. A deviation beyond 64 bits raises an error.
    """
    n, sums, m = model.n, model.sums, len(model.variances)
    scaled = model.components / np.sqrt(model.variances)
    explained = model.variances / model.trace if m else model.variances

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):
                some = b.iloc[i : i + 4096]
                apart = n * np.stack(some.x.to_list()) - sums
                # Where 64 bits could overflow, Python's integers add up.
                wide = float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= 2.0**62
                deviation = [sum(int(a) ** 2 for a in row) for row in apart] if wide else (apart * apart).sum(1)
                z = (apart / n) @ scaled
                yield pd.DataFrame(
                    {
                        "vec_id": np.repeat(some.vec_id.to_numpy(), m),
                        "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(some)),
                        "n": n,
                        "deviation": np.repeat(np.array(deviation, np.int64), m),
                        "whitened": z.ravel(),
                        "explained": np.tile(explained, len(some)),
                        "identity_error": model.identity_error,
                    }
                )

    return rows.mapInPandas(run, WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's whitening of `embeddings`: 16 components, or as many as the fit list's variance has.

    Null vectors and those with null or non-finite components are dropped; a null id is an id; repeated rows each get
    their rows and count once in the fit, as do equal vectors of different ids; columns other than the two are not read;
    fewer distinct vectors than components leave fewer components, and one vector or an empty table none and no rows.
    """
    small_batches(spark)
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whiten(rows, fit(rows))
