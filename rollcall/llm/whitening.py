"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Entries are scaled to integers x = floor(256 * c), so that sums are exact.
The model is fitted to each distinct vector once: their number n, the sums S
and, in a second pass, the covariance V of the vectors centred at S / n. Each
task reduces its batches to one matrix; what reaches the driver is
dims * dims numbers, whatever the number of rows (``MAX_DIMS`` bounds it).

There V is split: for a shift s inside its spectrum, the polar factor U of
V - s I has the eigenvalue 1 on the space of the eigenvalues above s and -1 on
that of those below, so (U + I) / 2 projects on the former. U comes from QDWH,
the dynamically weighted Halley iteration in its inverse-free QR form. An
orthonormal basis of the projector's range and of its complement
makes V block diagonal, and each block is split again down to single
components, the upper one first, until ``components`` are found.

The mean and the components (``components`` * dims numbers) are broadcast, and
each row is centred, projected and divided by the root of the eigenvalue where it is read.

Defined results: vectors that are null or hold null or non-finite entries are
left out, as are vectors of another length than the commonest (of equally
common ones, the greatest); repeated rows each get their rows; rows without an id
keep the null; a component whose eigenvalue is zero to double precision has
whitened values 0; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import workspace, write_table

SCALE = 256
COMPONENTS = 4
#: Longest vectors: a covariance of MAX_DIMS ** 2 doubles (128 MB) still fits in the driver.
MAX_DIMS = 4096
EPS = float(np.finfo(float).eps)
#: Rows of a batch of vectors, as long as the entries stay below MAX_ENTRIES.
MAX_ENTRIES = 1 << 18


# -- spectral divide and conquer ------------------------------------------------

def qdwh(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalues."""
    n = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.zeros_like(a)
    x, low, eye = a / norm, EPS / 4, np.eye(n)
    for _ in range(steps):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3) if low < 1 else 0.0
        root = (1 + d) ** 0.5
        wa = root + 0.5 * (8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) ** 0.5
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([wc**0.5 * x, eye]))
        after = wb / wc * x + (wa - wb / wc) / wc**0.5 * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        change = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if change < (8 * EPS) ** (1 / 3) and abs(1 - low) < 16 * EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Values inside the spectrum of a symmetric matrix, the likely middle first; the mean of the eigenvalues divides all but multiples of the identity."""
    mean, spread = np.trace(a) / len(a), np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a))) / len(a) ** 0.5
    yield float(np.median(np.diag(a)))
    for part in (0.0, 0.07, -0.11, 0.19, -0.23, 0.31, -0.37):
        yield float(mean + part * spread)


def _divide(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of the larger and of the smaller eigenvalues; None if all are equal to working precision."""
    n, scale = len(a), np.linalg.norm(a, 2)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * n * EPS * scale:
        return None
    best = None
    for shift in _shifts(a):
        u = qdwh(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
        basis, _ = np.linalg.qr(projector @ basis)
        full, _ = np.linalg.qr(np.hstack([basis, rng.standard_normal((n, n - k))]))
        upper, lower = full[:, :k], full[:, k:]
        # an eigenvalue at the shift itself belongs to neither side: the blocks stay coupled, and another shift is tried
        coupled = np.linalg.norm(lower.T @ a @ upper)
        if best is None or coupled < best[0]:
            best = coupled, upper, lower
        if coupled <= 64 * n * EPS * scale:
            break
    return None if best is None else best[1:]


def spectral_components(v: np.ndarray, components: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(seed)
    values, vectors = [], []
    # blocks still to divide, those of the largest eigenvalues on top
    stack = [(np.eye(len(v)), (v + v.T) / 2)]
    while stack and len(values) < components:
        basis, block = stack.pop()
        parts = _divide(block, rng) if len(block) > 1 else None
        if parts is None:
            for i in range(len(block)):
                values.append(float(block[i, i]))
                vectors.append(basis[:, i])
            continue
        for side in reversed(parts):
            part = basis @ side
            part, r = np.linalg.qr(part)
            within = part.T @ v @ part
            stack.append((part, (within + within.T) / 2))
    order = np.argsort(-np.array(values, float), kind="stable")[:components]
    return np.array(values, float)[order], np.array(vectors, float).reshape(len(values), len(v))[order].T


# -- passes over the vectors ----------------------------------------------------

def scaled_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite and of the commonest length; x = floor(scale * entry) as long."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    common = kept.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are supported")
    return kept.where(F.size("x") == dims)


def _matrices(batches: Iterator[pd.DataFrame], dims: int) -> Iterator[np.ndarray]:
    rows = max(1, MAX_ENTRIES // max(1, dims))
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield np.array(batch["x"].iloc[i : i + rows].tolist(), np.int64).reshape(-1, dims)


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * dims
        for x in _matrices(batches, dims):
            n += len(x)
            exact = x if np.abs(x.astype(float)).max(initial=0.0) * len(x) < 2**62 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
        yield pd.DataFrame({"d": range(-1, dims), "s": [str(n), *map(str, total)]})

    parts = fit.select("x").mapInPandas(sums, "d int, s string")
    rows = parts.groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["d"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def _moments(fit: DataFrame, dims: int, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Sum over the vectors of z z', with z the centred vector times ``project``; a task adds up its batches before it sends them on."""
    k = project.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((mean, project))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, p = shared.value
        total = np.zeros((k, k))
        for x in _matrices(batches, dims):
            z = (x - m) @ p
            total += z.T @ z
        yield pd.DataFrame({"i": range(k), "row": list(total)})

    rows = fit.select("x").mapInPandas(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k, k))
    at = rows.toPandas()
    out[at["i"].to_numpy(int), at["j"].to_numpy(int)] = at["v"].to_numpy(float)
    return out


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row for each whole vector and component (1 to ``components``, or the number of dimensions if that is less).

    Columns: vec_id, component, n (distinct vectors), deviation (sum over the
    dimensions of (n * x - S) ** 2, exact; null beyond a long), whitened, explained
    (the component's share of the variance) and identity_error (the largest entry of |covariance of the whitened fit list - identity|).
    """
    spark = rows.sparkSession
    folder = workspace(spark, "whitening")
    vectors = write_table(scaled_vectors(rows, vector, scale), f"{folder}/vectors")
    first = vectors.select(F.size("x").alias("dims")).first()
    dims = first["dims"] if first else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    # grouping combines a vector that many rows share within each task first
    fit = write_table(vectors.select("x").distinct(), f"{folder}/fit")
    n, sums = _totals(fit, dims)
    mean = np.array([s / n for s in sums])
    covariance = _moments(fit, dims, mean, np.eye(dims)) / n
    values, directions = spectral_components(covariance, min(components, dims))
    trace = float(np.trace(covariance))
    usable = values > dims * EPS * max(trace, 0.0)
    weights = directions * np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    error = float(np.abs(_moments(fit, dims, mean, weights) / n - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast((mean, weights, explained, sums))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, w, part, total = shared.value
        k = w.shape[1]
        for batch in batches:
            x = np.array(batch["x"].tolist(), np.int64).reshape(-1, dims)
            far = n * np.abs(x.astype(float)).max(initial=0.0) + max(map(abs, total))
            small = dims * far * far < 2.0**62
            exact = x if small else x.astype(object)
            off = n * exact - np.array(total, np.int64 if small else object)
            deviation = [d if d < 2**63 else None for d in map(int, (off * off).sum(axis=1))]
            z = (x - m) @ w
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": n,
                    "deviation": pd.array(deviation, "Int64").repeat(k),
                    "whitened": z.ravel(),
                    "explained": np.tile(part, len(x)),
                    "identity_error": error,
                }
            )

    return vectors.mapInPandas(project, schema)
