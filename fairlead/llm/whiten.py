"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Vectors become whole numbers ``x = floor(scale * c) + offset``; the fit list holds each distinct x vector once (n rows,
per-dimension sums S). With X the fit list centred by S/n, the bidiagonalisation builds orthonormal v_1, v_2, ... in the
space of dimensions and u_1, u_2, ... in the space of rows with X V = U B, B upper bidiagonal:

    alpha_j u_j = X v_j - beta_j u_(j-1)          beta_(j+1) v_(j+1) = X' u_j - alpha_j v_j

both reorthogonalised against all earlier vectors. u_j is a combination of the rows' products and is kept as u_j = X y_j,
with y_j on the driver, so that a step is one distributed pass: every task multiplies its rows by a vector z (X z) and
at once by the transpose (X' X z), and hands in one partial sum of d numbers. The driver keeps only d-sized vectors and
the small bidiagonal matrix, whose singular value decomposition B = P S Q' gives the components V Q and the eigenvalues
s^2 / n of the covariance. After at most d steps (fewer when the rows span fewer dimensions) the decomposition is
complete; a step that ends in an invariant space starts again from a vector orthogonal to all earlier ones.

Rows, columns and results, also for edge cases:

- a row whose vector is null, empty, holds a null, NaN or an infinity, or is shorter or longer than the longest valid
  vector is not whitened and gives no output row; all other rows give one row per component, repeated rows included;
- components are those with an eigenvalue above ``1e-9`` of the largest (at most ``components``); no rows, or all
  rows equal, give no components and so an empty result;
- ``deviation`` is the exact sum over dimensions of (n x - S)^2 of the row, as a decimal sum cast to long;
- ``whitened`` is (x - S/n) projected on the component over the square root of its eigenvalue; ``explained`` its
  eigenvalue over the covariance's trace; ``identity_error`` the largest absolute entry of the covariance of the
  whitened fit list minus the identity, measured in one more distributed pass;
- an existing column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.session import drop_folder, fresh_path

#: Eigenvalues at or below this share of the largest count as zero.
RANK_TOLERANCE = 1e-9
OUTPUTS = ("n", "component", "deviation", "whitened", "explained", "identity_error")


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def whole_numbers(vector: str = "embedding", scale: int = 64, offset: int = 1_000_000):
    """floor(scale * c) + offset of every entry, as array<bigint>."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("bigint") + offset)


def _finite(vector: str):
    return F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))),
                      F.lit(False))


def _products(fit: DataFrame, d: int, mean: np.ndarray, z: np.ndarray) -> np.ndarray:
    """X'(X z) for the centred fit list and a d x m matrix z, summed over all tasks; each task hands in d x m numbers."""
    m = z.shape[1]
    blob = np.ascontiguousarray(z, dtype=np.float64).tobytes()
    centre = np.ascontiguousarray(mean, dtype=np.float64).tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz = np.frombuffer(blob, dtype=np.float64).reshape(d, m)
        mu = np.frombuffer(centre, dtype=np.float64)
        total = np.zeros((d, m))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if values.size:
                rows = values.reshape(-1, d).astype(np.float64) - mu
                total += rows.T @ (rows @ zz)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], type=pa.list_(pa.float64()))], ["p"])

    parts = fit.mapInArrow(partial, "p array<double>").collect()
    return np.sum([np.asarray(r.p) for r in parts], axis=0).reshape(d, m) if parts else np.zeros((d, m))


def _reorthogonalise(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            r = r - (b @ r) * b
    return r


def _restart(basis: list[np.ndarray], d: int) -> np.ndarray | None:
    """A unit vector orthogonal to all of ``basis``: the unit vector of the dimension that keeps most of itself."""
    if len(basis) >= d:
        return None
    q = np.array(basis).reshape(len(basis), d)
    left = np.eye(d) - q.T @ q
    k = int(np.argmax(np.linalg.norm(left, axis=0)))
    v = _reorthogonalise(left[:, k], basis)
    return v / np.linalg.norm(v)


def bidiagonalise(fit: DataFrame, d: int, mean: np.ndarray, steps: int | None = None):
    """Golub-Kahan-Lanczos with full reorthogonalisation: (V, alphas, betas) with X V = U B; one pass a step."""
    steps = d if steps is None else steps
    start = np.cos(np.arange(1, d + 1) * 1.6180339887)
    v = start / np.linalg.norm(start)
    vs: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    gs: list[np.ndarray] = []   # X' u_i
    alphas, betas = [], [0.0]
    scale = None
    for _ in range(steps):
        vs.append(v)
        z = v - betas[-1] * ys[-1] if ys and betas[-1] else v.copy()
        a = _products(fit, d, mean, z[:, None])[:, 0]             # X'(X z): X z = X v_j - beta_j u_(j-1)
        norm2 = float(z @ a)
        c = np.array([y @ a for y in ys])                           # u_i' (X z)
        zr = z - (c @ np.array(ys) if ys else 0.0)
        alpha2 = norm2 - float(c @ c)
        scale = scale or max(norm2, 1e-300)
        if alpha2 <= (RANK_TOLERANCE * 1e-3) * scale:
            alpha = 0.0
            y, g = np.zeros(d), np.zeros(d)
        else:
            alpha = float(np.sqrt(alpha2))
            y = zr / alpha
            g = (a - (c @ np.array(gs) if gs else 0.0)) / alpha     # X' u_j
        alphas.append(alpha)
        ys.append(y)
        gs.append(g)
        r = _reorthogonalise(g - alpha * v, vs)
        beta = float(np.linalg.norm(r))
        if beta <= np.sqrt(RANK_TOLERANCE * 1e-3 * scale):
            betas.append(0.0)
            nxt = _restart(vs, d)
            if nxt is None:
                break
            v = nxt
        else:
            betas.append(beta)
            v = r / beta
    return np.array(vs).T, np.array(alphas), np.array(betas[1:len(alphas)])


def components_of(fit: DataFrame, d: int, mean: np.ndarray, n: int, count: int):
    """(components d x k, eigenvalues k) of the covariance of the fit list, by falling eigenvalue; at most ``count``."""
    if n < 2 or d == 0:
        return np.zeros((d, 0)), np.zeros(0)
    vs, alphas, betas = bidiagonalise(fit, d, mean)
    k = len(alphas)
    b = np.diag(alphas) + (np.diag(betas, 1) if k > 1 else 0.0)
    _, s, qt = np.linalg.svd(b)
    e = s ** 2 / n
    keep = e > RANK_TOLERANCE * (e.max() if e.size else 0.0)
    comps = (vs @ qt.T)[:, keep][:, :count]
    comps = comps / np.linalg.norm(comps, axis=0)
    return comps, e[keep][:count]


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """Per valid row and component: the row's columns, n, component, deviation, whitened, explained, identity_error.

    Runs jobs while called: the fit list is written to the shared folder and read by one pass for the sums and one
    pass a bidiagonalisation step; the result is a plan over the input.
    """
    spark = embeddings.sparkSession
    rest = [c for c in embeddings.columns if c not in OUTPUTS]
    xs, cs, ks = (_free(embeddings.columns, k) for k in ("_x", "_c", "_k"))
    valid = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & _finite(vector)).withColumn(
        xs, whole_numbers(vector, scale, offset))
    d = valid.agg(F.max(F.size(xs))).first()[0] or 0
    valid = valid.where(F.size(xs) == d)
    path = fresh_path(spark, "whiten-fit")
    valid.select(xs).dropDuplicates([xs]).write.parquet(path)
    fit = spark.read.parquet(path)
    sums = fit.select(F.posexplode(xs).alias("i", "x")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x").cast("decimal(38,0)") * F.col("x")).alias("q"))
    stats = sorted(sums.collect())
    if d == 0 or not stats:
        drop_folder(spark, path)
        return valid.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in zip(
            OUTPUTS, ("bigint", "int", "bigint", "double", "double", "double"))]).where(F.lit(False))
    n = int(stats[0].n)
    s = np.array([int(r.s) for r in stats], dtype=object)
    trace = float(sum(n * int(r.q) - int(r.s) ** 2 for r in stats)) / n ** 2
    mean = np.array([float(v) / n for v in s])
    comps, e = components_of(fit, d, mean, n, components)
    k = comps.shape[1]
    if k:
        scaled = comps / np.sqrt(e)
        cov = scaled.T @ _products(fit, d, mean, scaled) / n
        identity_error = float(np.abs(cov - np.eye(k)).max())
    else:
        identity_error = 0.0
    drop_folder(spark, path)

    sums_lit = F.array(*[F.lit(int(v)).cast("bigint") for v in s])
    mean_lit = F.array(*[F.lit(float(v)) for v in mean])
    deviation = F.aggregate(
        F.zip_with(xs, sums_lit, lambda x, t: F.pow(F.lit(n).cast("decimal(38,0)") * x - t, 2).cast("decimal(38,0)")),
        F.lit(0).cast("decimal(38,0)"), lambda acc, v: acc + v).cast("bigint")
    table = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.lit(float(e[j] / trace)).alias("explained"),
                               F.array(*[F.lit(float(w)) for w in scaled[:, j]]).alias("w")) for j in range(k)]) if k else None
    if table is None:
        return valid.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in zip(
            OUTPUTS, ("bigint", "int", "bigint", "double", "double", "double"))]).where(F.lit(False))
    centred = F.transform(xs, lambda x, i: x.cast("double") - F.element_at(mean_lit, i + 1))
    rows = valid.select(*rest, centred.alias(cs), deviation.alias("deviation"), F.explode(table).alias(ks))
    return rows.select(
        *rest, F.lit(n).cast("bigint").alias("n"), F.col(f"{ks}.component").alias("component"), "deviation",
        F.aggregate(F.zip_with(cs, f"{ks}.w", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v).alias("whitened"),
        F.col(f"{ks}.explained").alias("explained"), F.lit(identity_error).alias("identity_error"))
