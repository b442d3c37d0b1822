"""Whitening of embeddings from exact integer cross-products (bit-sliced scatter).

1. Rows count whose vector is a list of finite numbers and as long as the longest such list; others (null, null or non-finite
   entries, shorter) are left out. An entry c, as double, becomes the long x = floor(256 c).
2. The *fit list* holds every distinct x vector once: n vectors, sums S.
3. *Bit-sliced scatter.* A block of fit vectors is shifted per dimension so that its least entry is 0; each bit of each
   dimension becomes a plane, packed across the rows of the block into 64-bit words. The cross-product of two dimensions is the sum
   over pairs of their planes of 2^(p+q) times the ones in (plane p AND plane q); the shift is taken back in whole numbers.
   Tasks add up their blocks and give one row per pair of dimensions, so what reaches the driver grows with dimensions only.
4. N = n sum(x x') - S S' is n^2 times the covariance V, an integer matrix; it is divided once and given to ``eigh``.
5. whitened = (x - S/n) . unit eigenvector / sqrt(eigenvalue), from the integers n x - S. The covariance of the whitened
   fit list is measured in a pass of its own; ``identity_error`` is its largest distance from the identity.

A component whose eigenvalue is not above the rounding of the largest one (fewer vectors than dimensions, constant
dimensions) can't be scaled: its ``whitened`` is null and it is left out of ``identity_error`` (null if no component is left).
Repeated rows are rows; the fit list holds them once. An empty table, or one without a usable vector, gives no rows.
``deviation`` is decimal(38,0): the exact sum over dimensions of (n x - S)^2, null beyond 38 digits. Entries past the range of
a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialspark.llm.common import columns
from trialspark.session import frozen

SCALE = 256
COMPONENTS = 4
BLOCK = 8192  # rows of a block of bit planes
DIGITS = 10**38
SUMS = "i int, j int, n long, s decimal(38,0), c decimal(38,0)"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def integer_vectors(embeddings: DataFrame, id_col: str, vector_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """``id, x``: the usable rows, of the given length."""
    rows = columns(embeddings, id=id_col, v=vector_col).filter(usable(F.col("v")))
    if dims is not None:
        rows = rows.filter(F.size("v") == dims)
    return rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def matrix_of(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dims)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """(dims, bits, words): plane p of dimension d holds bit p of column d of y, packed across the rows."""
    rows, dims = y.shape
    words = -(-rows // 64)
    padded = np.zeros((dims, words * 64), dtype=np.uint64)
    padded[:, :rows] = y.T
    out = np.empty((dims, bits, words), dtype=np.uint64)
    for p in range(bits):
        ones = ((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        out[:, p, :] = np.packbits(ones, axis=1).view(np.uint64)
    return out


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products (upper triangle) of the rows of x, exact: object arrays of Python integers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    y = x.view(np.uint64) - low.view(np.uint64)  # right modulo 2^64, and less than 2^64
    bits = max(1, int(y.max()).bit_length())
    sliced = planes(y, bits)
    flat = sliced.reshape(dims * bits, -1)
    ones = np.bitwise_count(flat).sum(axis=1, dtype=np.int64).reshape(dims, bits)
    small = 2 * bits + rows.bit_length() < 62
    weight = np.array([1 << p for p in range(bits)], dtype=np.int64 if small else object)
    sums_y = (ones.astype(weight.dtype) * weight).sum(axis=1)
    cross = np.zeros((dims, dims), dtype=weight.dtype)
    for i in range(dims):
        right = flat[i * bits :]
        total = np.zeros(dims - i, dtype=weight.dtype)
        for p in range(bits):
            both = np.bitwise_count(right & sliced[i, p]).sum(axis=1, dtype=np.int64).reshape(dims - i, bits)
            total = total + weight[p] * (both.astype(weight.dtype) * weight).sum(axis=1)
        cross[i, i:] = total
    low, sums_y, cross = low.astype(object), sums_y.astype(object), cross.astype(object)
    shifted = np.outer(low, sums_y) + np.outer(sums_y, low) + rows * np.outer(low, low)
    return sums_y + rows * low, np.triu(cross + shifted)


def task_sums(dims: int):
    schema = to_arrow_schema(StructType.fromDDL(SUMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = np.ascontiguousarray(matrix_of(batch.slice(at, BLOCK), "x", dims))
                s, c = scatter(x)
                n, sums, cross = n + len(x), sums + s, cross + c
        if n:
            i, j = np.triu_indices(dims)
            rows = [i, j, np.full(len(i), n), sums[i].tolist(), cross[i, j].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(r, type=f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def fit(fit_list: DataFrame, dims: int, components: int) -> dict | None:
    """n, S, and the leading unit eigenvectors and eigenvalues of the covariance of the fit list."""
    summed = fit_list.mapInArrow(task_sums(dims), SUMS).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    found = summed.collect()  # dims (dims + 1) / 2 rows, whatever the number of vectors
    if not found:
        return None
    n, sums = int(found[0]["n"]), [0] * dims
    for r in found:
        if r["i"] == r["j"]:
            sums[r["i"]] = int(r["s"])
    cov = np.zeros((dims, dims))
    for r in found:
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["c"]) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(cov))
    e = values[order]
    live = e > dims * np.finfo(float).eps * max(values.max(), 0.0)
    return {
        "n": n, "sums": sums, "vectors": vectors[:, order], "e": e, "live": live,
        "explained": [float(v / trace) if trace > 0 else None for v in e],
    }


def deviations(x: np.ndarray, model: dict) -> np.ndarray:
    """n x - S, as int64 where it and its squares summed over a row fit, else as Python integers."""
    n, sums = model["n"], np.array(model["sums"], dtype=object)
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in model["sums"])
    if largest * largest * x.shape[1] < 1 << 63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def projected(z: np.ndarray, model: dict) -> np.ndarray:
    """The live components of centred rows (z = n x - S), scaled to variance 1."""
    live = model["live"]
    return (z / model["n"]).astype(np.float64) @ (model["vectors"][:, live] / np.sqrt(model["e"][live]))


def identity_error(fit_list: DataFrame, dims: int, model: dict) -> float | None:
    """Largest entry of (covariance of the whitened fit list - identity); rows are centred before they are multiplied."""
    k = int(model["live"].sum())
    if not k:
        return None
    schema = StructType.fromDDL("i int, j int, c double")

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = projected(deviations(matrix_of(batch, "x", dims), model), model)
            total += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], schema=to_arrow_schema(schema))

    cov = np.zeros((k, k))
    for r in fit_list.mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        cov[r["i"], r["j"]] = r["c"] / model["n"]
    return float(np.abs(cov - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: one row per usable row and component."""
    id_field = columns(embeddings, id=id_col).schema["id"]
    kind = id_field.dataType.simpleString()
    out = StructType.fromDDL(f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    usable_rows = columns(embeddings, v=vector_col).filter(usable(F.col("v")))
    dims = usable_rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return embeddings.sparkSession.createDataFrame([], out)
    rows = integer_vectors(embeddings, id_col, vector_col, scale, dims)
    fit_list = frozen(rows.select("x").distinct())
    model = fit(fit_list, dims, components)
    error = identity_error(fit_list, dims, model)
    arrow = to_arrow_schema(out)
    k, live = len(model["e"]), np.flatnonzero(model["live"])

    def run(batches):
        for batch in batches:
            z = deviations(matrix_of(batch, "x", dims), model)
            m = len(z)
            far = [d if d < DIGITS else None for d in (z * z).sum(axis=1).tolist()]
            w = np.full((m, k), np.nan)
            w[:, live] = projected(z, model)
            who = np.repeat(np.arange(m), k)
            value = pa.array(w.ravel(), mask=np.tile(~model["live"], m))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(who)).cast(arrow.field(0).type),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model["n"], dtype=np.int64)),
                    pa.array(far, type=arrow.field(3).type).take(pa.array(who)),
                    value,
                    pa.array(model["explained"] * m, type=pa.float64()),
                    pa.array([error] * (m * k), type=pa.float64()),
                ],
                schema=arrow,
            )

    return rows.mapInArrow(run, out)
