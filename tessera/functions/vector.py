"""Column functions over float arrays. Sums are taken in double precision.

These are the executable definitions; bulk search uses matrix products (see
operators.knn). Arrays of different lengths give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..metric import Metric

#: The smallest normal single-precision number: norms at or below it count as zero.
TINY = 1.1754943508222875e-38
LANES = 16


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once: as the variable of a lambda,
    where a plain expression would be evaluated again at each of its places, and
    inside of another lambda for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _paired(a, b, term) -> Column:
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))))


def dot(a, b) -> Column:
    """Inner product."""
    return _paired(a, b, lambda x, y: x * y)


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance."""
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def norm_sq(a) -> Column:
    return _sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either side has no length."""
    short = F.when(F.size(_col(a)) == F.size(_col(b)), F.lit(0.0))
    return _with(norm_sq(a) * norm_sq(b), lambda squares: F.when(squares <= TINY, short).otherwise(dot(a, b) / F.sqrt(squares)))


def score(metric: str | Metric, a, b) -> Column:
    """Larger is better: cosine, inner product, or minus the squared distance."""
    metric = Metric.parse(metric)
    return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.L2: lambda x, y: -l2_sq(x, y)}[metric](a, b)


def has_length(a) -> Column:
    """Whether a vector can be normalised: its squared norm fits single precision and is not tiny."""
    return _with(norm_sq(a), _long_enough)


def _long_enough(n: Column) -> Column:
    return (n > TINY) & (n <= 3.4028234663852886e38)


def normalize(a) -> Column:
    """Unit length in single precision; null where has_length is false."""

    def scaled(n):
        return _with(F.sqrt(n), lambda root: F.transform(_col(a), lambda x: (x.cast("double") / root).cast("float")))

    return _with(norm_sq(a), lambda n: F.when(_long_enough(n), scaled(n)))


def first_not_finite(a) -> Column:
    """0-based place of the first NaN or infinite component, -1 if there is none."""
    bad = F.transform(_col(a), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.array_position(bad, True) - 1


def problem(a, dim: int, metric: str | Metric) -> Column:
    """Why a row cannot be stored: 'dimension', 'not_finite', 'zero_norm', or null if it can."""
    a = _col(a)
    out = F.when(a.isNull() | (F.size(a) != dim), "dimension").when(first_not_finite(a) >= 0, "not_finite")
    return out.when(~has_length(a), "zero_norm") if Metric.parse(metric).normalizes else out


def stored_form(m: np.ndarray, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """A float64 matrix as it is stored (rows of unit length if ``unit``, single
    precision), and what is wrong with each row: null, 'not_finite' or 'zero_norm'."""
    said = np.full(len(m), None, object)
    with np.errstate(all="ignore"):
        fine = np.isfinite(m).all(axis=1)
        if unit:
            n = np.einsum("ij,ij->i", m, m)
            said[~((n > TINY) & (n <= 3.4028234663852886e38))] = "zero_norm"
            m = m / np.sqrt(n)[:, None]
        m = m.astype(np.float32)
    said[~fine | np.equal(said, None) & ~np.isfinite(m).all(axis=1)] = "not_finite"
    return m, said


def prepared(df: DataFrame, vector: str, dim: int, metric: str | Metric, problem_name: str) -> DataFrame:
    """``df`` with its vectors as they are stored (``normalize`` for cosine; null for
    rows that cannot be) and a column that says what is wrong with a row
    (``problem``), in Arrow batches: the same as the expressions, which are worked
    out for each component by itself."""
    unit, at = Metric.parse(metric).normalizes, df.columns.index(vector)

    def run(stream):
        for batch in stream:
            column = batch.column(at).cast(pa.list_(pa.float64()))
            whole = np.asarray(column.value_lengths().fill_null(-1)) == dim
            m, told = stored_form(np.asarray(column.filter(pa.array(whole)).flatten().fill_null(float("nan")), np.float64).reshape(-1, dim), unit)
            said = np.full(batch.num_rows, "dimension", object)
            said[whole] = told
            good = np.equal(said, None)
            ends = np.concatenate(([0], np.cumsum(good) * dim)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(m[good[whole]].reshape(-1)), mask=pa.array(~good))
            columns = [*batch.columns, pa.array(said.tolist(), pa.string())]
            columns[at] = lists
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, problem_name])

    schema = df.withColumn(vector, F.expr("cast(null as array<float>)")).withColumn(problem_name, F.lit(None).cast("string")).schema
    return df.mapInArrow(run, schema)


def padded_stride(dim) -> Column:
    """Components of a row padded to whole lanes."""
    d = _col(dim) if isinstance(dim, (str, Column)) else F.lit(dim)
    return (F.floor((d + (LANES - 1)) / LANES) * LANES).cast("long")


def lane_efficiency(dim) -> Column:
    d = _col(dim) if isinstance(dim, (str, Column)) else F.lit(dim)
    return F.when(d > 0, d / padded_stride(d)).otherwise(0.0)


def pad(a) -> Column:
    """The row with zeros up to its padded stride."""
    a = _col(a)
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), (padded_stride(F.size(a)) - F.size(a)).cast("int")))
