"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Components become integers, so sums and the scatter (centred at the rounded mean, the rest of the mean
taken off afterwards) are exact. The scatter's characteristic polynomial is computed modulo as many
31-bit primes as its coefficients need, by reduction to Hessenberg form, and put together by Chinese
remainders. All its roots are real, so the sign changes of its coefficients about a point count the roots
beyond it; bisection isolates the largest ones to ``BITS`` bits. Inverse iteration in long decimals
gives the null space at each root. What reaches the driver is of the size of the scatter, whatever
the number of rows.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise
from .vectors import of_one_length, usable

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Significant bits of a root, and digits of the decimals that solve for its null space.
BITS, DIGITS = 160, 110


# ---- exact sums ----


def _integers(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    """A list column of one length as integers floor(scale * entry) + shift."""
    x = scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if np.abs(x).max(initial=0) >= 2.0**61:
        raise ValueError("entries beyond 62 bits")
    return np.floor(x).astype(np.int64) + shift


def _exact_gram(z: np.ndarray) -> np.ndarray:
    """z'z as Python integers: by floats where no sum can pass 2^53, else by 64 bits, else by long integers."""
    most = int(np.abs(z).max(initial=0)) ** 2
    rows = 2**53 // max(most, 1)
    out = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    if rows:
        for at in range(0, len(z), rows):
            part = z[at : at + rows].astype(np.float64)
            out = out + (part.T @ part).astype(np.int64).astype(object)
        return out
    wide = z.astype(object)
    return out + wide.T @ wide


def sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors ``v`` of the length that most have (the shorter of equally common ones), and the exact sum of each component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v"))
            for d in lengths.unique().to_pylist():
                x = _integers(batch.column("v").filter(pc.equal(lengths, d)), scale, shift)
                part = x.sum(axis=0).astype(object) if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(axis=0)
                n, total = found.get(d, (0, 0))
                found[d] = n + len(x), total + part
        for d, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), _decimals([n, *total])], ["size", "place", "total"])

    # A row per component and task before the shuffle. Place -1 counts the vectors.
    got = rows.select("v").mapInArrow(partial, "size int, place int, total decimal(38,0)").groupBy("size", "place").agg(F.sum("total").alias("total"))
    got = materialise(got, "sums")
    most = got.where("place = -1").orderBy(F.desc("total"), "size").head()
    if most is None:
        return 0, []
    own = {r.place: int(r.total) for r in got.where(F.col("size") == most["size"]).collect()}
    return int(most["total"]), [own[i] for i in range(most["size"])]


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def scatter(rows: DataFrame, n: int, total: list[int], scale: int, shift: int) -> list[list[int]]:
    """n times the sum of outer products of the centred vectors, in integers: n^2 times the covariance.

    Vectors are centred at the whole number below the mean before they are multiplied; what is left of
    the mean comes off exactly.
    """
    d = len(total)
    base = np.array([s // n for s in total], dtype=np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if len(batch):
                gram = _exact_gram(_integers(batch.column("v"), scale, shift) - base)
                out = gram if out is None else out + gram
        if out is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(out[i, j])], ["i", "j", "v"])

    # One row per entry and task before the shuffle, one per entry after.
    entries = rows.select("v").mapInArrow(partial, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    rest = [s - n * (s // n) for s in total]
    out = [[0] * d for _ in range(d)]
    for r in entries:
        out[r.i][r.j] = out[r.j][r.i] = n * int(r.v) - rest[r.i] * rest[r.j]
    return out


# ---- the characteristic polynomial ----


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, which these bases decide below 3,215,031,751."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    s = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, n - 1 >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product passes ``bound``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo the prime ``p`` with zeros below the first subdiagonal."""
    h = m.copy()
    d = len(h)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        if pivot := int(nonzero[0]):
            a, b = k + 1, k + 1 + pivot
            h[[a, b]] = h[[b, a]]
            h[:, [a, b]] = h[:, [b, a]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1]) % p
        # The inverse of that on the right: one column gains multiples of the others, each product reduced before the sum.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - m) modulo ``p``, the constant first."""
    h = hessenberg(m, p)
    d = len(h)
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(d):
        row = np.roll(polys[k], 1) - h[k, k] * polys[k] % p
        t, factors = 1, []
        for i in range(k - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            factors.append(int(h[i, k]) * t % p)
        if factors:
            row = row - (np.array(factors)[:, None] * polys[k - 1 :: -1][:k] % p).sum(axis=0)
        polys[k + 1] = row % p
    return polys[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - matrix), the constant first, for a positive semidefinite integer matrix.

    Each prime is a row of work for the executors; the driver puts the residues together.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The k-th symmetric function of the eigenvalues is at most C(d, k) (trace / d)^k.
    primes = primes_beyond(2 * (trace // d + 2) ** d)

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array(matrix, dtype=object)
        for frame in frames:
            for p in frame["p"]:
                yield pd.DataFrame({"p": [p], "c": [polynomial_mod((whole % int(p)).astype(np.int64), int(p))]})

    work = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in work.mapInPandas(residues, "p bigint, c array<bigint>").collect():
        rest = product // r.p
        weight = rest * pow(rest, -1, r.p)
        out = [x + int(c) * weight for x, c in zip(out, r.c, strict=True)]
    return [v if 2 * (v := x % product) <= product else v - product for x in out]


# ---- its largest roots ----


def _shifted(scaled: list[int], a: int) -> list[int]:
    """Coefficients of q(x + a)."""
    c = list(scaled)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_beyond(coefficients: list[int], a: int, s: int) -> int:
    """How many roots exceed a / 2^s, with multiplicity: sign changes about that point, exact as all roots are real."""
    d = len(coefficients) - 1
    signs = [x > 0 for x in _shifted([c << s * (d - k) for k, c in enumerate(coefficients)], a) if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(coefficients: list[int], most: int, bits: int = BITS) -> list[tuple[int, int]]:
    """The ``most`` largest positive roots, or all there are, as (a, s): the root lies above a / 2^s, at most (a + 1) / 2^s.

    Roots are isolated by counts; one that is alone is then closed in by the polynomial's sign.
    """
    d = len(coefficients) - 1
    counts: dict[Fraction, int] = {}

    def beyond(a: int, s: int) -> int:
        at = Fraction(a, 1 << s)
        if at not in counts:
            counts[at] = roots_beyond(coefficients, a, s)
        return counts[at]

    def sign(a: int, s: int) -> int:
        total = 0
        for k in range(d, -1, -1):
            total = total * a + (coefficients[k] << s * (d - k))
        return (total > 0) - (total < 0)

    # No root passes the sum of all.
    top = abs(coefficients[d - 1]) + 1
    positive = beyond(0, 0)
    out = []
    for k in range(1, min(most, positive) + 1):
        lo, hi, s = 0, top, 0
        over_lo, over_hi = positive, 0
        while hi - lo > 1 or lo.bit_length() < bits:
            if hi - lo == 1:
                lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) // 2
            if over_lo - over_hi == 1:
                # Every root passed from the right turns the sign once.
                over = over_hi + (sign(mid, s) == (-1) ** k)
            else:
                over = beyond(mid, s)
            if over >= k:
                lo, over_lo = mid, over
            else:
                hi, over_hi = mid, over
        out.append((lo, s))
    return out


# ---- components ----


def null_space(matrix: list[list[int]], a: int, s: int, many: int) -> list[list[float]]:
    """``many`` orthonormal vectors of the eigenvalue next to a / 2^s, by inverse iteration; the largest entry of each is positive."""
    d = len(matrix)
    with decimal.localcontext(prec=DIGITS):
        root = Decimal(a) / Decimal(1 << s)
        size = max(Decimal(1), *(abs(Decimal(matrix[i][i])) for i in range(d)))
        m = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        for i in range(d):
            m[i, i] -= root
        rng = np.random.default_rng(d)
        starts = [np.array([Decimal(int(v)) for v in rng.integers(-1000, 1000, d)], dtype=object) for _ in range(many)]
        # Elimination with row pivots; factors and order are kept for every right-hand side.
        steps = []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
            m[[k, pivot]] = m[[pivot, k]]
            if abs(m[k, k]) < size * Decimal(10) ** (-DIGITS + 20):
                m[k, k] = size * Decimal(10) ** (-DIGITS + 20)
            u = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k:] = m[k + 1 :, k:] - np.outer(u, m[k, k:])
            steps.append((pivot, u))

        def solve(b: np.ndarray) -> np.ndarray:
            b = b.copy()
            for k, (pivot, u) in enumerate(steps):
                b[[k, pivot]] = b[[pivot, k]]
                b[k + 1 :] = b[k + 1 :] - u * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - (m[k, k + 1 :] * b[k + 1 :]).sum()) / m[k, k]
            return b

        out: list[np.ndarray] = []
        for b in starts:
            for _ in range(3):
                b = solve(b)
                for other in out:
                    b = b - other * (other * b).sum()
                b = b / (b * b).sum().sqrt()
            out.append(b)
        vectors = [[float(x) for x in v] for v in out]
    return [[-x for x in v] if max(v, key=abs) < 0 else v for v in vectors]


def components(spark, matrix: list[list[int]], most: int = COMPONENTS) -> tuple[list[Fraction], list[list[float]]]:
    """The largest positive eigenvalues of an integer matrix and their unit vectors, equal eigenvalues with an orthonormal basis."""
    common = math.gcd(*(abs(v) for row in matrix for v in row))
    if not common:
        return [], []
    reduced = [[v // common for v in row] for row in matrix]
    roots = largest_roots(characteristic_polynomial(spark, reduced), most)
    groups: list[list[int]] = []
    for i, (a, s) in enumerate(roots):
        if groups and abs(Fraction(*_over(roots[groups[-1][0]])) - Fraction(*_over((a, s)))) <= Fraction(4, 1 << s):
            groups[-1].append(i)
        else:
            groups.append([i])
    work = [(g[0], len(g), str(roots[g[0]][0]), roots[g[0]][1]) for g in groups]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                found = null_space(reduced, int(r.a), int(r.s), int(r.many))
                yield pd.DataFrame({"at": range(r.at, r.at + len(found)), "v": found})

    rows = spark.createDataFrame(work, "at int, many int, a string, s int").repartition(max(1, len(work)))
    vectors = {r.at: list(r.v) for r in rows.mapInPandas(solve, "at int, v array<double>").collect()}
    return [Fraction(*_over(r)) * common for r in roots], [vectors[i] for i in range(len(roots))]


def _over(root: tuple[int, int]) -> tuple[int, int]:
    """The middle of a root's interval as numerator and denominator."""
    return 2 * root[0] + 1, 2 << root[1]


# ---- the operator ----


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    Entries become x = floor(scale * entry) + shift. Rows whose vector is null, empty, or holds null or
    non-finite entries are dropped, as are those of another length than most have (of equally common
    lengths the shorter counts); all others are fitted and returned, also with a null or repeated vec_id.
    Components are numbered by falling variance, up to ``most``; those without variance are not returned, so
    equal vectors, a single one or none give no rows. Of equal eigenvalues the vectors are some
    orthonormal basis, the same for all rows. A deviation beyond 64 bits is null, and exact in
    deviation_exact. Entries whose x leaves 62 bits are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    n, total = sums(rows, scale, shift)
    d = len(total)
    rows = rows.where(F.size("v") == d)
    matrix = scatter(rows, n, total, scale, shift) if n else []
    values, axes = components(spark, matrix, most) if n else ([], [])
    if not values:
        return spark.createDataFrame([], OUT)
    trace = sum(matrix[i][i] for i in range(d))
    base = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n for s in total], dtype=np.int64)
    # The scatter is n^2 times the covariance.
    to_unit = np.array(axes).T / np.sqrt([float(v / n**2) for v in values])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _integers(batch.column("v"), scale, shift) - base
            white = (z - rest / n) @ to_unit
            wide = n * (int(np.abs(z).max(initial=0)) + 1)
            off = n * (z if wide**2 * d < 2**63 else z.astype(object)) - rest
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _decimals((off * off).sum(axis=1)), pa.array(list(white), pa.list_(pa.float64()))], ["vec_id", "deviation_exact", "w"])

    white = materialise(rows.mapInArrow(project, "vec_id bigint, deviation_exact decimal(38,0), w array<double>"), "whitened")
    k = len(values)
    pairs = [F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - float(i == j) for i in range(k) for j in range(i, k)]
    error = max(abs(x) for x in white.agg(*[p.alias(f"c{i}") for i, p in enumerate(pairs)]).first())
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return white.select("vec_id", "deviation_exact", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as bigint)").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
