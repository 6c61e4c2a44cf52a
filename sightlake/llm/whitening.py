"""Whitening of embeddings: the leading principal components at unit variance.

Method: a bidiagonal qd solver. Blockwise QR reduces the centred rows: each task folds its batches
into one triangle R, triangles are folded together 16 at a time. Householder reflections turn the
last R into an upper bidiagonal matrix, dqds finds its singular values, and twisted factorisations
give the directions, which go back through the reflections. Only one d x d triangle, d being the
vectors' length, ever reaches the driver; rows never do.

Entries become integers, so sums and deviations are exact; n * x - S is an integer and is rounded once,
when it is divided by n.

Defined results: rows whose vector is NULL, empty, or holds NULL or non-finite entries are dropped,
and so are vectors of another length than most have (of equally frequent lengths the larger counts).
Entries beyond 2**52 / 1024 count as that bound. A deviation beyond a long is NULL. Components without
variance (singular value at most d * eps of the largest, for example of equal rows or of fewer rows
than dimensions) have ``whitened`` NULL and ``explained`` as found; without any other component
``identity_error`` is NULL. Equal eigenvalues share their plane in some orthonormal basis. Repeated rows
and ids count as rows. An empty table gives no rows; other columns are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sightlake.session import materialize

from .common import batch_of

COMPONENTS = 8
FAN_IN = 16
EPS = float(np.finfo(float).eps)
BOUND = float(1 << 52)


# ---- the small matrix --------------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and superdiagonal of U^T r V, and the reflections that make up V."""
    a, n = r.astype(float).copy(), r.shape[1]
    right = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x / norm
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :].copy())
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def turned_back(z: np.ndarray, right: list) -> np.ndarray:
    """Vectors of the bidiagonal matrix (columns) in the coordinates of the original one."""
    z = z.copy()
    for start, v in reversed(right):
        z[start:] -= 2 * np.outer(v, v @ z[start:])
    return z


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by differential quotient-difference
    steps with shifts."""
    top = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if top == 0:
        return np.zeros(len(diagonal))
    floor = (EPS * EPS) ** 2  # a zero pivot counts as eps squared of the largest entry
    blocks = [([max(x, floor) for x in ((diagonal / top) ** 2).tolist()], ((above / top) ** 2).tolist(), 0.0)]
    out = []
    while blocks:
        q, e, moved = blocks.pop()
        steps = 0
        while len(q) > 1:
            m = len(q)
            split = next((i for i in range(m - 2, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] == 0), None)
            if split is not None:
                blocks.append((q[: split + 1], e[:split], moved))
                q, e, steps = q[split + 1 :], e[split + 1 :], 0
                continue
            if 1.5 * q[0] < q[-1]:  # the small end goes last
                q, e = q[::-1], e[::-1]
            # the smaller eigenvalue of the last two by two, a little less
            a, b, c = q[-2] + (e[-2] if m > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half = (a - c) / 2
            low = c - b / ((half + math.hypot(half, math.sqrt(b))) or 1.0) if half >= 0 else a - b / (-half + math.hypot(half, math.sqrt(b)))
            shift = max(0.0, min(low, q[-1])) * (1 - 1e-10)
            if steps % 12 == 11:
                shift = 0.0
            while True:
                done = _step(q, e, shift)
                if isinstance(done, tuple):
                    break
                # too large a shift: one that failed at the very end tells a better one
                shift = shift + done if -shift < done else shift / 4
                if shift < 1e-300:
                    shift = 0.0
            (q, e), moved, steps = done, moved + shift, steps + 1
        out += [x + moved for x in q]
    return np.array(sorted(out, reverse=True)) * top * top


def _step(q: list[float], e: list[float], shift: float):
    """One dqds step; where a pivot turns negative, that pivot (or minus infinity before the last)."""
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return -math.inf
        pivot = d + e[i]
        t = q[i + 1] / pivot if pivot else 1.0
        new_q.append(pivot)
        new_e.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return d if shift else ([*new_q, 0.0], new_e)
    return [*new_q, d], new_e


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of B^T B for ``value``, B upper bidiagonal, at right angles to ``others`` (vectors of
    nearby values)."""
    n = len(diagonal)
    scale = float(np.abs(diagonal).max() + np.abs(above).max(initial=0)) ** 2 or 1.0
    tiny = scale * EPS * EPS
    base = np.where(diagonal == 0, math.sqrt(tiny), diagonal)
    d = (base * base).tolist()
    l = (above / base[:-1]).tolist() if n > 1 else []  # noqa: E741

    def factors(x: float):
        s, up, low = [-x], [], []
        for i in range(n - 1):
            pivot = (s[i] + d[i]) or -tiny
            low.append(d[i] * l[i] / pivot)
            s.append(low[i] * l[i] * s[i] - x)
        p = [0.0] * n
        p[-1] = d[-1] - x
        up = [0.0] * max(0, n - 1)
        for i in range(n - 2, -1, -1):
            own = d[i] * l[i] * l[i]
            t = d[i] / ((own + p[i + 1]) or -tiny)
            up[i] = l[i] * t
            p[i] = (p[i + 1] * t if own else d[i]) - x
        gamma = [abs(g) if math.isfinite(g := a + b + x) else math.inf for a, b in zip(s, p)]
        return low, up, gamma, [a + b + x for a, b in zip(s, p)]

    def solved(k: int, low: list[float], up: list[float]) -> np.ndarray:
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z

    best = None
    for _ in range(4):  # the twist and a Rayleigh correction of the value
        low, up, gamma, signed = factors(value)
        k = int(np.argmin(gamma))
        z = solved(k, low, up)
        square = float(z @ z)
        if not math.isfinite(square):
            break
        best = z / math.sqrt(square)
        change = signed[k] / square
        if not others and abs(change) > 4 * EPS * abs(value):
            value += change
        else:
            break
    order = np.argsort(gamma)[: max(8, 2 * len(others) + 2)]
    choices = [best] if best is not None else []
    for k in order.tolist() if others or best is None else ():
        z = solved(k, low, up)
        if np.isfinite(z).all():
            choices.append(z / np.linalg.norm(z))
    random = np.random.default_rng(n + len(others))
    choices += [v / np.linalg.norm(v) for v in random.standard_normal((2, n))]
    for z in choices:  # the first that is no copy of its neighbours
        rest = z
        for _ in range(2):
            for o in others:
                rest = rest - (o @ rest) * o
        size = float(np.linalg.norm(rest))
        if size > 0.3 or not others:
            return _polished(rest / size, diagonal, above, value, others, scale)
    return _polished(rest / size, diagonal, above, value, others, scale)


def _polished(z: np.ndarray, diagonal: np.ndarray, above: np.ndarray, value: float, others: list[np.ndarray], scale: float) -> np.ndarray:
    """Inverse iteration inside a cluster of close values; a lone vector is good as it is."""
    if not others:
        return z
    t = np.diag(diagonal) + np.diag(above, 1)
    t = t.T @ t - (value + scale * EPS * 8) * np.eye(len(z))
    z = z + 0.01 * np.random.default_rng(len(others)).standard_normal(len(z))  # some of every direction
    for _ in range(3):
        z = np.linalg.solve(t, z)
        for _ in range(2):
            for o in others:
                z = z - (o @ z) * o
        z /= np.linalg.norm(z)
    return z


def components(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, falling, and its leading right singular vectors as columns."""
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    vectors: list[np.ndarray] = []
    for k in range(min(count, len(values))):
        near = [vectors[j] for j in range(k) if values[j] - values[k] <= 1e-3 * values[j]]
        vectors.append(twisted_vector(diagonal, above, float(values[k]), near))
    return values, turned_back(np.stack(vectors, axis=1), right)


# ---- the rows ----------------------------------------------------------------------------------

def _integers(vector: Column) -> Column:
    entry = lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double") * 1024))) + 100000
    return F.transform(vector, entry)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that are kept."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("v") == d).select("vec_id", _integers(F.col("v")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of every dimension."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.string())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _matrices(batches, 0):
            for part in np.array_split(x, max(1, len(x) // 512)):  # 512 entries of 53 bits fit a long
                own = [int(s) for s in part.sum(axis=0)]
                total = own if total is None else [a + b for a, b in zip(total, own)]
            n += len(x)
        if total:
            yield batch_of(schema, [range(len(total)), [n] * len(total), list(map(str, total))])

    parts = rows.select("x").mapInArrow(add, "dim int, n long, total string")
    sums = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = sums.orderBy("dim").collect()  # one row a dimension
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def _centred(x: np.ndarray, n: int, sums: np.ndarray, top: float) -> np.ndarray:
    """n * x - S, integers: in longs where they fit, else Python's own."""
    if n * top < 2.0**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows, by blockwise QR in tasks and rounds of ``FAN_IN`` triangles."""
    schema = pa.schema([("part", pa.int64()), ("r", pa.binary())])
    d, s = len(sums), np.array(sums, object)

    def folded(r: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, block]), mode="r")

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for x in _matrices(batches, 0):
            y = _centred(x, n, s, float(np.abs(x).max()) + float(max(map(abs, sums))) / n)
            r = folded(r, y.astype(float) / n)
        if len(r):
            yield batch_of(schema, [[TaskContext.get().partitionId()], [r.tobytes()]])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for part in table.sort_by("part").column("r").to_pylist():
            r = folded(r, np.frombuffer(part).reshape(-1, d))
        return pa.table([[key[0].as_py()], [r.tobytes()]], schema=schema)

    parts = materialize(rows.select("x").mapInArrow(reduce_rows, "part long, r binary"), "triangles")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        parts = parts.withColumn("key", F.floor(F.col("part") / FAN_IN)).groupBy("key").applyInArrow(fold, "part long, r binary")
        last //= FAN_IN
    r = np.frombuffer(parts.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def whitened(df: DataFrame, count: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(df, vec_id, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    report = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = exact_sums(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], report)
    r = triangle(rows, n, sums)
    squares, vectors = components(r, count)
    k, d = vectors.shape[1], len(sums)
    trace = float((r * r).sum())
    lively = squares[:k] > (d * EPS) ** 2 * squares[0] if squares[0] > 0 else np.zeros(k, bool)
    weights = np.where(lively, vectors / np.sqrt(np.where(lively, squares[:k] / n, 1.0)), 0.0)
    explained = [float(v / trace) if trace else 0.0 for v in squares[:k]]
    s, mean = np.array(sums, object), float(max(map(abs, sums))) / n

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(x, n, s, float(np.abs(x).max()) + mean)
        return y, (y.astype(float) / n) @ weights

    pair_schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for x in _matrices(batches, 0):
            z = np.hstack([projected(x)[1], np.ones((len(x), 1))])
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield batch_of(pair_schema, [i.ravel(), j.ravel(), total.ravel()])

    found = rows.select("x").mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    table = np.zeros((k + 1, k + 1))
    for row in found:  # (k + 1) squared rows
        table[row["i"], row["j"]] = row["total"]
    covariance = table[:k, :k] / n - np.outer(table[:k, k], table[:k, k]) / n / n
    off = np.abs(covariance - np.eye(k))[np.ix_(lively, lively)]
    error = float(off.max()) if off.size else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, z = projected(x)
            if y.dtype != object and d * float(np.abs(y).max()) ** 2 < 2.0**62:
                deviation = (y * y).sum(axis=1).tolist()
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in y]
                deviation = [v if v < 1 << 63 else None for v in exact]
            m, at = batch.num_rows, np.repeat(np.arange(batch.num_rows), k)
            none = np.tile(~lively, m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(z.ravel(), mask=none), pa.array(np.tile(explained, m)),
                pa.array([error] * (m * k), pa.float64()),
            ], names=[c.split()[0] for c in report.split(", ")])

    return rows.mapInArrow(apply, report)
