"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without forming V. A block Q of
columns is refined by passes over the vectors: each pass is a Spark job in which every task
returns the sum of x'(xQ) of its centred vectors x. An iteration applies a Chebyshev
polynomial of V to Q by the three-term recurrence, one pass for each degree; the polynomial
is small on [0, b], the unwanted part of the spectrum, and grows fast above b. Then come a
QR factorisation and a Rayleigh-Ritz projection, whose pass also gives the residuals
Vq - eq. It ends when every wanted residual is at rounding level, which certifies the pairs.

Vectors are packed once into blocks (a row of a Parquet table for some thousand vectors),
as integers, so that a pass reads few rows and n, S and deviation stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import written

COMPONENTS = 8
GUARDS = 24  # columns of the block beyond the wanted ones
DEGREE = 12
ITERATIONS = 60
# Residuals in terms of the largest eigenvalue: one that certifies a pair, and the level of
# rounding; between the two the iteration goes on as long as residuals still halve.
CERTIFIED, ROUNDING = 1e-11, 4e-15
SCALE, SHIFT = 1024, 100_000
BLOCK = 4096  # vectors of a block
LARGEST = 2.0**62 / SCALE  # entries beyond this have no place in a long


class NotCertified(ArithmeticError):
    """The iteration did not reach the wanted residuals."""


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of rows with a vector of finite entries.

    Vectors whose length is not the most frequent one (of several, the largest) have no
    place in the same space and are dropped as well; so are vectors without entries."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  NaN is larger than infinity
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors: ``ids``, ``n``, ``sums`` of each dimension and the integers ``x``
    (4 or 8 bytes each, one vector after the other)."""
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n", T.LongType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
            T.StructField("x", T.BinaryType()),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, parts, held = [], [], 0

        def block():
            x = np.concatenate(parts)
            small = len(x) == 0 or np.abs(x).max() < 1 << 31
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(ids)),
                    pa.array([len(x)], pa.int64()),
                    pa.array([x.sum(0).tolist()], pa.list_(pa.int64())),
                    pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                ],
                schema=pa.schema([("ids", pa.list_(ids[0].type)), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("x", pa.binary())]),
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if np.abs(c).max() > LARGEST:
                raise ArithmeticError("an entry is too large: 1024 times its value does not fit into a long")
            ids.append(batch.column(0))
            parts.append(np.floor(SCALE * c).astype(np.int64) + SHIFT)
            held += batch.num_rows
            if held >= BLOCK:
                yield block()
                ids, parts, held = [], [], 0
        if held:
            yield block()

    return vectors.mapInArrow(run, schema)


class Covariance:
    """Products with the covariance of packed blocks; each product is one pass."""

    def __init__(self, blocks: DataFrame):
        import numpy as np

        self.blocks = blocks
        sums = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at")
        self.sums = [int(r["s"]) for r in sums.collect()]  # one number for each dimension
        self.n = int(blocks.agg(F.sum("n").alias("n")).first()["n"] or 0)
        self.d = len(self.sums)
        # floor and rest apart, so that the mean has no rounding beyond its own
        self.mean = np.array([s // self.n + (s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(0)
        self.passes = 0

    def _summed(self, part, length: int):
        """Sums over all blocks of ``part(centred vectors)``, an array of ``length``.

        Tasks add up their blocks, then Spark the tasks' numbers, so only ``length``
        numbers reach the driver, however many tasks there are."""
        import numpy as np

        d, mean = self.d, self.mean

        def run(batches):
            import numpy as np
            import pyarrow as pa

            total = np.zeros(length)
            for batch in batches:
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    total += part(_integers(x.as_buffer(), n, d) - mean).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

        self.passes += 1
        parts = self.blocks.select("n", "x").mapInArrow(run, "part array<double>")
        rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(length)
        for r in rows:
            out[r["at"]] = r["v"]
        return out

    def times(self, q):
        """Vq, from x'(xq) of all centred vectors."""
        return self._summed(lambda x: x.T @ (x @ q), q.size).reshape(q.shape) / self.n

    def spread(self):
        """The diagonal of V; its sum is the trace."""
        return self._summed(lambda x: (x * x).sum(0), self.d) / self.n

    def projected(self, p):
        """Covariance of (x - mean) p."""
        k = p.shape[1]
        mean = self._summed(lambda x: (x @ p).sum(0), k) / self.n
        return self._summed(lambda x: (y := x @ p - mean).T @ y, k * k).reshape(k, k) / self.n


def _integers(data, n: int, d: int):
    """A block's integers, a row for each vector."""
    import numpy as np

    return np.frombuffer(data, "<i4" if len(data) == 4 * n * d else "<i8").reshape(n, d)


def components(v: Covariance, k: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, seed: int = 17):
    """(eigenvalues, eigenvectors as columns) of the k largest, certified by residuals.

    Raises NotCertified where residuals stay above CERTIFIED times the largest eigenvalue.
    Equal eigenvalues have any orthonormal vectors of their space.
    """
    import numpy as np

    wide = min(v.d, k + guards)
    k = min(k, v.d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.d, wide)))[0]
    last = float("inf")
    for _ in range(ITERATIONS):
        vq = v.times(q)
        small = q.T @ vq
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        off = float(np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max())
        if off <= ROUNDING * e[0] * np.sqrt(v.d) or last / 2 < off <= CERTIFIED * e[0]:
            return e[:k], q[:, :k]
        last = off
        if wide == v.d:  # the block is the whole space: only rounding is left
            continue
        # Chebyshev recurrence on [0, b], scaled so that values at e[0] stay near 1
        b = max(float(e[-1]), 1e-3 * float(e[0]))
        half = b / 2
        sigma = half / (e[0] - half) if e[0] > b else 1.0
        now, before, ratio = (vq - half * q) * (sigma / half), q, sigma
        for _ in range(degree - 1):
            following = 1 / (2 / sigma - ratio)
            now, before = (v.times(now) - half * now) * (2 * following / half) - before * (ratio * following), now
            ratio = following
        q = np.linalg.qr(now)[0]
    raise NotCertified(f"residuals of {last:.3g} after {ITERATIONS} iterations, largest eigenvalue {e[0]:.3g}")


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every
    usable vector and each of its ``k`` leading components.

    All usable rows count, repeated ones as often as they occur; null ids are kept. A
    component without variance (an eigenvalue below 1e-12 of the trace) cannot be whitened
    and has no rows, so equal vectors alone give none; an empty table gives none. A
    deviation beyond a long raises ArithmeticError. Other columns are not looked at.
    """
    import numpy as np

    blocks = written(packed(usable(vectors)), "vectors")
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_id", id_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    v = Covariance(blocks)
    trace = float(v.spread().sum()) if v.n else 0.0
    if not trace > 0:
        return vectors.sparkSession.createDataFrame([], schema)
    e, p = components(v, k)
    found = e > 1e-12 * trace
    e, p = e[found], p[:, found]
    scaled = p / np.sqrt(e)
    error = float(np.abs(v.projected(scaled) - np.eye(len(e))).max())
    n, d, mean, sums, shares, kept = v.n, v.d, v.mean, v.sums, e / trace, len(e)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        s = np.array(sums, object)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, data = batch.column(0)[at].values, batch.column(1)[at].as_buffer()
                m = len(ids)
                x = _integers(data, m, d)
                # In longs where they hold the largest square, else exactly and checked.
                reach = max(n * int(x.max()) - min(sums), max(sums) - n * int(x.min()), 1)
                if reach * reach * d < 1 << 63:
                    y = n * x.astype(np.int64) - s.astype(np.int64)
                    deviation = (y * y).sum(1)
                else:
                    exact = [sum((n * int(c) - t) ** 2 for c, t in zip(row, sums)) for row in x.tolist()]
                    if max(exact) >= 1 << 63:
                        raise ArithmeticError("a deviation does not fit into a long")
                    deviation = np.array(exact, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), kept))),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * kept, n, np.int64)),
                        pa.array(np.repeat(deviation, kept)),
                        pa.array(((x - mean) @ scaled).ravel()),
                        pa.array(np.tile(shares, m)),
                        pa.array(np.full(m * kept, error)),
                    ],
                    names=schema.names,
                )

    return blocks.select("ids", "x").mapInArrow(run, schema)
