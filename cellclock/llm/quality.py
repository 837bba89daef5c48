"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from the bytes it is made of and
from the kinds of characters that follow each other; gated attention weighs the passages;
the weighted representation is scored. Only documents carry labels, and encoder, attention
and score are learnt from these together (numpy, Adam), so the model finds the passages
that make a document good or bad on its own.

The model is fitted on at most ``train_rows`` labelled documents, those with the smallest
hash of their id; that bound makes the training task's size independent of the corpus.
Scoring reads every whole text.
"""

from __future__ import annotations

import io
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import crc_bucket, fresh, string_bytes

PASSAGE = 512  # bytes of a passage
TRAIN_ROWS = 4000
CODE, GATE = 24, 12  # sizes of the passage code and of the attention layer
EPOCHS, BAGS = 40, 64
CHUNK = 1 << 20
THRESHOLD = 0.7
KINDS = 12
CELLS = 256  # for the variety of a passage's 4- and 8-byte runs
FEATURES = 128 + KINDS * KINDS + 4


@lru_cache(maxsize=1)
def _kinds():
    """The kind of every byte value."""
    import numpy as np

    kind = np.full(256, 9, np.int64)  # other punctuation and control
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10] = 3, 4
    for n, group in ((5, ".,;:"), (6, "!?"), (7, "|<>{}[]\\/=_~"), (8, "#$%&*@^+")):
        kind[[ord(c) for c in group]] = n
    kind[192:], kind[128:192] = 10, 11
    return kind


def passage_codes(texts: list[bytes]):
    """(features, bounds): a row for each passage; text i has rows bounds[i]:bounds[i + 1].

    An empty text has one passage of zeros."""
    import numpy as np

    kinds = _kinds()
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((int(bounds[-1]), FEATURES), np.float32)
    pieces, rows, size = [], [], 0

    def flush():
        nonlocal pieces, rows, size
        if not pieces:
            return
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces])
        at = np.repeat(np.arange(len(pieces)), lengths)
        single = np.bincount(at * 128 + np.minimum(data, 127), minlength=len(pieces) * 128).reshape(-1, 128)
        k = kinds[data]
        inside = at[1:] == at[:-1]  # a pair never spans two passages
        pair = np.bincount((at[1:] * (KINDS * KINDS) + k[:-1] * KINDS + k[1:])[inside], minlength=len(pieces) * KINDS * KINDS).reshape(-1, KINDS * KINDS)
        out[rows, :-4] = np.sqrt(np.concatenate([single, pair], axis=1) / lengths[:, None]) * 2
        # Variety: cells that the hashes of 4- and 8-byte runs fill, and the fullest one.
        mix = data.astype(np.uint32)
        for n, span in enumerate((1, 2, 4)):
            mix = mix * np.uint32(0x9E3779B1)
            mix[span:] += mix[:-span] * np.uint32(0x85EBCA77 + 2 * n)
            if n:  # mix covers the 2 * span bytes up to its own, which count inside a passage only
                back = 2 * span - 1
                inside = at[back:] == at[: max(len(at) - back, 0)]
                cell = np.bincount((at * CELLS + (mix >> np.uint32(24)))[back:][inside], minlength=len(pieces) * CELLS).reshape(-1, CELLS)
                out[rows, 2 * n - 6] = (cell > 0).sum(1) / np.minimum(lengths, CELLS)
                out[rows, 2 * n - 5] = np.sqrt(cell.max(1) / lengths) * 2
        pieces, rows, size = [], [], 0

    for i, text in enumerate(texts):
        for j in range(0, len(text), PASSAGE):
            pieces.append(text[j : j + PASSAGE])
            rows.append(int(bounds[i]) + j // PASSAGE)
            size += PASSAGE
            if size >= CHUNK:
                flush()
    flush()
    return out, bounds


class AttentionModel:
    """Encoder, gated attention and score with their gradients."""

    NAMES = ("We", "be", "V", "U", "w", "u", "c")

    def __init__(self, weights: dict):
        self.p = weights

    @classmethod
    def fresh(cls, width: int, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return cls(
            {
                "We": draw(width, CODE),
                "be": np.zeros(CODE, np.float32),
                "V": draw(CODE, GATE),
                "U": draw(CODE, GATE),
                "w": draw(GATE, 1),
                "u": draw(CODE, 1),
                "c": np.zeros(1, np.float32),
            }
        )

    def forward(self, x, starts):
        """Logits of the bags that begin at ``starts``, and what the gradient needs."""
        import numpy as np

        p = self.p
        e = np.tanh(x @ p["We"] + p["be"])
        tv, su = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        s = ((tv * su) @ p["w"])[:, 0]
        sizes = np.diff(np.append(starts, len(x)))
        s = s - np.repeat(np.maximum.reduceat(s, starts), sizes)
        a = np.exp(s)
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * e, starts)
        return (z @ p["u"])[:, 0] + p["c"][0], (e, tv, su, a, z, sizes)

    def gradient(self, x, starts, y):
        """Gradients of the mean log loss."""
        import numpy as np

        p = self.p
        logit, (e, tv, su, a, z, sizes) = self.forward(x, starts)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["u"][:, 0]
        dz_rows = np.repeat(dz, sizes, axis=0)
        da = (dz_rows * e).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dg = ds[:, None] * p["w"][:, 0]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        de = a[:, None] * dz_rows + dv @ p["V"].T + du @ p["U"].T
        de *= 1 - e**2
        return {
            "We": x.T @ de,
            "be": de.sum(0),
            "V": e.T @ dv,
            "U": e.T @ du,
            "w": (tv * su).T @ ds[:, None],
            "u": z.T @ d[:, None],
            "c": d.sum(keepdims=True),
        }

    def fit(self, x, bounds, y, epochs: int = EPOCHS, bags: int = BAGS, rate: float = 0.004, decay: float = 1e-4, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            now = rate * (1 - epoch / epochs) + rate / 20
            for i in range(0, len(y), bags):
                some = order[i : i + bags]
                sizes = bounds[some + 1] - bounds[some]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                rows = np.repeat(bounds[some] - starts, sizes) + np.arange(sizes.sum())
                step += 1
                for k, g in self.gradient(x[rows], starts, y[some]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= now * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])
        return self

    def scores(self, texts: list[bytes]):
        import numpy as np

        out, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                x, bounds = passage_codes(held)
                # One text at a time: matrix products round by their shapes, and equal
                # texts are to have equal scores whatever stands beside them.
                one = np.zeros(1, np.int64)
                logits = [self.forward(x[a:b], one)[0][0] for a, b in zip(bounds[:-1], bounds[1:])]
                out.append(1 / (1 + np.exp(-np.array(logits, np.float64))))
                held, size = [], 0
        return np.concatenate(out) if out else np.empty(0)

    def dumps(self) -> bytes:
        import numpy as np

        buffer = io.BytesIO()
        np.savez(buffer, **self.p)
        return buffer.getvalue()

    @classmethod
    def loads(cls, data: bytes):
        import numpy as np

        with np.load(io.BytesIO(data)) as held:
            return cls({k: held[k] for k in cls.NAMES})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, held_modulus: int = 4, held_rest: int = 2) -> bytes | None:
    """A model fitted on labelled documents that are not held out, or None without any.

    ``labels`` has doc_id and ``label`` (0 or 1); null ids and labels are left out, of
    several labels of a document the larger counts. Held out are rows whose crc32(doc_id)
    mod ``held_modulus`` is ``held_rest``. The sample is bounded by ``train_rows``.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_bucket("doc_id", held_modulus) != held_rest))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("float").alias("_y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = string_bytes(batch.column(1))
            if texts:
                x, bounds = passage_codes(texts)
                codes = [x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.binary())], names=["doc_id", "_y", "codes"])

    def fit(batches):
        import numpy as np
        import pyarrow as pa

        bags = []
        for batch in batches:
            bags += zip(*(batch.column(i).to_pylist() for i in range(3)))
        if not bags:
            return
        bags.sort()
        x = [np.frombuffer(c, np.float16).reshape(-1, FEATURES) for _, _, c in bags]
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in x])])
        y = np.array([b[1] for b in bags], np.float32)
        model = AttentionModel.fresh(FEATURES).fit(np.concatenate(x).astype(np.float32), bounds, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.binary())], names=["model"])

    coded = rows.mapInArrow(encode, "doc_id long, _y float, codes binary")
    found = coded.repartition(1).mapInArrow(fit, "model binary").collect()  # one model of fixed size
    return bytes(found[0]["model"]) if found else None


@lru_cache(maxsize=2)
def _model(data: bytes) -> AttentionModel:
    return AttentionModel.loads(data)


def score(docs: DataFrame, model: bytes | None, column: str = "score") -> DataFrame:
    """Add ``column``, the probability of the label 1, to every row.

    Null and empty texts are scored as a passage of nothing. Without a model every row
    has 0.5. Columns that have this name are replaced.
    """
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        found = _model(model)
        for batch in batches:
            got = found.scores(string_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        (crc_bucket("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    (column,) = fresh(docs, "_quality")
    scored = score(docs, train(docs, labels), column)
    return scored.where(F.col(column) >= threshold).select(docs.columns)
