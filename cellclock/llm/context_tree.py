"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, with one blank between them and a line feed as its
end; a score is the log10 probability of that string, so of the words and the end. Every
byte is eight binary decisions. Each decision has a tree of contexts, the last 0 to DEPTH
bytes; a node predicts by the Krichevsky-Trofimov estimate of its counts, and all depths
are mixed with the weights that context-tree weighting gives them: a node's own estimate
against the product over its longer contexts, half and half before the data. Training
counts are frozen when texts are scored; where a longer context was never seen, the mix
ends with the node before it.

How it is spread. Documents are packed into blocks. A block reports its distinct grams
(DEPTH + 1 bytes) and words with their training counts; sums of these are the corpus
counts. Nodes from depth SPLIT on lie wholly with one run of the last SPLIT bytes, so
partitions by that run build them alone; the few above are built from sums of what the
partitions report. Every gram's probability is then joined back to the blocks that hold
it; only what most blocks hold, COMMON entries at most, is broadcast instead. Nothing
whole passes through one task: the model is a table as large as the corpus makes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import crc_bucket, partitions, string_bytes, written

DEPTH = 5  # bytes of context
SPLIT = 3  # bytes of context that a partition has for itself
BLOCK_DOCS = 6000
BLOCK_BYTES = 24 << 20  # a block ends at either bound
COMMON = 1 << 18  # entries broadcast at most
CHUNK = 1 << 20  # bytes looked at together
END = -1  # code of the end token; other words have negative codes below it, grams none

_ITEMS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("code", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("pack", T.BinaryType()),
    ]
)
_NODES = T.StructType(
    [
        T.StructField("run", T.LongType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("zeros", T.LongType()),
        T.StructField("ones", T.LongType()),
        T.StructField("weighted", T.DoubleType()),
    ]
)
_SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


# --- grams and words of a block -------------------------------------------------------


def canonical(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def gram_codes(data: bytes, depth: int):
    """A code for every byte of ``data``: itself, then the bytes before it, nearest first."""
    import numpy as np

    a = np.frombuffer(b"\n" * depth + data, np.uint8).astype(np.int64)
    n = len(data)
    code = a[depth:].copy()
    for k in range(1, depth + 1):
        code |= a[depth - k : depth - k + n] << (8 * k)
    return code


def word_codes(group: list[bytes]):
    """Codes of the words of canonical texts, each with its end, and their numbers."""
    import numpy as np

    from cellclock.llm.shingles import word_hashes

    hashes, bounds = word_hashes(group)
    codes = (hashes | np.uint64(1 << 63)).view(np.int64)
    codes[codes == END] -= 1
    return np.insert(codes, bounds[1:], END), np.diff(bounds) + 1


def runs(documents: list[bytes]):
    """Groups of canonical documents of about CHUNK bytes; (index of the first, bytes each)."""
    first, size, group = 0, 0, []
    for i, d in enumerate(documents):
        if group and size + len(d) > CHUNK:
            yield first, group
            first, size, group = i, 0, []
        group.append(d)
        size += len(d)
    if group:
        yield first, group


def _counted(parts):
    """Distinct codes of several (codes, counts) with summed counts."""
    import numpy as np

    codes = np.concatenate([c for c, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def block_items(documents: list[bytes], train: list[bool], depth: int):
    """Distinct grams and words of canonical documents with their counts in training texts."""
    import numpy as np

    grams, words = [], []
    for first, group in runs(documents):
        flagged = np.array(train[first : first + len(group)], np.int64)
        word, sizes = word_codes(group)
        gram = np.concatenate([gram_codes(d, depth) for d in group])
        for kind, out, both, lengths in (("g", grams, gram, [len(d) for d in group]), ("w", words, word, sizes)):
            flags = np.repeat(flagged, lengths)
            if kind == "g":  # grams leave room for the flag
                both = np.sort(both << 1 | flags)
                both, flags = both >> 1, both & 1
            else:
                order = np.argsort(both, kind="stable")
                both, flags = both[order], flags[order]
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            out.append((both[starts], np.add.reduceat(flags, starts)))
    pairs = [_counted(x) for x in (grams, words) if x]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*pairs))


# --- trees ------------------------------------------------------------------------------


def _log_gamma(x):
    import numpy as np

    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6))
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros, ones):
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class _Level:
    """Nodes of one depth: sorted keys (context << 8 | node), counts, log weighted probability."""

    def __init__(self, keys, zeros, ones, below=None):
        import numpy as np

        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros.astype(float), ones.astype(float))
        if below is None:
            self.weighted, self.share = own, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(own, below) - math.log(2)
            self.share = np.exp(own - math.log(2) - self.weighted)  # weight of the node's own estimate

    @property
    def estimate(self):
        """Probability of a one by the node's counts."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def build_levels(codes, counts, depth: int, top: int):
    """Levels ``top`` … ``depth`` of the trees under the given grams, and each gram's eight
    positions in the deepest level."""
    import numpy as np

    context, symbol = codes >> 8, codes & 255
    keys, bits = [], []
    for bit in range(8):
        node = (1 << bit) | (symbol >> (8 - bit))
        keys.append(context << 8 | node)
        bits.append(symbol >> (7 - bit) & 1)
    flat, one = np.concatenate(keys), np.concatenate(bits)
    n = np.tile(counts, 8)
    unique, at = np.unique(flat, return_inverse=True)
    zeros = np.bincount(at, np.where(one == 0, n, 0), len(unique)).astype(np.int64)
    ones = np.bincount(at, np.where(one == 1, n, 0), len(unique)).astype(np.int64)
    levels = {depth: _Level(unique, zeros, ones)}
    parents = {}
    for d in range(depth - 1, top - 1, -1):
        below = levels[d + 1]
        short = ((below.keys >> 8) & ((1 << 8 * d) - 1)) << 8 | (below.keys & 255)
        unique, up = np.unique(short, return_inverse=True)
        parents[d + 1] = up
        sums = [np.bincount(up, x, len(unique)) for x in (below.zeros, below.ones, below.weighted)]
        levels[d] = _Level(unique, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2])
    return levels, parents, at.reshape(8, -1), one.reshape(8, -1)


def gram_log10(codes, counts, depth: int, top: int, above):
    """log10 probability of each gram's byte in its context.

    ``above`` maps arrays of the keys of level ``top`` to what the shorter contexts give
    them: (a, b, u), where a + b p is the mix if the node predicts p and u that without it.
    """
    import numpy as np

    levels, parents, at, one = build_levels(codes, counts, depth, top)
    a, b, u = above(levels[top].keys)
    for d in range(top, depth + 1):
        level = levels[d]
        seen = level.zeros + level.ones > 0
        kt = level.estimate
        if d == depth:
            value = np.where(seen, a + b * kt, u)
            break
        u = np.where(seen, a + b * kt, u)  # where no longer context was seen
        a, b = a + b * level.share * kt, b * (1 - level.share)
        up = parents[d + 1]
        a, b, u = a[up], b[up], u[up]
    value = value[at]
    return np.log10(np.where(one == 1, value, 1 - value)).sum(axis=0)


# --- short contexts, as columns ------------------------------------------------------------


def _log_gamma_column(x: Column) -> Column:
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6))
    z = x + 7
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (z * 12) - 1 / (z * z * z * 360) + 1 / (z * z * z * z * z * 1260) - shift


def _with_weights(nodes: DataFrame) -> DataFrame:
    """Add the node's estimate, its weighted log probability and the weight of its own."""
    zeros, ones = F.col("zeros").cast("double"), F.col("ones").cast("double")
    own = _log_gamma_column(zeros + 0.5) + _log_gamma_column(ones + 0.5) - _log_gamma_column(zeros + ones + 1.0) - math.log(math.pi)
    nodes = nodes.withColumn("own", own)
    most = F.greatest("own", "below")
    mix = most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("below") - most)) - math.log(2)
    nodes = nodes.withColumn("weighted", mix)
    return nodes.withColumn("share", F.exp(F.col("own") - math.log(2) - F.col("weighted"))).withColumn("kt", (ones + 0.5) / (zeros + ones + 1.0))


def short_contexts(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """(run, node, a, b, u) for the nodes of depth ``split``: what the mix over the shorter
    contexts makes of their prediction. ``nodes`` has run, node, counts and weighted."""
    levels = {}
    below = nodes
    for d in range(split - 1, -1, -1):
        grouped = below.withColumn("run", F.col("run").bitwiseAND(F.lit((1 << 8 * d) - 1))).groupBy("run", "node")
        sums = grouped.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        below = levels[d] = written(_with_weights(sums), "short-contexts")
    mix = levels[0].select("run", "node", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.5).alias("u"))
    for d in range(split):
        here = levels[d].join(mix, ["run", "node"])
        seen = F.col("zeros") + F.col("ones") > 0
        mix = here.select(
            F.col("run").alias("up"),
            "node",
            (F.col("a") + F.col("b") * F.col("share") * F.col("kt")).alias("a"),
            (F.col("b") * (1 - F.col("share"))).alias("b"),
            F.when(seen, F.col("a") + F.col("b") * F.col("kt")).otherwise(F.col("u")).alias("u"),
        )
        lower = levels[d + 1] if d + 1 < split else nodes
        lower = lower.select("run", F.col("run").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("up"), "node")
        mix = lower.join(mix, ["up", "node"]).select("run", "node", "a", "b", "u")
    return mix


# --- the operator ---------------------------------------------------------------------------


def pack(ids, held: list[bool], documents: list[bytes]) -> bytes:
    """Documents of a block as one compressed record."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(documents, pa.large_binary())], names=["doc_id", "held_out", "text"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes):
    import pyarrow as pa

    with pa.ipc.open_stream(data) as held:
        return held.read_next_batch()


def packed_blocks(docs: DataFrame, held_modulus: int, depth: int = DEPTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of documents as they are read: a row with the packed documents, and a row
    (block, code, n) for each distinct gram and word with its count in training texts."""
    held = crc_bucket("doc_id", held_modulus) == 0

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, flags, documents, size = [], [], [], 0

        def block():
            number = part << 32 | seq
            codes, counts = block_items(documents, [not f for f in flags], depth)
            names = _ITEMS.names
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number]), none, none, pa.array([pack(ids, flags, documents)], pa.binary())], names=names)
            for at in range(0, len(codes), 1 << 16):
                some = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), number)), pa.array(some), pa.array(counts[at : at + (1 << 16)]), pa.nulls(len(some), pa.binary())], names=names
                )

        for batch in batches:
            for i, f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), string_bytes(batch.column(2))):
                ids.append(i)
                flags.append(f)
                documents.append(canonical(t))
                size += len(documents[-1])
                if len(ids) >= block_docs or size >= BLOCK_BYTES:
                    yield from block()
                    ids, flags, documents, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield from block()

    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, _ITEMS)


def _by_run(grams: DataFrame, extra: DataFrame | None, parts: int, split: int):
    rows = grams.select(F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * split) - 1)).alias("run"), "code", "n")
    if extra is None:
        return rows.repartition(parts, "run")
    none = F.lit(None)
    rows = rows.select("run", "code", "n", none.cast("int").alias("node"), *[none.cast("double").alias(c) for c in "abu"])
    extra = extra.select("run", none.cast("long").alias("code"), none.cast("long").alias("n"), "node", *"abu")
    return rows.union(extra).repartition(parts, "run")


def _deep_nodes(grams: DataFrame, depth: int, split: int, parts: int) -> DataFrame:
    """Nodes of depth ``split`` with counts and weighted probabilities."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        codes, counts = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2))
        level = build_levels(codes, counts, depth, split)[0][split]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(level.keys >> 8),
                pa.array((level.keys & 255).astype(np.int32)),
                pa.array(level.zeros),
                pa.array(level.ones),
                pa.array(level.weighted),
            ],
            names=_NODES.names,
        )

    return _by_run(grams, None, parts, split).mapInArrow(run, _NODES)


def gram_scores(grams: DataFrame, depth: int = DEPTH, split: int = SPLIT, parts: int | None = None) -> DataFrame:
    """(code, value): log10 probability of every gram's byte after its context.

    ``grams`` has distinct codes with their training counts, which may be zero.
    """
    parts = parts or partitions(grams.sparkSession)
    nodes = written(_deep_nodes(grams, depth, split, parts), "nodes")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        is_node = np.asarray(table.column("node").is_valid())
        of = lambda c, keep: table.column(c).filter(pa.array(keep)).to_numpy()
        keys = of("run", is_node) << 8 | of("node", is_node).astype(np.int64)
        order = np.argsort(keys)
        mix = [of(c, is_node)[order] for c in "abu"]
        keys = keys[order]

        def above(wanted):
            at = np.searchsorted(keys, wanted)
            return tuple(m[at] for m in mix)

        codes, counts = of("code", ~is_node), of("n", ~is_node)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(gram_log10(codes, counts, depth, split, above))], names=["code", "value"])

    return _by_run(grams, short_contexts(nodes, split), parts, split).mapInArrow(run, "code long, value double")


def scores(docs: DataFrame, held_modulus: int = 10, depth: int = DEPTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Score every text by a model of those whose crc32(doc_id) mod ``held_modulus`` is not 0.

    One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens (words and the
    end), n_known (tokens of the training texts), train_tokens, base_score (unigrams with
    0.1 added), score (log10 probability by context-tree weighting), bits_per_byte. Null
    and empty texts are the end token alone. A null doc_id counts as the empty string for
    the split. Without training texts every byte costs eight bits. An empty table gives no
    rows. Repeated rows count and are scored as often as they occur.
    """
    blocks = written(packed_blocks(docs, held_modulus, depth, block_docs), "blocks")
    packs, items = blocks.where("pack IS NOT NULL").select("block", "pack"), blocks.where("pack IS NULL").select("block", "code", "n")
    totals = written(items.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "totals")
    size = totals.where("code < 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, vocabulary = int(size[0]), int(size[1])

    # A word's value is its training count, a gram's its log probability.
    words = totals.where("code < 0").select("code", F.col("n").cast("double").alias("value"), "blocks")
    grams = totals.where("code >= 0")
    values = written(gram_scores(grams, depth).join(grams.select("code", "blocks"), "code").union(words), "values")

    # The number of blocks from which on an entry is broadcast, so that COMMON hold.
    room, least = COMMON, None
    for row in values.where("blocks > 1").groupBy("blocks").count().orderBy(F.desc("blocks")).toLocalIterator():
        if row["count"] > room:
            break
        room, least = room - row["count"], row["blocks"]
    common = values.where(F.col("blocks") >= least) if least else values.limit(0)
    held = common.select("code", "value").toPandas().sort_values("code")
    shared = docs.sparkSession.sparkContext.broadcast((held["code"].to_numpy("int64"), held["value"].to_numpy("float64")))
    rare = values.where(F.col("blocks") < least) if least else values
    wanted = items.select("block", "code").join(F.broadcast(common.select("code")), "code", "left_anti")
    wanted = wanted.join(rare.select("code", F.col("value").cast("float")), "code").select(F.col("block").alias("owner"), "code", "value")

    def run(key, texts, table):
        import numpy as np
        import pyarrow as pa

        codes = np.concatenate([shared.value[0], table.column("code").to_numpy()])
        order = np.argsort(codes)
        value = np.concatenate([shared.value[1], table.column("value").to_numpy().astype(np.float64)])[order]
        codes = codes[order]
        grams_from = int(np.searchsorted(codes, 0))
        gram_code, gram_value = codes[grams_from:], value[grams_from:]
        word_code, word_count = codes[:grams_from], value[:grams_from]
        parts = []
        for data in texts.column("pack").to_pylist():
            batch = unpack(data)
            documents = batch.column(2).to_pylist()
            out = np.zeros((5, len(documents)))
            floor = train_tokens + 0.1 * (vocabulary + 1)
            for first, group in runs(documents):
                lengths = np.array([len(d) for d in group])
                grams = np.concatenate([gram_codes(d, depth) for d in group])
                got = gram_value[np.searchsorted(gram_code, grams)]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                last = first + len(group)
                out[3, first:last] = np.add.reduceat(got, starts)
                out[4, first:last] = lengths
                words, sizes = word_codes(group)
                count = word_count[np.searchsorted(word_code, words)]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out[0, first:last] = sizes
                out[1, first:last] = np.add.reduceat((count > 0).astype(float), starts)
                out[2, first:last] = np.add.reduceat(np.log10((count + 0.1) / floor), starts)
            parts.append(
                pa.table(
                    {
                        "doc_id": batch.column(0),
                        "held_out": batch.column(1),
                        "n_tokens": out[0].astype(np.int64),
                        "n_known": out[1].astype(np.int64),
                        "base_score": out[2],
                        "score": out[3],
                        "n_bytes": out[4].astype(np.int64),
                    }
                )
            )
        if not parts:
            return pa.table({f.name: [] for f in _SCORED}, schema=empty)
        return pa.concat_tables(parts)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(_SCORED)
    scored = packs.groupBy("block").cogroup(wanted.groupBy("owner")).applyInArrow(run, _SCORED)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
