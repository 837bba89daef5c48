"""Near-duplicate documents: universal hash minima, banding, signature verification, full
sets, and connected components by alternating large-star and small-star.

Copies first become one node: texts with the same shingle set share a class, named by its
smallest doc_id, so a group of copies of any size is one row from there on. Bands of the
classes' signatures make buckets. Pairs are not formed inside a bucket at large:

1. A class with so many shingles found in no other candidate that no partner can exist
   is left out; that bound is exact.
2. Every class of a bucket is compared with the bucket's hub, the class with the least
   such shingles, that is the most typical one. Links make components.
3. Classes outside their bucket's main component are compared with those classes of
   other components that share one of their rarest shingles, which every link needs.

Together these steps settle every pair that shares a bucket: two classes are already
connected, or can't be linked, or are compared. A pair right at the threshold shares no
bucket with a chance of 1 in 20,000: with 25 bands of 5 minima for 0.8, and with 21 bands
of 6 for 0.85.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import forget, perhaps_among, string_bytes, written

PERCENT = 80
BANDS, ROWS = 25, 5
# Four standard deviations of the estimate from 125 minima at the threshold.
SLACK = 0.145

_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.LongType(), False)),
    ]
)
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])


@lru_cache(maxsize=4)
def _minhash(permutations: int):
    from cellclock.llm.shingles import MinHash

    return MinHash(permutations)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Size, two hashes, signature and buckets of every document's shingle set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cellclock.llm.shingles import band_keys, set_hashes, shingle_sets

        hasher = _minhash(bands * rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingle_sets(string_bytes(batch.column(1)))
            minima = np.stack([hasher.signature(s) for s in sets])
            keys = band_keys(minima, bands, rows)
            once, twice = set_hashes(sets)
            offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(once, pa.int64()),
                    pa.array(twice, pa.int64()),
                    pa.array([m.tobytes() for m in minima], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                schema=pa.schema(
                    [
                        ("doc_id", pa.int64()),
                        ("n_shingles", pa.int64()),
                        ("set_a", pa.int64()),
                        ("set_b", pa.int64()),
                        ("signature", pa.binary()),
                        ("buckets", pa.list_(pa.int64())),
                    ]
                ),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNED)


def full_sets(docs: DataFrame) -> DataFrame:
    """The distinct shingle hashes of every document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cellclock.llm.shingles import shingle_sets

        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingle_sets(string_bytes(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                schema=pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))]),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SETS)


def verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough and whose full sets are linked."""

    def side(frame, name, value):
        return frame.select(F.col("doc_id").alias(name), F.col(value).alias(f"_{name}"))

    least = percent / 100 - SLACK

    def agree(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            near = (left == right).mean(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(near))

    likely = (
        pairs.join(side(signatures, "a", "signature"), "a")
        .join(side(signatures, "b", "signature"), "b")
        .select("a", "b", "_a", "_b")
        .mapInArrow(agree, "a long, b long")
    )
    both = F.size(F.array_intersect("_a", "_b"))
    linked = likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    return linked.where(100 * both >= percent * (F.size("_a") + F.size("_b") - both)).select("a", "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for nodes with one.

    Large-star hangs every larger neighbour on the smallest neighbour, small-star every
    smaller one; alternating them ends in stars after about log(n) rounds. Each step is
    an aggregate with partial minima and a join that adaptive execution can split, so a
    node with any number of neighbours is never gathered. Empty edges give no rows.
    """

    def both_ways(e):
        return e.select(F.col("u"), F.col("v")).union(e.select(F.col("v"), F.col("u")))

    def large_star(e):
        near = both_ways(e)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(e):
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    now = state(edges)
    for _ in range(rounds):
        if not now[0]:
            break
        last, edges = edges, written(small_star(large_star(edges)), "links")
        forget(last)
        before, now = now, state(edges)
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return pairs.union(pairs.select("component", "component").distinct())


def rarest(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each class's rarest shingles with their places (from 0) in the order of frequency.

    Of two linked sets of n and m shingles, at least k = percent (n + m) / (100 + percent)
    are shared, so in one order for all sets the first shared one stands among the first
    n - k + 1 of one and the first m - k + 1 of the other; no more than the part returned
    here. Shingles that all copies of a group have stand last.
    """
    members = classes.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    rows = members.select("rep", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    ordered = rows.join(common, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("o"))
    head = F.slice("o", 1, F.floor(F.size("o") * (100 - percent) / 100).cast("int") + 1)
    return classes.join(ordered, "rep").select(*classes.columns, F.posexplode(head["shingle"]).alias("place", "shingle"))


def linked(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``near_duplicates`` finds: signed rows, classes (set_a, set_b, rep), verified
    links (a, b) between representatives, and (node, component) of those with a link."""
    # What is kept of every document is small: buckets are made again to be joined, and
    # signatures for the few documents that need them.
    every = signed(docs, bands, rows)
    base = written(every.drop("signature", "buckets"), "signed")
    usable = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    least = every.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "buckets")).alias("_l"))

    placed = least.select(F.col("_l.doc_id").alias("rep"), F.col("_l.n_shingles").alias("n"), F.explode("_l.buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("_c")).where("_c > 1").select("bucket")
    crowded = written(placed.join(shared, "bucket", "left_semi"), "crowded")
    candidates = crowded.select(F.col("rep").alias("doc_id")).distinct()
    texts = perhaps_among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), candidates, "doc_id")
    # By sort and merge at every size: candidates grow with the corpus.
    few = written(texts.join(candidates.hint("merge"), "doc_id", "left_semi"), "texts")
    keys = classes.select("set_a", "set_b", F.col("rep").alias("doc_id"))
    nodes = signed(few, bands, rows).join(keys, ["set_a", "set_b", "doc_id"], "left_semi").dropDuplicates(["set_a", "set_b", "doc_id"])
    nodes = written(nodes.select("doc_id", "signature"), "nodes")
    sets = written(full_sets(few).dropDuplicates(["doc_id", "shingles"]), "sets")

    # Shingles that only one candidate has.
    lone = (
        sets.select("doc_id", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_m"))
        .where("rep = _m")
        .groupBy("rep")
        .agg(F.count("*").alias("lone"))
    )
    alive = crowded.join(lone, "rep", "left").select("bucket", "rep", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
    alive = written(alive.where(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n")), "alive")

    def possible(x, y):
        """Whether sizes and unshared shingles allow a link."""
        most = F.least(F.col(f"{x}.n") - F.col(f"{x}.lone"), F.col(f"{y}.n") - F.col(f"{y}.lone"))
        return 100 * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - most)

    hubs = alive.groupBy("bucket").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("r"), "rep", "n", "lone")).alias("h"))
    hubs = hubs.select("bucket", F.col("h.rep").alias("rep"), F.col("h.n").alias("n"), F.col("h.lone").alias("lone"))
    first = (
        alive.alias("x")
        .join(hubs.alias("y"), F.expr("x.bucket = y.bucket AND x.rep <> y.rep") & possible("x", "y"))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )
    links = written(verified(first, nodes, sets, percent), "links-hub")
    found = components(links)

    # Classes that their buckets' hubs did not connect, and what they share buckets with.
    spread = alive.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = spread.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    spread = spread.join(mixed.select("bucket", F.col("m.component").alias("main")), "bucket")
    rest = spread.groupBy("rep", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("apart"))
    rare = written(rarest(rest, sets, percent), "rarest")
    least = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))  # shared shingles of a link
    second = (
        rare.where("apart")
        .alias("x")
        .join(
            rare.alias("y"),
            F.expr("x.shingle = y.shingle AND x.component <> y.component AND (NOT y.apart OR x.rep < y.rep)")
            & (F.col("x.place") <= F.col("x.n") - least)
            & (F.col("y.place") <= F.col("y.n") - least),
        )
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )
    more = written(verified(second, nodes, sets, percent), "links-rest")
    if more.limit(1).count():
        links = links.union(more)
        found = components(links)
    forget(crowded, few, nodes, sets, alive, rare)
    return base, classes, links, found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    distinct five-word shingles; component_id is the smallest doc_id reachable. Null and
    empty texts have no shingles and no links. Rows with a null doc_id are linked with
    nothing: component_id is null, and they are kept. Rows that share a doc_id count as
    one document. Other columns are not looked at. An empty table gives no rows.
    """
    base, classes, _, found = linked(docs, percent, bands, rows)
    member = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("_c")
    )
    out = base.join(member, ["set_a", "set_b"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_c"))).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Keep one row of each group of near-duplicates: that with the smallest doc_id.

    Of rows that share a doc_id one is kept, and all rows with a null doc_id.
    """
    kept = near_duplicates(docs, percent, bands, rows).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).union(docs.where("doc_id IS NULL"))
