"""Document fingerprints: universal hash minima over word shingles, in numpy; signature
bands are joined in Spark and the Jaccard likeness of every match is verified on full sets.

A fingerprint is 128 minima of 16 bits, written as 512 hexadecimal digits. The share of
equal minima, corrected for chance agreement, estimates the Jaccard likeness of the two
shingle sets with a standard error of at most 0.045. A text without words has the
fingerprint of the empty set: all digits f.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import partitions, string_bytes, written

MINIMA = 128
DIGITS = 4  # hexadecimal digits of a minimum
BANDS, ROWS = 32, 4
MEMBER = ["set_a", "set_b", "class_id", "n_links"]
SLACK = 0.142  # four standard deviations of the estimate at a likeness of 0.8


@lru_cache(maxsize=2)
def _minhash(minima: int):
    from cellclock.llm.shingles import MinHash

    return MinHash(minima)


def print_of_sets(sets: list):
    """A row of 16-bit minima for every shingle set."""
    import numpy as np

    hasher = _minhash(MINIMA)
    return np.stack([hasher.signature(s) for s in sets]).astype(">u2")


def print_of(texts: list[bytes]):
    """A row of 16-bit minima for every text."""
    from cellclock.llm.shingles import shingle_sets

    return print_of_sets(shingle_sets(texts))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1, as a column expression."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    cells = F.sequence(F.lit(0), F.lit(MINIMA - 1))
    same = F.aggregate(
        cells,
        F.lit(0),
        lambda n, i: n + (F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS))).cast("int"),
    )
    return _corrected(same / F.lit(MINIMA))


def _corrected(share):
    chance = 1 / (1 << 4 * DIGITS)
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and shingles (distinct hashes) of every row of ``docs`` (doc_id, text).

    Null and empty texts have the fingerprint of the empty set, rows are kept as they
    are, equal texts have equal fingerprints, an empty table gives no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cellclock.llm.shingles import shingle_sets

        for batch in batches:
            if batch.num_rows:
                sets = shingle_sets(string_bytes(batch.column(1)))
                marks = [row.tobytes().hex() for row in print_of_sets(sets)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), shingles], names=schema.names)

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("shingles", T.ArrayType(T.LongType(), False)),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def matches(left: DataFrame, right: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs (fingerprint, matched, likeness) of different fingerprints of two tables of
    ``fingerprints`` that share a band of minima and whose Jaccard likeness is at least
    ``least``. The estimate only leaves out pairs more than four standard deviations
    below; likeness is that of the full shingle sets, the largest if texts with different
    sets share a fingerprint. Equal fingerprints are one key here, so copies cost
    nothing; join the result back to documents by fingerprint."""
    width = rows * DIGITS

    def banded(prints, name):
        once = prints.select(F.col("fingerprint").alias(name)).where(f"{name} IS NOT NULL").distinct()
        keys = F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring({name}, i * {width} + 1, {width})))")
        return once.select(name, F.explode(keys).alias("band"))

    def sets(prints, name, value):
        return prints.select(F.col("fingerprint").alias(name), F.col("shingles").alias(value)).dropDuplicates([name, value])

    near = banded(left, "fingerprint").join(banded(right, "matched"), "band").where("fingerprint <> matched")
    near = near.select("fingerprint", "matched").distinct().where(likeness("fingerprint", "matched") >= least - SLACK)
    both = F.size(F.array_intersect("_a", "_b"))
    held = near.join(sets(left, "fingerprint", "_a"), "fingerprint").join(sets(right, "matched", "_b"), "matched")
    held = held.withColumn("likeness", both / (F.size("_a") + F.size("_b") - both)).where(F.col("likeness") >= least)
    return held.groupBy("fingerprint", "matched").agg(F.max("likeness").alias("likeness"))


def _placed(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, Column]:
    """Documents with a range number that ascends with (doc_id, text), for each range its
    first document, to be appended to the range before, and the number as a column.

    Range bounds are quantiles of the ids, a few numbers; they only set sizes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000))).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:
        place = F.expr(f"aggregate(array({', '.join(f'{c}L' for c in cuts)}), 0, (n, c) -> n + IF(doc_id > c, 1, 0))")
    place = F.coalesce(place, F.lit(0))
    rows = rows.withColumn("place", place)
    return rows, rows.groupBy("place").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("k")), place


def _edited(docs: DataFrame, parts: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """``edited_fingerprints``, with class_id and n_links where ``members`` are given:
    doc_id, set_a, set_b, class_id, n_links of the documents with a link or a copy.

    Members travel to the ranges of their documents and come right before them, so that
    no second shuffle of fingerprints is needed."""
    rows, firsts, place = _placed(docs, parts or partitions(docs.sparkSession))
    heads = sorted((r["place"], r["k"]["doc_id"], r["k"]["h"]) for r in firsts.collect())  # one for each range
    if not heads:
        heads = [(0, None, None)]
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    sent = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    first_of = F.array(*[F.struct(F.lit(i).cast("long").alias("a"), F.lit(h).cast("long").alias("b")) for _, i, h in heads])
    is_first = F.exists(first_of, lambda k: k["a"].eqNullSafe(F.col("doc_id")) & (k["b"] == F.xxhash64("text")))
    guests = rows.where(is_first).dropDuplicates(["place"]).withColumn("place", sent[F.col("place")]).withColumn("guest", F.lit(1))
    ordered = (
        rows.withColumn("guest", F.lit(0))
        .unionByName(guests)
    )
    if members is not None:
        ordered = ordered.unionByName(members.withColumns({"place": place, "guest": F.lit(0)}), allowMissingColumns=True)
    ordered = (
        ordered.repartitionByRange(parts or partitions(docs.sparkSession), "place")
        .sortWithinPartitions("place", "guest", "doc_id", F.col("text").isNotNull(), F.xxhash64("text"))
        .select("guest", "doc_id", "text", *(MEMBER if members is not None else []))
    )

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("same_edited", T.DoubleType()),
            T.StructField("same_next", T.DoubleType()),
            T.StructField("class_id", T.LongType()),
            T.StructField("n_links", T.LongType()),
        ]
    )

    def run(batches):
        import hashlib
        from itertools import repeat

        import numpy as np
        import pyarrow as pa

        from cellclock.llm.shingles import set_hashes, shingle_sets

        held = None  # (doc_id, text, fingerprint, class and links) that waits for its next document
        known_id, known = None, {}  # classes and links of one doc_id by the hashes of the set
        for batch in batches:
            if not batch.num_rows:
                continue
            guest, ids, texts, *member = (c.to_pylist() for c in batch.columns)
            there = [t.encode() for t in texts if t is not None]
            sets = shingle_sets(there)
            marks = iter(print_of_sets(sets) if sets else [])
            hashes = zip(*set_hashes(sets))
            member = zip(*member) if member else repeat(None)
            owners, edited, nexts = [], [], []
            for g, i, t, about in zip(guest, ids, texts, member):
                if t is None:
                    if i != known_id:
                        known_id, known = i, {}
                    known[about[:2]] = about[2:]
                    continue
                m, s = next(marks), next(hashes)
                if held is not None:
                    n = len(held[1])
                    cut = n // 4
                    owners.append(held)
                    edited.append((held[1][: n - cut] + t[:cut]).encode())
                    nexts.append(m)
                alone = (i, 0)
                held = None if g else (i, t, m, known.get(s, alone) if i == known_id else alone)
            if not owners:
                continue
            own = np.stack([o[2] for o in owners])
            other = print_of(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in owners], pa.int64()),
                    pa.array([len(o[1]) for o in owners], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([m.tobytes().hex() for m in own], pa.string()),
                    pa.array([m.tobytes().hex() for m in other], pa.string()),
                    pa.array((own == other).mean(axis=1), pa.float64()),
                    pa.array((own == np.stack(nexts)).mean(axis=1), pa.float64()),
                    pa.array([o[3][0] for o in owners], pa.int64()),
                    pa.array([o[3][1] for o in owners], pa.int64()),
                ],
                names=schema.names,
            )

    out = ordered.mapInArrow(run, schema)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        _corrected(F.col("same_edited")).alias("near_edited"),
        _corrected(F.col("same_next")).alias("near_next"),
        *(["n_links", "class_id"] if members is not None else []),
    )


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by as many of
    the first of the next document in ascending doc_id, or all it has; the last document
    is followed by the first. Null texts are empty; ties of doc_id follow a hash of
    their texts; null ids come first. Tasks stream over sorted ranges and hold two
    documents at a time; the first document of a range is also sent to the range before.
    """
    return _edited(docs, parts)


def matched_fingerprints(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``edited_fingerprints`` with class_id and n_links, from the band join of all documents.

    Texts with one shingle set are one key. Keys that share a band of minima are compared
    as in ``near_dedup``: with the band's representative, and with each other where that
    leaves them apart; a link is verified on full sets. class_id is the smallest doc_id
    that links reach, n_links the number of links found of the document's key, which is
    not that of all its near texts where a band has a representative. Texts without words
    are a class of their own; null ids have a null class and no links.
    """
    from cellclock.llm.near_dedup import linked

    base, classes, links, found = linked(docs, percent, BANDS, ROWS)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
    groups = groups.select("set_a", "set_b", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = base.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_a", "set_b")
    members = rows.join(groups, ["set_a", "set_b"]).where("class_id <> doc_id OR n_links > 0").select("doc_id", *MEMBER).distinct()
    return _edited(docs, members=written(members, "members"))
