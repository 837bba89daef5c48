"""Benchmark passages in documents, found by winnowing; DataFrame functions only.

A document word is *hit* when it lies in an occurrence of ten consecutive words of a
benchmark item, or of a whole item of fewer words. Fingerprints are the smallest hash of
every six neighbouring 5-grams (the last one of equals), taken in both tables alike, so
any ten shared words share a fingerprint at the same place. Shared fingerprints are then
extended word by word. Whole short items are looked up by grams of their own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.llm.common import fresh, written

SPAN = 10  # words that make an occurrence
GRAM = 5  # words of a hashed gram
WINDOW = SPAN - GRAM + 1  # grams among which one is kept
REACH = SPAN - GRAM  # words that a hit is extended by on either side
PLACE_BITS = 28
PLACE_MASK = (1 << PLACE_BITS) - 1
HASH_MASK = ((1 << 63) - 1) ^ PLACE_MASK

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """Words of a text, A-Z lower-cased; none for null.

    ``lower`` is far faster than ``translate`` and does the same unless the text has
    letters beyond ASCII that it would change too.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _gram(w: Column, i: Column, n: int) -> Column:
    """Packed hash and place of the gram of ``n`` words at ``i``; smaller places are larger."""
    h = F.xxhash64(F.lit(n), *[F.get(w, i + j if j else i) for j in range(n)])
    return h.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR((F.lit(PLACE_MASK) - i).cast("long"))


def _upto(n: Column) -> Column:
    """0 … n - 1, nothing for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def prints(w: Column, lengths: list[int]) -> Column:
    """Packed fingerprints of a word array: winnowed grams if ``lengths`` has SPAN, all
    grams of each smaller length in it."""
    found = [F.array().cast("array<bigint>")]
    for n in lengths:
        if n == SPAN:
            grams = F.transform(_upto(F.size(w) - GRAM + 1), lambda i: _gram(w, i, GRAM))
            found.append(
                _let(
                    grams,
                    lambda g: F.array_distinct(
                        F.transform(_upto(F.size(g) - WINDOW + 1), lambda j: F.least(*[F.get(g, j + o if o else j) for o in range(WINDOW)]))
                    ),
                )
            )
        else:
            found.append(F.transform(_upto(F.size(w) - n + 1), _short(w, n)))
    return F.concat(*found)


def _short(w: Column, n: int):
    """As ``_gram`` for whole short items; another seed keeps the two kinds apart."""

    def gram(i: Column) -> Column:
        h = F.xxhash64(F.lit(-n), *[F.get(w, i + j if j else i) for j in range(n)])
        return h.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR((F.lit(PLACE_MASK) - i).cast("long"))

    return gram


def _place(p: Column) -> Column:
    return (F.lit(PLACE_MASK) - p.bitwiseAND(F.lit(PLACE_MASK))).cast("int")


def _run(w: Column, hit: Column) -> Column:
    """The doc words [start, stop) that a hit covers after extension, or null.

    ``hit.around`` holds the item's words from REACH before the gram to REACH after it,
    null beyond the item's ends."""

    def same(k):
        return F.coalesce(F.get(w, hit["at"] + k) == F.get(hit["around"], F.lit(REACH) + k), F.lit(False))

    core = F.forall(F.sequence(F.lit(0), hit["core"] - 1), lambda i: same(i))

    def reach(step):
        chain = F.lit(REACH)
        for k in range(REACH, 0, -1):
            chain = F.when(~same(step(k)), F.lit(k - 1)).otherwise(chain)
        return F.when(hit["core"] < hit["span"], chain).otherwise(F.lit(0))

    left, right = reach(lambda k: F.lit(-k)), reach(lambda k: hit["core"] + (k - 1))
    run = F.struct((hit["at"] - left).alias("start"), (hit["at"] + hit["core"] + right).alias("stop"), hit["item"].alias("item"))
    return F.when(core & (left + hit["core"] + right >= hit["span"]), run)


def item_prints(benchmark: DataFrame, item_id: str = "item_id") -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items with the words around them, and the span lengths in use."""
    base = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words("text").alias("w"))
    base = base.where(F.size("w") > 0).withColumn("span", F.least(F.size("w"), F.lit(SPAN)))
    base = written(base, "items")
    lengths = sorted(r[0] for r in base.select("span").distinct().collect())  # ten values at most
    own = reduce(lambda e, n: e.when(F.col("span") == n, prints(F.col("w"), [n])), lengths, F.when(F.lit(False), F.array().cast("array<bigint>")))
    rows = base.withColumn("p", F.explode(own)).select(
        F.shiftright("p", PLACE_BITS).alias("key"),
        "item",
        "span",
        F.when(F.col("span") == SPAN, F.lit(GRAM)).otherwise(F.col("span")).alias("core"),
        _place(F.col("p")).alias("q"),
        "w",
    )
    around = F.transform(F.sequence(F.lit(-REACH), F.lit(SPAN - 1)), lambda k: F.get(F.col("w"), F.col("q") + k))
    return written(rows.select("key", "item", "span", "core", around.alias("around")).distinct(), "item-prints"), lengths


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items
    (their ids as sorted strings) and contaminated.

    Null and empty texts have no words and no hits; empty items match nothing; items with
    a null id are left out; repeated rows get the same result each; a null doc_id is kept.
    Without documents there are no rows, without items nothing is contaminated. Other
    columns of either table are not looked at.
    """
    items, lengths = item_prints(benchmark)
    key = [F.col("doc_id"), F.xxhash64("text").alias("h")]
    base = docs.select(*key, words("text").alias("w"))
    # The first entry of each document is the number of its words, below zero.
    entries = base.select("doc_id", "h", F.explode(F.concat(F.array((-1 - F.size("w")).cast("long")), prints(F.col("w"), lengths))).alias("p"))
    found = (
        entries.withColumn("key", F.shiftright("p", PLACE_BITS))
        .join(items, "key", "left")
        .where("p < 0 OR item IS NOT NULL")
        .select("doc_id", "h", "p", "item", "span", "core", "around")
    )
    found = written(found, "shared-prints")
    sizes = found.where("p < 0").select("doc_id", "h", (-1 - F.col("p")).alias("n_words"))

    hits = (
        found.where("p >= 0")
        .withColumn("at", _place(F.col("p")))
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("at", "item", "span", "core", "around")).alias("hits"))
        .withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    )
    texts = docs.select(*key, "text")
    marked = texts.join(hits, texts["doc_id"].eqNullSafe(hits["_id"]) & (texts["h"] == hits["_h"])).select("_id", "_h", words("text").alias("w"), "hits")
    runs = F.filter(F.transform("hits", lambda x: _run(F.col("w"), x)), lambda r: r.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"] - 1)))))
    marked = (
        marked.select("_id", "_h", runs.alias("runs"))
        .select("_id", "_h", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.col("runs.item"))).alias("items"))
        .dropDuplicates(["_id", "_h"])
    )
    out = sizes.join(marked, sizes["doc_id"].eqNullSafe(marked["_id"]) & (sizes["h"] == marked["_h"]), "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "h",
    )


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of ``contamination`` with the items as one digest."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    key, i, h = fresh(docs, "_key", "_id", "_h")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad[i]) & (keyed[key] == bad[h]), "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[i:i + n - 1] AS g, n
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b) WHERE n > 0)),
dw AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
