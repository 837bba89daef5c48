"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its lower-cased words and of their beginnings (4 to 6 letters), which
stand for the forms of a word. A logistic model over these features is fitted with a lasso
penalty and a counterfactual one: every labelled text that mentions a group of people is
also read with the mentioned terms swapped for other terms of the same kind, and the
squared change of the score is penalised. So a group's name cannot become a sign of
toxicity because toxic texts mention it more often, and neutral mentions stay clean.

Features are counted by a Spark aggregate over the labelled sample; those that tell the
classes apart, ``MAX_FEATURES`` at most, are the model's vocabulary. The sample is bounded
by ``train_rows``, so the fit has one size whatever the corpus. Scoring reads every text.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import Recent, crc_bucket

TRAIN_ROWS = 12_000
MAX_FEATURES = 20_000
LEAST_Z = 4.0  # of a feature's difference between the classes
LEAST_DOCS = 3
LASSO = 2e-5
PAIRING = 5.0  # weight of the counterfactual penalty
SWAPS = 3  # counterfactuals of a text
STEPS = 300
THRESHOLD = 0.5
WORDS_KEPT = 200_000

#: Terms that name groups of people, by kind; a swap stays inside a kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("her", "his"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("african", "asian", "european", "american", "arab", "latino"),
    ("black", "white", "brown"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("étrangers", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
    ("extranjeros", "inmigrantes", "refugiados"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The distinct lower-cased runs of letters of a text."""
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings; a beginning is marked by a hyphen."""
    return (word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n))


def swapped(words: set[str], terms=IDENTITY_TERMS, swaps: int = SWAPS) -> list[set[str]]:
    """The words with all identity terms swapped, once for each of up to ``swaps`` turns;
    none where no term occurs."""
    groups = [(g, words & set(g)) for g in terms]
    groups = [(g, found) for g, found in groups if found]
    if not groups:
        return []
    out = []
    for turn in range(1, 1 + min(swaps, max(len(g) for g, _ in groups) - 1)):
        new = set(words)
        for g, found in groups:
            new -= found
        for g, found in groups:
            step = (turn - 1) % (len(g) - 1) + 1
            new |= {g[(g.index(w) + step) % len(g)] for w in found}
        out.append(new)
    return out


def fit(x: list, y, pairs: list, size: int, lasso: float = LASSO, pairing: float = PAIRING, steps: int = STEPS):
    """(weights, bias) by accelerated proximal gradient steps.

    ``x`` holds the feature numbers of each text, ``pairs`` (features only in a text,
    features only in its counterfactual). Minimises the mean log loss plus ``lasso`` times
    the sum of absolute weights plus ``pairing`` times the mean squared change of the
    logit over the pairs."""
    import numpy as np

    def flat(lists):
        owner = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        return np.concatenate([np.asarray(v, np.int64) for v in lists] or [np.empty(0, np.int64)]), owner

    y = np.asarray(y, float)
    n, m = len(y), len(pairs)
    at, row = flat(x)
    (lost, lost_row), (won, won_row) = flat([p[0] for p in pairs]), flat([p[1] for p in pairs])
    logits = lambda w: np.bincount(row, w[at], minlength=n)
    change = lambda w: np.bincount(lost_row, w[lost], minlength=m) - np.bincount(won_row, w[won], minlength=m)
    back = lambda g: np.bincount(at, g[row], minlength=size)
    undo = lambda g: np.bincount(lost, g[lost_row], minlength=size) - np.bincount(won, g[won_row], minlength=size)

    def curvature(v):
        out = back(logits(v)) / (4 * n)
        return out + 2 * pairing * undo(change(v)) / m if m else out

    v, steep = np.random.default_rng(5).standard_normal(size), 1.0
    for _ in range(20):
        v = curvature(v)
        steep = float(np.linalg.norm(v)) or 1.0
        v /= steep
    steep = 1.1 * steep + 0.25
    share = min(max(y.mean(), 0.5 / n), 1 - 0.5 / n)
    w, b, t = np.zeros(size), math.log(share / (1 - share)), 1.0
    z, zb = w, b
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(logits(z) + zb))) - y) / n
        slope = back(g)
        if m:
            slope += 2 * pairing * undo(change(z)) / m
        new = z - slope / steep
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / steep, 0)
        new_b = zb - g.sum() / 0.25
        if ((z - new) * (new - w)).sum() + (zb - new_b) * (new_b - b) > 0:
            t = 1.0  # the momentum points uphill
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return w, b


class ToxicityModel:
    """Weights by feature; scores of texts."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self._known = Recent(WORDS_KEPT)  # word -> its features that have a weight

    def _hits(self, word: str) -> tuple[str, ...]:
        hits = self._known.get(word)
        if hits is None:
            hits = self._known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return hits

    def score(self, text: str) -> float:
        """Probability of the label 1; it depends on the text's set of words alone."""
        found = set()
        for w in words_of(text):
            found.update(self._hits(w))
        logit = math.fsum([self.bias, *(self.weights[f] for f in found)])
        return 1 / (1 + math.exp(-logit)) if logit >= 0 else (e := math.exp(logit)) / (1 + e)

    def dumps(self) -> str:
        return json.dumps([self.bias, self.weights])

    @classmethod
    def loads(cls, data: str) -> ToxicityModel:
        return cls(*json.loads(data))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, held_modulus: int, held_rest: int) -> DataFrame:
    """(text, _y) of at most ``train_rows`` labelled documents, those with the smallest
    hashes of their ids, without those whose crc32(doc_id) mod ``held_modulus`` is ``held_rest``."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_bucket("doc_id", held_modulus) != held_rest))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)  # bounded by the parameter, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(sample), "_id").select("text", "_y")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    held_modulus: int = 5,
    held_rest: int = 0,
    pairing: float = PAIRING,
    terms=IDENTITY_TERMS,
) -> str | None:
    """A fitted model (JSON), or None without labelled texts of both classes.

    Null ids, labels other than 0 and 1, and null texts are left out; of several labels
    of a document the larger counts; documents that share an id all take part.
    """
    from cellclock.llm.common import written

    rows = written(labelled(docs, labels, label, train_rows, held_modulus, held_rest), "labelled")
    classes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n, n1 = sum(classes.values()), classes.get(1, 0)
    if not 0 < n1 < n:
        return None

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list({f for w in words_of(text) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["f", "y"])

    counts = rows.mapInArrow(spread, "f string, y int").groupBy("f").agg(F.count("*").alias("c"), F.sum("y").alias("c1"))
    share = n1 / n
    spreadness = F.sqrt(F.greatest(F.lit(1e-9), share * (1 - share) * F.col("c") * (1 - F.col("c") / n)))
    told = counts.withColumn("z", F.abs((F.col("c1") - F.col("c") * share) / spreadness)).where((F.col("c") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z))
    vocabulary = [r["f"] for r in told.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).collect()]  # bounded by MAX_FEATURES
    number = {f: i for i, f in enumerate(vocabulary)}

    def encode(batches):
        import pyarrow as pa

        numbers = lambda words: sorted({number[f] for w in words for f in features_of(w) if f in number})
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                own = set(numbers(words))
                others = [set(numbers(s)) for s in swapped(words, terms)]
                coded = json.dumps([sorted(own), [[sorted(own - o), sorted(o - own)] for o in others]])
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([coded], pa.string())], names=["y", "coded"])

    def solve(batches):
        import pyarrow as pa

        held = sorted((c, y) for b in batches for y, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if held:
            coded = [json.loads(c) for c, _ in held]
            w, b = fit([x for x, _ in coded], [y for _, y in held], [p for _, ps in coded for p in ps], len(vocabulary), pairing=pairing)
            model = ToxicityModel(b, {f: float(v) for f, v in zip(vocabulary, w) if v})
            yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.string())], names=["model"])

    # One task, whose rows are bounded by train_rows and whose features by MAX_FEATURES.
    found = rows.mapInArrow(encode, "y int, coded string").repartition(1).mapInArrow(solve, "model string").collect()
    return found[0]["model"] if found else None


@lru_cache(maxsize=2)
def _model(data: str) -> ToxicityModel:
    return ToxicityModel.loads(data)


def score(docs: DataFrame, model: str | None, column: str = "score") -> DataFrame:
    """Add ``column``, the probability of the label 1, to every row.

    Null and empty texts have the score of no words. Without a model every row has 0.5.
    A column of this name is replaced; others are kept as they are.
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
            got = [found.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Repeated rows are kept, null ids too (held_out as of the empty string's crc32);
    an empty table gives no rows."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        (crc_bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
