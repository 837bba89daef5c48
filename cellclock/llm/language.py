"""Language of web pages by Bayesian fusion of evidence.

The posterior of a page's language joins, as logarithms,

* its text: hashed byte trigrams under models counted from all documents with a known
  language, tempered because neighbouring trigrams are not independent;
* the language its markup declares, and the one its address suggests (country suffix,
  language subdomain or path segment): how often each such statement goes with each
  language, counted over all pages;
* a prior of its host, smoothed by its domain, which is smoothed by all pages, from
  grouped counts that leave the page itself out.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import string_bytes, written
from cellclock.llm.url_lists import host

BUCKETS = 1 << 15
TEMPER = 0.25  # weight of a trigram
STRENGTH = 4.0  # pages that a prior counts for
# Country suffixes with one main language.
SUFFIX_LANG = {
    "at": "de", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "es": "es", "fi": "fi",
    "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "il": "he", "it": "it", "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl",
    "no": "no", "nz": "en", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
}

_OPENED = re.compile(r"<(script|style|noscript|template)\b|<!--", re.I)
_CLOSED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template")} | {None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,3})(?![A-Za-z])", re.I)


def visible(html: str) -> str:
    """The text of a page without markup, in time linear in its length.

    Scripts, styles and comments that are not closed reach to the end."""
    kept, at = [], 0
    while found := _OPENED.search(html, at):
        kept.append(html[at : found.start()])
        closed = _CLOSED[found[1] and found[1].lower()].search(html, found.end())
        at = closed.end() if closed else len(html)
    kept.append(html[at:])
    text = " ".join(kept)
    end = text.rfind(">") + 1  # behind it no tag can end
    return unescape(_TAG.sub(" ", text[:end]) + text[end:])


def declared(html: str) -> str | None:
    """The language that the first <html> tag with such a statement declares."""
    for tag in _HTML.finditer(html):
        if found := _LANG.search(tag[1]):
            return found[1].lower()
    return None


def trigrams(data: bytes):
    """Buckets of the byte trigrams of a text, ASCII lower-cased."""
    import numpy as np

    a = np.frombuffer(b" ".join(data.lower().split()), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    code = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64)


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts of all texts with a language code."""
    code = F.lower(F.regexp_extract(lang, "^([A-Za-z]{2,3})(?:[-_]|$)", 1))  # pt of pt-BR
    usable = docs.select(code.alias("lang"), text).where("lang <> ''")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        totals: dict = {}
        for batch in batches:
            for code, t in zip(batch.column(0).to_pylist(), string_bytes(batch.column(1))):
                if code not in totals:
                    totals[code] = np.zeros(BUCKETS, np.int64)
                totals[code] += np.bincount(trigrams(t), minlength=BUCKETS)
        for code, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    return usable.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, confidence and the single statements (text_lang, declared_lang,
    address_lang) of every row of ``pages`` (page_id, url, html).

    Null or empty html has no text and declares nothing; a page without an address has a
    prior from all pages only; ties go to the language first in the alphabet. Without
    documents of a known language the languages are null. Other columns of either table
    are not looked at; repeated rows count and are returned as often as they occur.
    """
    import numpy as np

    # At most 2 ** 15 numbers for each of the few language codes, whatever the corpus.
    counts = language_counts(docs).toPandas()
    codes = sorted(counts["lang"].unique())
    if not codes:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared_lang"), none.alias("address_lang"))
    model = np.full((BUCKETS, len(codes)), 0.5)
    model[counts["bucket"], np.searchsorted(codes, counts["lang"])] += counts["n"]
    model = np.log(model / model.sum(axis=0)).astype(np.float32)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    known = set(codes)

    def address(h: str | None, url: str | None) -> str | None:
        labels = (h or "").split(".")
        if labels[0] in known and len(labels) > 2:
            return labels[0]
        path = re.sub(r"^[^:]*://[^/?#]*", "", url or "").split("?")[0].split("#")[0]
        for part in path.split("/")[1:3]:
            if part.lower()[:2] in known and re.fullmatch(r"[A-Za-z]{2}(-[A-Za-z]{2})?", part):
                return part.lower()[:2]
        return SUFFIX_LANG.get(labels[-1]) if SUFFIX_LANG.get(labels[-1]) in known else None

    def read(batches):
        import numpy as np
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            ids, urls, hosts, htmls = (batch.column(i).to_pylist() for i in range(4))
            likes, said, where = [], [], []
            for u, h, html in zip(urls, hosts, htmls):
                at = trigrams(visible(html or "").encode())
                likes.append((TEMPER * table[at].sum(axis=0, dtype=np.float64)).tolist())
                d = declared(html or "")
                said.append(d if d in known else ("other" if d else None))
                where.append(address(h, u))
            best = [codes[int(np.argmax(x))] if any(x) else None for x in likes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, pa.string()) for v in (best, said, where)), pa.array(likes, pa.list_(pa.float64()))],
                names=schema.names,
            )

    id_type = pages.schema["page_id"].dataType
    text = [T.StructField(c, T.StringType()) for c in ("url", "host", "text_lang", "declared_lang", "address_lang")]
    schema = T.StructType([T.StructField("page_id", id_type), *text, T.StructField("likes", T.ArrayType(T.DoubleType()))])
    seen = written(pages.select("page_id", "url", host("url").alias("host"), "html").mapInArrow(read, schema), "statements")
    seen = seen.withColumn("domain", F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.)", ""))

    # How statements go with languages: a few dozen numbers each.
    def reliability(column):
        table = np.ones((len(codes), len(codes) + 2))
        slots = {**{c: i for i, c in enumerate(codes)}, "other": len(codes), None: len(codes) + 1}
        for row in seen.where("text_lang IS NOT NULL").groupBy("text_lang", column).count().collect():
            table[codes.index(row[0]), slots[row[1]]] += row[2]
        return slots, np.log(table / table.sum(axis=1, keepdims=True))

    slots, by_declared = reliability("declared_lang")
    _, by_address = reliability("address_lang")
    overall = np.ones(len(codes))
    for row in seen.where("text_lang IS NOT NULL").groupBy("text_lang").count().collect():
        overall[codes.index(row[0])] += row[1]

    def priors(key):
        per = seen.where("text_lang IS NOT NULL").groupBy(key, "text_lang").agg(F.count("*").alias("n"))
        return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias(f"{key}_n"))

    joined = seen.join(priors("host"), "host", "left").join(priors("domain"), "domain", "left")
    joined = joined.select("page_id", "url", "text_lang", "declared_lang", "address_lang", "likes", F.col("host") != "", "host_n", "domain_n")

    def fuse(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            lang, sure = [], []
            for t, d, a, likes, placed, host_n, domain_n in zip(*columns[2:]):
                own = np.array([c == t for c in codes], float)
                prior = np.maximum(overall - own, 1e-9)
                prior = prior / prior.sum()
                for n in (domain_n, host_n) if placed else ():
                    found = dict(n or ())
                    n = np.array([found.get(c, 0) for c in codes], float) - own
                    prior = (n + STRENGTH * prior) / (n.sum() + STRENGTH)
                p = np.array(likes) + by_declared[:, slots[d]] + by_address[:, slots[a]] + np.log(prior)
                p = np.exp(p - p.max())
                p /= p.sum()
                best = int(np.argmax(p))
                lang.append(codes[best])
                sure.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang), pa.array(sure), *(batch.column(i) for i in (2, 3, 4))], names=out.names
            )

    out = T.StructType(
        [
            T.StructField("page_id", id_type),
            T.StructField("url", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            *[T.StructField(c, T.StringType()) for c in ("text_lang", "declared_lang", "address_lang")],
        ]
    )
    return joined.mapInArrow(fuse, out)
