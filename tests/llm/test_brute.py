"""Plain Python versions of operators that SQL cannot express."""

import math
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellclock.llm import language, pii, quality
from cellclock.llm.queries import vocabulary

from .conftest import ODD, prose
from .test_copies import brute as brute_components
from .test_copies import edited
from .test_text import brute_hits

# ---- language ----------------------------------------------------------------------


def plain_text(html):
    """Markup taken out by walking over the page once."""
    out, at, low = [], 0, html.lower()
    while at < len(html):
        if low.startswith("<!--", at):
            end = low.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
            out.append(" ")
            continue
        name = re.match(r"<(script|style|noscript|template)(?!\w)", low[at : at + 12])
        if name:
            end = re.compile(rf"</{name[1]}\s*>").search(low, at + len(name[0]))
            at = len(html) if not end else end.end()
            out.append(" ")
            continue
        if html[at] == "<" and html.find(">", at) >= 0:
            at = html.find(">", at) + 1
            out.append(" ")
            continue
        out.append(html[at])
        at += 1
    return unescape("".join(out))


def brute_languages(pages, docs):
    counts = defaultdict(Counter)
    bucket = lambda t: [((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 17 for i in range(len(t) - 2)]
    flat = lambda text: b" ".join(text.encode().lower().split())
    for lang, text in docs:
        counts[lang].update(bucket(flat(text)))
    codes = sorted(counts)
    total = {c: sum(counts[c].values()) + 0.5 * language.BUCKETS for c in codes}
    rows = []
    for i, url, html in pages:
        at = bucket(flat(plain_text(html or "")))
        like = [0.25 * sum(math.log((counts[c][b] + 0.5) / total[c]) for b in at) for c in codes]
        said = re.search(r"<html[^>]*\blang\s*=\s*[\"']?\s*([a-z]{2,3})(?![a-z])", (html or "").lower())
        said = said and said[1]
        host = re.match(r"[a-z]+://(?:[^@/]*@)?([^/:?#]*)", (url or "").lower())
        host = host[1] if host else ""
        labels = host.split(".")
        parts = re.sub(r"^[^:]*://[^/?#]*", "", url or "").split("?")[0].split("#")[0].split("/")[1:3]
        named = [p.lower()[:2] for p in parts if p.lower()[:2] in codes and re.fullmatch(r"[A-Za-z]{2}(-[A-Za-z]{2})?", p)]
        suffix = language.SUFFIX_LANG.get(labels[-1])
        where = labels[0] if labels[0] in codes and len(labels) > 2 else named[0] if named else suffix if suffix in codes else None
        best = codes[int(np.argmax(like))] if any(like) else None
        rows.append((i, url, best, (said if said in codes else "other") if said else None, where, like, host))
    kinds = [*codes, "other", None]
    tables = []
    for column in (3, 4):
        table = {c: {k: 1.0 for k in kinds} for c in codes}
        for r in rows:
            if r[2]:
                table[r[2]][r[column]] += 1
        tables.append({c: {k: math.log(n / sum(t.values())) for k, n in t.items()} for c, t in table.items()})
    domain = lambda h: h.split(".", 1)[1] if h.count(".") >= 2 else h
    overall, by_host, by_domain = Counter({c: 1 for c in codes}), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if r[2]:
            overall[r[2]] += 1
            by_host[r[6]][r[2]] += 1
            by_domain[domain(r[6])][r[2]] += 1
    out = []
    for i, url, best, said, where, like, host in rows:
        prior = {c: max(overall[c] - (c == best), 1e-9) for c in codes}
        whole = sum(prior.values())
        prior = {c: v / whole for c, v in prior.items()}
        for seen in (by_domain[domain(host)], by_host[host]) if host else ():
            n = {c: seen[c] - (c == best) for c in codes}
            prior = {c: (n[c] + 4.0 * prior[c]) / (sum(n.values()) + 4.0) for c in codes}
        logs = [x + tables[0][c][said] + tables[1][c][where] + math.log(prior[c]) for c, x in zip(codes, like)]
        p = np.exp(np.array(logs) - max(logs))
        p /= p.sum()
        out.append((str(i), codes[int(np.argmax(p))], float(p.max()), best, said, where))
    return out


def test_languages_are_brute_force(spark):
    docs = [("de", "der die und nicht mit auf von dem ein " * 9), ("fr", "le la des une que pour dans est sur " * 9), ("en", "the of and to in is that for it " * 9)]
    rng = np.random.default_rng(4)
    pages = []
    for n in range(120):
        lang, text = docs[rng.integers(0, 3)]
        words = " ".join(rng.choice(text.split(), 3 + n % 6))
        head = ["", f"<html lang={lang}>", f'<html class=a lang="{lang}-XX">', "<html lang='xx'>"][n % 4]
        junk = ["", "<script>var the = 1</script>", "<!-- der die -->", "<style>x", "<b>le</b>"][n % 5]
        url = [f"https://{lang}.a{n % 3}.example.com/x", f"https://b{n % 4}.example.{'de' if lang == 'de' else 'org'}/", f"https://c.org/{lang}/p{n}", None, "https://d.fr"][n % 5]
        pages.append((n, url, f"{head}<body>{words}{junk} &amp; {words}"))
    pages += [(500, "https://b1.example.org/", None), (501, None, None), (None, "https://c.org/fr/", "<p>"), (502, "https://c.org/", "a < b"), (502, "https://c.org/", "a < b")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    known = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(docs)], "doc_id long, text string, lang string")
    got = [(str(r.page_id), r.lang, r.confidence, r.text_lang, r.declared_lang, r.address_lang) for r in language.languages(frame, known).collect()]
    want = brute_languages(pages, docs)
    without = lambda rows: sorted(((r[0], r[1], *r[3:]) for r in rows), key=str)
    assert without(got) == without(want)
    sure = lambda rows: [r[2] for r in sorted(rows, key=lambda r: (r[0], r[2]))]
    assert sure(got) == pytest.approx(sure(want), abs=1e-6)  # the model's logarithms are 32-bit numbers


@pytest.mark.parametrize("html", ["<script>x" * 100_000, "<!-- a" * 100_000, "<" * 800_000, "<html " * 100_000, "<html lang=" + " " * 500_000])
def test_pages_are_read_in_linear_time(html):
    import time

    start = time.process_time()
    language.visible(html)
    language.declared(html)
    assert time.process_time() - start < 2


# ---- quality -----------------------------------------------------------------------


def plain_features(passage):
    """A passage's features by loops over its bytes."""
    def kind(b):
        if 97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57:
            return 0 if b >= 97 else 1 if b >= 65 else 2
        if b in b"\t\x0b\x0c\r ":
            return 3
        if b == 10:
            return 4
        for n, group in ((5, b".,;:"), (6, b"!?"), (7, b"|<>{}[]\\/=_~"), (8, b"#$%&*@^+")):
            if b in group:
                return n
        return 10 if b >= 192 else 11 if b >= 128 else 9

    n, out = len(passage), np.zeros(quality.FEATURES)
    for b in passage:
        out[min(b, 127)] += 1
    for a, b in zip(passage, passage[1:]):
        out[128 + quality.KINDS * kind(a) + kind(b)] += 1
    out[:-4] = 2 * np.sqrt(out[:-4] / n)
    mask = (1 << 32) - 1
    hashes = list(passage)
    for step, span in enumerate((1, 2, 4)):
        hashes = [h * 0x9E3779B1 & mask for h in hashes]
        hashes = [h if i < span else h + hashes[i - span] * (0x85EBCA77 + 2 * step) & mask for i, h in enumerate(hashes)]
        if step:
            cells = Counter(h >> 24 for h in hashes[2 * span - 1 :])
            out[2 * step - 6] = len(cells) / min(n, quality.CELLS)
            out[2 * step - 5] = 2 * math.sqrt(max(cells.values(), default=0) / n)
    return out


def plain_score(p, text):
    """Gated attention over the passages of one text, by loops."""
    passages = [text[i : i + quality.PASSAGE] for i in range(0, len(text), quality.PASSAGE)]
    codes, gates = [], []
    for x in [plain_features(t) for t in passages] or [np.zeros(quality.FEATURES)]:
        e = np.tanh(x @ p["We"] + p["be"])
        codes.append(e)
        gates.append(float((np.tanh(e @ p["V"]) / (1 + np.exp(-(e @ p["U"])))) @ p["w"][:, 0]))
    a = np.exp(np.array(gates) - max(gates))
    z = sum(w * e for w, e in zip(a / a.sum(), codes))
    return 1 / (1 + math.exp(-float(z @ p["u"][:, 0] + p["c"][0])))


@pytest.fixture(scope="module")
def model(spark):
    from cellclock.llm.common import ready
    from conftest import SF_DIR

    ready(spark)
    larger = SF_DIR.replace("sf0.001", "sf0.01")
    return quality.train(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet"))


def odd_texts():
    return [(i, t) for i, t in ODD] + [(100 + i, t) for i, t in enumerate(["a", "ab", "abcd efg", "x" * 513, prose(90, 5) + "é" * 300, "#$ 12 | " * 200])]


def test_scores_are_a_plain_forward_pass(make, model):
    p = {k: v.astype(float) for k, v in quality.AttentionModel.loads(model).p.items()}
    got = sorted((str(r.doc_id), r.score) for r in quality.score(make(odd_texts()), model).collect())
    want = sorted((str(i), plain_score(p, (t or "").encode())) for i, t in odd_texts())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_equal_texts_have_equal_scores_everywhere(spark, make, model):
    texts = [(i, t) for i, (_, t) in enumerate(odd_texts())] + [(1000 + i, prose(20 + 37 * i % 400, i)) for i in range(80)]
    twice = make(texts + [(5000 + i, t) for i, t in texts])
    runs = []
    for rows, parts in ((500, 1), (7, 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        runs.append({r.doc_id: r.score for r in quality.score(twice.repartition(parts), model).collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert runs[0] == runs[1]  # to the last bit
    assert all(runs[0][i] == runs[0][5000 + i] for i, _ in texts)


# ---- the pipeline ------------------------------------------------------------------


def test_pipeline_is_brute_force(spark, tmp_path):
    """Every stage in plain Python; the model's scores and the surrogates are taken as given."""
    items = [(1, prose(40, 70)), (2, prose(25, 71))]
    texts = [(i, prose(60 + i, 300 + i)) for i in range(30)]
    texts += [(40 + i, "#$%& || " * (20 + i)) for i in range(12)]  # junk
    texts += [(60 + i, prose(61, 301)) for i in range(3)]  # copies
    texts += [(70 + i, edited(prose(200, 9), 2, i)) for i in range(4)]  # near copies
    texts += [(80, prose(30, 1) + " " + " ".join(items[0][1].split()[5:20])), (81, items[1][1])]
    texts += [(90, prose(30, 2) + " write to ann.lee72@mail3.example.com or call +1 487 555 7209"), (91, prose(40, 3) + " Mrs Anna Smith"), (92, None), (93, "")]
    labels = [(i, int(not 40 <= i < 60), 0) for i, _ in texts if i < 60]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = [(i, t) for i, t in texts if scores[i] >= 0.7]
    assert {i for i, _ in kept} >= {i for i, _ in texts if i < 30} and not any(40 <= i < 60 for i, _ in kept)
    root = brute_components(kept, 80)
    kept = [(i, t) for i, t in kept if root[i] == i]
    kept = [(i, t) for i, t in kept if not brute_hits(t, items)[1]]
    want = dict(kept)
    assert not set(want) & {61, 62, 71, 72, 73, 80, 81} and len(want) >= 32
    given = {r.doc_id: r.text for r in pii.replace_entities(docs.where(docs.doc_id.isin(*want)), corpus_pipeline.SURROGATE_KEY).collect()}
    assert {i for i in want if given[i] != want[i]} == {90, 91} & set(want)
    library = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want)
    for i, r in got.items():
        ids = library.encode(given[i] or "", add_special_tokens=False).ids
        assert (r.text, r.lang, r.source, r.n_tokens) == (given[i], "en", "s", len(ids))
        assert r.n_chars == (len(given[i]) if given[i] is not None else None)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
