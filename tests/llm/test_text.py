import math
import re
import zlib
from collections import Counter

import numpy as np

from cellclock.llm import context_tree, decontaminate, language, pii, quality, url_lists

from .conftest import ODD, prose
from .test_copies import LOW, WORD

HIT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hit_words(text):
    return HIT_WORD.findall((text or "").translate(LOW))


def brute_hits(text, items):
    w, hit, found = hit_words(text), set(), set()
    for item, t in items:
        v = hit_words(t)
        n = min(len(v), 10)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination(spark, make, empty):
    items = [(1, prose(40, 70)), (2, "Very short item"), (3, None), (4, ""), (10, prose(10, 71)), (11, prose(40, 70)), (12, "na na na na na na na na na na na na"), (13, "ein"), (14, "ÉTÉ à la mer, L'été")]
    a, b = items[0][1].split(), items[4][1].split()
    texts = [
        (1, prose(50, 80) + " " + " ".join(a[5:17]) + " " + prose(30, 81)),
        (2, " ".join(a[:9]) + " X " + " ".join(a[9:19]).upper()),
        (3, "x very, SHORT item. y"),
        (4, " ".join(b)),
        (5, " ".join(b[:9])),
        (6, "na " * 25),
        (7, "ein mehr ein"),
        (8, None),
        (9, ""),
        (9, " ".join(a) * 2),
        (9, " ".join(a) * 2),
        (None, " ".join(a[3:20])),
        (20, "ÉTÉ à la mer l'été"),
        (21, "Été à la mer l'été"),
        (22, prose(20_000, 82) + " " + " ".join(a)),
    ]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, h string")
    got = decontaminate.contamination(make(texts), bench).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str)
    want = sorted(((i, *(x := brute_hits(t, items)), x[1] > 0) for i, t in texts), key=str)
    assert have == want
    kept = decontaminate.drop_contaminated(make(texts), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in texts if not brute_hits(t, items)[1]), key=str)
    assert decontaminate.contamination(empty, bench).collect() == []
    none = decontaminate.contamination(make(texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)


def test_surrogates(make, odd, empty):
    texts = [
        (1, "mail Ann.Lee72@mail3.example.com, ANN.LEE72@MAIL3.EXAMPLE.COM."),
        (2, "ip 10.2.3.4, not 1.2.3.4.5 v4.0. 256.1.1.1"),
        (3, "card 4111111111111111 and 4111-1111-1111-1111 not 4111111111111112 or 9995111111111111"),
        (4, "tel +1 (487) 555-7209 or +1 487 555 7209"),
        (5, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" TOKEN = "B44E15E09FD311C3CF3163B66D5A9875B883D8CE"!!'),
        (6, "Mrs Anna Smith met Mr. Smith and HERR SMITH; Госпожа Анна Иванова"),
        (7, "nothing 3. here"),
        (8, "again ann.lee72@mail3.example.com"),
        (8, "again ann.lee72@mail3.example.com"),
        (9, "thé.44@mail1.example.com###"),
        (10, None),
        (11, ""),
    ]
    out = pii.replace_entities(make(texts), "key", "n_replaced").collect()
    assert len(out) == len(texts)
    got = {r.doc_id: r for r in out}
    mail = re.match(r"mail (\w+\.\w+\d\d@\w+\d\.\w+\.example), (\S+)\.$", got[1].text)
    assert mail and mail[2] == mail[1].upper() and "lee" not in got[1].text.lower()
    assert got[8].text == "again " + mail[1]
    ip = re.match(r"ip (\d+\.\d+\.\d+\.\d+), not 1.2.3.4.5 v4.0. 256.1.1.1$", got[2].text)
    assert ip and ip[1] != "10.2.3.4" and all(int(x) < 256 for x in ip[1].split("."))
    card = re.match(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}) not 4111111111111112 or 9995111111111111$", got[3].text)
    digits = [int(c) for c in reversed(card[1])]
    assert card[1] == card[2].replace("-", "") != "4111111111111111"
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    tel = re.match(r"tel \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})$", got[4].text)
    assert tel.groups()[:3] == tel.groups()[3:] != ("487", "555", "7209")
    token = re.match(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"!!$', got[5].text)
    assert token[1].upper() == token[2] and token[1][:4] != "b44e"
    name = re.match(r"Mrs (\w+) (\w+) met Mr. (\w+) and HERR (\w+); Госпожа (\w+) (\w+)$", got[6].text)
    assert name[2] == name[3] == name[4].capitalize() != "Smith"
    assert name[1].endswith(("a", "ina", "ella", "ia")) and re.match("[А-я]+$", name[5] + name[6])
    assert [got[i].text for i in (7, 10, 11)] == ["nothing 3. here", None, ""]
    assert {r.doc_id: r.n_replaced for r in out} == {1: 2, 2: 1, 3: 2, 4: 2, 5: 2, 6: 4, 7: 0, 8: 1, 9: 1, 10: 0, 11: 0}
    same = pii.replace_entities(odd, "key")
    assert same.columns == odd.columns
    assert sorted((str(r.text) for r in same.collect())) == sorted(str(t) for _, t in ODD)
    assert pii.replace_entities(empty, "key").collect() == []


def test_later_mentions_are_the_same_entity(make):
    texts = [
        (1, "Mrs Anna Smith wrote. Anna Smith came; Smith said SMITH and ANNA SMITH, Smithers, Anna alone, Annas Smith"),
        (2, "Anna Smith without a title, Smith too"),
        (3, "Frau Erika Groß und Herr Ünal: Groß, Ünal, Erika Groß, Erika Ünal. Госпожа Анна Иванова, Иванова и Анна Иванова"),
        (4, "Mr Jones paid with 4111111111111111. Jones, Jones."),
    ]
    got = {r.doc_id: r for r in pii.replace_entities(make(texts), "key", "n_replaced").collect()}
    a, s = re.match(r"Mrs (\w+) (\w+) wrote", got[1].text).groups()
    assert got[1].text == f"Mrs {a} {s} wrote. {a} {s} came; {s} said {s.upper()} and {a.upper()} {s.upper()}, Smithers, Anna alone, Annas {s}"
    assert got[1].n_replaced == 6
    assert got[2].text == texts[1][1] and got[2].n_replaced == 0
    e, g, u = re.match(r"Frau (\w+) (\w+) und Herr (\w+):", got[3].text).groups()
    assert f": {g}, {u}, {e} {g}, {e} {u}. " in got[3].text and "Groß" not in got[3].text
    an, iv = re.search(r"Госпожа (\w+) (\w+),", got[3].text).groups()
    assert got[3].text.endswith(f", {iv} и {an} {iv}")
    j = re.match(r"Mr (\w+) paid", got[4].text)[1]
    assert got[4].text.endswith(f". {j}, {j}.") and got[4].n_replaced == 4


def test_surrogates_are_distinct(spark):
    names = spark.createDataFrame([(f"given_f|N{i}",) for i in range(300)] + [(f"ip|10.0.{i}.7",) for i in range(200)], "entity string")
    out = pii.surrogates(names, "k").collect()
    assert len(out) == 500 and len({r.surrogate for r in out}) == 500
    assert not {r.surrogate for r in out} & {r.entity for r in out}


def test_quality(spark, documents, odd, empty):
    from conftest import SF_DIR

    labels = spark.read.parquet(SF_DIR.replace("sf0.001", "sf0.01") + "/labels.parquet")
    docs = spark.read.parquet(SF_DIR.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert docs.count() == quality.quality_scores(docs, labels).count()
    held = [r for r in got if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    scored = quality.quality_scores(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.quality_scores(empty, labels).collect() == []
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x = rng.random((9, quality.FEATURES)).astype(np.float32)
    starts, y = np.array([0, 2, 5]), np.array([0, 1, 1], np.float32)
    model = quality.AttentionModel.fresh(quality.FEATURES)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, starts)[0]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradient(x, starts, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-5
        up = loss()
        model.p[name][at] = keep - 1e-5
        down = loss()
        model.p[name][at] = keep
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-7)


def brute_tree(train, texts, depth):
    """Scores by walking every decision of every byte through plain dictionaries."""
    counts = Counter()
    for t in train:
        d = context_tree.canonical(t)
        full = b"\n" * depth + d
        for i in range(len(d)):
            symbol = d[i] | 256
            for k in range(8):
                for n in range(depth + 1):
                    counts[full[i + depth - n : i + depth], symbol >> (8 - k), symbol >> (7 - k) & 1] += 1
    nodes = {(c, s) for c, s, _ in counts}
    longer = {}
    for c, s in nodes:
        if c:
            longer.setdefault((c[1:], s), []).append((c, s))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    own = {n: kt(counts[(*n, 0)], counts[(*n, 1)]) for n in nodes}
    weighted = {}
    for n in sorted(nodes, key=lambda n: -len(n[0])):
        if len(n[0]) == depth:
            weighted[n] = own[n]
        else:
            weighted[n] = np.logaddexp(own[n], sum(weighted[x] for x in longer[n])) - math.log(2)

    def predict(full, i, s):
        n = 0
        p = None
        chain = []
        while n <= depth and (full[i - n : i], s) in nodes:
            chain.append((full[i - n : i], s))
            n += 1
        if not chain:
            return 0.5
        for c in reversed(chain):
            est = (counts[(*c, 1)] + 0.5) / (counts[(*c, 0)] + counts[(*c, 1)] + 1)
            share = math.exp(own[c] - math.log(2) - weighted[c])
            p = est if p is None else share * est + (1 - share) * p
        return p

    out = []
    for t in texts:
        d = context_tree.canonical(t)
        full, total = b"\n" * depth + d, 0.0
        for i in range(len(d)):
            symbol = d[i] | 256
            for k in range(8):
                p = predict(full, i + depth, symbol >> (8 - k))
                total += math.log10(p if symbol >> (7 - k) & 1 else 1 - p)
        out.append(total)
    return out


def test_context_tree_scores(make, odd, empty):
    texts = [(i, prose(12 + i % 7, i) + (" Zzz" if i % 5 == 0 else "")) for i in range(40)] + [(41, None), (42, ""), (42, ""), (None, "na so was")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    got = context_tree.scores(make(texts), block_docs=9).collect()
    train = [(t or "").encode() for i, t in texts if not held(i)]
    want = brute_tree(train, [(t or "").encode() for _, t in texts], context_tree.DEPTH)
    tokens = Counter()
    for i, t in texts:
        if not held(i):
            tokens.update(WORD.findall((t or "").translate(LOW)) + [None])
    n, v = sum(tokens.values()), len(tokens)
    rows = []
    for (i, t), s in zip(texts, want):
        w = WORD.findall((t or "").translate(LOW)) + [None]
        rows.append((i, held(i), len(w), sum(tokens[x] > 0 for x in w), n, sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), s))
    order = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=order), sorted(rows, key=order), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6)
    assert context_tree.scores(odd).count() == len(ODD)
    assert context_tree.scores(empty).collect() == []


def test_scores_beat_single_words(spark):
    from conftest import SF_DIR

    docs = spark.read.parquet(SF_DIR.replace("sf0.001", "sf0.1") + "/documents.parquet")
    held = [r for r in context_tree.scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_languages(spark, documents, odd):
    pages = [
        (1, "https://fr.a.example.com/x", "<html lang='fr'><body>" + "le la des une que pour dans".replace(" ", " est ") + "</body></html>", "z"),
        (2, "https://a.example.de/", None, "z"),
        (3, None, "", "z"),
        (4, "not a url", "<html lang=xx><script>var le = 1</script>", "z"),
        (None, "https://b.example.org/de/", "<p>der die und nicht mit auf von", "z"),
        (5, "https://b.example.org/de/", "<p>" + "der die und nicht mit auf von " * 400, "z"),
        (5, "https://b.example.org/de/", "<p>" + "der die und nicht mit auf von " * 400, "z"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = language.languages(frame, documents).collect()
    assert len(got) == len(pages)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].lang == "fr" and by_id[5].lang == "de" and by_id[None].lang == "de"
    assert (by_id[2].text_lang, by_id[2].address_lang, by_id[2].declared_lang) == (None, "de", None)
    assert by_id[4].declared_lang == "other" and all(0 < r.confidence <= 1 for r in got)
    assert language.languages(frame.limit(0), documents).collect() == []
    assert {r.lang for r in language.languages(frame, documents.limit(0)).collect()} == {None}


def test_pages_agree_with_their_markup(spark, documents):
    from conftest import SF_DIR

    got = language.languages(spark.read.parquet(f"{SF_DIR}/pages.parquet"), documents).collect()
    assert np.mean([r.lang == r.declared_lang for r in got if r.declared_lang]) > 0.95


def test_url_lists(spark):
    entries = [
        ("spam", "block", "bad.example.com", "add", "2024-01-10"),
        ("spam", "block", "bad.example.com", "add", "2024-01-12"),
        ("spam", "block", "bad.example.com", "remove", "2024-03-01"),
        ("spam", "block", "bad.example.com", "remove", "2024-03-05"),
        ("spam", "block", "bad.example.com", "add", "2024-06-01"),
        ("trusted", "allow", "bad.example.com/news", "add", "2024-02-01"),
        ("adult", "block", "example.org", "add", "2024-05-01"),
        ("trusted", "allow", "example.org", "add", "2024-05-01"),
        ("x", "block", "gone.com", "remove", "2024-01-01"),
        ("day", "block", "day.com", "add", "2024-01-05"),
        ("day", "block", "day.com", "remove", "2024-01-05"),
        ("n", "block", None, "add", "2024-01-05"),
    ]
    captures = [
        (1, "https://bad.example.com/a", "2024-01-09", "unlisted"),
        (2, "https://www.bad.example.com:8080/a?b", "2024-01-10", "block"),
        (3, "https://bad.example.com/news/x", "2024-02-01", "allow"),
        (4, "https://bad.example.com/newsletter", "2024-02-29", "block"),
        (5, "https://bad.example.com/", "2024-03-01", "unlisted"),
        (6, "https://u:p@BAD.example.com", "2026-06-01", "block"),
        (7, "https://example.org/", "2024-05-01", "block"),
        (8, "http://gone.com/", "2024-05-01", "unlisted"),
        (9, "http://day.com/", "2024-01-05", "unlisted"),
        (10, None, "2024-01-05", "unlisted"),
        (11, "http://bad.example.com", None, "unlisted"),
        (12, "no url", "2024-05-01", "unlisted"),
        (12, "no url", "2024-05-01", "unlisted"),
    ]
    e = spark.createDataFrame(entries, "list string, effect string, pattern string, action string, at string")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched string, verdict string")
    got = url_lists.evaluate(c, e).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((i, v) for i, _, _, v in captures)
    assert url_lists.evaluate(c.limit(0), e).collect() == []
    assert {r.verdict for r in url_lists.evaluate(c, e.limit(0)).collect()} == {"unlisted"}


def test_url_lists_with_deep_paths_and_capitals(spark):
    entries = [
        ("spam", "block", "a.org/x/y/z/w", "add", "2024-01-01"),
        ("spam", "block", "B.org/Top/Page", "add", "2024-01-01"),
        ("spam", "block", "C.org", "add", "2024-01-01"),
        ("spam", "block", "c.org", "remove", "2024-02-01"),
    ]
    e = spark.createDataFrame(entries, "list string, effect string, pattern string, action string, at string")
    urls = ["http://A.org/x/y/z/w/v", "http://a.org/x/y/z", "http://b.org/Top/Page", "http://b.org/top/page", "http://c.org/"]
    c = spark.createDataFrame([(u, "2024-03-01") for u in urls], "url string, fetched string")
    got = {r.url: (r.verdict, r.pattern) for r in url_lists.evaluate(c, e).collect()}
    none = ("unlisted", None)
    assert [got[u] for u in urls] == [("block", "a.org/x/y/z/w"), none, ("block", "b.org/Top/Page"), none, none]


def test_addresses_of_all_scripts_and_hot_domains(make):
    mails = ["王小明@例子.公司", "王小明@例子.中国", "홍길동@예시.한국", "דוד@דוגמה.ישראל"]
    mails += [f"{c}@mail.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    secret = "AKIA" + "ABCDEFGHIJKLMNOP"
    docs = make([(i, f"to {m} now") for i, m in enumerate(mails)] + [(99, f"id {secret} end")])
    got = {r.doc_id: r.text for r in pii.replace_entities(docs, "k").collect()}
    new = [got[i].split()[1] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    assert all(not set(m.split("@")[0]) & set(n) for m, n in zip(mails[:4], new[:4]))
    assert all(n.isascii() and n.endswith(".example") for n in new[:4])
    assert secret not in got[99]


def test_language_counts_with_regions(spark):
    texts = [("pt-BR", "abcd"), ("PT", "abcd"), ("zh_CN", "efgh"), ("english", "ijkl"), ("", "mnop"), (None, "qrst")]
    got = language.language_counts(spark.createDataFrame(texts, "lang string, text string")).groupBy("lang").sum("n").collect()
    assert {r[0]: r[1] for r in got} == {"pt": 4, "zh": 2}
