import hashlib
import random
import re
import tempfile
import time
from pathlib import Path

from cellclock.llm import common, fingerprints, near_dedup, shingles
from cellclock.session import shared_folder

from .conftest import ODD, WORDS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sets_of(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, percent):
    """component of each id by comparing all pairs."""
    sets = {}
    for i, t in texts:
        sets.setdefault(i, []).append(sets_of(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                        r, s = root(a), root(b)
                        parent[max(r, s)] = min(r, s)
    return {i: root(i) for i in ids}


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(10**6))
    return " ".join(w)


def test_shingle_counts():
    texts = ["", " ", "a", "A b", "a B c d e", "x" * 2_500_000 + " y z", "ab " * 500_000, "\x0b\x1c a\x00b é", prose(500, 8)]
    got = shingles.shingle_sets([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(sets_of(t)) for t in texts]


def test_chain_of_edits_and_copies(make):
    base = prose(300, 20)
    texts = [(100 + i, base if i % 4 == 0 else edited(base, i % 12, i)) for i in range(60)]
    chain = prose(300, 21)
    for i in range(12):  # each linked with the next, not with all
        texts.append((10 + i, chain))
        chain = edited(chain, 3, 900 + i)
    texts += [(1, "few words"), (2, "Few  words"), (3, None), (4, ""), (5, prose(80, 22))]
    for percent, bands, per_band in ((85, 21, 6), (80, 25, 5)):
        want = brute(texts, percent)
        got = near_dedup.near_duplicates(make(texts), percent, bands, per_band).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(sets_of(t)) for i, t in texts}


def test_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[7].component_id == 6 and not by_id[7].kept
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 9)] == [1, 2, 3, 4, 5, 9]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(empty).collect() == []
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, None, None, 8, 9], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edited_fingerprints(make, odd, empty):
    texts = [(i, prose(40 + 7 * i, i) if i % 9 else "") for i in range(60)] + [(77, "Zwei Wörter 🎉🎉🎉🎉")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(texts), parts=5).collect()}
    assert len(got) == len(texts)
    for n, (i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        cut = len(t) // 4
        changed = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = sets_of(t), sets_of(changed)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - true) < 0.2
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD)
    assert fingerprints.edited_fingerprints(empty).collect() == []


def test_matches_are_verified(make, odd, empty):
    base = prose(400, 30)
    texts = [(1, base), (2, base), (3, edited(base, 4, 1)), (4, edited(base, 150, 2)), (5, prose(400, 31))]
    prints = fingerprints.fingerprints(make(texts))
    by_id = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert by_id[1] == by_id[2]
    got = {(r.fingerprint, r.matched) for r in fingerprints.matches(prints, prints).collect()}
    assert got == {(by_id[1], by_id[3]), (by_id[3], by_id[1])}
    assert fingerprints.fingerprints(odd).count() == len(ODD)
    assert fingerprints.fingerprints(empty).collect() == []


def test_matches_near_the_threshold(make):
    texts = []
    for b in range(10):
        base = prose(400, 40 + b)
        texts += [(10 * b, base)] + [(10 * b + n - 5, edited(base, n, 100 * b + n)) for n in range(6, 12)]
    sets = {i: sets_of(t) for i, t in texts}
    true = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    close = [j for j in true.values() if 0.78 <= j <= 0.86]
    assert min(close) < 0.8 and sum(j >= 0.8 for j in close) > 10
    prints = fingerprints.fingerprints(make(texts))
    by_print = {r.fingerprint: r.doc_id for r in prints.collect()}
    got = [(by_print[r.fingerprint], by_print[r.matched], r.likeness) for r in fingerprints.matches(prints, prints).collect()]
    assert {(a, b): j for a, b, j in got if a < b} == {p: j for p, j in true.items() if j >= 0.8}


def test_matched_fingerprints(make, odd, empty):
    texts = [(i, prose(300, 60)) for i in (1, 2, 3)]
    texts += [(10 + n, edited(prose(300, 60), 3, 700 + n)) for n in range(8)]
    texts += [(30 + n, prose(200, 70 + n)) for n in range(4)] + [(40, edited(prose(200, 70), 2, 9)), (50, ""), (51, None)]
    got = {r.doc_id: r for r in fingerprints.matched_fingerprints(make(texts)).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(texts, 80)
    assert all((got[i].n_links > 0) == (i < 20 or i in (30, 40)) for i in got)
    assert got[1].n_links == got[2].n_links
    plain = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(texts)).collect()}
    assert all(got[i].asDict() | plain[i].asDict() == got[i].asDict() for i in got)
    assert fingerprints.matched_fingerprints(odd).count() == len(ODD)
    assert fingerprints.matched_fingerprints(empty).collect() == []


def test_scratch_of_fingerprints(spark, make):
    """Nothing as long as a signature or a text stays on disk for every document."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    texts = [(i, prose(12, 1000 + i)) for i in range(3000)] + [(5000 + i, edited(prose(60, 1), i % 3, i)) for i in range(40)]
    docs = make(texts)
    before = held()
    out = fingerprints.matched_fingerprints(docs)
    assert held() - before < 150 * len(texts)
    got = {r.doc_id: r.class_id for r in out.collect()}
    assert len(got) == len(texts) and all(got[i] == i for i in range(3000)) and got[5000] == got[5039] == 5000


def test_written_leaves_no_shuffle_files(spark):
    top = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    files = lambda: set(top.glob("blockmgr-*/*/shuffle_*.data"))
    before = files()
    out = common.written(spark.range(5000).repartition(7, "id"), "trial")
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 5000
    common.forget(out)


def test_rows_perhaps_among_keys(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 100 = 7, NULL, id) AS k", "CAST(id AS STRING) AS v")
    keys = spark.range(0, 20_000, 10).selectExpr("IF(id % 1000 = 0, NULL, id) AS k")
    got = {r.k for r in common.perhaps_among(rows, keys, "k").collect()}
    want = {i for i in range(0, 20_000, 10) if i % 1000}
    assert want <= got and None not in got and len(got) < 1.05 * len(want)
    assert common.perhaps_among(rows, keys.limit(0), "k").collect() == []
