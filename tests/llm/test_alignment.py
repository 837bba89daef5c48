import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellclock.llm import alignment

from .conftest import ODD, prose

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    symbols = alignment.byte_symbols()
    return a, {i: bytes(symbols[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(libraries, text):
    """(n_a, n_b, groups, links) from whole texts, by comparing all ranges of a group."""
    a, bytes_a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes_a[i] for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        n, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, ids_a[i:n])) + "|" + ",".join(map(str, ids_b[j:m])))
        for x in range(i, n):
            for y in range(j, m):
                if max(ends_a[x] - len(of_a[x]), ends_b[y] - len(of_b[y])) < min(ends_a[x], ends_b[y]):
                    links[ids_a[x], ids_b[y]] += 1
        i, j = n, m
    return len(ids_a), len(ids_b), groups, links


def expected(libraries, texts):
    found = [(i, brute(libraries, t)) for i, t in texts]
    counts = Counter(p for _, x in found if x for p in x[3])
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = []
    for i, x in found:
        if not x:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for p, n in x[3].items() if counts[p] == most[p[0]])
        digest = hashlib.sha256(";".join(x[2]).encode()).hexdigest()
        rows.append((i, x[0], x[1], len(x[2]), sum(x[3].values()), best, sum(n * counts[p] for p, n in x[3].items()), digest))
    return rows, found


def texts():
    rng = random.Random(6)
    out = [(100 + i, prose(30, i) + rng.choice(["", " ", "  ", "\n", ".", "  x", "\t\ty"])) for i in range(60)]
    out += [(200 + i, "".join(rng.choice("ab \n\té中🎉'1.-<s>") for _ in range(90))) for i in range(60)]
    out += [(300 + i, "".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(40))) for i in range(20)]
    out += [(400, "▁ a"), (401, "  lead"), (402, "trail   "), (403, "<|endoftext|> <s> </s> <unk> <0x41>"), (404, " "), (405, "   "), (406, "\x00 \x00a"), (407, "\n\n  \n b")]
    return [t for t in ODD if t[0] != 5] + out + [(5, prose(3000, 1))] + out[:5]


def test_alignments(make, empty, libraries, monkeypatch):
    want, found = expected(libraries, texts())
    got = alignment.alignments(make(texts()), A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert alignment.alignments(empty, A_PATH, B_PATH).collect() == []


def test_pair_counts_and_postings(make, libraries):
    docs = make(texts()).repartition(3)
    documents, postings = alignment.index(docs, A_PATH, B_PATH)
    _, found = expected(libraries, texts())
    n_docs, n_links = Counter(), Counter()
    for _, x in found:
        if x:
            n_docs.update(x[3].keys())
            n_links.update(x[3])
    got = {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in alignment.pair_counts(postings).collect()}
    assert got == {p: (n_docs[p], n_links[p]) for p in n_docs}
    (a, b), _ = n_docs.most_common(1)[0]
    held = alignment.documents_of(documents, postings, F.col("pair") == a * alignment.PAIR + b)
    assert Counter((r.doc_id, r.times) for r in held.collect()) == Counter((i, x[3][a, b]) for i, x in found if x and x[3][a, b])


def test_small_blocks_give_the_same(make, libraries):
    aligner = alignment.Aligner(*alignment.read_files(A_PATH, B_PATH))
    block, want = alignment.Block(), {}
    for slot, got in enumerate(aligner.align([t for _, t in texts() if t and "▁" not in t])):
        block.add(got[4])
        for p, n in zip(*np.unique(got[4], return_counts=True)):
            want.setdefault(int(p), {})[slot] = int(n)
    pairs, n_docs, links, planes = block.postings()
    assert pairs.tolist() == sorted(want)
    for p, n, total, ps in zip(pairs.tolist(), n_docs.tolist(), links.tolist(), planes):
        times = Counter()
        for k, plane in enumerate(ps):
            for slot in alignment._unpacked(plane).tolist() if plane else ():
                times[slot] += 1 << k
        assert times == want[p] and n == len(times) and total == sum(times.values())


def test_packed_sets():
    rng = random.Random(7)
    for slots in ([0], [65535], list(range(5000)), [*range(10), *range(500, 900), 4000], sorted(rng.sample(range(32768), 9000)), sorted(rng.sample(range(32768), 20))):
        data = alignment._packed(np.array(slots), 1 << 16)
        assert alignment._unpacked(data).tolist() == slots
        assert len(data) <= 1 + min(2 * len(slots), 8192)


def test_long_text_without_spaces(make, libraries):
    long = [(1, "ab1" * 40_000), (2, prose(40_000, 9))]
    got = sorted(map(tuple, alignment.alignments(make(long), A_PATH, B_PATH).collect()))
    aligner = alignment.Aligner(*alignment.read_files(A_PATH, B_PATH))
    for row, (_, t) in zip(got, long):
        assert row[1] == len(libraries[0].encode(" " + t, add_special_tokens=False).ids) and row[2] == len(libraries[2].encode(t))
        assert row[4] == row[1] + row[2] - row[3]  # ends that are not common
    assert len(aligner.segments(long[1][1])) == 40_000
