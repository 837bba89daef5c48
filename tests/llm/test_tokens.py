import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cellclock.llm import bpe_automaton, token_files
from cellclock.llm.queries import vocabulary

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def expected_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_automaton_agrees_with_merging(library):
    codec = bpe_automaton.Codec(bpe_automaton.read_definition(vocabulary()))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdethinorg's .!1é") for _ in range(120)) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(80)) for _ in range(200)]
    texts += ["aaaa aaaaaaa", "-" * 300, "the" * 500, "İ Σ ΑΣ ß ſ ½ ² Ⅷ ٣", "a\x1cb\x85c d"]
    for text in texts:
        ids = expected_ids(library, text)
        data = np.array(ids, "<u4").tobytes()
        assert codec.encode(text.encode()) == data
        assert codec.decode(data) == library.decode(ids, skip_special_tokens=False)


def test_every_arc_of_the_automaton_is_a_valid_pair(library):
    automaton = bpe_automaton.MergeAutomaton(bpe_automaton.read_definition(vocabulary()))
    assert len(automaton.born) == 48894
    rng = random.Random(5)
    inner = [t for t in automaton.inner if t is not None]
    final = [t for t in automaton.final if t is not None]
    for _ in range(2000):
        a, b = rng.choice(inner), rng.choice(final)
        word = automaton.labels[a] + automaton.labels[b][: -len("</w>")]
        merged = library.model.tokenize(word)
        assert automaton.follows(a, b) == ([m.id for m in merged] == [a, b])


def test_token_digests(odd, empty, library):
    got = bpe_automaton.token_digests(odd, vocabulary()).collect()
    want = []
    for i, text in ODD:
        ids = expected_ids(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_automaton.token_digests(empty, vocabulary()).collect() == []


def test_encode_keeps_columns(odd):
    coded = bpe_automaton.encode(odd, vocabulary())
    assert sorted(coded.columns) == sorted(odd.columns)  # ids and n_tokens are replaced
    assert coded.count() == len(ODD)


def test_elias_fano():
    rng = random.Random(3)
    for case in ([0], [0, 0, 0], [0, 5], [0] + [1000] * 4, sorted(rng.randrange(10**6) for _ in range(5000))):
        low_bits, low, high = token_files.EliasFano.coded(np.array(case))
        coded = token_files.EliasFano(len(case), low_bits, low, high)
        n = len(case)
        for a, b in ((0, n), (0, 1), (n // 3, n // 3 + 1), (n // 2, n)):
            assert coded.select_all(a, b).tolist() == case[a:b]
        assert [coded.select(i) for i in range(len(case))] == case
    assert len(low) + len(high) < 5000 * 8 / 4


def test_segment_documents():
    documents = [np.array(x, "<u2").tobytes() for x in ([1], [], [5, 6, 7], [9] * 300)]
    segment = token_files.Segment(token_files.pack(documents, 2))
    assert [segment.document(i).tobytes() for i in range(4)] == documents


def test_token_files(odd, empty, library):
    got = {}
    for r in token_files.token_file_digests(odd, vocabulary(), end_id=1, parts=3).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    start = 0
    order = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
    whole = sorted(x for v in got.values() for x in v)
    assert len(whole) == len(ODD)
    for s, n, _ in whole:
        assert s == start
        start += n
    for i, text in order:
        data = np.array(expected_ids(library, text) + [1], "<u4").tobytes()
        assert any((n, c) == (len(data) // 4, zlib.crc32(data)) for _, n, c in got[i])
    assert [min(got[k])[0] for k in sorted(k for k in got if k is not None)] == sorted(min(got[k])[0] for k in got if k is not None)
    assert token_files.token_file_digests(empty, vocabulary()).collect() == []


def test_document_ids():
    low, high = -(1 << 63), (1 << 63) - 1
    for ids in ([], [None], [None, None, 5], [7], [low, high], [low, -3, -3, 0, 1, 300, 70_000, 1 << 40], list(range(1000))):
        data = token_files.pack_ids(ids)
        nulls, known = token_files.unpack_ids(data, len(ids))
        assert [None] * nulls + known.tolist() == ids
    assert len(data) < 1100


def test_single_documents_are_read(spark, make, library):
    texts = [*ODD, (-(1 << 63), "least id"), (1 << 62, "great id"), (50, "the cat")]
    out = token_files.scratch_path(spark, "random-access")
    token_files.write_token_files(make(texts), vocabulary(), out, 1, parts=3)
    for wanted in ([8], [6, 7, None], [-(1 << 63), 1 << 62, 12345], [], [None]):
        got = sorted((str(r.doc_id), bytes(r.ids)) for r in token_files.read_documents(spark, out, wanted).collect())
        want = [(str(i), np.array(expected_ids(library, t) + [1], "<u4").tobytes()) for i, t in texts if i in wanted]
        assert got == sorted(want)
    whole = {r.doc_id for r in token_files.read_token_files(spark, out).collect()}
    assert whole == {i for i, _ in texts}


def test_byte_level_vocabulary_goes_whole(library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.LibraryEncoder(bpe_automaton.read_definition(path))
    other = Tokenizer.from_file(path)
    assert not encoder.by_word
    for text in ("Hello  world.\n Next", ""):
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


class Counting:
    """Passes calls on and notes the words that it was given."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode(self, words, **options):
        self.seen += words if isinstance(words, list) else [words]
        return self.inner.encode(words, **options)

    def tokenize(self, word):
        self.seen.append(word)
        return self.inner.tokenize(word)


def counted(monkeypatch, kept):
    monkeypatch.setattr(token_files, "WORDS_KEPT", kept)
    encoder, seen = token_files.LibraryEncoder(bpe_automaton.read_definition(vocabulary())), []
    encoder.library, encoder.model = Counting(encoder.library, seen), Counting(getattr(encoder, "model", None), seen)
    return encoder, seen


def test_frequent_words_are_asked_for_once(monkeypatch, library):
    encoder, seen = counted(monkeypatch, 5)
    for i in range(12):
        text = f"the cat {'abcdefghijkl'[i] * 3} and"
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == expected_ids(library, text)
    assert sorted(w for w in seen if w in ("the", "cat", "and")) == ["and", "cat", "the"]
    assert len(encoder.known) + len(encoder.older) <= 2 * (5 + 4)


def test_a_word_with_punctuation_is_no_new_word(monkeypatch, library):
    encoder, seen = counted(monkeypatch, 1000)
    text = "winter winter, winter... winter?! winter### Winter: winter) café café; CAFÉ!! café###"
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == expected_ids(library, text)
    assert sum("winter" in w for w in seen) == 1
    assert sum("caf" in w for w in seen) <= 2  # É is outside ASCII, so that form is a word


def test_words_agree_with_whole_texts(monkeypatch, library):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 300)
    encoder = token_files.LibraryEncoder(bpe_automaton.read_definition(vocabulary()))
    assert encoder.by_word and encoder.lower and encoder.letters
    rng = random.Random(9)
    tricky = list("abestrz09 .,'#<|>=\n\t_-") + list("éÉßœŒ×÷ñÿŸİıſΣς²ªºµ…–«»̸́  각中ก") + ["'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "\x00", "the "]
    texts = ["".join(rng.choices(tricky, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["x" * 5000 + ".", "é." * 3000, "", " ", ".", "<|startoftext|>Winter, Winter.<|endoftext|>.", "A<|STARTOFTEXT|>"]
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        got = encoder.encode([t.encode() for t in some])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [expected_ids(library, t) for t in some]
    assert encoder.encode([]) == [] and encoder.encode([b"", b" "]) == [b"", b""]
    broken = [b"ab\xc3", b"\xa9. x\xc3.", b"\xff\xfe, a\xe2\x80."]
    got = encoder.encode(broken)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [expected_ids(library, t.decode("utf-8", "replace")) for t in broken]
