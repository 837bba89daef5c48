"""Tokenization by a merge automaton: encode pre-split words by table-driven transitions
and decode by emitting arc labels.

The automaton accepts, for every word, exactly one sequence of tokens: the one that
applying the merges in order would give. It is built gadget by gadget. At the start one
state loops on every symbol. The gadget of rule (u, v) -> w

* gives u's target a state of its own, without the arc v,
* adds an arc w beside every arc u that is left,
* leads it to a copy of what v's target is at that moment.

As every arc with the same label leads to the same state, a state is named by the label
of its incoming arcs. Copies are not written out: a state keeps the few arcs it has lost,
with the step of the loss, and the state it was copied from; so the whole automaton has
one entry per merge, and cells of its transition table are filled in when first used.

A word is read byte by byte by a second table, over all labels: its state is the longest
end of what was read that begins a label, so it names the labels that end here. Every
beginning of a word has one path through the merge automaton, so each position keeps one
arc: the label that may follow the arc kept where it begins. No position is read twice.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import Recent, string_bytes

WORDS_KEPT = 200_000  # entries of a generation of the per-process word table
PIECES_KEPT = 60_000
LONG_WORD = 64  # bytes of a word that is not worth keeping
CELLS_KEPT = 400_000  # entries of the transition tables before they start anew
FOREVER = 1 << 60
START = -1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in plain):
        table[chr(256 + n)] = b
    return table


class MergeAutomaton:
    """A deterministic automaton over tokens, compiled from a ``tokenizers`` BPE file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.labels = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, at in vocab.items():
            self.labels[at] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, at in self.special.items():
            self.labels[at] = token
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        self.born: dict[int, int] = {}  # step of the gadget that made the token
        self.copy_of: dict[int, int] = {}  # state its target was copied from
        self.beside: dict[int, int] = {}  # arc it was added beside
        self.lost: dict[int, dict[int, int]] = {}  # state -> lost arc -> step
        self.table: dict[int, bool] = {}  # filled rows: state << 20 | arc
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for step, (left, right) in enumerate(merges):
            self._gadget(step, vocab[left], vocab[right], vocab[left + right])

        symbols = byte_symbols()
        self.steps: dict[int, int] = {}  # node << 8 | byte -> node of the label trie
        self.inner, self.final = [None], [None]  # label read at a node, inside and at the end of a word
        self.width = [0] * len(self.labels)
        above = [0]  # node << 8 | byte that leads to a node
        for token, at in vocab.items():
            final = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if final else token
            if not body or any(c not in symbols for c in body) or not (len(body) == 1 or at in self.born):
                continue
            node = 0
            for c in body:
                step = node << 8 | symbols[c]
                node = self.steps.setdefault(step, len(self.inner))
                if node == len(self.inner):
                    self.inner.append(None)
                    self.final.append(None)
                    above.append(step)
            (self.final if final else self.inner)[node] = at
            self.width[at] = len(body)
        if not self.suffix:
            raise ValueError("the vocabulary marks no word ends")
        self.above = above
        self.shorter: dict[int, int] = {0: 0}  # node -> the longest proper end of it that is a node
        self.reads: dict[int, int] = {}  # filled cells: node << 8 | byte -> node
        self.ending: dict[int, tuple] = {}  # node -> labels inside a word that end here, longest first
        self.closing: dict[int, tuple] = {}  # node -> labels at the end of a word that end here

    def _gadget(self, step: int, left: int, right: int, token: int) -> None:
        if token in self.born or not self._has_arc(left, right, step - 1):
            return  # no path reads left and right in a row, so the rule never fires
        self.lost.setdefault(left, {})[right] = step
        self.born[token], self.copy_of[token], self.beside[token] = step, right, left

    def _has_arc(self, state: int, arc: int, step: int) -> bool:
        """Whether ``state`` has ``arc`` after ``step``: neither the arc nor those it
        was added beside had been lost when they were needed."""
        while True:
            at, until = state, step
            while at is not None:  # the state's own losses, then those it was copied with
                lost = self.lost.get(at, {}).get(arc)
                if lost is not None and lost <= until:
                    return False
                until = min(until, self.born.get(at, 0) - 1)
                at = self.copy_of.get(at)
            if arc not in self.born:
                return True
            step, arc = min(step, self.born[arc]), self.beside[arc]

    def follows(self, state: int, arc: int) -> bool:
        """One cell of the transition table."""
        if state == START:
            return True
        key = state << 20 | arc
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CELLS_KEPT:
                self.table.clear()
            known = self.table[key] = self._has_arc(state, arc, FOREVER)
        return known

    def _shorter(self, node: int) -> int:
        chain = []
        while node not in self.shorter:
            chain.append(node)
            node = self.above[node] >> 8
        for node in reversed(chain):
            parent, byte = self.above[node] >> 8, self.above[node] & 255
            self.shorter[node] = self._read(self.shorter[parent], byte) if parent else 0
        return self.shorter[chain[0]] if chain else self.shorter[node]

    def _read(self, node: int, byte: int) -> int:
        """The node after another byte: the longest end of what was read that is one."""
        while True:
            to = self.steps.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self._shorter(node)

    def _arcs(self, node: int, at_end: bool) -> tuple:
        """(label, width) of the labels that end at ``node``, longest first."""
        held, labels = (self.closing, self.final) if at_end else (self.ending, self.inner)
        out, at = [], node
        while at:
            if labels[at] is not None:
                out.append((labels[at], self.width[labels[at]]))
            at = self._shorter(at)
        held[node] = tuple(out)
        return held[node]

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word, by one pass over its bytes."""
        last = len(word)
        if not last:
            return []
        reads, table, follows = self.reads, self.table, self.follows
        arcs, node, held = [START], 0, self.ending
        if len(reads) >= CELLS_KEPT:
            reads.clear()
        for at, byte in enumerate(word, 1):
            cell = node << 8 | byte
            to = reads.get(cell)
            if to is None:
                to = reads[cell] = self._read(node, byte)
            node = to
            if at == last:
                held = self.closing
            found = held.get(node)
            if found is None:
                found = self._arcs(node, at == last)
            for arc, width in found:
                before = arcs[at - width]
                if before is None:
                    continue
                if before != START:
                    known = table.get(before << 20 | arc)
                    if not (follows(before, arc) if known is None else known):
                        continue
                arcs.append(arc)
                break
            else:
                arcs.append(None)
        if arcs[last] is None:
            raise ValueError(f"no path for {word!r}")
        path = []
        while last:
            path.append(arcs[last])
            last -= self.width[arcs[last]]
        return path[::-1]

    def decode(self, ids) -> str:
        """The labels of the arcs with these ids, blank between them, as the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


class WordSplitter:
    """Cuts a text into the words that the vocabulary's merges apply to.

    Text is first cut at ASCII white space, which no word spans. Latin text takes the
    rules spelt out below; for other scripts the library's own normalizer and splitter
    are asked, so that both agree on every code point.
    """

    _pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(definition)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.bytes_of = byte_symbols()

    def split(self, text: str) -> list[bytes]:
        if text.isascii() and text.isprintable() or all(0x20 < ord(c) < 0x7F or c in "áâäàçéèêëíïîñóôöúûùüßœÁÂÄÀÇÉÈÊËÍÏÎÑÓÔÖÚÛÙÜ" for c in text):
            return [p.encode() for p in self._pieces.findall(text.lower())]
        if text.isascii() and not text.strip():
            return []
        plain = self.normalizer.normalize_str(text)
        return [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.splitter.pre_tokenize_str(plain)]


class Codec:
    """Texts to ids and back, with a table of the words seen lately."""

    def __init__(self, definition: str):
        self.automaton = MergeAutomaton(definition)
        self.splitter = WordSplitter(definition)
        self.special = [t.encode() for t in self.automaton.special]
        self.new, self.old = {}, {}  # word -> ids, in two generations
        self.pieces = Recent(PIECES_KEPT)
        # What the vocabulary does anyway, and what makes fewer words to know: ASCII in
        # lower case, and a last stop or comma as a word of its own.
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lower = self.splitter.normalizer.normalize_str(upper) == upper.lower()
        self.stops = all(self.splitter.split(f"ab{a}{b}") == [*self.splitter.split(f"ab{a}"), b.encode()] for a in "z9" for b in ".,")

    def _ids(self, word: bytes) -> bytes:
        """Ids of a word that is not known."""
        if self.stops and len(word) > 1 and word[-1] in b".," and word[-2:-1].isalnum():
            return self._known(word[:-1]) + self._known(word[-1:])
        ids = array("I")
        text = word.decode("utf-8", "replace")
        special = self.automaton.special
        parts = self.automaton._special.split(text) if special and "<" in text else [text]
        for part in parts:
            if part in special:
                ids.append(special[part])
                continue
            for piece in self.splitter.split(part) if part else ():
                known = self.pieces.get(piece)
                if known is None:
                    known = array("I", self.automaton.encode_word(piece))
                    if len(piece) <= LONG_WORD:
                        self.pieces[piece] = known
                ids.extend(known)
        return ids.tobytes()

    def _known(self, word: bytes) -> bytes:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._ids(word)
                if len(word) > LONG_WORD:
                    return ids
            if len(self.new) >= WORDS_KEPT:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.lower and not any(t in text for t in self.special):
            text = text.lower()
        words = text.split()
        table = self.new
        try:
            return b"".join([table[w] for w in words])
        except KeyError:
            return b"".join(map(self._known, words))

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def _codec(definition: str) -> Codec:
    return Codec(definition)


def read_definition(path: str) -> str:
    """The vocabulary file, read on the driver; it travels with the plan, so executors
    need no copy. Its size is fixed by the vocabulary, not by the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit ids) and ``n_tokens``.

    ``path`` is a ``tokenizers`` BPE file with an end-of-word suffix. Whole texts are
    encoded without special tokens, truncation or padding; null and empty texts have no
    ids; rows, repeated ones too, are kept as they are; columns named like the new ones
    are replaced.
    """
    docs = docs.drop(ids, "n_tokens")
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        codec = _codec(definition.value)
        for batch in batches:
            out = [codec.encode(t) for t in string_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary()), pa.array([len(o) // 4 for o in out], pa.int64())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the arc labels of ``ids`` (null ids give the empty text)."""
    tokens = tokens.drop(decoded)
    definition = tokens.sparkSession.sparkContext.broadcast(read_definition(path))
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded, T.StringType())])
    at = tokens.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        codec = _codec(definition.value)
        for batch in batches:
            out = [codec.decode(v or b"") for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return tokens.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows; without ``keep_text`` the text
    does not come back from the Python workers."""
    docs = docs.drop(ids, "n_tokens", decoded)
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    kept = [i for i, f in enumerate(docs.schema.fields) if keep_text or f.name != text]
    added = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField(decoded, T.StringType())]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *added])
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        codec = _codec(definition.value)
        for batch in batches:
            out = [codec.encode(t) for t in string_bytes(batch.column(at))]
            columns = [batch.column(i) for i in kept]
            columns += [pa.array(out, pa.binary()), pa.array([len(o) // 4 for o in out], pa.int64()), pa.array(map(codec.decode, out), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; one row of digests per document."""
    coded = encode_decode(docs.select("doc_id", "text"), path, keep_text=False)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
