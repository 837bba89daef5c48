"""Alignment of two tokenizers by inverted pair bitmaps.

A text is encoded by tokenizer A (a byte-level BPE file) and tokenizer B (a SentencePiece
model with byte fallback); both give a partition of the bytes of space+text. An A and a B
token are linked where their byte ranges overlap; offsets where both have an end cut the
tokens into groups.

Which documents hold a pair of ids is kept as an inverted index. Documents are numbered in
*blocks*; the posting of a pair in a block is a set of compressed bitmaps over the block's
documents, one for each bit of the pair's multiplicity in a document (*planes*): an OR of
the planes popcounts to the number of documents, and the planes' popcounts, weighted by
their powers of two, to the number of links. Counts are added up over blocks by Spark.
Scores go back the same way: each posting, joined with the count of its pair, hands it to
the documents that its bitmaps name.

Neither tokenizer has a token that continues over a space which follows a character other
than white space, so a text falls apart at such spaces into *segments* that are encoded
independently, and segments seen lately are not encoded again. The vocabularies are
checked for this property; where one lacks it, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import Recent, partitions, written

BLOCK_DOCS = 1 << 15  # documents of a block at most
BLOCK_POSTINGS = 2_000_000  # document-pair entries after which a block is closed
SEGMENTS_KEPT = 150_000
NEW_SEGMENTS = 20_000  # segments that are encoded at a time
LONG_SEGMENT = 64  # characters of a segment that is not worth keeping
PAIR = 1 << 32  # a pair is A's id times this, plus B's id

# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in plain):
        table[chr(256 + n)] = b
    return table


class Aligner:
    """Both tokenizers and the table of known segments."""

    def __init__(self, definition_a: str, model_b: bytes):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        symbols = byte_symbols()
        self.bytes_a = {i: bytes(map(symbols.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_b = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:-1], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.bytes_b[i] = piece.replace("▁", " ").encode()
        self.width_a, self.width_b = (
            np.array([len(t.get(i, b"")) for i in range(1 + max(t))], np.int64) for t in (self.bytes_a, self.bytes_b)
        )
        # What a token's id becomes in a text of groups, inside a list and at its end.
        self.shown_a = [f"{i}{c}" for i in range(len(self.width_a)) for c in ",|"]
        self.shown_b = [f"{i}{c}" for i in range(len(self.width_b)) for c in ",;"]
        self.short = self._short_encoder(json.loads(definition_a)["model"])
        inside = lambda t: any(not t[:i].decode("utf-8", "replace")[-1].isspace() for i in range(1, len(t)) if t[i] == 32)
        probe = self.segments_of(" ab  c\n d ef ")
        self.cut = (
            not any(map(inside, (*self.bytes_a.values(), *self.bytes_b.values())))
            and self._ids_a(["".join(probe)])[0] == sum(self._ids_a(probe), [])
            and self._ids_b(["".join(probe)])[0] == sum(self._ids_b(probe), [])
        )
        self.known = Recent(SEGMENTS_KEPT)

    def _short_encoder(self, model: dict):
        """The same vocabulary in a library that is quicker with short texts, or None where
        ids do not ascend with the order of the merges, which that library goes by."""
        import tiktoken

        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made) or any(len(self.bytes_a[i]) > 1 for i in self.bytes_a.keys() - set(made)):
            return None
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={})

    def _ids_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]

    def _ids_b(self, segments: list[str]) -> list[list[int]]:
        # the tokenizer puts the first space itself
        return self.b.encode([s[1:] for s in segments], num_threads=1)

    @staticmethod
    def segments_of(text: str) -> list[str]:
        """A text cut before each space that follows no white space; spaces at the end stay
        with what they follow."""
        if text[-1] == " " or _RUN.search(text):
            return _CUT.split(text)
        first, *words = text.split(" ")
        return [first, *(" " + w for w in words)] if first else [" " + w for w in words]

    def segments(self, text: str) -> list[str]:
        """Pieces of space+text that are encoded on their own."""
        return self.segments_of(" " + text) if self.cut else [" " + text]

    def learn(self, segments: list[str]) -> list[tuple]:
        """(n_a + n_b * PAIR, groups as text, linked pairs) of each segment; () where the
        tokens' bytes are not those of the segment.

        Links are the pieces that all ends of both tokenizers cut a segment into: each piece
        is the overlap of one A and one B token."""
        import numpy as np

        if self.short is not None:
            # letters of other scripts are left to the library, whose tables define them
            short = [len(s) <= LONG_SEGMENT and max(s) < "\u0250" for s in segments]
            rest = iter(self._ids_a([s for s, own in zip(segments, short) if not own]))
            of_a = [self.short.encode_ordinary(s) if own else next(rest) for s, own in zip(segments, short)]
        else:
            of_a = self._ids_a(segments)
        of_b = self._ids_b(segments)
        data = [s.encode() for s in segments]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (of_a, of_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(segments)) for ids in (of_a, of_b))
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        until = np.cumsum(np.fromiter(map(len, data), np.int64, len(segments)))
        whole = b"".join(data)
        good = n_a.all() and n_b.all() and (ends_a[np.cumsum(n_a) - 1] == until).all() and (ends_b[np.cumsum(n_b) - 1] == until).all()
        if not good or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            if len(segments) == 1:
                return [()]
            half = len(segments) // 2
            return self.learn(segments[:half]) + self.learn(segments[half:])

        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] * PAIR + b[np.searchsorted(ends_b, ends)]
        pair_until = np.searchsorted(ends, until, "right").tolist()
        # Tokens in the order in which groups are written, with what follows each.
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        order = np.argsort(group, kind="stable")
        last_a, last_b = np.isin(ends_a, common), np.isin(ends_b, common)
        shown = [*map(self.shown_a.__getitem__, (2 * a + last_a).tolist()), *map(self.shown_b.__getitem__, (2 * b + last_b).tolist())]
        shown = [shown[i] for i in order.tolist()]
        shown_until = np.cumsum(n_a + n_b).tolist()
        raw, out, i, j = pairs.astype("<i8").tobytes(), [], 0, 0
        for counts, p, t in zip((n_a + n_b * PAIR).tolist(), pair_until, shown_until):
            out.append((counts, "".join(shown[j:t])[:-1].encode(), raw[8 * i : 8 * p]))
            i, j = p, t
        return out

    def align(self, texts: list[str]) -> list:
        """For each text (n_a, n_b, n_groups, groups, array of linked pairs with repeats),
        or None where it has no tokens."""
        import numpy as np

        cut = [self.segments(t) if t else [] for t in texts]
        found = {s: self.known.get(s) for s in set().union(*cut)}
        missing = [s for s, a in found.items() if a is None]
        for at in range(0, len(missing), NEW_SEGMENTS):
            some = missing[at : at + NEW_SEGMENTS]
            for s, a in zip(some, self.learn(some)):
                found[s] = a
                if len(s) <= LONG_SEGMENT:
                    self.known[s] = a
        out = []
        for segments in cut:
            parts = [found[s] for s in segments]
            if not parts or () in parts:
                out.append(None)
                continue
            n_b, n_a = divmod(sum([p[0] for p in parts]), PAIR)
            linked = np.frombuffer(b"".join([p[2] for p in parts]), "<i8")
            out.append((n_a, n_b, n_a + n_b - len(linked), b";".join([p[1] for p in parts]), linked))
        return out


def _packed(slots, size: int) -> bytes:
    """A set of ascending document numbers of a block, in the smallest of three forms:
    a list of 16-bit numbers, runs (first, length - 1), or a bitmap."""
    import numpy as np

    breaks = np.flatnonzero(np.diff(slots) != 1)
    runs = 1 + len(breaks)
    bitmap = -(-size // 8)
    if min(2 * len(slots), 4 * runs) >= bitmap:
        bits = np.zeros(8 * bitmap, np.uint8)
        bits[slots] = 1
        return b"B" + np.packbits(bits, bitorder="little").tobytes()
    if 4 * runs < 2 * len(slots):
        first = slots[np.concatenate([[0], breaks + 1])]
        last = slots[np.concatenate([breaks, [len(slots) - 1]])]
        return b"R" + np.stack([first, last - first], 1).astype("<u2").tobytes()
    return b"L" + slots.astype("<u2").tobytes()


def _unpacked(data: bytes):
    """The document numbers that ``_packed`` was given."""
    import numpy as np

    kind, body = data[:1], data[1:]
    if kind == b"L":
        return np.frombuffer(body, "<u2").astype(np.int64)
    if kind == b"R":
        first, more = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64).T
        starts = np.cumsum(more + 1) - (more + 1)
        return np.repeat(first - starts, more + 1) + np.arange(int((more + 1).sum()))
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))


class Block:
    """Postings of the documents that a task has read since the last block."""

    def __init__(self):
        self.docs, self.entries = 0, 0
        self.keys, self.counts = [], []

    def add(self, linked) -> int:
        """Take the next document with its linked pairs; gives its number in the block."""
        import numpy as np

        slot = self.docs
        self.docs += 1
        pairs, counts = np.unique(linked, return_counts=True)
        self.keys.append((pairs, np.full(len(pairs), slot, np.int64)))
        self.counts.append(counts)
        self.entries += len(pairs)
        return slot

    def full(self) -> bool:
        return self.docs >= BLOCK_DOCS or self.entries >= BLOCK_POSTINGS

    def postings(self):
        """(pair, documents, links, planes) of every pair, the documents OR-merged."""
        import numpy as np

        pairs = np.concatenate([k[0] for k in self.keys] or [np.empty(0, np.int64)])
        slots = np.concatenate([k[1] for k in self.keys] or [np.empty(0, np.int64)])
        counts = np.concatenate(self.counts or [np.empty(0, np.int64)])
        order = np.argsort(pairs, kind="stable")  # documents stay in ascending order
        pairs, slots, counts = pairs[order], slots[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(pairs)) if len(pairs) else starts
        links = np.add.reduceat(counts, starts) if len(pairs) else starts
        most = np.maximum.reduceat(counts, starts) if len(pairs) else starts
        short = slots.astype("<u2").tobytes()
        planes = []
        for a, b, m in zip(starts.tolist(), ends.tolist(), most.tolist()):
            if m == 1 and b - a <= 2:  # most pairs are rare: the list form at once
                planes.append([b"L" + short[2 * a : 2 * b]])
                continue
            own, times = slots[a:b], counts[a:b]
            planes.append([_packed(own[held], self.docs) if (held := times >> k & 1 == 1).any() else b"" for k in range(int(m).bit_length())])
        return pairs[starts], ends - starts, links, planes


def read_files(a_path: str, b_path: str) -> tuple[str, bytes]:
    """Both vocabularies, read on the driver; they travel with the plan."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


@lru_cache(maxsize=1)
def _aligner(definition_a: str, model_b: bytes) -> Aligner:
    return Aligner(definition_a, model_b)


ENTRY = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),  # 0: a document, 1: a posting
        T.StructField("doc_id", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pair", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("planes", T.ArrayType(T.BinaryType())),
    ]
)
DOCUMENT = ["doc_id", "block", "slot", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
POSTING = ["pair", "block", "n_docs", "n_links", "planes"]


def index(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of ``docs`` (doc_id, text), written to the shared folder.

    Each text is read once; a task's documents and postings go to the same table, so block
    numbers stay those of the attempt that was kept. Null and empty texts, and those whose
    tokens do not give their bytes back, have no tokens. Rows are kept as they are; rows
    that share a doc_id are documents of their own.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(read_files(a_path, b_path))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = _aligner(*files.value)
        part, blocks, block = TaskContext.get().partitionId(), 0, Block()
        arrow = pa.schema(
            [
                ("kind", pa.int32()), ("doc_id", pa.int64()), ("block", pa.int64()), ("slot", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n_docs", pa.int64()), ("planes", pa.list_(pa.binary())),
            ]
        )

        def rows(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def closed():
            pairs, n_docs, links, planes = block.postings()
            for at in range(0, len(pairs), 50_000):
                cut = slice(at, at + 50_000)
                yield rows(kind=[1] * len(pairs[cut]), block=[part << 32 | blocks] * len(pairs[cut]), pair=pairs[cut], n_docs=n_docs[cut], n_links=links[cut], planes=planes[cut])

        for batch in batches:
            ids, texts, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc_id, got in zip(ids, aligner.align(texts)):
                if got is None:
                    held.append((doc_id, None, None, 0, 0, 0, 0, ""))
                    continue
                n_a, n_b, n_groups, groups, linked = got
                held.append((doc_id, part << 32 | blocks, block.add(linked), n_a, n_b, n_groups, len(linked), hashlib.sha256(groups).hexdigest()))
                if block.full():
                    yield from closed()
                    blocks, block = blocks + 1, Block()
            if held:
                yield rows(kind=[0] * len(held), **dict(zip(DOCUMENT, zip(*held))))
        yield from closed()

    both = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENTRY), "alignment")
    return both.where("kind = 0").select(DOCUMENT), both.where("kind = 1").select(POSTING)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a_id, b_id, pair, n_docs, n_links, best) of every linked pair of ids.

    n_docs is how many documents hold the pair linked, n_links how many links there are;
    best marks the pairs with the most documents of their A id, ties included."""
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = counts.withColumn("a_id", F.shiftright("pair", 32).cast("int")).withColumn("b_id", F.col("pair").bitwiseAND(PAIR - 1).cast("int"))
    # one row for each token of A, so bounded by its vocabulary
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    held = counts.join(F.broadcast(most), "a_id")
    return held.select("a_id", "b_id", "pair", "n_docs", "n_links", (F.col("n_docs") == F.col("_most")).alias("best"))


def documents_of(documents: DataFrame, postings: DataFrame, wanted: Column) -> DataFrame:
    """(pair, doc_id, times) of every document that holds a pair for which ``wanted`` (a
    condition on a posting's columns) is true, read from its planes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for pair, block, planes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                slots = [_unpacked(p) if p else np.empty(0, np.int64) for p in planes]
                times = np.bincount(np.concatenate(slots), np.concatenate([np.full(len(s), 1 << k) for k, s in enumerate(slots)]))
                held = np.flatnonzero(times)
                columns = [pa.array(np.full(len(held), v), pa.int64()) for v in (pair, block)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.int32()), pa.array(times[held].astype(np.int64))], names=["pair", "block", "slot", "times"])

    found = postings.where(wanted).select("pair", "block", "planes").mapInArrow(run, "pair long, block long, slot int, times long")
    return found.join(documents.select("doc_id", "block", "slot"), ["block", "slot"]).select("pair", "doc_id", "times")


def returned(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, slot, n_best, count_sum) of every document with links.

    The count of a pair goes to the documents of its postings: n_best adds up the links of
    pairs that are best, count_sum the counts of all links. Tasks stream over the postings
    of one block after the other and hold two numbers for each of its documents."""
    # Counts are as many as pairs, which has no bound worth sending to all tasks: both sides
    # are shuffled at every size.
    scored = postings.select("pair", "block", "planes").join(counts.select("pair", F.col("n_docs").alias("count"), "best").hint("merge"), "pair")
    ordered = scored.repartition(partitions(postings.sparkSession), "block").sortWithinPartitions("block").select("block", "count", "best", "planes")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, best, total = None, None, None

        def block():
            held = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), now, np.int64)), pa.array(held.astype(np.int32)), pa.array(best[held]), pa.array(total[held])],
                names=["block", "slot", "n_best", "count_sum"],
            )

        for batch in batches:
            for at, count, is_best, planes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != now:
                    if now is not None:
                        yield block()
                    now, best, total = at, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                for k, plane in enumerate(planes):
                    if plane:
                        if len(plane) == 3:  # one document
                            slots = plane[1] | plane[2] << 8
                        else:
                            slots = _unpacked(plane)
                        total[slots] += count << k
                        if is_best:
                            best[slots] += 1 << k
        if now is not None:
            yield block()

    return ordered.mapInArrow(run, "block long, slot int, n_best long, count_sum long")


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Documents without tokens (see ``index``) have zeros and an empty digest; an empty
    table gives no rows; other columns of ``docs`` are not looked at."""
    documents, postings = index(docs, a_path, b_path)
    counts = written(pair_counts(postings), "pair-counts")
    back = returned(postings, counts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return documents.join(back, ["block", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
