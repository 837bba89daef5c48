"""Token ids on disk: a concatenated id array with Elias-Fano coded document bounds.

A *segment* holds consecutive documents. Its bytes, all numbers little-endian, are

    8  magic ``CCEF0001``
    8  number of documents n
    8  number of ids u
    1  number of low bits l, 1 width of an id in bytes (2 or 4), 6 zero
    …  low parts of the n + 1 bounds, l bits each, packed, filled up to 8 bytes
    …  high parts, bit (bound >> l) + i set for the i-th bound, filled up to 8 bytes
    …  the u ids

A bound is the number of ids before a document, the last one u; the i-th is found by a
*select* of the i-th set bit. That takes about 2 + log2(u / n) bits for each document
instead of 64. Segments lie in a Parquet table, one row each, with the number of the
part, the number in the part, the first and last document id, and ``doc_ids``: the number
of leading documents with a null id (8 bytes), then of the others the first id (8 bytes),
the width of a difference (1 byte) and the differences, as ids ascend.
"""

from __future__ import annotations

import re
import string
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.llm.common import partitions, string_bytes
from cellclock.session import scratch_path

MAGIC = b"CCEF0001"
SEGMENT_IDS = 1 << 21  # ids after which a segment is closed
WORDS_KEPT = 400_000  # entries of a generation of the per-process word table
NEW_WORDS = 20_000  # words given to the library at a time
LONG_WORD = 64  # bytes of a word that is not worth keeping
MARKS = string.punctuation.replace("'", "")  # an apostrophe may begin a piece of letters
LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
LETTERS = string.ascii_lowercase + LATIN + "œŒ"
ONLY_LETTERS = re.compile(f"[{LETTERS}]+")

SEGMENT = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("doc_ids", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
ENTRY = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


class EliasFano:
    """A non-decreasing sequence of n + 1 bounds, read by select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        import numpy as np

        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        # rank directory: set bits before each block of 64 bytes
        ones = np.bitwise_count(self.high).astype(np.int64)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), 64)) if len(ones) else ones
        self.before = np.concatenate([[0], np.cumsum(blocks)])

    @staticmethod
    def coded(bounds) -> tuple[int, bytes, bytes]:
        """Number of low bits, low part and high part of the bounds."""
        import numpy as np

        n, u = len(bounds), int(bounds[-1])
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        values = np.asarray(bounds, np.uint64)
        bits = (values[:, None] >> shifts & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        high = np.zeros((u >> low_bits) + n + 1, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return low_bits, _padded(low), _padded(np.packbits(high, bitorder="little").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        end = at + self.low_bits
        word = int.from_bytes(self.low[at >> 3 : (end + 7) >> 3].tobytes(), "little")
        return word >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th bound: block from the directory, then the bit inside the block."""
        import numpy as np

        block = int(np.searchsorted(self.before, i, "right")) - 1
        rest = i - int(self.before[block])
        bits = np.flatnonzero(np.unpackbits(self.high[block * 64 : block * 64 + 64], bitorder="little"))
        at = block * 512 + int(bits[rest])
        return (at - i) << self.low_bits | self._low(i)

    def select_all(self, first: int, last: int):
        """The bounds first to last - 1, by a select in each block of the directory."""
        import numpy as np

        out, at = np.empty(last - first, np.int64), first
        while at < last:
            block = int(np.searchsorted(self.before, at, "right")) - 1
            until = min(last, int(self.before[block + 1]))
            bits = np.flatnonzero(np.unpackbits(self.high[block * 64 : block * 64 + 64], bitorder="little"))
            own = bits[at - int(self.before[block]) : until - int(self.before[block])] + block * 512
            out[at - first : until - first] = (own - np.arange(at, until)) << self.low_bits
            at = until
        if self.low_bits:
            start, end = first * self.low_bits, last * self.low_bits
            bits = np.unpackbits(self.low[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start]
            out |= (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out


def pack_ids(doc_ids: list) -> bytes:
    """Ascending document ids, nulls first."""
    import numpy as np

    nulls = sum(i is None for i in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64).view(np.uint64)
    steps = np.diff(known)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << 8 * w)
    first = known[:1].tobytes() or bytes(8)
    return nulls.to_bytes(8, "little") + first + bytes([width]) + steps.astype(f"<u{width}").tobytes()


def unpack_ids(data: bytes, n: int):
    """(number of nulls, ids of the others) of ``n`` documents."""
    import numpy as np

    nulls, width = int.from_bytes(data[:8], "little"), data[16]
    if nulls == n:
        return nulls, np.empty(0, np.int64)
    steps = np.frombuffer(data, f"<u{width}", n - nulls - 1, 17).astype(np.uint64)
    return nulls, np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 8), steps]), dtype=np.uint64).view(np.int64)


def pack(documents: list[bytes], width: int) -> bytes:
    """A segment of documents given as little-endian ids of ``width`` bytes."""
    import numpy as np

    lengths = np.fromiter((len(d) // width for d in documents), np.int64, len(documents))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    low_bits, low, high = EliasFano.coded(bounds)
    head = MAGIC + len(documents).to_bytes(8, "little") + int(bounds[-1]).to_bytes(8, "little") + bytes([low_bits, width]) + bytes(6)
    return b"".join([head, low, high, *documents])


class Segment:
    """A packed segment, opened for reading."""

    def __init__(self, payload: bytes):
        import numpy as np

        if payload[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_ids = (int.from_bytes(payload[i : i + 8], "little") for i in (8, 16))
        low_bits, width = payload[24], payload[25]
        low_size = -(-(self.n_docs + 1) * low_bits // 8)
        high_at = 32 + low_size + -low_size % 8
        high_size = -(-((self.n_ids >> low_bits) + self.n_docs + 2) // 8)
        ids_at = high_at + high_size + -high_size % 8
        self.bounds = EliasFano(self.n_docs + 1, low_bits, payload[32:high_at], payload[high_at:ids_at])
        self.ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", self.n_ids, ids_at)

    def document(self, i: int):
        """Ids of one document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class LibraryEncoder:
    """Texts to ids with the ``tokenizers`` library, which sees each word once.

    With a vocabulary of words, texts are cut at ASCII white space, which no token spans
    and no rule of the normalizer looks across, and before punctuation that follows a
    letter or digit. Arrow cuts a batch, finds its different words and gathers their ids,
    so only different words become Python objects. New words of Latin letters alone go to
    the library's model, all others whole to the library.
    """

    def __init__(self, definition: str):
        import numpy as np
        from tokenizers import Tokenizer

        from cellclock.llm.bpe_automaton import byte_symbols

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = {byte: symbol for symbol, byte in byte_symbols().items()}
        self.known: dict[bytes, bytes] = {}  # word -> ids, in two generations
        self.older: dict[bytes, bytes] = {}
        self.kind = np.zeros(256, np.uint8)  # 1 letter or digit, 2 part of a longer character, 4 punctuation
        self.kind[list((string.ascii_letters + string.digits).encode())] = 1
        self.kind[128:] = 2
        self.kind[list(MARKS.encode())] = 4
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        # Whether white space ends every token, as in word vocabularies; else texts go whole.
        self.by_word = ids("ab c\n d") == ids("ab") + ids("c") + ids("d")
        # Whether these texts are the same to the library, as they are to word vocabularies.
        self.lower = ids("Ab9") == ids("ab9") and all(
            ids(a + m + b) == ids(a) + ids(m + b) for a in ("ab", "b9", "é", "ß") for m in MARKS for b in ("", "s", "'s", ".", "9")
        )
        # Whether a word of letters is one piece, its bytes as symbols in lower case.
        self.letters = self.by_word and self.lower and all(map(self._is_piece, (LETTERS, LETTERS[::-1], *LETTERS)))

    def _symbols(self, letters: str) -> str:
        return letters if letters.isascii() else letters.lower().encode().decode("latin-1").translate(self.symbols)

    def _is_piece(self, word: str) -> bool:
        normalizer, splitter = self.library.normalizer, self.library.pre_tokenizer
        if normalizer is None or splitter is None:
            return False
        return [p for p, _ in splitter.pre_tokenize_str(normalizer.normalize_str(word))] == [self._symbols(word)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            got = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(g.ids, f"<u{self.width}").tobytes() for g in got]
        cut = pc.ascii_split_whitespace(self._separated(texts))
        places = cut.values.dictionary_encode()
        if not len(places):
            return [b""] * len(texts)
        listed = pa.ListArray.from_arrays(pa.array([0, len(places.dictionary)], pa.int32()), places.dictionary)
        words = pc.binary_join(listed, pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes().split(b" ")
        coded = pa.array(self._ids(words), pa.large_binary()).take(places.indices)
        _, bounds, data = coded.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(coded) + 1)[cut.offsets.to_numpy()].tolist()
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _separated(self, texts: list[bytes]):
        """The texts as an Arrow array, each after a blank; but for those with special
        tokens in lower case, which the vocabulary makes anyway, and with a blank before
        punctuation. That leaves far fewer different words."""
        import numpy as np
        import pyarrow as pa

        whole = np.zeros(len(texts), bool)
        if self.lower:
            lowered = [t.lower() for t in texts]
            whole[:] = [any(s in t for s in self.special) for t in lowered]
            texts = [t if w else low for t, low, w in zip(texts, lowered, whole.tolist())]
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
        data = b" ".join([b"", *texts])
        if self.lower:
            chars = np.frombuffer(data, np.uint8)
            kind = self.kind[chars]
            at = np.flatnonzero((kind[1:] == 4) & (kind[:-1] & 3 > 0)) + 1
            # Of longer characters only the letters of LATIN: 0xC3 and any but these two.
            last = chars[at - 1]
            at = at[(last < 128) | (chars[at - 2] == 0xC3) & (last != 0x97) & (last != 0xB7)]
            if whole.any():
                at = at[~whole[np.searchsorted(starts, at, "right") - 1]]
            kept = np.ones(len(chars) + len(at), bool)
            kept[at + np.arange(len(at))] = False
            spaced = np.full(len(kept), 32, np.uint8)
            spaced[kept] = chars
            data, starts = spaced, starts + np.searchsorted(at, starts)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(data))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) >= WORDS_KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        new = []
        for at in [at for at, ids in enumerate(out) if ids is None]:
            ids = older.get(words[at])
            if ids is None:
                new.append(at)
            else:
                out[at] = known[words[at]] = ids
        asked = [words[at] for at in new]
        for at, w, ids in zip(new, asked, self._asked(asked)):
            out[at] = ids
            if len(w) <= LONG_WORD:
                known[w] = ids
        return out

    def _asked(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are not known."""
        import numpy as np

        out, plain, rest, ids, bounds = [b""] * len(words), [], [], [], [0]
        for at, w in enumerate(words):
            text = w.decode("utf-8", "replace")
            if self.letters and ONLY_LETTERS.fullmatch(text):
                plain.append(at)
                ids += [t.id for t in self.model.tokenize(self._symbols(text))]
                bounds.append(len(ids) * self.width)
            else:
                rest.append((at, text))
        data = np.array(ids, f"<u{self.width}").tobytes()
        for at, a, b in zip(plain, bounds[:-1], bounds[1:]):
            out[at] = data[a:b]
        for first in range(0, len(rest), NEW_WORDS):
            some = rest[first : first + NEW_WORDS]
            got = self.library.encode([text for _, text in some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, f"<u{self.width}")
            owner = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
            if len(owner) and owner.min() < 0:  # special tokens have no word: one by one
                for at, text in some:
                    one = self.library.encode(text, add_special_tokens=False)
                    out[at] = np.array(one.ids, f"<u{self.width}").tobytes()
                continue
            bounds = (np.searchsorted(owner, np.arange(len(some) + 1)) * self.width).tolist()
            data = ids.tobytes()
            for (at, _), a, b in zip(some, bounds[:-1], bounds[1:]):
                out[at] = data[a:b]
        return out


@lru_cache(maxsize=2)
def _encoder(definition: str) -> LibraryEncoder:
    return LibraryEncoder(definition)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write segments below ``out`` in ascending
    doc_id order; ``end_id`` closes every document.

    Null and empty texts become documents of the end id alone. Null ids come first.
    Repeated ids are kept, in the order of a hash of their texts. An empty table gives
    no segments. Tasks stream: they hold one segment at a time, whatever a part's size.
    """
    from cellclock.llm.bpe_automaton import read_definition

    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(path))
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(parts or partitions(spark), "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(definition.value)
        end = end_id.to_bytes(encoder.width, "little")
        documents, ids, size, seq, part = [], [], 0, 0, None

        def segment():
            known = [i for i in (ids[-1], next((i for i in ids if i is not None), None)) if i is not None]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([len(documents)], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([known[-1] if known else None], pa.int64()),
                    pa.array([known[0] if known else None], pa.int64()),
                    pa.array([pack_ids(ids)], pa.binary()),
                    pa.array([pack(documents, encoder.width)], pa.binary()),
                ],
                names=SEGMENT.names,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for doc_id, coded in zip(batch.column(1).to_pylist(), encoder.encode(string_bytes(batch.column(2)))):
                documents.append(coded + end)
                ids.append(doc_id)
                size += len(documents[-1]) // encoder.width
                if size >= SEGMENT_IDS:
                    yield segment()
                    documents, ids, size, seq = [], [], 0, seq + 1
        if documents:
            yield segment()

    ordered.mapInArrow(run, SEGMENT).write.option("compression", "zstd").parquet(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """One row per document of the files below ``out``: doc_id, start (ids before it in
    all files), n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers)."""
    segments = spark.read.schema(SEGMENT).parquet(out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, seq, keys, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
                segment = Segment(payload)
                n = segment.n_docs
                bounds = segment.bounds.select_all(0, n + 1)
                wide = segment.ids.astype("<u4")
                nulls, known = unpack_ids(keys, n)
                doc_ids = np.concatenate([np.zeros(nulls, np.int64), known])
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([seq] * n, pa.int32()),
                        pa.array(doc_ids, pa.int64(), mask=np.arange(n) < nulls),
                        pa.array(bounds[:-1], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=ENTRY.names,
                )

    entries = segments.select("part", "seq", "doc_ids", "payload").mapInArrow(run, ENTRY)
    # Sizes of segments, a few numbers for two million ids each, added up in two steps:
    # parts first, then the segments inside a part.
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    whole = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.select("part", "seq", inside.alias("_inside")).join(whole, "part").select("part", "seq", (F.col("_part_start") + F.col("_inside")).alias("_start"))
    return entries.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_documents(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents of a short list, null for a null id.

    Only segments whose range of ids holds one of them are opened; there a document is two
    selects away. Repeated ids give a row for each document; unknown ids give none."""
    wanted = sorted({i for i in doc_ids if i is not None})
    null_too = len(wanted) < len(set(doc_ids))
    in_range = F.lit(False)
    for i in wanted:
        in_range |= (F.col("first_id") <= i) & (F.col("last_id") >= i)
    has_null = F.hex(F.substring("doc_ids", 1, 8)) != "0" * 16
    may_hold = in_range | has_null if null_too else in_range
    segments = spark.read.schema(SEGMENT).parquet(out).where(may_hold).select("n_docs", "doc_ids", "payload")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n, keys, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                segment = Segment(payload)
                nulls, known = unpack_ids(keys, n)
                at = [nulls + int(i) for i in np.flatnonzero(np.isin(known, wanted))]
                at = [*range(nulls), *at] if null_too else at
                names = [None if i < nulls else int(known[i - nulls]) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([segment.document(i).astype("<u4").tobytes() for i in at], pa.binary())], names=["doc_id", "ids"]
                )

    return segments.mapInArrow(run, "doc_id long, ids binary")


def token_file_digests(docs: DataFrame, path: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, out, end_id, parts)
    return read_token_files(docs.sparkSession, out)
