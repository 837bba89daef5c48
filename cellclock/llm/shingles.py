"""Word shingles and their min-wise signatures, computed for whole batches with numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A shingle is five
words in a row; a text of fewer words is one shingle, a text without words has none.
Shingles stand for themselves as 64-bit hashes: two different ones of one pair of texts
meet with a chance of about (sizes of both)^2 / 2^64.
"""

from __future__ import annotations

from functools import lru_cache

WIDTH = 5
CHUNK = 1 << 19  # bytes hashed at a time
SEED = 20_240_229


@lru_cache(maxsize=1)
def _tables():
    """Byte values, powers and inverse powers of the word hash."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    values = rng.integers(1, 1 << 64, 256, np.uint64)
    values[65:91] = values[97:123]
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    values[~inside] = 0
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = 2 * CHUNK + 2

    def powers(x):
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(x)
        return np.multiply.accumulate(out)

    steps = rng.integers(0, 1 << 64, WIDTH + 1, np.uint64) | np.uint64(1)
    return values, inside, powers(base), powers(inverse), steps


def mixed(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts):
    """Runs of (document, bytes) of about CHUNK bytes; long texts are cut at white space."""
    run, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > CHUNK:
                end = at + CHUNK
                tail = text[at:end]
                cut = max(tail.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut >= 0:
                    end = at + cut + 1
                else:  # one huge word: up to where it ends
                    ahead = [p for p in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                    end = min(ahead, default=len(text))
            if size and size + end - at > CHUNK:
                yield run
                run, size = [], 0
            run.append((i, text[at:end]))
            size += end - at + 1
            if end >= len(text):
                break
            at = end
    if run:
        yield run


def word_hashes(texts: list[bytes]):
    """(hashes, bounds): hashes of the words of all texts; the words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``."""
    import numpy as np

    values, inside, up, down, _ = _tables()
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for run in _pieces(texts):
        data = np.frombuffer(b" " + b" ".join(p for _, p in run) + b" ", np.uint8)
        if len(data) > len(up):  # a single word beyond the tables
            n = len(data)
            grow = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x[1], np.uint64)]))
            up_, down_ = grow(up), grow(down)
        else:
            up_, down_ = up, down
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up_[: len(data)], out=sums[1:])
        edges = np.flatnonzero(np.diff(inside[data].view(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        hashes.append(mixed((sums[ends] - sums[starts]) * down_[starts]))
        lengths = np.array([len(p) + 1 for _, p in run], np.int64)
        owner = np.searchsorted(np.cumsum(lengths), starts - 1, "right")
        np.add.at(counts, np.array([i for i, _ in run])[owner], 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), bounds


def shingle_sets(texts: list[bytes]) -> list:
    """Sorted distinct shingle hashes of every text."""
    import numpy as np

    steps = _tables()[4]
    words, bounds = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        rolled += words[j : n - WIDTH + 1 + j] * steps[j] if n >= WIDTH else np.uint64(0)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(rolled[a : b - WIDTH + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            few = np.append(words[a:b] * steps[: b - a], steps[WIDTH:] * np.uint64(b - a))
            out.append(mixed(few.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_hashes(sets: list):
    """Two 64-bit hashes of every shingle set."""
    import numpy as np

    once = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    twice = np.array([mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return once.tolist(), twice.tolist()


class MinHash:
    """Signatures by many universal hash functions x -> a x + b on 32-bit words."""

    def __init__(self, permutations: int, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, permutations, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, permutations, np.uint32)[:, None]

    def signature(self, shingles):
        """The minimum of every hash function; all ones for an empty set."""
        import numpy as np

        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            block = self.a * short[None, at : at + 2048]
            block += self.b
            np.minimum(least, block.min(axis=1), out=least)
        return least


def band_keys(signatures, bands: int, rows: int):
    """One 64-bit key for each signature and band of ``rows`` minima; the band's number
    is part of the key. ``signatures`` has a row for each text."""
    import numpy as np

    parts = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        keys = mixed(keys ^ parts[:, :, j])
    return keys.view(np.int64)
