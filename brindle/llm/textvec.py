"""Vectorised text primitives: code points, words and their hashes for whole batches.

A batch of strings is laid end to end as one array of code points, so that every
step below is a numpy pass over the batch and not a Python loop over characters.
A word is a maximal run of alphanumeric characters or underscores, compared in
lower case (by the one-to-one lower-case mapping of its characters).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZE = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit words."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark's bigint holds them."""
    return x.view(np.int64)


_tables: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    """lower: code point to its lower case; word, upper, digit, space: flags; mixed: 64 random bits of the lower case."""
    if not _tables:
        lower = np.arange(_SIZE, dtype=np.uint32)
        flags = {k: np.zeros(_SIZE, dtype=bool) for k in ("word", "alpha", "upper", "digit", "space")}
        for i in (*range(0xD800), *range(0xE000, 0x32000)):
            c = chr(i)
            if c.isalnum():
                flags["word"][i] = True
                flags["alpha"][i] = c.isalpha()
                flags["digit"][i] = c.isdigit()
                low = c.lower()
                if low != c:
                    flags["upper"][i] = True
                    if len(low) == 1:
                        lower[i] = ord(low)
            elif c.isspace():
                flags["space"][i] = True
        flags["word"][ord("_")] = True
        _tables.update(flags, lower=lower, mixed=mix(lower.astype(U64)))
    return _tables


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            steps = np.full((2, size), [[_BASE], [_INVERSE]], dtype=U64)
            steps[:, 0] = 1
            _powers[:] = np.cumprod(steps, axis=1, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of the batch that hold about `limit` characters, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        n = len(t) + 1
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)


class Chars:
    """Code points of some strings, each followed by a line feed that belongs to none."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=self.n)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        joined = "\n".join([*texts, ""])
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def flags(self, kind: str) -> np.ndarray:
        return tables()[kind][self.points]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The string that each of the ascending positions lies in."""
        cuts = np.searchsorted(positions, self.starts)
        return np.repeat(np.arange(self.n), np.diff(cuts))

    def prefix(self) -> np.ndarray:
        """Prefix sums of the mixed lower-case code points times the powers of the base."""
        up, _ = powers(len(self.points))
        out = np.empty(len(self.points) + 1, dtype=U64)
        out[0] = 0
        np.cumsum(tables()["mixed"][self.points] * up, out=out[1:])
        return out

    def span_hashes(self, begin: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the lower-case characters of each span [begin, end)."""
        prefix = self.prefix() if prefix is None else prefix
        _, down = powers(len(prefix))
        return mix((prefix[end] - prefix[begin]) * down[begin])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: the string it lies in, first and last position (exclusive) in the batch, hash."""
        flag = np.zeros(len(self.points) + 2, dtype=np.int8)
        flag[1:-1] = self.flags("word")
        step = np.diff(flag)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return self.doc_of(begin), begin, end, self.span_hashes(begin, end)


def shingles(doc: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of a string, and the string of each; a shorter string is one shingle."""
    n = len(words)
    if not n:
        return doc, words
    h = np.zeros(n, dtype=U64)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    length = np.diff(np.append(np.flatnonzero(first), n))
    left = np.repeat(np.append(np.flatnonzero(first)[1:], n), length) - np.arange(n)  # words from here to the end of the string
    for k in range(size):
        h[: n - k] += np.where(left[: n - k] > k, mix(words[k:] + U64(k)) * U64(2 * k + 1), U64(0)) if k else mix(words)
    keep = (left >= size) | first
    return doc[keep], mix(h[keep])


def counted(doc: np.ndarray, item: np.ndarray, bits: int = 44) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (string, item) in order, and how often each occurs; items are cut to their upper `bits` bits."""
    if not len(item):
        return doc, item, doc
    packed = np.sort((doc.astype(U64) << U64(bits)) | (item >> U64(64 - bits)))
    at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    return (packed[at] >> U64(bits)).astype(np.int64), packed[at] & U64((1 << bits) - 1), np.diff(np.append(at, len(packed)))
