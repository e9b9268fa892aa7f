"""Vectorised word spans, word hashes and rolling (Rabin-Karp) window hashes over UTF-8 bytes, with NumPy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1B54A32D192ED03 | 1
_TABLE = np.random.RandomState(20240607).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())

        def table(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        have = _powers[base] = (table(base), table(pow(base, -1, 2**64)))
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_chunk(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_IS_SPACE[buf]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(_BASE, len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=prefix[1:])
    return starts, mix((prefix[ends] - prefix[starts]) * down[starts], 0x51ED270B)


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the bounds of each text among them.

    Words are runs of bytes other than ASCII white space. Work goes by pieces of about `chunk` bytes cut at white
    space, so memory doesn't follow the longest text.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + len(texts[j]) < chunk):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1 and size > 2 * chunk:
            raw, at = texts[i], 0
            while at < len(raw):
                end = min(len(raw), at + chunk)
                while end < len(raw) and not _IS_SPACE[raw[end]]:
                    end += 1
                h = _hash_chunk(np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at))[1]
                hashes.append(h)
                counts[i + 1] += len(h)
                at = end
        else:
            buf = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", dtype=np.uint8)
            starts, h = _hash_chunk(buf)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            bounds = np.searchsorted(starts, ends)
            counts[i + 1 : j + 1] = np.diff(np.concatenate(([0], bounds)))
            hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def window_hashes(words: np.ndarray, ptr: np.ndarray, window: int, base: int = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of `window` words inside one text: (hash, index of its first word).

    Prefix sums of hash * base**i modulo 2**64; a window is the difference of two, shifted by base**-i and mixed.
    """
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(base, len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(len(words))
    starts = np.flatnonzero(left >= window)
    return mix((prefix[starts + window] - prefix[starts]) * down[starts], 0x2545F491), starts


def raw(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
