"""Vectorised word splitting and hashing of Arrow text batches (numpy, no loop over words)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a text larger than this is cut between words, never dropped.
BLOCK = 2 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words: all but space and \x09-\x0D
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[32, *range(9, 14)]] = False
#: bytes of words: ASCII letters and digits, and all of non-ASCII characters
ALNUM_SPLIT = np.zeros(256, bool)
ALNUM_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: first bytes, and second bytes below them, of non-ASCII characters that are punctuation or blanks: general
#: and CJK punctuation; of the first also the signs of Latin-1 but for the letters \xAA, \xB5 and \xBA
_PUNCTUATION = {0xE2: (3, (0x80, 0x81)), 0xE3: (3, (0x80,)), 0xC2: (2, tuple(b for b in range(0x80, 0xC0) if b not in (0xAA, 0xB5, 0xBA)))}


def word_bytes(data: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Which bytes belong to words; for ALNUM_SPLIT, punctuation beyond ASCII parts words too."""
    word = is_word[data]
    if is_word is ALNUM_SPLIT:
        for lead, (size, seconds) in _PUNCTUATION.items():
            at = np.flatnonzero(data[:-1] == lead)
            at = at[np.isin(data[at + 1], seconds)]
            for k in range(size):
                word[at[at + k < len(data)] + k] = False
    return word


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and where each text begins, with the end."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give unused memory back: workers are used again, by other operators too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def split_batches(batches, column: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)
    release()


def piece_hashes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte runs that begin at ``starts``; bytes where ``counts`` is false are left out."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(starts, len(data)))
    run = np.arange(len(data), dtype=np.int64)
    run[starts[0] :] -= np.repeat(starts, size)
    power = np.full(int(run[starts[0] :].max()) + 1, _STEP, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    run[: starts[0]] = 0
    value = _BYTE[data]
    value *= power[run]
    if counts is not None:
        value[~counts] = 0
    return mix(np.add.reduceat(value, starts))


def word_hashes(texts: pa.Array, is_word: np.ndarray = BLANK_SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, in order, and each text's first word, with the end."""
    data, off = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    hashes, begins = [], []
    words = word_bytes(data, is_word)
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        word = words[at:end]
        if end < len(data):
            gaps = np.flatnonzero(~word | first[at:end])
            if len(gaps) and gaps[-1]:
                end = at + int(gaps[-1])
            else:  # one word of more than BLOCK bytes
                more = words[end:] & ~first[end:-1]
                end = len(data) if more.all() else end + int(np.argmin(more))
            word = words[at:end]
        seg = LOWER[data[at:end]]
        start = word.copy()
        start[1:] &= ~word[:-1] | first[at + 1 : end]
        starts = np.flatnonzero(start)
        if len(starts):
            hashes.append(piece_hashes(seg, starts, word))
            begins.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    where = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(where, off).astype(np.int64)
