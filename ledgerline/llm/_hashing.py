"""Hashes of words and of runs of words, for whole Arrow columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are hashed at once.
AT_ONCE = 4 << 20
#: Odd multipliers (fractional parts of the golden ratio and of the square root of 2, as 64 bits).
FACTORS = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909)
#: Words up to so many bytes (a multiple of 8) are hashed together.
AT_LENGTH = 64
#: The first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def parts(batches: Iterator[pa.RecordBatch], text: int, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``at_once`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + at_once, "right")))
            yield batch.slice(at, end - at)
            at = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (between white space \\x20, \\x09-\\x0D) one after another, and where each text's begin; null has none.

    ``lower``: A-Z to a-z first.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(np.concatenate([[0], real]))[np.concatenate([[0], np.cumsum(counts)])]
    return flat.filter(pa.array(real)), ends.astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word.

    Words are hashed all at once, eight bytes a step, from their length on; those of one length up to 8 bytes can't collide.
    Longer ones than AT_LENGTH bytes are hashed one by one.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    begin, size = ends[:-1], np.diff(ends)
    raw = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # those from each byte on
    out = mixed((mixed(size.astype(np.uint64) ^ (np.uint64(seed) << np.uint64(32))) * np.uint64(FACTORS[0])) ^ (eight[begin] & _FIRST[np.minimum(size, 8)]))
    longer = np.flatnonzero(size > 8)
    for at in range(8, AT_LENGTH, 8):
        if not len(longer):
            break
        out[longer] = mixed((out[longer] * np.uint64(FACTORS[0])) ^ (eight[begin[longer] + at] & _FIRST[np.minimum(size[longer] - at, 8)]))
        longer = longer[size[longer] > at + 8]
    for i in longer:
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : ends[i + 1]], seed)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(h: np.ndarray, k: int, factor: int = FACTORS[0]) -> np.ndarray:
    """Hash of the k words from each position on (over the ends of texts too); len(h) - k + 1 of them.

    A polynomial in an odd factor modulo 2**64, put together from runs of 1, 2, 4, ... words, then mixed.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out, have, step, size = len(h) - k + 1, None, 0, h, 1
    while True:
        if k & size:
            part = step[have : have + n]
            out = part.copy() if out is None else out * np.uint64(pow(factor, size, 1 << 64)) + part
            have += size
        if size * 2 > k:
            return mixed(out)
        step = step[:-size] * np.uint64(pow(factor, size, 1 << 64)) + step[size:]
        size *= 2


def inside(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each of the total - k + 1 positions, whether k words from there lie in one text."""
    ok = np.ones(max(0, total - k + 1), bool)
    for end in starts[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    return ok


def first_smallest(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the position of the first smallest."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at = np.where(h[a] <= h[b], a, b)
        size *= 2
    a, b = at[:n], at[w - size : w - size + n]
    return np.where(h[a] <= h[b], a, b)
