"""Hashes of the word shingles of whole texts, by numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

#: ASCII white space ends a word; A-Z count as a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUE = np.arange(1, 257, dtype=np.uint64)
VALUE[65:91] = VALUE[97:123]
VALUE[SPACE] = 0

P, A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_powers = np.cumprod(np.full(1024, P, np.uint64), dtype=np.uint64)
#: Bytes that are hashed at once.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that stirs all bits."""
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(raw: np.ndarray, ends: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order. ends: offsets of the rows, from 0.

    A word's hash is a sum over its bytes, so that texts of any length are read a segment at a time; a word that
    a segment's end cuts is summed on in the next.
    """
    global _powers
    sums, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held, length, row = 0, 0, 0  # the word that is cut

    def close():
        sums.append(np.array([held], np.uint64))
        owners.append(np.array([row]))

    for a in range(0, len(raw), segment):
        part = raw[a : a + segment]
        space = SPACE[part]
        fresh = np.empty(len(part), bool)
        fresh[0] = a == 0 or SPACE[raw[a - 1]]
        fresh[1:] = space[:-1]
        low, high = np.searchsorted(ends[:-1], [a, a + len(part)])
        fresh[ends[low:high] - a] = True
        starts = np.flatnonzero(fresh & ~space)
        lead = int(starts[0]) if len(starts) else len(part)
        if (most := max(lead, int(np.diff(np.append(starts, len(part))).max()) if len(starts) else 0)) > len(_powers):
            _powers = np.cumprod(np.full(2 * most, P, np.uint64), dtype=np.uint64)
        if length:
            more = (VALUE[part[:lead]] * _powers[:lead]).sum(dtype=np.uint64)
            held = (held + int(more) * pow(int(P), length, 1 << 64)) % (1 << 64)
            length += lead
            if len(starts) or fresh[0] or space[:lead].any():
                close()
                length = 0
        if len(starts):
            reach = np.diff(np.append(starts, len(part)))
            place = np.arange(lead, len(part)) - np.repeat(starts, reach)
            found = np.add.reduceat(VALUE[part[lead:]] * _powers[place], starts - lead)
            of = np.searchsorted(ends, a + starts, "right") - 1
            if not space[starts[-1] :].any():
                held, length, row = int(found[-1]), int(reach[-1]), int(of[-1])
                found, of = found[:-1], of[:-1]
            sums.append(found)
            owners.append(of)
    if length:
        close()
    return mix(np.concatenate(sums)), np.concatenate(owners)


def shingle_hashes(raw: np.ndarray, ends: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of `width` words; a row with fewer words has one, of all its words."""
    words, rows = word_hashes(raw, ends)
    n, parts, owners = len(words), [], []
    if n >= width:
        s = words[: n - width + 1].copy()
        for k in range(1, width):
            s = mix(s * C + words[k : n - width + 1 + k])
        whole = rows[: n - width + 1] == rows[width - 1 :]
        parts.append(s[whole])
        owners.append(rows[: n - width + 1][whole])
    count = np.bincount(rows, minlength=len(ends) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            s = words[first[short]] ^ np.uint64(k)
            for j in range(1, k):
                s = mix(s * C + words[first[short] + j])
            parts.append(mix(s + P))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def slices(ends: np.ndarray, most: int = 1 << 19):
    """Row ranges whose texts have at most `most` bytes; a longer single text is a range of its own."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to
