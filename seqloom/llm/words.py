"""64-bit hashes of words and word shingles for many texts at once, in numpy.

Words are lower-cased (A-Z) runs of ASCII letters, digits and any character
beyond ASCII. In UTF-8 these are exactly the runs of bytes a-z, 0-9 and 0x80
and above, so no text is decoded.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SHINGLE = 5
#: Bytes hashed at a time; bounds memory for texts of any length.
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, modulo 2 ** 64, for i up to n."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of h (uint64), one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data; a word is hashed by its own bytes alone."""
    b = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_WORD[b].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def _cut(data: bytes, at: int) -> int:
    """The first place from at on where no word goes on."""
    while at < len(data):
        part = _WORD[_LOWER[np.frombuffer(data, dtype=np.uint8, count=min(4096, len(data) - at), offset=at)]]
        if not part.all():
            return at + int(np.argmin(part))
        at += len(part)
    return len(data)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text (None: none)."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= SLICE):
            size += len(texts[last] or b"")
            last += 1
        if size > SLICE:  # one long text
            data, at = texts[first] or b"", 0
            while at < len(data):
                to = _cut(data, min(len(data), at + SLICE))
                h = _word_hashes(data[at:to])[1]
                hashes.append(h)
                counts[first] += len(h)
                at = to
        else:
            part = [t or b"" for t in texts[first:last]]
            begin = np.cumsum([0] + [len(t) + 1 for t in part])[:-1]
            starts, h = _word_hashes(b"\n".join(part))
            hashes.append(h)
            counts[first:last] = np.bincount(np.searchsorted(begin, starts, side="right") - 1, minlength=len(part)) if len(h) else 0
        first = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def windows(h: np.ndarray, counts: np.ndarray, length: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of length words within a text, and their number per text.

    With short, a text of fewer words, but not none, has one run: all its words.
    """
    begin = np.cumsum(counts) - counts
    full = np.maximum(counts - length + 1, 0)
    out_counts = np.where((full == 0) & (counts > 0), 1, full) if short else full
    out = np.zeros(int(out_counts.sum()), dtype=np.uint64)
    to = np.cumsum(out_counts) - out_counts
    if len(h) >= length:
        run = np.zeros(len(h) - length + 1, dtype=np.uint64)
        for k in range(length):
            run += h[k : k + len(run)] * _STEP[k]
        some = np.flatnonzero(full)
        at = np.repeat(begin[some] - (np.cumsum(full[some]) - full[some]), full[some]) + np.arange(int(full[some].sum()))
        put = np.repeat(to[some] - (np.cumsum(full[some]) - full[some]), full[some]) + np.arange(int(full[some].sum()))
        out[put] = run[at]
    if short:
        for i in np.flatnonzero((full == 0) & (counts > 0)):
            own = h[begin[i] : begin[i] + counts[i]]
            out[to[i]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_counts
