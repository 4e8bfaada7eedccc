"""NumPy kernels over the UTF-8 bytes of many texts at once.

All work on one buffer with n + 1 offsets (``shared.texts``): no loop over words.
A word is ``[^\\x20\\x09-\\x0D]+`` unless a kernel says otherwise. Range hashes are
64-bit polynomials over random byte values; equal hashes count as equal words,
which errs with a chance of about pairs / 2**64 in one text.

A text over ``BLOCK`` bytes is taken in blocks that end between words, so that what is
held for each byte is bounded; what is held for each word is not.
"""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes whose hashes and positions are worked out at once.
BLOCK = 1 << 21
#: Texts that are counted one by one at most.
FEW = 64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = -(-n // (1 << 18)) << 18
        found = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            found.append(np.cumprod(step, dtype=np.uint64))
        if size > 2 * BLOCK:  # not worth keeping
            return found[0][:n], found[1][:n]
        _POWERS[:] = found
    return _POWERS[0][:n], _POWERS[1][:n]


class Ranges:
    """Hashes of any ranges of one buffer, of bytes unless other values are given."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE) -> None:
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of bytes in a class."""
    hit = inside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    start = hit.copy()
    start[1:] &= ~hit[:-1] | cut[1:-1]
    end = hit.copy()
    end[:-1] &= ~hit[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def blocks(buf: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about ``BLOCK`` bytes that no run of bytes in a class crosses."""
    out, at = [], 0
    while at < len(buf):
        to = at + BLOCK
        while to < len(buf):
            gap = np.flatnonzero(~inside[buf[to : to + (1 << 16)]])
            if len(gap):
                to += int(gap[0])
                break
            to += 1 << 16
        out.append((at, min(to, len(buf))))
        at = out[-1][1]
    return out


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of the maximal runs of bytes in a class."""
    found = []
    for a, b in blocks(buf, inside):
        own = np.concatenate([[0], offsets[(offsets > a) & (offsets < b)] - a, [b - a]])
        start, end, _ = runs(buf[a:b], own, inside)
        found.append((start + a, end + a, Ranges(buf[a:b])(start, end)))
    start, end, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    return start, end, np.searchsorted(offsets, start, "right") - 1, key


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of all \\n-split lines; an empty text has one."""
    breaks = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    doc_s, doc_e = np.concatenate([np.arange(n), owner]), np.concatenate([owner, np.arange(n)])
    # by text first: an empty text starts where its neighbour does
    s, e = np.lexsort((start, doc_s)), np.lexsort((end, doc_e))
    return start[s], end[e], doc_s[s]


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(owner, weights, minlength=n)
    return out if weights is not None and weights.dtype.kind == "f" else np.rint(out).astype(np.int64)


def line_keys(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; then the text number and a hash of each line with a word, of
    which ``word`` has the starts."""
    n = len(offsets) - 1
    if len(buf) <= BLOCK:
        at, to, line_of = lines(buf, offsets)
        first = np.searchsorted(word, at)
        full = (first < len(word)) & (np.append(word, np.iinfo(np.int64).max)[first] < to)
        return per_text(line_of, n), line_of[full], Ranges(buf)(at[full], to[full])
    count, owner, keys = np.zeros(n, np.int64), [], []
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        split = buf[a:b].tobytes().split(b"\n")
        own = [xxhash.xxh3_64_intdigest(x) for x in split if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
        count[i] = len(split)
        owner.append(np.full(len(own), i))
        keys.append(np.array(own, np.uint64))
    return count, np.concatenate(owner), np.concatenate(keys)


def count_bytes(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) <= FEW:
        return np.array([np.count_nonzero(hit[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64)
    sums = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether a value is found twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_words(word_hash: np.ndarray, owner: np.ndarray, n: int, width: int = 8) -> np.ndarray:
    """Per text: words inside a ``width``-word window that the text has twice or more."""
    m = len(word_hash) - width + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    key = np.zeros(m, np.uint64)
    for j in range(width):
        key = key * np.uint64(_BASE) + word_hash[j : j + m]
    key = mix(key) ^ mix(owner[:m].astype(np.uint64) + np.uint64(77))
    at = np.flatnonzero(owner[:m] == owner[width - 1 :])
    at = at[repeated(key[at])]
    edge = np.zeros(len(word_hash) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return per_text(owner[np.cumsum(edge[:-1]) > 0], n)


def basics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: the counts that the quality rules and the classifier start from."""
    n = len(offsets) - 1
    start, _, owner, word_hash = words(buf, offsets, ~SPACE)
    n_lines, line_of, key = line_keys(buf, offsets, start)
    points = (buf & 0xC0) != 0x80
    count = lambda chars: count_bytes(members(chars)[buf], offsets)
    n_words = per_text(owner, n)
    distinct = np.unique(key ^ mix(line_of.astype(np.uint64) + np.uint64(99)), return_index=True)[1]
    distinct_words = np.unique(word_hash ^ mix(owner.astype(np.uint64) + np.uint64(55)), return_index=True)[1]
    letters = (buf >= 0x61) & (buf <= 0x7A) | (buf >= 0xC0)
    return {
        "n_words": n_words,
        "word_chars": count_bytes(points & ~SPACE[buf], offsets),
        "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": per_text(line_of, n) - per_text(line_of[distinct], n),
        "n_repeat_words": repeated_words(word_hash, owner, n),
        "n_lines": n_lines,
        "n_chars": count_bytes(points, offsets),
        "n_upper": count_bytes((buf >= 0x41) & (buf <= 0x5A), offsets),
        "n_lower": count_bytes(letters, offsets),
        "n_digits": count("0123456789"),
        "n_bangs": count("!?"),
        "n_stops": count(".,;:"),
        "n_pipes": count("|<>"),
        "n_distinct": per_text(owner[distinct_words], n),
    }
