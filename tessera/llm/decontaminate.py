"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased character by character, with runs of white
space as one space. An item of n characters within k edits of a passage shares at
least n - q + 1 - q * k of its q-grams with it, on diagonals (text position minus
item position) at most k apart. So:

1. q-grams of a text are looked up among those of the items;
2. hits are counted per item in overlapping bands of 2 (k + 1) diagonals, one
   starting at every (k + 1)th, so any k + 1 neighbouring diagonals lie in one;
3. bands that meet the bound are verified by alignment of the whole item within the
   band, free at both ends of the text; regions of at most k edits are leaks.

k is ``edit_share`` of the item's length, rounded down. q is the first of ``q`` for which
the bound is ``least`` or more, or 1 for an item for which none is. Items over ``window``
characters are searched in overlapping windows, so a part of a long item is a leak too.
A short item is easily part of some word: one under ``alone`` characters is a leak only
where no letter or digit is next to it.

The benchmark is the query set: it is read in blocks of about ``block_chars``
characters, each sent to all tasks and searched for in all rows. No row is shuffled.

Defined cases: null texts and items, and those of white space only, never match;
repeated rows are reported each, items of equal text under the least of their ids; of
overlapping regions of one item the one of fewest edits is reported, of these the
first; a very long text is searched in segments that overlap by more than an item, by
one task; an empty benchmark or table
gives no leaks; columns of other names are not read, or kept as they are by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks

_TABLE_BITS = 22
#: Characters of a long text that are searched at once, with what they share with the next ones.
SEGMENT = 1 << 20
#: Pairs of a hit and its place in an item that are held at once.
SPREAD = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    q: tuple[int, ...] = (12, 8, 4, 2)
    least: int = 4
    edit_share: float = 0.05
    window: int = 600
    alone: int = 12
    block_chars: int = 2_000_000


def _lower() -> np.ndarray:
    low = [chr(c).lower() for c in range(0x10000)]
    return np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)


_LOWER = _lower()


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal characters of all texts end to end, the text number of each and its
    place in its own text."""
    whole = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t or "") for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
    out = np.where(whole < 0x10000, _LOWER[np.minimum(whole, 0xFFFF)], whole)
    space = (whole == 32) | (whole >= 9) & (whole <= 13)
    out[space] = 32
    keep = np.ones(len(whole), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    return out[keep], owner[keep], place[keep]


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = max(len(chars) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(q if n else 0):
        out *= _FACTOR
        out += chars[j : j + n]
    out ^= out >> np.uint64(31)
    return out * _FACTOR


@dataclass(frozen=True)
class Pattern:
    item: object
    chars: np.ndarray
    edits: int
    q: int
    alone: bool

    @property
    def bound(self) -> int:
        """The q-grams that a passage within ``edits`` shares at least."""
        return len(self.chars) - self.q + 1 - self.q * self.edits


def patterns(items: list[tuple[object, str | None]], p: Params) -> list[Pattern]:
    out = []
    for item, text in items:
        chars = normal([(text or "").strip()])[0]
        for at in range(0, max(len(chars) - p.window // 2, 1), p.window // 2) if len(chars) > p.window else (0,):
            own = chars[at : at + p.window]
            n, edits = len(own), int(p.edit_share * len(own))
            q = next((q for q in p.q if n - q + 1 - q * edits >= p.least), 1)
            if n:
                out.append(Pattern(item, own, edits, q, len(chars) < p.alone))
    return out


class Index:
    """A block of items, searched for by their q-grams, those of one q after the other."""

    def __init__(self, items: list[tuple[object, str | None]], p: Params) -> None:
        of: dict[int, list[Pattern]] = {}
        for x in patterns(items, p):
            of.setdefault(x.q, []).append(x)
        self.parts = [Grams(q, of[q]) for q in sorted(of, reverse=True)]

    def search(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(text number, item, start, end, edits), offsets in characters of the text."""
        if not self.parts:
            return []
        long = {i for i, t in enumerate(texts) if t and len(t) > SEGMENT}
        found = self._regions([None if i in long else t for i, t in enumerate(texts)])
        for i in long:
            for a, b in self._segments(texts[i]):
                for (_, part, m), edits, start, end in self._regions([texts[i][a:b]]):
                    # what touches a cut is whole in the segment beside
                    if (start or not a) and (end < b - a or b == len(texts[i])):
                        found.append(((i, part, m), edits, start + a, end + a))
        best: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for key, *region in found:
            best.setdefault(key, []).append(tuple(region))
        out = []
        for (t, part, m), regions in best.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(regions):
                if all(end <= a or start >= z for a, z in taken):
                    taken.append((start, end))
                    out.append((t, self.parts[part].patterns[m].item, start, end, edits))
        return out

    def _regions(self, texts: list[str | None]) -> list[tuple[tuple[int, int, int], int, int, int]]:
        given = normal(texts)
        return [((t, i, m), *region) for i, part in enumerate(self.parts) for t, m, *region in part.search(*given)]

    def _segments(self, text: str) -> Iterator[tuple[int, int]]:
        """Ranges of a long text that share more than a region with their neighbours."""
        reach = int(max((p.size + p.edits).max() for p in self.parts)) + 2
        for at in range(0, len(text), SEGMENT):
            a, b, step = at, min(at + SEGMENT, len(text)), reach
            while a and len(normal([text[a:at]])[0]) < reach:
                a, step = max(0, a - step), 2 * step
            step, end = reach, b
            while b < len(text) and len(normal([text[end:b]])[0]) < reach:
                b, step = min(len(text), b + step), 2 * step
            yield a, b


def _letter(char: int) -> bool:
    return chr(char).isalnum()


class Grams:
    """The patterns of one q and the places of their q-grams."""

    def __init__(self, q: int, patterns: list[Pattern]) -> None:
        self.q, self.patterns = q, patterns
        codes = [grams(x.chars, q) for x in patterns]
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code))
        self.pattern = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.at = np.concatenate([np.arange(len(c)) for c in codes])[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.code >> np.uint64(64 - _TABLE_BITS)] = True
        self.edits, self.bound, self.size = (np.array([f(x) for x in patterns], np.int64) for f in (lambda x: x.edits, lambda x: x.bound, lambda x: len(x.chars)))

    def search(self, chars: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, pattern, edits, start, end) of all regions that are close enough."""
        code = grams(chars, self.q)
        hit = np.flatnonzero(self.table[code >> np.uint64(64 - _TABLE_BITS)])
        hit = hit[owner[hit] == owner[hit + self.q - 1]] if len(hit) else hit
        row = np.searchsorted(self.code, code[hit])
        found = self.code[np.minimum(row, len(self.code) - 1)] == code[hit]
        hit, row = hit[found], row[found]
        # a region needs so many hits within the longest item and its edits
        span, least = int((self.size + self.edits).max()), int(self.bound.min())
        ahead = np.searchsorted(hit, hit + span) - np.arange(len(hit))
        reach = np.full(len(hit) + 1, 0, np.int64)
        full = np.flatnonzero(ahead >= least)
        np.add.at(reach, full, 1)
        np.add.at(reach, full + ahead[full], -1)
        dense = np.cumsum(reach[:-1]) > 0
        hit, row = hit[dense], row[dense]
        key, n = self._bands(hit, row, owner)
        out = []
        for t, m, b in key[n >= self.bound[key[:, 1]]].tolist():
            if r := self._verify(chars, owner, t, self.patterns[m], b * (int(self.edits[m]) + 1)):
                edits, start, end = r
                out.append((t, m, edits, int(place[start]), int(place[end - 1]) + 1))
        return out

    def _bands(self, hit: np.ndarray, row: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern, band) and its hits. A frequent q-gram has many places in
        items, so hits are spread out and counted some at a time."""
        times = self.last[row] - self.first[row]
        ends, at = np.cumsum(times), 0
        keys, counts = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
        while at < len(hit):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD, "right")))
            n = times[at:to]
            into = np.repeat(self.first[row[at:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where, pattern = np.repeat(hit[at:to], n), self.pattern[into]
            band = np.floor_divide(where - self.at[into], self.edits[pattern] + 1)
            # the text is part of the key: diagonals of two texts may meet in a band
            key, count = np.unique(np.stack([np.tile(owner[where], 2), np.tile(pattern, 2), np.concatenate([band, band - 1])], 1), axis=0, return_counts=True)
            keys.append(key)
            counts.append(count)
            at = to
        if len(keys) == 2:
            return keys[1], counts[1]
        key, same = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        return key, np.bincount(same.ravel(), np.concatenate(counts), minlength=len(key)).astype(np.int64)

    def _verify(self, chars: np.ndarray, owner: np.ndarray, t: int, x: Pattern, low: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the best alignment in the band of diagonals from
        ``low``, widened by k on both sides; None if it takes over k edits."""
        n, k = len(x.chars), x.edits
        a, z = np.searchsorted(owner, [t, t + 1])
        first, last = low - k, low + 2 * (k + 1) + k
        width = last - first
        text = np.full(n + width, 0xFFFFFFFF, np.uint32)  # matches nothing outside the text
        from_, to = max(first, a), min(first + n + width, z)
        text[from_ - first : to - first] = chars[from_:to]
        one = np.int64(1) << 32
        step = np.arange(width) * one
        # value: edits, then the diagonal of the start; a start outside the text is never worth it
        now = np.arange(width, dtype=np.int64)
        for i in range(n):
            new = now + one * (text[i : i + width] != x.chars[i])
            new[:-1] = np.minimum(new[:-1], now[1:] + one)
            now = np.minimum.accumulate(new - step) + step
            if now.min() >> 32 > k:
                return None
        end = int(np.argmin(now))
        edits, start = int(now[end] >> 32), int(now[end] & (one - 1))
        start, end = max(first + start, a), min(first + end + n, z)
        if edits > k or start >= end:
            return None
        if x.alone and (start > a and _letter(chars[start - 1]) or end < z and _letter(chars[end])):
            return None
        return edits, start, end


def blocks(benchmark: DataFrame, p: Params, item_col: str, text_col: str) -> Iterator[Index]:
    """The items, each text once, in blocks dealt by their texts."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // p.block_chars)
    for b in range(n):
        yield Index([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()], p)


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per verified region."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = benchmark.select(F.col(item_col)).schema[0].dataType
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", kind)]).add("start", "long").add("end", "long").add("edits", "long")
    item_type = pa.string() if isinstance(kind, T.StringType) else None

    def found(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "_text"):
                    if hits := sent.value.search(part.column("_text").to_pylist()):
                        at, item, start, end, edits = zip(*sorted(hits, key=lambda h: (h[0], h[2], h[3])), strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(item, item_type), *(pa.array(v, pa.int64()) for v in (start, end, edits))], schema.names)

        return rows.mapInArrow(run, schema)

    out = None
    for index in blocks(benchmark, p, item_col, item_text_col):
        out = found(index) if out is None else out.unionByName(found(index))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns, in one pass a block."""
    for index in blocks(benchmark, p, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in sent.value.search(part.column(text_col).to_pylist())]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
