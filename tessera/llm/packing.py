"""Best-fit packing of documents into sequences under several capacities.

A document's token ids end with an end id; only documents over the token capacity
are cut, into full pieces and a rest. A bin is a vector of residuals: tokens,
documents and attention cost (the sum of squared piece lengths). Pieces are placed
by decreasing length into the fitting bin whose residual vector, after placement,
has the least weighted norm (``score="norm"``) or whose weighted dot product with
the demand is largest (``"dot"``); if none fits under every constraint, a bin opens.

Pieces of equal length are alike, so the packer runs on the number of pieces of each
length, at most ``tokens`` numbers, whatever the corpus: bins in one state are a
range of sequence numbers and pieces are a range of ranks. Every piece then finds
its place from its rank among pieces of its length, which comes from counts per
input partition; no group is gathered.

Tokens: texts are cut where no token of the tokenizer crosses, and a worker encodes
each frequent word once. This is done for tokenizers whose normalizer and
pre-tokenizer are the known ones; with any other, texts are encoded whole.

Defined cases: a null text is empty (one piece, the end id alone); repeated rows are
packed each; bins that score the same are taken in order of opening; a very long text
is encoded in parts that end with a word; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Ranges
from .shared import chunks, table

#: Bytes that the words a worker keeps the ids of take at most, about: the first ones, which hold the frequent ones.
CACHE_BYTES = 16 << 20
#: What a kept word takes besides its ids, and its characters where they are kept, about.
PLAIN_BYTES, ODD_BYTES = 32, 150
#: Characters of a text that are encoded at once, up to the next end of a word.
PART_CHARS = 1 << 19


@dataclass(frozen=True)
class Params:
    """Capacities of a sequence. Attention never binds beyond the tokens (a sum of
    squares is at most the square of the sum); more pieces than ``documents`` have
    place in a sequence of very short ones only, so hardly more sequences are used
    than tokens ask for."""

    tokens: int = 2048
    documents: int = 128
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"
    end_id: int = 0


# Fixed values, of the tokenizer file's own format: what is known to part texts where we do.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Counts by length and partition that are sent to all tasks at most; beyond that, pieces are joined with theirs by a shuffle.
SENT_OFFSETS = 1_000_000

PLAIN = 0x250
#: What is not plain: İ is two characters in lower case; later ones may compose or depend on their neighbours.
_ODD = re.compile(f"[İ{chr(PLAIN)}-{chr(0x10FFFF)}]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of plain characters, and the class of each character that comes out."""
    low = np.array([ord(chr(c).lower()) if c != ord("İ") else c for c in range(PLAIN)], np.uint32)
    kind = np.full(int(low.max()) + 1, _OTHER, np.uint8)
    for c in {*low.tolist(), *range(PLAIN)}:
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kind[[*range(9, 14), 0x20, 0x85, 0xA0]] = _SPACE
    return low, kind


_LOW, _KIND = _tables()
_CHAR = np.random.default_rng(49).integers(1, 2**63, len(_KIND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the tokenizer's words in plain lower-case characters, of texts
    that start at ``first``."""
    kind = _KIND[text]
    begin = np.ones(len(text), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    begin[first[first < len(text)]] = True
    # 's and the like: a quote alone before a letter takes the letters of the ending
    quote = np.flatnonzero((text == 0x27) & begin)
    quote = quote[quote + 1 < len(text)]
    quote = quote[begin[quote + 1] & (kind[quote + 1] == _LETTER) & ~np.isin(quote + 1, first)]
    for ending in _ENDINGS:
        last = quote + len(ending)
        hit = last < len(text)
        for i, c in enumerate(ending):
            at = np.minimum(quote + 1 + i, len(text) - 1)
            hit &= (text[at] == ord(c)) & (~begin[at] if i else True)
        begin[quote[hit] + 1] = False
        after = last[hit] + 1
        after = after[after < len(text)]
        begin[after] = True
        quote = quote[~hit]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(text))
    word = kind[start] != _SPACE
    return start[word], end[word]


class Encoder:
    """Text to little-endian unsigned 32-bit ids, by way of a word cache.

    Plain texts are lower-cased and cut into the tokenizer's words; in others the words
    are what spaces and line breaks part. No token crosses either cut. Plain words are
    known by a 64-bit hash, so two count as one with a chance of words squared / 2**65."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        before = given.get("pre_tokenizer") or {}
        self.known = given.get("normalizer") == _NORMALIZER and before.get("type") == "Sequence" and before.get("pretokenizers") == [_SPLIT, _BYTES]
        self.odd: dict[str, bytes] = {"": b""}
        self.odd_bytes = 0
        # of plain words: hashes in order, and the number of each; ids end to end, and where those of each number start
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts = array("I"), array("q", [0])

    @cached_property
    def whole(self):
        """The tokenizer as it is."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    @cached_property
    def bare(self):
        """Without what has been done to plain words: they come normal and cut."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        out = Tokenizer.from_file(self.path)
        out.normalizer, out.pre_tokenizer, out.encode_special_tokens = None, ByteLevel(add_prefix_space=False, use_regex=False), True
        return out

    @staticmethod
    def _encoded(tokenizer, words: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(words), 4096):
            for e in tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                yield e.ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        text = _LOW[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        start, end = cut(text, first)
        word = Ranges(text, _CHAR)(start, end)
        distinct, at, each = np.unique(word, return_index=True, return_inverse=True)
        n_words, n_ids = len(self.starts) - 1, len(self.ids)
        row = np.searchsorted(self.hashes, distinct)
        found = np.full(len(distinct), -1)
        inside = np.flatnonzero(row < len(self.hashes))
        inside = inside[self.hashes[row[inside]] == distinct[inside]]
        found[inside] = self.numbers[row[inside]]
        new = np.flatnonzero(found < 0)
        # the new words, each with a line break after it
        a, long = start[at[new]], end[at[new]] - start[at[new]] + 1
        done = np.cumsum(long)
        chars = np.repeat(a - (done - long), long) + np.arange(done[-1] if len(done) else 0)
        chars = text[np.minimum(chars, len(text) - 1)]
        chars[done - 1] = 0x0A
        for ids in self._encoded(self.bare, chars.tobytes().decode("utf-32-le").split("\n")[:-1]):
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
        found[new] = n_words + np.arange(len(new))
        number = found[each]
        ids, starts = np.array(self.ids, "<u4"), np.array(self.starts)
        if n_words * PLAIN_BYTES + n_ids * 4 <= CACHE_BYTES:
            self.hashes, self.numbers = np.insert(self.hashes, row[new], distinct[new]), np.insert(self.numbers, row[new], found[new])
        else:  # full before these
            del self.ids[n_ids:], self.starts[n_words + 1 :]
        count = starts[number + 1] - starts[number]
        done = np.cumsum(count)
        out = ids[np.repeat(starts[number] - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        ends = np.append(0, done)[np.searchsorted(start, first + size)]
        return [out[a:b].tobytes() for a, b in zip(np.append(0, ends), ends, strict=False)]

    def _others(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split) - self.odd.keys())
        found = dict(zip(new, (array("I", x).tobytes() for x in self._encoded(self.whole, new)), strict=True))
        if self.odd_bytes <= CACHE_BYTES:
            self.odd |= found
            self.odd_bytes += sum(ODD_BYTES + 4 * len(w) + len(x) for w, x in found.items())
        return [b"".join(found[w] if w in found else self.odd[w] for w in words) for words in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return [array("I", x).tobytes() for x in self._encoded(self.whole, texts)]
        parts: list[list[tuple[int, str]]] = [[], []]  # plain ones and others
        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                to = t.find(" ", at + PART_CHARS) if len(t) - at > PART_CHARS else -1
                part = t[at : to if to >= 0 else len(t)]
                parts[bool(_ODD.search(t))].append((i, part))
                at += len(part)
        out: list[list[bytes]] = [[] for _ in texts]
        for some, encode in zip(parts, (self._plain, self._others), strict=True):
            at = 0
            while at < len(some):
                to, room = at, PART_CHARS
                while to < len(some) and (to == at or len(some[to][1]) <= room):
                    room -= len(some[to][1])
                    to += 1
                for (i, _), ids in zip(some[at:to], encode([t for _, t in some[at:to]]), strict=True):
                    out[i].append(ids)
                at = to
        return [b"".join(x) for x in out]


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and _part, _rank: the input partition
    and the piece's rank among those of its length there."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    end = np.array([p.end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer_path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for some in chunks(batch, "_text"):
                out, owner = [], []
                for i, ids in enumerate(encode(some.column("_text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * p.tokens)):
                        own = ids[at : at + 4 * p.tokens]
                        n = len(own) // 4
                        owner.append(i)
                        out.append((k, at // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                cols = list(zip(*out, strict=True))
                kinds = (pa.int32(), *(pa.int64(),) * 3, pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in zip(names[1:], ("integer", "long", "long", "long", "integer", "long"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], p: Params = Params()) -> np.ndarray:
    """Rows (length, first rank, ranks, copies, first sequence, offset): ranks
    first + i * copies + j of the length go to sequence first + i at offset + j * length."""
    caps, weight = np.array([p.tokens, p.documents, p.attention]), np.array(p.weights)
    first = np.zeros(0, np.int64)  # of a range of bins in one state
    size = np.zeros(0, np.int64)
    used = np.zeros((0, 3), np.int64)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, rank, left = np.array([length, 1, length * length]), 0, counts[length]
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        while left:
            rest = caps - used
            fits = np.flatnonzero((rest >= need).all(1))
            if len(fits):
                share = (rest[fits] - need) / caps if p.score == "norm" else rest[fits] / caps * (need / caps)
                g = fits[np.argmin(np.sqrt((weight * share**2).sum(1)))] if p.score == "norm" else fits[np.argmax((weight * share).sum(1))]
                most = int(((caps - used[g]) // need).min())
                copies = min(most, left) if p.score == "norm" else 1  # by norm, the bin just used is the best again
                bins = min(int(size[g]), left // copies)
                out.append((length, rank, bins * copies, copies, first[g], used[g][0]))
                new = (first[g], bins, used[g] + copies * need)
                if bins < size[g]:
                    first[g], size[g] = first[g] + bins, size[g] - bins
                    first, size, used = np.append(first, new[0]), np.append(size, bins), np.vstack([used, new[2]])
                else:
                    used[g] = new[2]
            else:
                copies = min(int((caps // need).min()), left)
                bins = left // copies
                out.append((length, rank, bins * copies, copies, opened, 0))
                first, size, used = np.append(first, opened), np.append(size, bins), np.vstack([used, copies * need])
                opened += bins
            rank, left = rank + bins * copies, left - bins * copies
        full = (used >= caps).any(1)
        first, size, used = first[~full], size[~full], used[~full]
    return np.array(out, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_path: str, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = table(pieces(docs, tokenizer_path, p, id_col, text_col), "pieces")
    by_part = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    by_part = table(by_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))), "offsets")
    counts = by_part.groupBy("length").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("parts")).collect()  # at most ``tokens``
    offsets = by_part.drop("_n")
    if sum(r["parts"] for r in counts) <= SENT_OFFSETS:
        offsets = F.broadcast(offsets)
    rows = plan({r["length"]: r["n"] for r in counts}, p)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = cut.join(offsets, ["length", "_part"]).select(*names[:5], (F.col("_before") + F.col("_rank")).alias("_rank"))
    # plan rows of a length are in order of rank
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    start_of = np.searchsorted(rows[:, 0], np.arange(p.tokens + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                row[own] = start_of[n] + np.searchsorted(rows[start_of[n] : start_of[n + 1], 1], rank[own], "right") - 1
            i = rank - rows[row, 1]
            sequence, offset = rows[row, 4] + i // rows[row, 3], rows[row, 5] + i % rows[row, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    schema = T.StructType(ranked.schema.fields[:5]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)
