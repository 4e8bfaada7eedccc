"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, A-Z lower-cased; a chain is a sentence (no line break or
.!? between its tokens). Tags are O and T. A token's features are hashed: itself, its
first four and five characters (so inflected forms not seen before are known by
their stem), the tokens before and after it. Forward-backward
marginals give each token's chance of T; neighbouring tokens of 0.5 or more are one
offending span, and a text's score is 1 - prod(1 - p) over its tokens with p of
``floor`` or more (with less, long clean texts would add up to a suspicion).

Tokens are labelled from labelled texts: each toxic text has one unit of blame, dealt
among its words and beginnings that are far more common in toxic texts than in
others, in proportion to the blame these have in all toxic texts, a few times over.
What keeps the blame for several texts is labelled T in toxic texts; all else is O. The chain
is fitted to these by AdaGrad on the exact likelihood.

The fit uses a bounded sample: the ``toxic_rows`` and ``clean_rows`` labelled rows of
least hash whose texts have at most ``row_bytes`` bytes (the next one stands in for a
longer one), as long as all have at most ``sample_bytes`` together. Every text is then
scored whole.

A chain of any length is walked in blocks of ``SPAN`` tokens, all blocks at once; a
block's steps multiply to one 2 x 2 matrix, which carries the odds over it.

Defined cases: a null or wordless text has score 0; with no toxic labels, or nothing
to blame, every score is 0; repeated rows are scored each, and learnt from each if
their bytes together fit the sample; ids of equal hash are taken in order; a very long
text is scored whole by one task; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import chunks, texts

BITS = 22
#: Lengths, in characters, of the beginnings of words that are features.
BEGINNINGS = (4, 5)
#: Features of a token itself, its neighbours aside.
OWN = 1 + len(BEGINNINGS)
#: Tokens that the fit has in hand at once, in whole chains.
PIECE = 1 << 17
#: Tokens of a chain that are walked one after the other.
SPAN = 256
_BREAK = kernel.members("\n.!?")
_SALT = [np.uint64(0x632BE59BD9B4E019 * (i + 1) % 2**64) for i in range(OWN + 2)]


@dataclass(frozen=True)
class Params:
    toxic_rows: int = 1200
    clean_rows: int = 2400
    row_bytes: int = 200_000
    sample_bytes: int = 32 << 20
    rounds: int = 2
    steps: int = 40
    rate: float = 0.5
    l2: float = 1e-6
    floor: float = 0.2
    min_texts: float = 0.6
    min_share: float = 0.002


@dataclass(frozen=True)
class Model:
    """Weights of features for tag T (given sparsely), and of transitions."""

    at: np.ndarray
    weight: np.ndarray
    move: np.ndarray  # [from, to], 0: O, 1: T
    start: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


@dataclass(frozen=True)
class Tokens:
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray  # whether a chain starts here
    own: np.ndarray  # token x 3: the features that itself and its beginnings make


def tokens(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    parts, breaks = [], 0
    for a, b in kernel.blocks(buf, kernel.LETTER):
        bounds = np.concatenate([[0], offsets[(offsets > a) & (offsets < b)] - a, [b - a]])
        start, end, own, at = _tokens(buf[a:b], bounds)
        parts.append((start + a, end + a, own, at[:-1] + breaks))
        breaks += int(at[-1])
    if not parts:
        return Tokens(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool), np.zeros((0, OWN), np.int32))
    start, end, own, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.searchsorted(offsets, start, "right") - 1
    first = np.ones(len(start), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
    return Tokens(start, end, owner, first, own)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and features of tokens, and the breaks before each and in all."""
    start, end, _ = kernel.runs(buf, offsets, kernel.LETTER)
    of = kernel.Ranges(kernel.LOWER[buf])
    leads = (buf & 0xC0) != 0x80
    points = np.append(np.flatnonzero(leads), np.full(BEGINNINGS[-1] + 1, len(buf)))
    nth = np.cumsum(leads)[start] - 1 if len(start) else start
    breaks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_BREAK[buf], out=breaks[1:])
    own = np.empty((len(start), OWN), np.int32)
    own[:, 0] = _cell(of(start, end), 0)
    for i, n in enumerate(BEGINNINGS, 1):
        own[:, i] = _cell(of(start, np.minimum(points[nth + n], end)), i)
    return start, end, own, np.append(breaks[start], breaks[-1])


def _cell(h: np.ndarray, i: int) -> np.ndarray:
    return (kernel.mix(h ^ _SALT[i]) >> np.uint64(64 - BITS)).astype(np.int32)


def beside(own: np.ndarray, side: int) -> np.ndarray:
    """The features that words make as the neighbour before (0) or after (1) a token."""
    return _cell(own.astype(np.uint64) + np.uint64(1), OWN + side)


def summed(weight: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Each token's energy from its own weights and those it has as a neighbour."""
    out = sum(weight[:OWN])
    inner = ~first[1:]
    out[1:] += weight[OWN][:-1] * inner
    out[:-1] += weight[OWN + 1][1:] * inner
    return out


def _odds(up: np.ndarray, first: np.ndarray, move: np.ndarray, start: float) -> np.ndarray:
    """r at each token: up * start at a chain's first, then up * (r tt + ot) / (r to + oo)."""
    out = np.empty(len(up))
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(first)))
    blocks = -(-size // SPAN)
    place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(begin, blocks) + place * SPAN
    size = np.minimum(np.repeat(begin + size, blocks) - at, SPAN)
    enter = np.zeros(len(at))  # the odds before each block but a chain's first
    full = np.flatnonzero(np.append(place[1:], 0) > 0)  # blocks that another one follows
    if len(full):
        over = np.tile(np.eye(2), (len(full), 1, 1))
        for t in range(SPAN):
            u = up[at[full] + t]
            step = move * np.stack([np.ones(len(u)), u], 1)[:, None, :]
            if not t:
                head = place[full] == 0
                step[head] = np.stack([np.ones(head.sum()), u[head] * start], 1)[:, None, :]
            over = over @ step
            over /= over.sum((1, 2), keepdims=True)
        order = np.argsort(place[full], kind="stable")  # all first blocks, all second ones, and so on
        cuts = np.searchsorted(place[full][order], np.arange(place.max() + 1))
        for x, y in zip(cuts, cuts[1:], strict=False):
            m, b = over[order[x:y]], full[order[x:y]]
            enter[b + 1] = (m[:, 0, 1] + enter[b] * m[:, 1, 1]) / (m[:, 0, 0] + enter[b] * m[:, 1, 0])
    (oo, ot), (to, tt) = move
    order = np.argsort(-size, kind="stable")
    at, size, place, r = at[order], size[order], place[order], enter[order]
    for t, n in enumerate(np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right").tolist()):
        i = at[:n] + t
        now = (r[:n] * tt + ot) / (r[:n] * to + oo)
        r = out[i] = up[i] * (now if t else np.where(place == 0, start, now))
    return out


def marginals(energy: np.ndarray, first: np.ndarray, move: np.ndarray, start: float, pairs: bool = False):
    """Chance of T for each token by forward-backward, as odds T : O at each step.

    With ``pairs``, also the expected number of moves [from, to] and of starts in T."""
    up = np.exp(np.clip(energy, -30, 30))
    forth = np.exp(move)
    (oo, ot), (to, tt) = forth
    last = np.append(first[1:], True)[: len(first)]
    ahead = _odds(up, first, forth, np.exp(start))
    behind = _odds(up[::-1], last[::-1], forth.T, 1.0)[::-1]  # its own energy with it
    odds = ahead * behind / up
    p = odds / (1 + odds)
    if not pairs:
        return p
    i = np.flatnonzero(~first)
    r, b = ahead[i - 1], behind[i]
    parts = (np.full(len(i), oo), ot * b, r * to, r * tt * b)
    whole = sum(parts)
    return p, np.array([(x / whole).sum() for x in parts]).reshape(2, 2), p[first].sum()


def _numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of all columns, and the columns as their numbers."""
    kinds = np.unique(np.concatenate([np.unique(c) for c in columns]))
    return kinds, [np.searchsorted(kinds, c).astype(np.int32) for c in columns]


def blamed(own: np.ndarray, owner: np.ndarray, toxic: np.ndarray, p: Params = Params()) -> np.ndarray:
    """The features of tokens themselves that toxic texts owe their label to."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    kinds, each = _numbered([own[:, i] for i in range(OWN)])
    met = np.unique(np.concatenate([np.unique(owner * len(kinds) + x) for x in each]))
    text, kind = met // len(kinds), met % len(kinds)
    hit = toxic[text]
    in_toxic, in_clean = (np.bincount(kind[x], minlength=len(kinds)) for x in (hit, ~hit))
    likely = (in_toxic >= 2) & (in_toxic / max(n_toxic, 1) > 20 * (in_clean + 0.5) / (n_clean + 1))
    use = hit & likely[kind]
    text, kind = text[use], kind[use]
    blame = in_toxic.astype(float) ** 2
    for _ in range(p.rounds):
        total = np.bincount(text, blame[kind], minlength=len(toxic))
        blame = np.bincount(kind, blame[kind] / np.maximum(total[text], 1e-300), minlength=len(kinds))
    guilty = blame >= max(p.min_texts, p.min_share * n_toxic)
    # a beginning that one longer beginning or word nearly always stands for gives way to it
    out = guilty.copy()
    for short, long in ((1, 2), (1, 0), (2, 0)):
        a, b = each[short], each[long]
        out[a[guilty[a] & guilty[b] & (in_toxic[b] >= 0.9 * in_toxic[a])]] = False
    return kinds[out]


def learn(own: np.ndarray, first: np.ndarray, tag: np.ndarray, p: Params = Params()) -> Model:
    """Maximum likelihood by AdaGrad over all chains at once."""
    words, word = np.unique(own[:, 0], return_inverse=True)
    word = word.astype(np.int32)
    columns, index = [words], [word]
    for i in range(1, OWN):
        some, at = np.unique(own[:, i], return_inverse=True)
        columns.append(some)
        index.append(at.astype(np.int32))
    # what a word makes of its neighbours, by word
    ids, into = _numbered([*columns, beside(words, 0), beside(words, 1)])
    index += [word, word]
    weight, move, start = np.zeros(len(ids)), np.zeros((2, 2)), 0.0
    inner = np.flatnonzero(~first)
    seen = np.bincount(tag[inner - 1] * 2 + tag[inner], minlength=4).reshape(2, 2)
    began = tag[first].sum()
    # whole chains, some tokens at a time
    begin = np.flatnonzero(first)
    cuts = np.append(begin[np.unique(np.searchsorted(begin, np.arange(0, len(tag), PIECE)).clip(0, max(len(begin) - 1, 0)))], len(tag)) if len(tag) else []
    pieces = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    g2_w, g2_m, g2_s = np.full(len(ids), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(p.steps if len(tag) else 0):
        g, gm, gs = -p.l2 * weight * len(tag), seen.astype(float), float(began)
        own_weight = [weight[x] for x in into]
        sums = [np.zeros(len(x)) for x in into]
        for piece in pieces:
            at, head = [i[piece] for i in index], first[piece]
            prob, moved, starts = marginals(summed([w[i] for w, i in zip(own_weight, at, strict=True)], head), head, move, start, pairs=True)
            left = tag[piece] - prob
            shares = [left] * OWN + [np.append(np.where(head, 0, left)[1:], 0), np.append(0, np.where(head[1:], 0, left[:-1]))]
            for total, i, share in zip(sums, at, shares, strict=True):
                total += np.bincount(i, share, minlength=len(total))
            gm -= moved
            gs -= float(starts)
        for x, total in zip(into, sums, strict=True):
            g += np.bincount(x, total, minlength=len(ids))
        gm[0, 0] = 0  # the scale of the others
        g2_w, g2_m, g2_s = g2_w + g * g, g2_m + gm * gm, g2_s + gs * gs
        weight, move, start = weight + p.rate * g / np.sqrt(g2_w), move + p.rate * gm / np.sqrt(g2_m), start + p.rate * gs / np.sqrt(g2_s)
    known = weight != 0
    return Model(ids[known], weight[known], move, start)


def _sample(docs: DataFrame, labels: DataFrame, p: Params, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_id, _toxic of the rows to learn from: a bounded number, of bounded size."""
    given = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic")).distinct()
    sizes = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("_bytes"))
    found = given.join(sizes.groupBy("_id").agg(F.sum("_bytes").alias("_bytes")).where(F.col("_bytes") <= p.row_bytes), "_id").withColumn("_hash", F.xxhash64("_id"))
    least = lambda toxic, n: found.where(F.col("_toxic") == toxic).orderBy("_hash", "_id").limit(n)
    rows, room = [], p.sample_bytes
    for r in sorted(least(True, p.toxic_rows).unionByName(least(False, p.clean_rows)).collect(), key=lambda r: (r["_hash"], str(r["_id"]), r["_toxic"])):
        if r["_bytes"] <= room:
            rows.append((r["_id"], r["_toxic"]))
            room -= r["_bytes"]
    return docs.sparkSession.createDataFrame(rows, found.select("_id", "_toxic").schema)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from the labelled rows; ``labels`` holds only rows to learn from."""
    some = F.broadcast(_sample(docs, labels, p, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(some, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                x = tokens(*texts(part.column("_text")))
                cut = np.searchsorted(x.owner, np.arange(part.num_rows + 1))
                found = [[v[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] for v in (x.first, x.own)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(f, pa.binary()) for f in found)], schema.names)

    schema = T.StructType([rows.schema["_id"]]).add("_toxic", "boolean").add("first", "binary").add("own", "binary")
    found = rows.select("_id", "_toxic", "_text").mapInArrow(run, schema).collect()
    # rows come in any order; the fit does not depend on it
    found.sort(key=lambda r: (str(r["_id"]), r["_toxic"], bytes(r["own"])))
    toxic = np.array([r["_toxic"] for r in found], bool)
    owner = np.repeat(np.arange(len(found)), [len(r["first"]) for r in found])
    first, own = (np.frombuffer(b"".join(r[c] for r in found), kind) for c, kind in (("first", bool), ("own", np.int32)))
    del found
    return learned(first, own.reshape(-1, OWN), owner, toxic, p) if len(owner) else None


def learned(first: np.ndarray, own: np.ndarray, owner: np.ndarray, toxic: np.ndarray, p: Params = Params()) -> Model | None:
    """A model from tokens, their texts and labels."""
    tag = (np.isin(own, blamed(own, owner, toxic, p)).any(1) & toxic[owner]).astype(np.int8)
    return learn(own, first, tag, p) if tag.any() else None


def score(docs: DataFrame, model: Model | None, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted and spans, array<struct<start, end,
    chance>> in code points, ends exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value.dense() if sent.value else None
        for batch in batches:
            for part in chunks(batch, "_text"):
                n = part.num_rows
                result, spans = np.zeros(n), [[] for _ in range(n)]
                if weight is not None:
                    buf, offsets = texts(part.column("_text"))
                    x = tokens(buf, offsets)
                    makes = [x.own[:, i] for i in range(OWN)] + [beside(x.own[:, 0], side) for side in (0, 1)]
                    energy = summed([weight[m] for m in makes], x.first)
                    chance = marginals(energy, x.first, sent.value.move, sent.value.start)
                    hit = np.flatnonzero(chance >= p.floor)
                    clear = np.bincount(x.owner[hit], np.log1p(-np.minimum(chance[hit], 1 - 1e-12)), minlength=n)
                    result = 0.0 - np.expm1(clear)
                    points = np.zeros(len(buf) + 1, np.int64)
                    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
                    hit = hit[chance[hit] >= 0.5]
                    joined = np.zeros(len(hit), bool)
                    joined[1:] = (hit[1:] == hit[:-1] + 1) & ~x.first[hit[1:]]
                    for i, more in zip(hit.tolist(), joined.tolist(), strict=True):
                        own, base = spans[x.owner[i]], points[offsets[x.owner[i]]]
                        if more:
                            own[-1] |= {"end": int(points[x.end[i]] - base), "chance": max(own[-1]["chance"], float(chance[i]))}
                        else:
                            own.append({"start": int(points[x.start[i]] - base), "end": int(points[x.end[i]] - base), "chance": float(chance[i])})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(result), pa.array((result >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(span))], schema.names)

    kind = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("chance", "double"))
    schema = T.StructType([rows.schema["doc_id"]]).add("score", "double").add("predicted", "integer").add("spans", kind)
    return rows.mapInArrow(run, schema)
