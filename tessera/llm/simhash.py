"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: XXH64 (seed 42) of every shingle of ``words`` lower-cased words,
repeats included; a bit is set if it is set in over half of them.

Links: two fingerprints within ``distance`` bits, cut into b blocks, agree on at
least b - distance blocks. Every distinct fingerprint is dealt to a bucket for each
choice of b - distance blocks (for 4 bits and 6 blocks: 15 choices of 2 blocks, 21
or 22 bits), so each close pair meets in a bucket. A task verifies the Hamming
distances in its buckets and writes a spanning forest, never all pairs. Buckets
over ``LARGE`` fingerprints are cut into pieces, and each two pieces meet in a task
of their own. More blocks make finer buckets with the same links, so their number is
chosen by that of the fingerprints (unless it is given).

Components: alternating large-star and small-star steps over tables in the shared
folder, until no edge changes. A hot vertex is met by partial aggregation and a
join whose skewed partitions Spark splits.

Exact copies are one fingerprint before any link is looked for.

Defined cases: a null or wordless text has fingerprint 0, linked like any other;
texts under ``words`` words are one shingle; repeated rows get the same class; a
null id is never the class unless its class has no other; a bit set in just half of
the hashes is 0; a very long text is taken in blocks of words; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SENT_IDS, chunks, table

#: Bytes of a text whose words are taken at once, up to the end of a word.
BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Members of a bucket that one task compares with each other.
LARGE = 4096
#: Members of an average bucket at most.
FULL = 512
#: Runs up to this length are compared by shifts, all runs at once.
SHORT = 48


@dataclass(frozen=True)
class Params:
    words: int = 4
    distance: int = 4
    blocks: int | None = None


def fingerprint(text: bytes, words: int = 4) -> int:
    w: list[bytes] = []  # of a block of the text, after the last words of the one before
    ones, n, at = np.zeros(64, np.int64), 0, 0
    while at < len(text):
        end = _BLANK.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        to = end.start() if end else len(text)
        w = w[len(w) - words + 1 :] if len(w) >= words else w
        w += text[at:to].lower().split()
        at = to
        if len(w) >= words:
            h = _hashed(w, words)
            ones, n = ones + _ones(h), n + len(h)
    if not n:
        if not w:
            return 0
        ones, n = _ones(_hashed(w, len(w))), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hashed(w: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every ``size`` words in a row."""
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        out += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fp, the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                out = np.array([fingerprint(x.as_buffer().to_pybytes(), p.words) for x in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"]]).add("fp", "long"))


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks, from ``distance`` + 2 on, whose buckets have ``FULL`` of n fingerprints on average."""
    return next((b for b in range(distance + 2, distance + 6) if n >> (64 * (b - distance) // b) <= FULL), distance + 6)


def widths(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints within ``distance``: each
    one found takes all unseen ones near it out of the search."""
    left, rights, edges = fp, [], []
    queue: list[np.uint64] = []
    while len(left) or queue:
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(left ^ at) <= distance
        if near.any():
            found = left[near]
            edges.append(np.full(len(found), at, np.uint64))
            rights.append(found)
            queue.extend(found)
            left = left[~near]
        elif not queue and len(left) < 2:
            break
    return (np.concatenate(edges), np.concatenate(rights)) if edges else (np.zeros(0, np.uint64),) * 2


def _thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (of row numbers) that join two trees not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            parent[y] = x
            keep[i] = True
    return a[keep], b[keep]


def bucket_edges(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of all runs of equal ``group``."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    small = np.repeat(size <= SHORT, size)
    pairs_a, pairs_b = [], []
    for d in range(1, int(size[size <= SHORT].max(initial=1))):
        near = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= distance]
        pairs_a.append(near)
        pairs_b.append(near + d)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs_a, pairs_b))
    a, b = _thinned(a, b)
    out = [(fp[a], fp[b])] + [forest(fp[c : c + n], distance) for c, n in zip(cut.tolist(), size.tolist(), strict=True) if n > SHORT]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def links(fps: DataFrame, p: Params = Params(), large: int = LARGE) -> DataFrame:
    """u, v (u < v): edges whose components are those of all close pairs of ``fp``."""
    blocks = p.blocks or blocks_for(fps.count(), p.distance)
    cuts = widths(blocks)
    value = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for at, w in cuts]
    choices = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - p.distance)):
        choices.append(F.xxhash64(F.lit(n), *(value[i] for i in chosen)))
    keys = fps.select("fp", F.explode(F.array(*choices)).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(sizes, "bucket").withColumn("pieces", F.ceil(F.col("n") / large).cast("int"))
    mine = F.pmod(F.xxhash64(F.col("fp")), F.col("pieces")).cast("int")
    # a bucket of one piece is one group; else a piece meets every piece
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    met = members.withColumn("mine", mine).withColumn("other", other)
    grouped = met.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp")
    # groups that share a hash are compared as one, which adds work but no wrong edge
    dealt = grouped.repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_edges(g, fp, p.distance)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        for batch in batches:
            g = np.concatenate([g, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(g):
                last = int(np.searchsorted(g, g[-1]))
                if last:
                    yield done(g[:last], fp[:last])
                g, fp = g[last:], fp[last:]
        if len(g):
            yield done(g, fp)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """fp, root for every end of an edge; the root is the least of its component."""
    now = table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each edge leads from a vertex to a smaller one
        down = table(large, "edges")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = table(small.where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the least id
    of the rows reachable over links."""
    marked = table(fingerprints(docs, p, id_col, text_col), "fingerprints")
    least = table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), p, large))
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the least id, a
    null one last, and of repeated ids one row. Rows are told apart by a number of their own."""
    rows = table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col("_row").alias("doc_id"), F.col(id_col).alias("_id"))
    named = table(classes(rows, p, "_row", text_col).join(ids, "doc_id").select("doc_id", "_id", "component_id"), "named")
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "doc_id")).alias("least"))
    others = table(named.join(least, "component_id").where("doc_id <> least.doc_id").select(F.col("doc_id").alias("_row")), "others")
    others = F.broadcast(others) if others.count() <= SENT_IDS else others.hint("merge")
    return rows.join(others, "_row", "left_anti").select(*docs.columns)
