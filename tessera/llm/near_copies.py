"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Shingles: every ``words`` lower-cased words in a row, as 64-bit hashes, each once.

Candidates: rows with one set of shingles are one node. Nodes are compared if SimHash
puts them in one class (``simhash``, on the same shingles, within 4 bits) or if they
agree on all ``rows`` least hashes of one of ``bands`` bands. SimHash alone does not
reach 0.8: such pairs differ in 10 bits and more, where its blocks would be too short
to tell texts apart. A pair at just 0.8 is in no common band with a chance of
(1 - 0.8 ** 4) ** 20, 3 in 100,000, and nearer pairs with less. Groups of the same
nodes are looked at once.

Links: a task has the sets of a group and writes a spanning forest of the pairs that
are similar enough by exact count. Groups over ``LARGE`` nodes are cut into pieces,
and each two pieces meet in a task of their own.

Defined cases: texts without words are copies of each other; texts under ``words``
words are one shingle; one row of each class stays, that of the least doc_id, a null
one last; of repeated ids one row. Rows are told apart by a number of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .kernel import _BASE, LOWER, SPACE, mix, per_text, words
from .shared import SENT_IDS, chunks, table, texts

#: Nodes of a piece of a group.
LARGE = 256


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: Similarity from which texts are near copies, in hundredths.
    percent: int = 80
    bands: int = 20
    rows: int = 4


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, end to end, and n + 1 bounds."""
    buf, n = LOWER[buf], len(offsets) - 1
    _, _, owner, word = words(buf, offsets, ~SPACE)
    count = per_text(owner, n)
    first = np.cumsum(count) - count
    full = np.flatnonzero(owner[: max(0, len(word) - width + 1)] == owner[width - 1 :])
    few = np.flatnonzero((count > 0) & (count < width))
    at, owner = np.concatenate([full, first[few]]), np.concatenate([owner[full], few])
    size = np.minimum(count[owner], width)
    key = np.zeros(len(at), np.uint64)
    for j in range(width):
        more = j < size
        key[more] = key[more] * np.uint64(_BASE) + word[at[more] + j]
    key = mix(key ^ size.astype(np.uint64))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.concatenate([[0], np.cumsum(per_text(owner[new], n))])


def _reduced(f: np.ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``f`` over each part of ``values``; 0 for an empty one."""
    out, has = np.zeros(len(bounds) - 1, np.uint64), bounds[1:] > bounds[:-1]
    if has.any():
        out[has] = f.reduceat(values, bounds[:-1][has])
    return out


def bands(key: np.ndarray, bounds: np.ndarray, p: Params) -> np.ndarray:
    """Per text, a hash of each band's least hashes."""
    rng = np.random.default_rng(80)
    out = np.zeros((len(bounds) - 1, p.bands), np.uint64)
    for b in range(p.bands):
        for _ in range(p.rows):
            times, plus = rng.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            out[:, b] = mix(out[:, b] * np.uint64(_BASE) + _reduced(np.minimum, key * times + plus, bounds))
        out[:, b] = mix(out[:, b] + np.uint64(b))
    return out


def _listed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _marked(rows: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """Per row: its number, doc_id, SimHash fingerprint, node and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                key, bounds = shingles(*texts(part.column(2)), p.words)
                node = mix(_reduced(np.add, mix(key), bounds) ^ np.diff(bounds).astype(np.uint64))
                found = bands(key, bounds, p)
                fp = np.array([simhash.fingerprint(x.as_buffer().to_pybytes(), p.words) for x in part.column(2)], np.uint64)
                columns = [part.column(0), part.column(1), pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), _listed(found.reshape(-1), np.arange(len(found) + 1) * p.bands)]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "fp", "node", "bands"])

    given = rows.select("_row", F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = T.StructType([given.schema["_row"], given.schema["doc_id"]])
    return given.mapInArrow(run, kinds.add("fp", "long").add("node", "long").add("bands", T.ArrayType(T.LongType())))


def _sets(rows: DataFrame, firsts: DataFrame, p: Params, text_col: str) -> DataFrame:
    """node, shingles: the sets of the rows that ``firsts(_row, node)`` names."""
    given = rows.select("_row", F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(_sent(firsts), "_row").select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _listed(*shingles(*texts(part.column(1)), p.words))], ["node", "shingles"])

    return given.mapInArrow(run, T.StructType([given.schema["node"]]).add("shingles", T.ArrayType(T.LongType())))


def forest(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of set numbers) of a spanning forest of the sets that are similar enough."""
    distinct, dense = np.unique(values, return_inverse=True)
    size, has = np.diff(bounds), np.zeros(len(distinct), bool)
    unseen = np.ones(len(size), bool)
    a, b, queue = [], [], []
    for first in range(len(size)):
        if not unseen[first]:
            continue
        unseen[first] = False
        queue.append(first)
        while queue and unseen.any():
            at = queue.pop()
            own = dense[bounds[at] : bounds[at + 1]]
            has[own] = True
            sums = np.concatenate([[0], np.cumsum(has[dense])])
            has[own] = False
            both = sums[bounds[1:]] - sums[bounds[:-1]]
            near = np.flatnonzero(unseen & (100 * both >= percent * (size + size[at] - both)))
            unseen[near] = False
            a += [at] * len(near)
            b += near.tolist()
            queue += near.tolist()
        queue.clear()
    return np.array(a, np.int64), np.array(b, np.int64)


def _groups(marked: DataFrame, p: Params, large: int) -> DataFrame:
    """g, node: the sets to compare with each other."""
    pairs = table(marked.select("fp", "node").distinct(), "nodes")
    roots = simhash.components(simhash.links(pairs.select("fp").distinct(), simhash.Params(words=p.words)))
    same = pairs.join(roots, "fp", "left").select(F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("key"), "node")
    keys = same.unionByName(marked.select(F.explode("bands").alias("key"), "node")).distinct()
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    once = sizes.groupBy("n", "members").agg(F.min("key").alias("key"))
    members = keys.join(once, "key").withColumn("pieces", F.ceil(F.col("n") / large).cast("int"))
    mine = F.pmod(F.xxhash64(F.col("node")), F.col("pieces")).cast("int")
    met = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node")


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


def links(rows: DataFrame, marked: DataFrame, p: Params = Params(), text_col: str = "text", large: int = LARGE) -> DataFrame:
    """u, v (u < v): nodes; edges whose components are those of all near pairs."""
    groups = table(_groups(marked, p, large), "groups")
    firsts = marked.groupBy("node").agg(F.min("_row").alias("_row")).join(groups.select("node").distinct(), "node", "left_semi")
    sets = _sets(rows, table(firsts.select("_row", "node"), "firsts"), p, text_col)
    dealt = groups.join(sets, "node").select("g", "node", "shingles").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(group: pa.RecordBatch) -> pa.RecordBatch:
            values, node = group.column(2), group.column(1).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())]).astype(np.int64)
            a, b = forest(values.flatten().to_numpy(), bounds, p.percent)
            a, b = node[a], node[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            g = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist()
            for x, y in zip(cut, cut[1:], strict=False):
                yield done(batch.slice(x, y - x))
            rest = batch.slice(cut[-1]) if cut else None
        if rest is not None:
            yield done(rest)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def representatives(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """One row of ``docs`` for each class of near copies, with all its columns."""
    rows = table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    marked = table(_marked(rows, p, id_col, text_col), "marked")
    least = marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
    roots = simhash.components(links(rows, marked, p, text_col, large)).withColumnRenamed("fp", "node")
    rooted = table(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least._row").alias("kept"))
    named = rooted.join(kept, "root").select("node", "kept")
    others = table(marked.join(named, "node").where("_row <> kept").select("_row"), "others")
    return rows.join(_sent(others), "_row", "left_anti").select(*docs.columns)
