"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased, as a 128-bit hash. Two tables are kept:

* ``refs``: key, document and the number of rows of that document that hold the key.
  Inserting documents adds counts; deleting them subtracts, and rows at zero go. So
  deleting what was inserted restores the table, whatever happened in between.
* ``filters``: per shard of the key space, a cuckoo filter of the keys found in at
  least ``min_docs`` documents. Keys that reach the limit are inserted, keys that
  fall below it are deleted.

A change works on the shards that its documents have keys in: their references are
read (files are in order of shard, so others are skipped), counted and written anew,
and so are their filters. ``save`` writes an index to a folder and ``load`` reads it
again, so a later job can delete what an earlier one inserted.

A repeated key loses its lines except in the largest doc_id holding it. The filters
let most lines pass without a look at the exact counts: lines whose key is in no
filter stay, and the exact counts settle the rest, false positives among them.
While filters and repeated keys take at most ``broadcast_bytes``, they are sent to
all tasks and texts are rewritten in one pass without a shuffle. Beyond that,
references meet the filters (all of them sent if they are that small, else each shard's
in the tasks that have its references), what is in one meets the exact counts by a
join, and texts meet their lost keys by another. Results are the same.

Hot keys: counts are pre-aggregated, a shard's references are dealt to ``PIECES`` tasks
by document, and the join on keys is one that Spark splits.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code
points never count; a document that holds a key often counts once; rows of one id
are one document, and rows of a null id too, which is never the largest beside
others; deleting what was not inserted has no effect; a very long text is split whole
by one task; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, table

#: Tasks that the references of a shard are dealt to.
PIECES = 16
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4


@dataclass(frozen=True)
class Params:
    min_chars: int = 40
    min_docs: int = 5
    shards: int = 64
    broadcast_bytes: int = 16 << 20


class CuckooFilter:
    """Segments of buckets of four 16-bit marks; a full segment gets a larger next one."""

    def __init__(self, capacity: int = 64, data: bytes | None = None) -> None:
        self.segments: list[np.ndarray] = []
        if data is None:
            self._grow(capacity)
        else:
            at = 0
            while at < len(data):
                (n,) = struct.unpack_from("<q", data, at)
                self.segments.append(np.frombuffer(data, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
                at += 8 + 2 * n * SLOTS

    def _grow(self, capacity: int) -> None:
        self.segments.append(np.zeros((1 << max(2, (int(capacity / 0.85) // SLOTS).bit_length()), SLOTS), np.uint16))

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<q", len(s)) + s.tobytes() for s in self.segments)

    @staticmethod
    def _places(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(key & np.uint64(0xFFFF), np.uint64(1))
        one = (key >> np.uint64(16)) & np.uint64(buckets - 1)
        return mark.astype(np.uint16), one, one ^ ((mark * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64(buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for s in self.segments:
            mark, one, two = self._places(keys, len(s))
            out |= (s[one] == mark[:, None]).any(1) | (s[two] == mark[:, None]).any(1)
        return out

    def add(self, keys: np.ndarray) -> None:
        for key in self._fill(self.segments[-1], keys):
            if not self._put(self.segments[-1], key):
                self._grow(4 * SLOTS * len(self.segments[-1]))
                self._put(self.segments[-1], key)

    def _fill(self, s: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Put keys where either of their buckets has room; the rest is returned."""
        for choice in (0, 1):
            mark, *places = self._places(keys, len(s))
            order = np.argsort(places[choice], kind="stable")
            keys, mark, at = keys[order], mark[order], places[choice][order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            slots = np.argsort(s[at] != 0, axis=1, kind="stable")  # free ones first
            fits = rank < (s[at] == 0).sum(1)
            s[at[fits], slots[fits, rank[fits]]] = mark[fits]
            keys = keys[~fits]
        return keys

    def _put(self, s: np.ndarray, key: np.uint64) -> bool:
        marks, one, two = self._places(np.array([key], np.uint64), len(s))
        mark, at, other = marks[0], int(one[0]), int(two[0])
        trail = []
        for turn in range(200):
            for b in (at, other) if not turn else (at,):
                if len(free := np.flatnonzero(s[b] == 0)):
                    s[b, free[0]] = mark
                    return True
            slot = turn % SLOTS
            trail.append((at, slot, s[at, slot]))
            mark, s[at, slot] = s[at, slot], mark
            at ^= int((int(mark) * 0x9E3779B97F4A7C15 % 2**64 >> 32) & (len(s) - 1))
        for b, slot, was in reversed(trail):  # as it was: no key is lost
            s[b, slot] = was
        return False

    def remove(self, keys: np.ndarray) -> None:
        for key in keys:
            for s in reversed(self.segments):
                marks, one, two = self._places(np.array([key], np.uint64), len(s))
                hits = [(b, h[0]) for b in (int(one[0]), int(two[0])) if len(h := np.flatnonzero(s[b] == marks[0]))]
                if hits:
                    s[hits[0]] = 0
                    break


class Probe:
    """Whether keys are in the filter of their shard."""

    def __init__(self, data: dict[int, bytes], shards: int) -> None:
        self.filters, self.shards = {s: CuckooFilter(data=d) for s, d in data.items()}, shards

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard, hit = np.mod(k1, self.shards), np.zeros(len(k1), bool)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, f in self.filters.items():
            if len(own := order[cuts[s] : cuts[s + 1]]):
                hit[own] = f.contains(k2[own].view(np.uint64))
        return hit


class Exact:
    """Repeated keys in order, with the document that holds each."""

    def __init__(self, rows: list[tuple]) -> None:
        rows.sort(key=lambda r: r[:2])
        self.k1, self.k2 = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.holder = [r[2] for r in rows]

    def find(self, k1: int, k2: int) -> int | None:
        at = int(np.searchsorted(self.k1, k1))
        while at < len(self.k1) and self.k1[at] == k1:
            if self.k2[at] == k2:
                return at
            at += 1
        return None


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's 128-bit hash, or None if the key is under ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def keyed(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2: each row's distinct keys."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "_text")):
            owner, keys = [], []
            for i, text in enumerate(batch.column(1)):
                own = {line_key(x, p.min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")} - {None}
                owner += [i] * len(own)
                keys += own
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc_id", "k1", "k2"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"]]).add("k1", "long").add("k2", "long"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """The tables; ``insert`` and ``delete`` return the index after the change.

    refs: shard, k1, k2, doc_id, n. repeated: shard, k1, k2, holder. filters: shard, data."""

    refs: DataFrame
    repeated: DataFrame
    filters: DataFrame
    params: Params
    blank: bool = False

    @staticmethod
    def empty(spark: SparkSession, id_type: T.DataType, p: Params = Params()) -> LineIndex:
        key = T.StructType().add("shard", "integer").add("k1", "long").add("k2", "long")
        refs = T.StructType([*key.fields, T.StructField("doc_id", id_type), T.StructField("n", T.LongType())])
        repeated = T.StructType([*key.fields, T.StructField("holder", id_type)])
        return LineIndex(spark.createDataFrame([], refs), spark.createDataFrame([], repeated), spark.createDataFrame([], "shard int, data binary"), p, True)

    @staticmethod
    def over(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """An index of ``docs``, with more shards for inputs of many partitions."""
        p = replace(p, shards=max(p.shards, docs.rdd.getNumPartitions() // 64))
        return LineIndex.empty(docs.sparkSession, docs.schema[id_col].dataType, p).insert(docs, id_col, text_col)

    def save(self, folder: str) -> None:
        """Write the index to a folder that does not exist yet."""
        self.refs.sortWithinPartitions("shard", "k1", "k2").write.parquet(f"{folder}/refs")
        self.repeated.write.parquet(f"{folder}/repeated")
        self.filters.write.parquet(f"{folder}/filters")
        self.refs.sparkSession.createDataFrame([tuple(asdict(self.params).values())], ", ".join(f"{k} long" for k in asdict(self.params))).coalesce(1).write.parquet(f"{folder}/params")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineIndex:
        p = spark.read.parquet(f"{folder}/params").first()
        return LineIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("refs", "repeated", "filters")), Params(**p.asDict()))

    def _changed(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> LineIndex:
        p = self.params
        delta = keyed(docs, p, id_col, text_col).select(shard_of(p.shards).alias("shard"), "k1", "k2", "doc_id", F.lit(sign).cast("long").alias("n"))
        old, filters = (self.refs, self.repeated), self.filters
        rest = None
        if not self.blank:
            delta = table(delta, "delta")
            touched = [r["shard"] for r in delta.select("shard").distinct().collect()]  # at most ``shards``
            mine = F.col("shard").isin(touched)
            old, rest = [t.where(mine) for t in old], [t.where(~mine) for t in (self.refs, self.repeated, filters)]
            filters = filters.where(mine)
        refs = old[0].unionByName(delta).groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        refs = table(refs.sortWithinPartitions("shard", "k1", "k2"), "refs")
        counts = refs.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder"))
        repeated = table(counts.where(F.col("docs") >= p.min_docs).select("shard", "k1", "k2", "holder"), "repeated")
        filters = table(self._filtered(old[1], repeated, filters), "filters")
        if rest:
            refs, repeated, filters = (a.unionByName(b) for a, b in zip(rest, (refs, repeated, filters), strict=True))
        return LineIndex(refs, repeated, filters, p)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._changed(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._changed(docs, -1, id_col, text_col)

    @staticmethod
    def _filtered(before: DataFrame, after: DataFrame, filters: DataFrame) -> DataFrame:
        """The filters after keys came into or left the repeated ones."""
        signed = lambda t, d: t.select("shard", "k1", "k2", F.lit(d).alias("d"))
        change = signed(after, 1).unionByName(signed(before, -1)).groupBy("shard", "k1", "k2").agg(F.sum("d").alias("d")).where("d <> 0").select("shard", "k2", "d")

        def run(old: pa.Table, new: pa.Table) -> pa.Table:
            if not new.num_rows:
                return old
            keys, d = new["k2"].to_numpy().view(np.uint64), new["d"].to_numpy()
            f = CuckooFilter(data=old["data"][0].as_py()) if old.num_rows else CuckooFilter(int((d > 0).sum()))
            f.remove(keys[d < 0])
            f.add(keys[d > 0])
            return pa.table({"shard": pa.array([new["shard"][0].as_py()], pa.int32()), "data": pa.array([f.to_bytes()], pa.binary())})

        return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(run, "shard int, data binary")

    def _filter_bytes(self) -> int:
        return self.filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0

    def _sent(self):
        return self.filters.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in self.filters.collect()})

    def suspects(self, refs: DataFrame) -> DataFrame:
        """The references (k1, k2, doc_id) whose key is in the filter of its shard."""
        p = self.params
        if self._filter_bytes() <= p.broadcast_bytes:
            sent = self._sent()

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                probe = Probe(sent.value, p.shards)
                for batch in batches:
                    yield batch.filter(pa.array(probe(batch.column(0).to_numpy(), batch.column(1).to_numpy())))

            return refs.select("k1", "k2", "doc_id").mapInArrow(run, refs.select("k1", "k2", "doc_id").schema)
        # each shard's filter goes before its references, to every task that has some
        piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int")
        own = refs.select("k1", "k2", "doc_id", shard_of(p.shards).alias("shard"), piece.alias("piece"), F.lit(None).cast("binary").alias("data"))
        kind = {f.name: f.dataType for f in own.schema.fields}
        none = lambda c: F.lit(None).cast(kind[c]).alias(c)
        first = self.filters.select(none("k1"), none("k2"), none("doc_id"), "shard", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"), "data")
        dealt = own.unionByName(first).repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("data").isNull())

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, f = None, None
            for batch in batches:
                shard, k2 = batch.column(3).to_numpy(), batch.column(1).fill_null(0).to_numpy().view(np.uint64)
                heads, hit = batch.column(5).is_valid().to_numpy(zero_copy_only=False), np.zeros(len(shard), bool)
                cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | heads[1:]])).tolist() if len(shard) else []
                for x, y in zip(cut, [*cut[1:], len(shard)], strict=True):
                    if heads[x]:
                        at, f = shard[x], CuckooFilter(data=batch.column(5)[x].as_py())
                        x += 1
                    if at == shard[y - 1]:  # else nothing of the shard is repeated
                        hit[x:y] = f.contains(k2[x:y])
                yield pa.RecordBatch.from_arrays(batch.columns[:3], ["k1", "k2", "doc_id"]).filter(pa.array(hit))

        return dealt.mapInArrow(join, own.select("k1", "k2", "doc_id").schema)

    def drops(self) -> DataFrame:
        """doc_id, keys: the keys whose lines a document loses."""
        lost = self.suspects(self.refs).join(self.repeated, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def _applied(self, docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
        """_row, _kept (what stays of the text), _n and _gone (lines), for each row."""
        p = self.params
        rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        held = self.repeated.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("holder").cast("string"))), F.lit(0)).alias("bytes")).first()
        small = self._filter_bytes() + 24 * held["n"] + held["bytes"] <= p.broadcast_bytes
        if small:
            filters = self._sent()
            exact = self.filters.sparkSession.sparkContext.broadcast(Exact([tuple(r) for r in self.repeated.select("k1", "k2", "holder").collect()]))
        else:
            lost = self.drops().select(F.col("doc_id").alias("_lost_by"), F.col("keys").alias("_keys"))
            rows = rows.join(lost.hint("merge"), F.col("_id").eqNullSafe(F.col("_lost_by")), "left").select("_row", "_keys", "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe(filters.value, p.shards) if small else None
            for batch in (part for whole in batches for part in chunks(whole, "_text")):
                split = [x.as_buffer().to_pybytes().split(b"\n") for x in batch.column(2)]
                if small:
                    at = [(i, j, key) for i, own in enumerate(split) for j, x in enumerate(own) if (key := line_key(x, p.min_chars))]
                    k = np.frombuffer(b"".join(key for _, _, key in at), "<i8").reshape(-1, 2)
                    holder, ids, gone = exact.value.holder, batch.column(1), [set() for _ in split]
                    for n in np.flatnonzero(probe(k[:, 0], k[:, 1])).tolist():
                        i, j, _ = at[n]
                        row = exact.value.find(*k[n].tolist())
                        if row is not None and holder[row] != ids[i].as_py():
                            gone[i].add(j)
                else:
                    gone = []
                    for own, keys in zip(split, batch.column(1), strict=True):
                        lost_keys = {struct.pack("<qq", x["k1"], x["k2"]) for x in keys.as_py() or ()}
                        gone.append({j for j, x in enumerate(own) if line_key(x, p.min_chars) in lost_keys} if lost_keys else set())
                kept = [b"\n".join(x for j, x in enumerate(own) if j not in out) if out else b"\n".join(own) for own, out in zip(split, gone, strict=True)]
                counts = [pa.array([len(x) for x in some], pa.int64()) for some in (split, gone)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).view(pa.string()), *counts], ["_row", "_kept", "_n", "_gone"])

        return rows.mapInArrow(run, T.StructType([rows.schema["_row"]]).add("_kept", "string").add("_n", "long").add("_gone", "long"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, text (what stays), n_lines and n_dropped for each row of ``docs``, which
        the index holds."""
        out = self._applied(docs, F.struct(F.col(id_col).alias("doc_id")), id_col, text_col)
        return out.select("_row.doc_id", F.col("_kept").alias("text"), F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"))

    def rewritten(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` with what stays of their texts, other columns as they are."""
        out = self._applied(docs, F.struct(*(F.col(c) for c in docs.columns if c != text_col)), id_col, text_col)
        return out.select(*(F.col("_kept").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
