"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 by id (ties by size and checksum; rows equal in all of
these are interchangeable). The permutation acts on pairs (left, right) of a grid
of a x b cells, a = ceil(sqrt n), b = ceil(n / a): rounds add a keyed function of
one half to the other, modulo its range, which is a bijection. A number that lands
at n or above walks on along its cycle until it is below n. The place p it reaches
gives shard p mod shards and slot p div shards, so counts differ by one at most and
slots have no gaps; anyone can compute them from (row number, n, seed) alone.

Built from DataFrame functions only. Numbering needs no window: a range partitioned
and sorted table gives each row its partition and place there, and the counts of
the partitions (as many rows as partitions) give the offsets.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids come
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Modulus of the round function, a prime: 2 * PRIME**2 is under 2**63.
PRIME = 2147483629
ROUNDS = 8
#: Steps of a walk. It stays outside for fewer steps than the grid has cells over n,
#: so under 64 for n <= 4096; beyond, each step ends it with chance 1 - 1 / sqrt(n) or more.
WALK = 64


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(rounds)]


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _noise(x: Column, key: Column) -> Column:
    y = (x % _long(PRIME) * key["m"] + key["c"]) % _long(PRIME)
    return (y * y + y * key["m"]) % _long(PRIME)


def permute(number: Column, n: int, seed: int) -> Column:
    """The place, 0 to n - 1, of a row number, 0 to n - 1."""
    a, b = (_long(v) for v in grid(n))
    rounds = F.array(*[F.struct(_long(m).alias("m"), _long(c).alias("c"), F.lit(i % 2 == 1).alias("odd")) for i, (m, c) in enumerate(keys(seed))])

    def turn(s: Column, key: Column) -> Column:
        left = F.when(key["odd"], s["left"]).otherwise((s["left"] + _noise(s["right"], key)) % a)
        right = F.when(key["odd"], (s["right"] + _noise(s["left"], key)) % b).otherwise(s["right"])
        return F.struct(left.alias("left"), right.alias("right"))

    def once(x: Column) -> Column:
        halves = F.struct((x % a).alias("left"), F.call_function("div", x, a).alias("right"))
        return F.aggregate(rounds, halves, turn, lambda s: s["right"] * a + s["left"])

    def step(s: Column, _: Column) -> Column:
        return F.when(s["moved"] & (s["x"] < _long(n)), s).otherwise(F.struct(once(s["x"]).alias("x"), F.lit(True).alias("moved")))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(number.alias("x"), F.lit(False).alias("moved")), step, lambda s: s["x"])
    return F.when(walk < _long(n), walk).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long"))


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, row_number, place, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32", "_at"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id of the input row spreads equal rows over partitions; after the sort the same function numbers each partition
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = table(dealt.drop("_at").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(_long((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    n, firsts = 0, []
    for p, c in counts:
        firsts.append((p, n))
        n += c
    offsets = spark.createDataFrame(firsts, "_part long, _first long")
    p = permute(F.col("row_number"), n, seed)
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select("doc_id", "size", "text_crc32", (F.col("_first") + place).alias("row_number"))
        .withColumn("place", p)
        .withColumn("shard", (F.col("place") % n_shards).cast("int"))
        .withColumn("slot", F.call_function("div", F.col("place"), _long(n_shards)))
    )
