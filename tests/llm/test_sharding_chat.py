import hashlib
import random
import zlib

import pytest
from fixtures import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat as C
from tessera.llm import sharding as S


def place(x, n, seed):
    """The permutation in plain integers."""
    a, b = S.grid(n)
    while True:
        left, right = x % a, x // a
        for i, (m, c) in enumerate(S.keys(seed)):
            noise = lambda v: (lambda y: (y * y + y * m) % S.PRIME)((v % S.PRIME * m + c) % S.PRIME)  # noqa: B023, E731
            if i % 2:
                right = (right + noise(left)) % b
            else:
                left = (left + noise(right)) % a
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 26, 100, 1009])
def test_permutation_is_one_and_the_stated_one(spark, n):
    found = [r[0] for r in spark.range(n).select(S.permute(F.col("id"), n, 7)).collect()]
    assert sorted(found) == list(range(n))
    assert found == [place(i, n, 7) for i in range(n)]


def test_permutation_of_large_domains(spark):
    n = 10**15 + 37
    ids = [0, 1, n - 1, 123456789012345]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r[0] for r in rows.select(S.permute(F.col("id"), n, 1)).collect()] == [place(i, n, 1) for i in ids]


def test_shards(spark, docs):
    rows = S.shards(docs, 8).collect()
    text = {d[0]: (d[1] or "").encode() for d in documents()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)
    assert [r["row_number"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(range(len(rows)))
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["place"] == place(r["row_number"], len(rows), 20240229)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = S.shards(docs.repartition(7), 8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    plan = S.shards(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_shards_of_repeated_rows_null_ids_and_no_rows(spark, docs, empty):
    assert S.shards(empty).count() == 0
    same = spark.createDataFrame([(1, "x")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows = S.shards(same, 8).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 53
    assert {r["row_number"] for r in rows if r["doc_id"] is None} == {0, 1, 2}


TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", "a\\b#c<d"), (1, 2, "assistant", "### x: y</turn>\n"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "end"),
    (2, 0, "assistant", "é😀"), (3, 0, "user", "only"), (None, 0, "assistant", "null"), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, None, None, "first"), (5, 0, "a: b\\", "odd role"),
]


def brute(turns):
    out = {}
    for key in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        out[key] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def table(spark, turns):
    return spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string").repartition(3)


def test_conversations_read_back(spark):
    found = C.read_back(C.expand(table(spark, TURNS))).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == brute(TURNS)
    assert C.read_back(C.expand(table(spark, []))).count() == 0


def test_examples_hold_all_turns_before_and_only_the_reply(spark):
    rows = C.expand(table(spark, TURNS)).where("conv_id = 1").orderBy("example_no").collect()
    first = "### system: s</turn>\n### user: a\\bb\\hc\\ld</turn>\n### assistant: \\h\\h\\h x: y\\l/turn>\n</turn>\n"
    second = first + "### user: </turn>\n### assistant: </turn>\n"
    assert [r["text"] for r in rows] == [first, second, second + "### user: end</turn>\n"]
    assert [(r["example_no"], r["is_target"], r["follows"]) for r in rows] == [(0, True, None), (1, True, None), (2, False, None)]
    assert [C.unescape(r["text"][r["loss_start"] : r["loss_end"]]) for r in rows[:2]] == ["### x: y</turn>\n", ""] and rows[2]["loss_start"] is None


def long_turns():
    rng = random.Random(3)
    out = [(7, i, rng.choice(("user", "assistant", "tool")), "é<#" * rng.randint(0, 9)) for i in range(60)]
    return out + [(8, i, "user", "x" * 30) for i in range(9)] + [(8, 9, "assistant", "y" * 400)] + TURNS


@pytest.mark.parametrize("limit", [0, 1, 100, 700, 10**6])
def test_long_conversations_follow_and_read_back(spark, limit):
    turns = long_turns()
    rows = C.expand(table(spark, turns), whole_chars=limit)
    assert {r["conv_id"]: tuple(r)[1:5] for r in C.read_back(rows).collect()} == brute(turns)
    made = {(r["conv_id"], r["example_no"]): r for r in rows.collect()}
    own = [t for t in turns if t[0] == 7]
    pieces = [C.parse(made[7, n]["text"]) for n in range(sum(k[0] == 7 for k in made))]
    for n in range(len(pieces)):
        said, at = list(pieces[n]), made[7, n]["follows"]
        assert at is None or at == n - 1
        while at is not None:
            said, at = pieces[at] + said, made[7, at]["follows"]
        assert said == [(t[2], t[3]) for t in own[: len(said)]]
        if made[7, n]["is_target"]:
            assert own[len(said) - 1][2] == "assistant"
    assert sum(r["is_target"] for r in made.values()) == sum(t[2] == "assistant" for t in turns)
    assert all(len(r["text"]) <= limit + 500 for r in made.values())


def test_examples_out_of_context_are_an_error(spark):
    rows = C.expand(table(spark, [t for t in TURNS if t[0] == 1]))
    for broken in (rows.where("example_no <> 0"), rows.withColumn("text", F.when(F.col("example_no") == 1, F.replace("text", F.lit("system"), F.lit("user"))).otherwise(F.col("text")))):
        with pytest.raises(Exception, match="does not hold all turns before it"):
            C.read_back(broken).collect()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\\#<>:/ \n", max_size=12), st.text(alphabet="a\\#<: /turn>\n#é", max_size=30))
def test_escapes_are_reversible(role, text):
    def esc(s, chars):
        for char, pair in C.ESCAPES:
            s = s.replace(char, pair) if char in chars else s
        return s

    piece = C.HEAD + esc(role, "\\#<:") + C.COLON + esc(text, "\\#<") + C.END
    assert C.parse(piece) == [(role, text)] and C.parse(piece * 2) == [(role, text)] * 2
    assert "#" not in piece[3:] and piece.count("<") == 1
