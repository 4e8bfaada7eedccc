from fixtures import frame

from tessera.llm import simhash as S


def test_one_row_per_class_with_null_and_repeated_ids(spark):
    rows = [(d, t, "en", "s", 0, 0) for d, t in [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "x y"), (None, "x y"), (7, "one two"), (9, "one two")]]
    found = S.representatives(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in found) == [("7", "a b c d e"), ("7", "one two"), ("None", "x y")]
