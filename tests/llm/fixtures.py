"""Small documents with every awkward case, and plain restatements of the rules."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
SHARED = "This line of well over forty characters is shared by many documents."

_SYLLABLES = "an be co di el fo gu ha in jo ka lu mé no ör pa qui ra su ti".split()


def words(n, rng):
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars, n_words): the last name clashes with results."""
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "x", "\n\n a \n\n", "😀 é " * 9, "a" * 5000, SHARED, "\t" + SHARED.upper() + "\r", SHARED + "\n" + SHARED]
    texts += [words(60, rng) + "\n" + SHARED + "\n" + words(30, rng) for _ in range(4)]
    base = words(200, rng)
    texts += [base, base, base.replace("an", "en", 1), base + " extra", words(5000, rng)]
    texts += [" ".join([words(8, rng)] * 6) for _ in range(2)] + [words(25, rng) for _ in range(10)]
    return [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 99) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int"


def frame(spark, rows=None, partitions=3):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def base_counts(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)
