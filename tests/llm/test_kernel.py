"""Very long texts are taken in blocks, with the results of the whole."""

import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, words

from tessera.llm import decontaminate, kernel, near_copies, pairwise_quality, simhash, toxic_crf
from tessera.llm.shared import texts

TEXTS = [d[1] for d in documents()] + ["a. b\n\nc é😀ü! " * 40, "x" * 300, "\n".join(["same line here"] * 9), " \n \t " * 20]


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_change_nothing(monkeypatch, block):
    given = texts(pa.array(TEXTS))
    of = lambda: (list(kernel.basics(*given).values()), [*vars(toxic_crf.tokens(*given)).values()], near_copies.shingles(*given, 5), kernel.words(*given, ~kernel.SPACE))
    marks = lambda: [simhash.fingerprint((t or "").encode(), n) for t in TEXTS for n in (1, 4, 5)]
    whole, prints = of(), marks()
    monkeypatch.setattr(kernel, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert all(same(a, b) for a, b in zip(of(), whole, strict=True))
    assert marks() == prints


def test_features_equal_brute_force():
    found = pairwise_quality.features(kernel.basics(*texts(pa.array(TEXTS))))
    for text, row in zip(TEXTS, found, strict=True):
        text = text or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
        rows = text.split("\n")
        full = [x for x in rows if x.strip(" \t\n\x0b\x0c\r")]
        upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" or c > "\x7f" for c in text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeat = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 1000 else set()
        n, chars = max(len(w), 1), max(len(text), 1)
        any_of = lambda some: sum(text.count(c) for c in some)  # noqa: B023, E731
        expected = [
            np.log1p(len(w)), min(len(w), 20) / 20, np.log1p(len(rows)), sum(map(len, w)) / n / 8, np.log1p(4 * any_of("#*$%&|<>") / n), np.log1p(4 * any_of("|<>") / n), np.log1p(4 * any_of("!?") / n), np.log1p(any_of(".,;:") / n),
            upper / max(upper + lower, 1), any_of("0123456789") / chars, (len(text) - sum(map(len, w))) / chars, len(repeat) / n, (len(full) - len(set(full))) / len(rows), len(set(w)) / n, np.log1p(n / len(rows)),
        ]
        assert np.allclose(row, expected), text[:40]


_HEAVY = """
import random, resource, sys
sys.path[:0] = {path!r}
import pyarrow as pa
from fixtures import words
from tessera.llm import decontaminate, kernel, near_copies, simhash, toxic_crf
from tessera.llm.shared import texts
part = words(20_000, random.Random(1)).replace(" the", ".\\n the")
given = texts(pa.array([part * (12_000_000 // len(part))]))
decontaminate.Index([(1, "nothing of the kind " * 9)], decontaminate.Params())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{call}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(
    "call",
    [
        "kernel.basics(*given)",
        "x = toxic_crf.tokens(*given)",
        "near_copies.shingles(*given, 5)",
        "simhash.fingerprint(given[0].tobytes(), 4)",
        "decontaminate.Index([(1, 'nothing of the kind ' * 9)], decontaminate.Params()).search([given[0].tobytes().decode()])",
    ],
)
def test_memory_for_a_very_long_text(call):
    """Under 30 bytes for each of its own: a text of 30 MB fits beside others."""
    run = subprocess.run([sys.executable, "-c", _HEAVY.format(path=sys.path, call=call)], capture_output=True, text=True, check=True, timeout=300)
    assert int(run.stdout) < 30 * 12


def test_this_module_imports_what_it_measures():
    assert callable(words) and decontaminate.Params().q and resource.RUSAGE_SELF == 0
