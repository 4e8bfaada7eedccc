"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure is over a cutoff. Cutoffs are certified on
labelled holdout rows, per stratum (by default the language):

* The candidates of a rule are a fixed grid, tested from the most lenient to the
  strictest. A cutoff is certified if the exact binomial tail says that the share
  of good texts it rejects is under ``alpha / rules``: P(Bin(n, alpha / rules) <= k)
  <= delta / (rules * strata), k of n good texts being rejected. Testing in a
  fixed order stops at the first failure, so no further correction for the
  length of the grid is due; Bonferroni's covers rules and strata. With chance
  1 - delta, the rules reject under ``alpha`` of the good texts of every stratum that
  the base rule passes. What the base rule rejects is fixed, and not covered.
* Among certified cutoffs the one with the best ``bad rejected - penalty * good
  rejected`` is taken (the middle, if several in a row tie); a rule that gains
  nothing is off.
* In a stratum with too few good rows to certify anything, and in one that no labelled
  row is of, all rules are off: nothing is known of its good texts, and cutoffs learnt
  from others could reject all of them.

Only counts per stratum, rule, grid cell and label reach the driver, of strata with
enough good rows to certify a cutoff.

Defined cases: a null text is an empty one; null strata are one stratum; an empty
label table certifies nothing, so only the base rule rejects; repeated rows count
each. Labelled rows with a null label are ignored. A measure equal to a cutoff is
rejected. A very long text is measured whole by one task. Columns of the input other
than id, text and stratum are not read by ``measured``; ``keep`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import SENT_IDS, chunks, table, texts

NONE = "\0null"
#: Cells of the grid of candidate cutoffs over a measure's range.
CELLS = 64
#: Strata whose cutoffs are sent to all tasks at most.
MOST_STRATA = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    top: float  # measures are cut to 0..top


RULES = (Rule("symbols_per_word", 2.0), Rule("bangs_per_word", 2.0), Rule("dup_line_share", 1.0), Rule("upper_share", 1.0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Params:
    alpha: float = 0.04
    delta: float = 0.05
    penalty: float = 20.0
    min_words: int = 20
    max_repeat_percent: int = 30
    rules: tuple[Rule, ...] = RULES


@dataclass(frozen=True)
class Cutoffs:
    """Per certified stratum and rule the grid cell from which texts are rejected."""

    rules: tuple[Rule, ...]
    cells: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def of(self, stratum: str) -> tuple[int, ...]:
        return self.cells.get(stratum) or (CELLS,) * len(self.rules)


def measures(b: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, one column per rule of RULES."""
    words = np.maximum(b["n_words"], 1)
    return np.stack([b["n_symbols"] / words, b["n_bangs"] / words, b["n_dup_lines"] / np.maximum(b["n_lines"], 1), b["n_upper"] / np.maximum(b["n_upper"] + b["n_lower"], 1)], 1)


def cells(values: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """The grid cell of each measure, 0 to CELLS - 1; cutoff c rejects cells >= c."""
    top = np.array([r.top for r in rules])
    return np.minimum((values / top * CELLS).astype(np.int64), CELLS - 1)


def base_failed(b: dict[str, np.ndarray], p: Params) -> np.ndarray:
    return (b["n_words"] < p.min_words) | (100 * b["n_repeat_words"] > p.max_repeat_percent * b["n_words"])


def certified(k: int, n: int, share: float, delta: float) -> bool:
    """Whether k of n rejected good texts prove a true share under ``share``."""
    if n == 0:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(delta)


def choose(good: np.ndarray, bad: np.ndarray, share: float, delta: float, penalty: float) -> int:
    """The cutoff for one rule and stratum from its counts per cell; CELLS: off."""
    n_good, n_bad = int(good.sum()), max(int(bad.sum()), 1)
    best, ties = 0.0, []
    for c in range(CELLS - 1, 0, -1):
        k = int(good[c:].sum())
        if not certified(k, n_good, share, delta):
            break
        gain = bad[c:].sum() / n_bad - penalty * k / max(n_good, 1)
        if gain > best + 1e-12:
            best, ties = gain, [c]
        elif ties and abs(gain - best) <= 1e-12 and ties[-1] == c + 1:
            ties.append(c)
    return ties[len(ties) // 2] if ties else CELLS


def _counted(part: pa.RecordBatch, p: Params) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    b = kernel.basics(*texts(part.column("_text")))
    return b, base_failed(b, p), cells(measures(b), p.rules)


def measured(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row, from one pass over the texts: doc_id, stratum, the five base counts,
    base_failed and cells, the grid cell of each rule's measure."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(NONE))
    rows = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                b, failed, at = _counted(part, p)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(b[k]) for k in BASE), pa.array(failed), pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], schema.names)

    schema = T.StructType(rows.schema.fields[:2])
    for name, kind in (*((k, "long") for k in BASE), ("base_failed", "boolean")):
        schema = schema.add(name, kind)
    schema = schema.add("cells", T.ArrayType(T.IntegerType()))
    return table(rows.mapInArrow(run, schema), "measured")


def calibrate(rows: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", label_col: str = "quality") -> Cutoffs:
    """Certified cutoffs from ``measured`` rows and their labels; see the module."""
    rules = p.rules
    given = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    found = rows.where(~F.col("base_failed")).select("doc_id", "stratum", "cells").join(given, "doc_id").select("stratum", "label", F.posexplode("cells").alias("rule", "cell"))
    counts = found.groupBy("stratum", "label", "rule", "cell").count()
    # the smallest number of good rows that can certify anything, so small strata stay off the driver
    least = math.ceil(math.log(p.delta / len(rules)) / math.log1p(-p.alpha / len(rules)))
    large = counts.where("label = 1 and rule = 0").groupBy("stratum").agg(F.sum("count").alias("n")).where(F.col("n") >= least).select("stratum")
    table_: dict[str, np.ndarray] = {}
    for x in counts.join(large, "stratum", "left_semi").collect():
        table_.setdefault(x["stratum"], np.zeros((2, len(rules), CELLS), np.int64))[int(x["label"] == 1), x["rule"], x["cell"]] += x["count"]
    delta = p.delta / (len(rules) * max(len(table_), 1))
    out = {}
    for stratum, (bad, good) in table_.items():
        out[stratum] = tuple(choose(good[r], bad[r], p.alpha / len(rules), delta, p.penalty) for r in range(len(rules)))
    return Cutoffs(rules, {s: c for s, c in out.items() if min(c) < CELLS})


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that have a label, if there are few enough labels to look for
    them without a shuffle of texts; else all rows. ``calibrate`` uses no others."""
    ids = table(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_labelled")).distinct(), "labelled")
    if ids.count() > SENT_IDS:
        return docs
    return docs.join(F.broadcast(ids), F.col(id_col) == F.col("_labelled"), "left_semi")


def judged(rows: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """``measured`` rows as doc_id, the five base counts, base_failed and kept."""
    limits = rows.sparkSession.createDataFrame(sorted((s, list(c)) for s, c in cutoffs.cells.items()), "stratum string, _limits array<int>")
    with_limits = rows.join(F.broadcast(limits) if len(cutoffs.cells) <= MOST_STRATA else limits, "stratum", "left")
    over = F.exists(F.zip_with("cells", "_limits", lambda c, most: c >= most), lambda x: x)
    return with_limits.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, cutoffs: Cutoffs, p: Params = Params(), text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                _, failed, at = _counted(part.rename_columns(["_text" if c == text_col else f"c{i}" for i, c in enumerate(part.schema.names)]), p)
                strata = part.column(stratum_col).cast(pa.string()).to_pylist()
                limit = np.array([cutoffs.of(NONE if x is None else x) for x in strata]).reshape(-1, len(cutoffs.rules))
                yield part.filter(pa.array(~failed & ~(at >= limit).any(1)))

    return docs.mapInArrow(run, docs.schema)
