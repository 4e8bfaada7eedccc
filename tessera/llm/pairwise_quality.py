"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

A labelled good text is preferred over a labelled bad one. The score s(x) = w.x is
fitted by logistic loss on feature differences, log(1 + exp(-w.(x_good - x_bad))),
over every pair of a good and a bad one of all labelled rows. The threshold is a
quantile of all labelled rows' scores: the one that leaves as many texts below it as
there are bad ones. The published score is 1 / (1 + exp(-(s - threshold) / scale)), so
0.5 is the quantile.

Pairs are not listed. The loss and its derivatives are sums over pairs of smooth
functions of the difference of two scores, which polynomials of degree NODES - 1
replace in each cell of 2 * HALF in either score; Chebyshev nodes leave some 1e-13 of
them. So sums per class, cell and node (``moments``) give the loss, gradient and Hessian
over all pairs, and each step of Newton's method is one pass over the labelled rows'
features, which lie in a table; sums of many tasks are added in a tree. The quantile is
found by counts of the scores' leading bits, 16 more in each pass.

Features are ratios of the whole text's own characters, words and lines; id,
language, source and labels are no inputs.

Defined cases: a null text is empty; with no good or no bad labelled row every
score is 1 or 0 (0.5 rounded by the only class; 1 with no labels at all); repeated
rows are scored each, and learnt from each; a score equal to the threshold counts as
good; a very long text is measured whole by one task; columns of other names are not
read. Weights are rounded to 9 digits, so the order of rows does not show in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import SENT_IDS, chunks, mark, release, table, texts


#: Half a cell's width in scores, and nodes in a cell.
HALF, NODES = 2.0, 24
#: Sums of so many tasks at most are added by one.
FAN = 32


@dataclass(frozen=True)
class Params:
    pairs: int | None = None  # so many random pairs, drawn in the driver's memory; None: all pairs
    l2: float = 1e-4
    steps: int = 25
    seed: int = 11


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """w.x, added column by column: equal rows have equal sums in any batch."""
        out = np.zeros(len(x))
        for k, w in enumerate(self.weight):
            out += (x[:, k] - self.mean[k]) / self.scale[k] * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (self.raw(x) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def features(b: dict[str, np.ndarray]) -> np.ndarray:
    words, points, rows = np.maximum(b["n_words"], 1), np.maximum(b["n_chars"], 1), np.maximum(b["n_lines"], 1)
    return np.stack(
        [
            np.log1p(b["n_words"]), np.minimum(b["n_words"], 20) / 20, np.log1p(rows), b["word_chars"] / words / 8,
            np.log1p(4 * b["n_symbols"] / words), np.log1p(4 * b["n_pipes"] / words), np.log1p(4 * b["n_bangs"] / words), np.log1p(b["n_stops"] / words),
            b["n_upper"] / np.maximum(b["n_upper"] + b["n_lower"], 1), b["n_digits"] / points, (b["n_chars"] - b["word_chars"]) / points,
            b["n_repeat_words"] / words, b["n_dup_lines"] / rows, b["n_distinct"] / words, np.log1p(words / rows),
        ],
        1,
    )


FEATURES = 15


_NODES = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: Chebyshev polynomials to the nodes' Lagrange polynomials.
_BASIS = chebvander(_NODES, NODES - 1).T * np.where(np.arange(NODES), 2, 1)[:, None] / NODES

Sums = dict[int, np.ndarray]
#: Loss, gradient downhill and Hessian.
Slopes = tuple[float, np.ndarray, np.ndarray]


def moments(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> Sums:
    """By 2 * cell of the score + class: sums of 1, z and z z' (its upper half) dealt to the cell's nodes."""
    at = z @ w / (2 * HALF)
    cell = np.floor(at).astype(np.int64)
    basis = chebvander(2 * (at - cell) - 1, NODES - 1) @ _BASIS
    i, j = np.triu_indices(z.shape[1])
    each = np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], 1)
    key = 2 * cell + good
    return {int(k): basis[key == k].T @ each[key == k] for k in np.unique(key)}


def added(many: Iterable[Sums]) -> Sums:
    out: Sums = {}
    for sums in many:
        for k, m in sums.items():
            out[k] = out[k] + m if k in out else m
    return out


def slopes(sums: Sums, w: np.ndarray, p: Params) -> Slopes:
    """Of the mean loss over all pairs of a good and a bad row, from ``moments``."""
    d = len(w)
    nodes = lambda k: HALF * (2 * (k >> 1) + 1 + _NODES)
    parts = lambda m: (m[:, 0], m[:, 1 : d + 1], m[:, d + 1 :])
    bad = [k for k in sums if not k & 1]
    v, (nb, sb, qb) = np.concatenate([nodes(k) for k in bad]), parts(np.concatenate([sums[k] for k in bad]))
    loss, pairs, down, cross, own = 0.0, 0.0, np.zeros(d), np.zeros((d, d)), np.zeros(qb.shape[1])
    for k in (k for k in sums if k & 1):
        n, s, q = parts(sums[k])
        t = nodes(k)[:, None] - v
        e = np.exp(-np.abs(t))
        f, h = np.where(t > 0, e, 1) / (1 + e), e / (1 + e) ** 2
        loss += n @ (np.log1p(e) + np.maximum(-t, 0)) @ nb
        pairs += n.sum() * nb.sum()
        down += s.T @ (f @ nb) - n @ f @ sb
        cross += s.T @ h @ sb
        own += q.T @ (h @ nb) + n @ h @ qb
    curve, upper = np.zeros((d, d)), np.triu_indices(d)
    curve[upper] = own
    curve += np.triu(curve, 1).T - cross - cross.T
    return loss / pairs + p.l2 / 2 * w @ w, down / pairs - p.l2 * w, curve / pairs + p.l2 * np.eye(d)


def _drawn(d: np.ndarray, w: np.ndarray, p: Params) -> Slopes:
    """The same over the differences ``d``."""
    t = d @ w
    e = np.exp(-np.abs(t))
    f, h = np.where(t > 0, e, 1) / (1 + e), e / (1 + e) ** 2
    loss = (np.log1p(e) + np.maximum(-t, 0)).mean()
    return loss + p.l2 / 2 * w @ w, d.T @ f / len(d) - p.l2 * w, d.T @ (d * h[:, None]) / len(d) + p.l2 * np.eye(len(w))


def _unit(std: np.ndarray) -> np.ndarray:
    """Scales; a feature that is the same in all rows gets 1, so what it is elsewhere is not blown up."""
    return np.where(std < 1e-9, 1.0, std)


def _digits(x: np.ndarray) -> np.ndarray:
    return np.array([float(f"{v:.9g}") for v in x])


def _newton(at: Callable[[np.ndarray], Slopes], width: int, p: Params) -> np.ndarray:
    """The weights of least loss; a step that would raise the loss is halved."""
    w = np.zeros(width)
    loss, down, curve = at(w)
    for _ in range(p.steps):
        step = np.linalg.solve(curve, down)
        while np.abs(step).max() >= 1e-7 and (new := at(w + step))[0] > loss + 1e-10:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            return _digits(w)
        loss, down, curve = new
    raise RuntimeError(f"no least loss in {p.steps} steps")


def _constant(width: int, score: int) -> Model:
    zero = np.zeros(width)
    return Model(zero, zero + 1, zero, -1.0 if score else 1.0, 1e-2)


def _placed(m: Model, least: float, below: float, above: float, most: float) -> Model:
    """With the threshold between two scores, and the spread from the least and the most."""
    return replace(m, threshold=(below + above) / 2, spread=max((most - least) / 20, 1e-6))


def fit_pairs(x: np.ndarray, label: np.ndarray, p: Params = Params()) -> Model:
    """A model from features in memory."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    if not len(good) or not len(bad):
        return _constant(x.shape[1], len(good) or not len(bad))
    mean, scale = x.mean(0), _unit(x.std(0))
    z, rng = (x - mean) / scale, np.random.default_rng(p.seed)
    if p.pairs:
        d = z[rng.choice(good, p.pairs)] - z[rng.choice(bad, p.pairs)]
        w = _newton(lambda w: _drawn(d, w, p), x.shape[1], p)
    else:
        w = _newton(lambda w: slopes(moments(z, label == 1, w), w, p), x.shape[1], p)
    m = Model(mean, scale, w, 0.0, 1.0)
    s = np.sort(m.raw(x))
    return _placed(m, float(s[0]), float(s[len(bad) - 1]), float(s[len(bad)]), float(s[-1]))


def _frames(rows: DataFrame, kept: list[str], run, schema: T.StructType) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                out = run(kernel.basics(*texts(part.column("_text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *out], schema.names)

    return rows.mapInArrow(go, schema)


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


_SUMS = T.StructType().add("k", "long").add("m", "binary")


def _rows(sums: Sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], _SUMS.names)


def _sums(pairs: Iterable[tuple[int, bytes]]) -> Iterator[Sums]:
    return ({k: np.frombuffer(m).reshape(NODES, -1)} for k, m in pairs)


def _all_moments(rows: DataFrame, m: Model, w: np.ndarray, tasks: int) -> Sums:
    """``moments`` of a table of features, in one pass."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _rows(added(moments((_x(b) - m.mean) / m.scale, b.column("_label").to_numpy() == 1, w) for b in batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _rows(added(s for b in batches for s in _sums(zip(b.column("k").to_pylist(), b.column("m").to_pylist()))))

    found = rows.mapInArrow(go, _SUMS)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        found = found.repartition(tasks).mapInArrow(add, _SUMS)
    return added(_sums(found.collect()))


def _ordered(b: np.ndarray) -> np.ndarray:
    """The bits of doubles as integers in the doubles' order, and back."""
    return b ^ ((b >> 63) & np.int64(2**63 - 1))


def _score_of(key: int) -> float:
    return float(_ordered(np.array([key], np.int64)).view(np.float64)[0])


def _at_rank(keys: DataFrame, rank: int) -> int:
    """The ``_key`` that ``rank`` others stand before, by counts of its leading bits."""
    some = keys
    for shift in (48, 32, 16, 0):
        front = F.shiftright("_key", shift)
        for at, n in sorted(some.groupBy(front).count().collect()):
            if rank < n:
                break
            rank -= n
        some = some.where(front == at)
    return at


def _measured(docs: DataFrame, given: DataFrame) -> DataFrame:
    """Label and features of every labelled row; beyond SENT_IDS labels, features meet them by a shuffle, texts do not."""
    few = given.count() <= SENT_IDS
    rows = docs.join(F.broadcast(given), "_id") if few else docs
    kept = ["_id", "_label"] if few else ["_id"]
    schema = T.StructType([*(rows.schema[k] for k in kept), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(b: dict[str, np.ndarray]) -> list[pa.Array]:
        x = features(b)
        return [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, x.ravel())]

    made = _frames(rows, kept, run, schema)
    return (made if few else made.join(given.hint("merge"), "_id")).select("_label", "x")


def _fitted(rows: DataFrame, p: Params) -> Model:
    x = [F.col("x")[k] for k in range(FEATURES)]
    n, good, *found = rows.agg(F.count("*"), F.count_if(F.col("_label") == 1), *map(F.avg, x), *map(F.stddev_pop, x)).first()
    if good in (0, n):
        return _constant(FEATURES, good or not n)
    if p.pairs:
        some = rows.orderBy("_label", "x").toPandas()
        return fit_pairs(np.stack(some["x"].to_list()), some["_label"].to_numpy(), p)
    m = Model(_digits(found[:FEATURES]), _digits(_unit(np.array(found[FEATURES:]))), np.zeros(FEATURES), 0.0, 1.0)
    tasks = rows.rdd.getNumPartitions()
    m = replace(m, weight=_newton(lambda w: slopes(_all_moments(rows, m, w, tasks), w, p), FEATURES, p))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ordered((m.raw(_x(b)) + 0.0).view(np.int64)))], ["_key"])

    keys, bad = rows.mapInArrow(keyed, "_key long"), n - good
    below = _at_rank(keys, bad - 1)
    to, above, least, most = keys.agg(F.count_if(F.col("_key") <= below), F.min(F.when(F.col("_key") > below, F.col("_key"))), F.min("_key"), F.max("_key")).first()
    return _placed(m, *map(_score_of, (least, below, below if to > bad else above, most)))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from all labelled rows; ``labels`` holds only rows to learn from."""
    given = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    since = mark()
    rows = table(_measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), given), "measured")
    try:
        return _fitted(rows, p)
    finally:
        release(since, since + 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 if score >= 0.5)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(b: dict[str, np.ndarray]) -> list[pa.Array]:
        s = model.score(features(b))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return _frames(rows, ["doc_id"], run, T.StructType([rows.schema["doc_id"]]).add("score", "double").add("predicted", "integer"))
