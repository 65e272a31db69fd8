"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a quantile of the scores.

A pair prefers a document labelled 1 to one labelled 0. The chance that x is preferred to y is
the logistic of w . (f(x) - f(y)); w is fitted by Newton steps on the logistic loss of all pairs
of all labelled documents. The pairs are not listed: what the loss and its derivatives need of
them depends on a pair through two scores only, and smoothly. So each document's moments are
dealt to the nodes of a grid of scores next to its own, by the weights of a polynomial
interpolation; the executors add them up, and the driver pairs nodes (relative error about 1e-9).
The cut lies at the quantile of the labelled documents' scores that their share of label 0 gives,
and the score is a logistic of the distance from it, so that the cut has a fixed score.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, give_back, stored

UPPER = bytes(range(65, 91))
SYMBOLS = b"%$#&*@^~=+<>{}[]\\/_|!"
FEATURES = ("log_words", "distinct", "adjacent_repeats", "line_repeats", "upper", "symbols", "bare_marks", "doubled_marks", "digits", "mean_word", "long_words")
#: Distance of the nodes of the grid of scores, and the nodes around a score that stand for it.
STEP, AROUND = 0.25, np.arange(-5, 7)
#: Cells in which scores are counted at once to find one by its rank.
CELLS = 4096
#: Labelled rows, of a hash, whose fit the steps over all rows begin with.
SAMPLE = 8192
#: The score at the cut.
CUT_SCORE = 0.3
_LINES = re.compile(r"[\n\r]+")
#: Two equal marks next to each other.
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; an empty or null text has zeros, and a word count of 0."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    size = len(raw)
    seen = set(words)
    lines = [x for x in _LINES.split(text) if x]
    count = lambda chars: size - len(raw.translate(None, chars))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), len(seen) / n, sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), count(UPPER) / size, count(SYMBOLS) / size,
        sum(not w.isalnum() and not any(map(str.isalnum, w)) for w in words) / n, len(_DOUBLED.findall(raw)) / n, count(b"0123456789") / size,
        float(lengths.mean()) / 10, float((lengths > 20).mean()),
    ]


#: Places of the products of (1, features) with each other.
_I, _J = np.triu_indices(len(FEATURES) + 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))


def _node_sums(y: np.ndarray, z: np.ndarray, w: np.ndarray, sums: dict[tuple[int, int], np.ndarray]) -> None:
    """Adds to sums, by label and node, the products of (1, standardised features) of these documents."""
    at = z @ w / STEP
    node = np.floor(at).astype(np.int64)
    far = (at - node)[:, None] - AROUND
    share = np.stack([np.prod(np.delete(far, j, 1) / np.delete(AROUND[j] - AROUND, j), axis=1) for j in range(len(AROUND))])
    one = np.column_stack([np.ones(len(z)), z])
    products = one[:, _I] * one[:, _J]
    order = np.lexsort((node, y))
    cuts = np.flatnonzero(np.diff(y[order]) | np.diff(node[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        for j, m in zip(AROUND, share[:, own] @ products[own], strict=True):
            key = int(y[own[0]]), int(node[own[0]] + j)
            sums[key] = sums[key] + m if key in sums else m


def _moments(mean: np.ndarray, sd: np.ndarray, w: np.ndarray):
    """Rows y, node, m: what `_node_sums` makes of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            _node_sums(batch.column("y").to_numpy(), (_matrix(batch) - mean) / sd, w, sums)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=["y", "node", "m"])

    return run


def _pairs(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of all pairs with the penalty, its gradient and its second derivatives."""
    found = rows.mapInArrow(_moments(mean, sd, w), "y int, node long, m array<double>").groupBy("y", "node").agg(*[F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(len(_I))])
    got = found.toPandas()  # one row a node
    return _of_nodes(got["y"].to_numpy(), got["node"].to_numpy(), got[[f"m{k}" for k in range(len(_I))]].to_numpy(), w, penalty)


def _of_nodes(y: np.ndarray, node: np.ndarray, sums: np.ndarray, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The same from the sums of nodes."""
    order = np.lexsort((node, y))
    y, node, sums = y[order], node[order], sums[order]
    sides = []
    for label in (1, 0):
        own = y == label
        full = np.empty((int(own.sum()), len(w) + 1, len(w) + 1))
        full[:, _I, _J] = full[:, _J, _I] = sums[own]
        sides.append((node[own] * STEP, full))
    (s, good), (t, bad) = sides
    loss, slope, bend = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(s), 512):
        g = good[i : i + 512]
        ahead = s[i : i + 512, None] - t
        p = np.exp(-np.logaddexp(0, ahead))
        q = p * (1 - p)
        loss += g[:, 0, 0] @ np.logaddexp(0, -ahead) @ bad[:, 0, 0]
        slope -= (p @ bad[:, 0, 0]) @ g[:, 0, 1:] - (g[:, 0, 0] @ p) @ bad[:, 0, 1:]
        cross = g[:, 0, 1:].T @ q @ bad[:, 0, 1:]
        bend += np.tensordot(q @ bad[:, 0, 0], g[:, 1:, 1:], 1) + np.tensordot(g[:, 0, 0] @ q, bad[:, 1:, 1:], 1) - cross - cross.T
    n = good[:, 0, 0].sum() * bad[:, 0, 0].sum()
    return loss / n + penalty / 2 * w @ w, slope / n + penalty * w, bend / n + penalty * np.eye(len(w))


def by_rank(values: DataFrame, rank: int) -> tuple[float, float]:
    """The values of the column s with this rank, from 0, and the next one. Values are counted in
    cells, then those of the cell that has the rank, until it has one value."""
    lo, hi = values.agg(F.min("s"), F.max("s")).first()
    left = rank
    while lo < hi:
        cell = F.least(F.floor((F.col("s") - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))
        cells = values.where(F.col("s").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # at most CELLS rows
        for c in sorted(cells, key=lambda c: c["cell"]):
            if left < c["n"]:
                lo, hi = c["lo"], c["hi"]
                break
            left -= c["n"]
    upto, above = values.agg(F.count_if(F.col("s") <= lo), F.min(F.when(F.col("s") > lo, F.col("s")))).first()
    return lo, lo if upto > rank + 1 or above is None else above


def _raw(mean: np.ndarray, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch) - mean) * w).sum(axis=1))], names=["s"])

    return run


def newton(of, w: np.ndarray) -> np.ndarray:
    """Newton steps from w on a function that gives its value and derivatives, halved where it would grow."""
    loss, slope, bend = of(w)
    for _ in range(25):
        step = np.linalg.solve(bend, slope)
        if np.abs(step).max() < 1e-6:
            # A step this short squares its error: the next would not be seen in the weights.
            return w - step
        now = of(w - step)
        while now[0] > loss + 1e-9 and np.abs(step).max() > 1e-6:
            step = step / 2
            now = of(w - step)
        w, (loss, slope, bend) = w - step, now
    return w


def fit(rows: DataFrame, penalty: float = 1e-3) -> dict:
    """From rows y, x: weights of the features, and the cut. All rows and all pairs count."""
    k = range(len(FEATURES))
    about = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), *[F.avg(F.col("x")[i]) for i in k], *[F.stddev_pop(F.col("x")[i]) for i in k]).first()
    n, n_good = about[:2]
    if not 0 < n_good < n:
        return {"mean": np.zeros(len(k)), "w": np.zeros(len(k)), "cut": 1.0 if n and not n_good else -1.0}
    mean, sd = np.array(about[2 : 2 + len(k)]), np.array(about[2 + len(k) :]) + 1e-6
    # The steps begin where those of a sample end, so that few need all rows.
    some = rows.select("y", "x").orderBy(F.xxhash64("y", "x")).limit(SAMPLE).toArrow()
    y, z = some["y"].to_numpy(), (_matrix(some.combine_chunks().to_batches()[0]) - mean) / sd

    def of_sample(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        _node_sums(y, z, w, sums)
        keys = np.array(list(sums))
        return _of_nodes(keys[:, 0], keys[:, 1], np.array(list(sums.values())), w, penalty)

    w = np.zeros(len(k))
    if 0 < y.sum() < len(y):
        w = newton(of_sample, w)
    w = newton(lambda w: _pairs(rows, mean, sd, w, penalty), w)
    # Sums in another order differ in their last digits.
    mean, w = np.round(mean, 12), np.round(w / sd, 9)
    lower, upper = by_rank(stored(rows.mapInArrow(_raw(mean, w), "s double"), "quality-scores"), n - n_good - 1)
    return {"mean": mean, "w": w, "cut": (lower + upper) / 2}


def scorer(model: dict):
    """A vectorised function of texts that gives scores from 0 to 1; the cut has score CUT_SCORE."""
    mean, w, cut, base = model["mean"], model["w"], model["cut"], float(np.log(CUT_SCORE / (1 - CUT_SCORE)))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            # Row by row, so that a score does not depend on the rows beside it.
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) * w).sum(axis=1) - cut + base, -30, 30))))
        give_back()

    return score


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fits on the whole texts of all labelled rows, held-out ids left out. Their features stay on the
    executors. Labels other than 0 and 1 are not used; of an id's labels the least counts."""
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    # Texts are not shuffled: few labels go to the texts, many meet the texts' features.
    if picked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(picked), "doc_id").select("y", measured("text").alias("x"))
    else:
        rows = rows.select("doc_id", measured("text").alias("x")).join(picked, "doc_id").select("y", "x")
    return fit(stored(rows, "quality-features"))


def quality_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Every text is scored whole; a null text counts as empty. An empty table gives an empty
    result; repeated rows get equal scores; other columns are ignored. Without labels of both
    kinds all documents get one score, above the cut.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with their columns, whatever their
    names. Null and empty texts have the score of a text without words; repeated rows stay or go
    together; an empty table stays empty."""
    return docs.where(scorer(model)(F.col(text_col)) >= CUT_SCORE)
