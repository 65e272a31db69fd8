"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents. Tokens are labelled from them: a token of a toxic document is toxic if one
of its features (the word, or a prefix of it) is found in toxic documents far more often than in
others, and more often than by chance, counted over the labelled sample. A two-state chain with word, prefix, suffix and
neighbour features is then fitted to the labelled tokens by its exact likelihood. Forward-backward
gives each token's chance to be toxic; a small logistic model turns a document's largest chance
and expected number of toxic tokens into its score, and runs of likely tokens are its spans.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, word_count
from .quality import held_out

#: Weights nearer to 0 are dropped.
LEAST_WEIGHT = 0.03
#: Labelled documents that are fitted on: at most so many toxic ones, others, and words in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 1_200, 3_000, 6_000_000
#: Documents of each kind whose chains give the gradient, and the words they may have in all.
CHAIN_DOCS, CHAIN_WORDS = 600, 1_000_000
#: A marker's count must be so unlikely by chance, among all features that are tested.
LUCK = 0.05
#: Words whose weights a worker remembers.
CACHE = 100_000
#: Positions of a chain that are multiplied out together.
STRIDE = 64
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"


def word_features(word: str) -> list[str]:
    """Names of a word's features; the first ones, of the word and its prefixes, can be markers."""
    core = word.strip(_EDGES).lower()
    names = ["w" + core]
    for k in range(3, min(6, len(core)) + 1):
        names.append("p" + core[:k])
    names += ("s" + core[-3:], "z")
    return names


class Weights(dict):
    """A word's log odds, remembered for the last words seen."""

    def __init__(self, weights: dict[str, float]):
        self.bias = weights.get("z", 0.0)
        self.kinds = [{n[1:]: v for n, v in weights.items() if n[0] == k and (k != "p" or len(n) == size + 1)} for k, size in (("w", 0), ("s", 0), ("p", 3), ("p", 4), ("p", 5), ("p", 6))]

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(_EDGES).lower()
        whole, tail, p3, p4, p5, p6 = self.kinds
        # A shorter word has no prefix of a length, and what it is cut to is no name of that kind.
        v = self[word] = self.bias + whole.get(core, 0.0) + tail.get(core[-3:], 0.0) + p3.get(core[:3], 0.0) + p4.get(core[:4], 0.0) + p5.get(core[:5], 0.0) + p6.get(core[:6], 0.0)
        return v


def names_of(text: str | None) -> set[str]:
    """The features of a text's words that can be markers."""
    return {n for w in set((text or "").split()) for n in word_features(w)[:-2]}


def unlikely(k: int, m: int, share: float) -> float:
    """Log of the chance that of m documents at least k are toxic, where a share of all is."""
    x = np.arange(k, m + 1)
    ways = [lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) for i in x.tolist()]
    logs = np.array(ways) + x * np.log(share) + (m - x) * np.log1p(-share)
    return float(logs.max() + np.log(np.exp(logs - logs.max()).sum()))


def marker_kinds(counts: list[tuple[int, int, int]], bad: int, rest: int, share: float = 0.03, ratio: float = 20.0, rare: float = 4.0) -> tuple[dict, dict]:
    """Which counts make a marker: ({(toxic, others): weight} of sure ones, and of those that only
    documents without a sure one are searched for).

    counts lists (toxic documents, other documents, features with these counts). A sure marker is
    in a share of the toxic documents and `ratio` times as often there as in others; a rare one is
    `rare` times as often there. Both must be unlikely by chance, among all features counted.
    """
    tested, sure, more = sum(n for *_, n in counts), {}, {}
    for k, c, _ in counts:
        odds = (k + 0.5) / bad / ((c + 0.5) / rest)
        if odds > rare and unlikely(k, k + c, bad / (bad + rest)) < np.log(LUCK / tested):
            more[k, c] = float(np.log(odds))
            if odds > ratio and k >= share * bad:
                sure[k, c] = more[k, c]
    return sure, more


def cover(left: list[set[str]], weight: dict[str, float], least: float) -> set[str]:
    """Markers of documents that have no sure one, such as those of a rarer language: the features
    that mark most of them, by count and weight, one by one, as long as they mark `least`."""
    found = set()
    while left:
        held = Counter(n for names in left for n in names)
        fit = [n for n, k in held.items() if k >= least]
        if not fit:
            break
        best = max(fit, key=lambda n: (held[n] * weight[n], n))
        found.add(best)
        left = [names for names in left if best not in names]
    return found


class Chain:
    """Forward-backward over many two-state chains at once. State 0 stands before each chain."""

    def __init__(self, trans: np.ndarray):
        self.a = np.exp(trans)

    def run(self, u: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Chance of state 1 at each position; with pairs also the expected transitions.

        u holds the positions' log odds for state 1, chain after chain. Each chain is cut to
        strides; products of their 2 x 2 steps are formed for all strides together, then carried
        along the chains, then opened again.
        """
        lengths = np.asarray(lengths)
        parts = -(-lengths // STRIDE)
        n, first = int(parts.sum()), np.concatenate([[0], np.cumsum(parts)])
        at = np.repeat(first[:-1] * STRIDE - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        live = np.zeros(n * STRIDE, bool)
        live[at] = True
        e = np.ones(n * STRIDE)
        e[at] = np.exp(np.clip(u, -15, 15))
        # m[t, i, j, strides]: the step into a position; the identity where there is none.
        m = np.empty((STRIDE, 2, 2, n))
        live, e = live.reshape(n, STRIDE).T, e.reshape(n, STRIDE).T
        for i in (0, 1):
            m[:, i, 0] = np.where(live, self.a[i, 0], float(i == 0))
            m[:, i, 1] = np.where(live, self.a[i, 1] * e, float(i == 1))
        prod = np.zeros((2, 2, n))
        prod[0, 0] = prod[1, 1] = 1
        for t in range(STRIDE):
            prod = np.stack([np.stack([prod[i, 0] * m[t, 0, j] + prod[i, 1] * m[t, 1, j] for j in (0, 1)]) for i in (0, 1)])
            if t % 8 == 7:
                prod /= prod.max(axis=(0, 1))
        alpha, beta = np.empty((2, n)), np.empty((2, n))
        order = np.argsort(-parts, kind="stable")
        carry_f, carry_b = np.tile([[1.0], [0.0]], len(parts)), np.ones((2, len(parts)))
        for k in range(int(parts.max(initial=0))):
            own = order[: np.searchsorted(-parts[order], -k)]
            f = first[own] + k
            alpha[:, f] = x = carry_f[:, own]
            x = np.stack([x[0] * prod[0, j, f] + x[1] * prod[1, j, f] for j in (0, 1)])
            carry_f[:, own] = x / x.sum(0)
            b = first[own + 1] - 1 - k
            beta[:, b] = x = carry_b[:, own]
            x = np.stack([prod[i, 0, b] * x[0] + prod[i, 1, b] * x[1] for i in (0, 1)])
            carry_b[:, own] = x / x.sum(0)
        forward = np.empty((STRIDE + 1, 2, n))
        forward[0] = alpha
        for t in range(STRIDE):
            x = forward[t]
            x = np.stack([x[0] * m[t, 0, j] + x[1] * m[t, 1, j] for j in (0, 1)])
            forward[t + 1] = x / x.sum(0)
        chance, expected = np.empty((STRIDE, n)), np.zeros((2, 2))
        x = beta
        for t in range(STRIDE - 1, -1, -1):
            both = forward[t + 1] * x
            chance[t] = both[1] / both.sum(0)
            if pairs:
                xi = forward[t][:, None] * m[t] * x[None, :]
                expected += (xi / xi.sum((0, 1)))[:, :, live[t]].sum(2)
            x = np.stack([m[t, i, 0] * x[0] + m[t, i, 1] * x[1] for i in (0, 1)])
            x = x / x.sum(0)
        chance = chance.T.reshape(-1)[at]
        return (chance, expected) if pairs else chance


def fit_chain(docs: list[tuple[int, list[str], np.ndarray]], marks: set[str], rounds: int = 30) -> dict:
    """Chain weights by AdaGrad on the exact gradient. A document is its label, its distinct words,
    and the numbers of its words among these."""
    vocabulary: dict[str, int] = {}
    tokens, gold, lengths = [], [], []
    for y, words, own in docs:
        if len(own):
            numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))
            tokens.append(numbers[own])
            gold.append(np.full(len(own), y == 1))
            lengths.append(len(own))
    model = {"weights": {}, "trans": np.zeros((2, 2)), "doc": np.array([-3.0, 0.0, 0.0])}
    if not lengths:
        return model
    number: dict[str, int] = {}
    marked, flat, of = np.zeros(len(vocabulary), bool), array("i"), array("i")
    for i, w in enumerate(vocabulary):
        names = word_features(w)
        marked[i] = any(n in marks for n in names[:-2])
        flat.extend([number.setdefault(n, len(number)) for n in names])
        of.extend([i] * len(names))
    n_words = len(vocabulary)
    del vocabulary
    flat, of, tokens, gold, lengths = np.array(flat), np.array(of), np.concatenate(tokens), np.concatenate(gold), np.array(lengths)
    y = marked[tokens] & gold
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    before = np.concatenate([[0], y[:-1]]).astype(int)
    before[starts] = 0
    counted = np.zeros((2, 2))
    np.add.at(counted, (before, y.astype(int)), 1)
    w, trans, seen_w, seen_t = np.zeros(len(number)), np.zeros((2, 2)), np.full(len(number), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        u = np.bincount(of, w[flat], n_words)
        p, expected = Chain(trans).run(u[tokens], lengths, pairs=True)
        per_word = np.bincount(tokens, y - p, n_words)
        g = np.bincount(flat, per_word[of], len(number)) - 0.02 * w
        seen_w += g * g
        w += 0.5 * g / np.sqrt(seen_w)
        g = counted - expected
        seen_t += g * g
        trans += 0.2 * g / np.sqrt(seen_t)
    model["weights"] = {n: float(w[i]) for n, i in number.items() if abs(w[i]) >= LEAST_WEIGHT}
    model["trans"] = trans
    return model


def fit_documents(summary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The logistic model of a document's label from the two numbers that its chain gives."""
    x = np.column_stack([np.ones(len(summary)), summary])
    b = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (toxic - q) - 0.5 * b)
    return b


def _marginals(texts: list[str], model: dict, cache: Weights | None = None):
    """For each text: its tokens' chances and (log odds of the largest, log of the expected number)."""
    cache = Weights(model["weights"]) if cache is None else cache
    split = [t.split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    u = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), float, int(lengths.sum()))
    some = lengths > 0
    p = Chain(model["trans"]).run(u, lengths[some]) if some.any() else np.empty(0)
    p = np.clip(p, 1e-9, 1 - 1e-9)
    ends = np.cumsum(lengths)
    for k, n in zip(ends, lengths, strict=True):
        own = p[k - n : k]
        top = float(own.max()) if n else 1e-9
        yield own, (np.log(top / (1 - top)), np.log1p(float(own.sum()) if n else 0.0))


def scorer(model: dict, spans: bool = False):
    """A vectorised function of texts that gives struct(score, spans): spans are the offsets
    [start, end) in code points of runs of tokens that are more likely toxic than not."""

    @F.pandas_udf("score double, spans array<array<int>>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Weights(model["weights"])
        for texts in parts:
            values, found = [], []
            texts = [t or "" for t in texts]
            start, held = 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held < 1_000_000 and end < len(texts):
                    continue
                for text, (own, x) in zip(texts[start:end], _marginals(texts[start:end], model, cache), strict=True):
                    values.append(1 / (1 + np.exp(-np.clip(model["doc"] @ [1.0, *x], -30, 30))))
                    found.append(_spans(text, own) if spans else [])
                start, held = end, 0
            yield pd.DataFrame({"score": np.array(values, float), "spans": pd.Series(found, dtype=object)})

    return score


def _spans(text: str, chances: np.ndarray) -> list[list[int]]:
    if not (chances > 0.5).any():
        return []
    at, out, words = 0, [], text.split()
    last = -2
    for i, w in enumerate(words):
        at = text.index(w, at)
        if chances[i] > 0.5:
            if last == i - 1:
                out[-1][1] = at + len(w)
            else:
                out.append([at, at + len(w)])
            last = i
        at += len(w)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows y, text: in how many toxic and other documents of the partition each feature is."""
    seen = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(names_of(text))
    names = list(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())], names=["name", "k", "c"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows y, text, id: distinct words, and the text as their numbers."""
    for batch in batches:
        words, own = [], []
        for text in batch.column(1).to_pylist():
            seen: dict[str, int] = {}
            own.append(np.fromiter((seen.setdefault(w, len(seen)) for w in (text or "").split()), np.int32).tobytes())
            words.append(list(seen))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(own, pa.binary())], names=["doc_id", "y", "words", "own"])


def _unmarked(sure: set[str], more: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [names_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(n & more) for n in names if not n & sure], pa.list_(pa.string()))], names=["names"])

    return run


def sample_within(sizes: list[tuple[int, int, int]], words: int, chain_docs: int, chain_words: int) -> dict[int, bool]:
    """Which documents are fitted on, and whether their chains give the gradient, from (id, label, words)
    in the sample's order. One that does not fit into a bound is passed over and takes none of it; the
    shortest of each label is in whatever its length, so long texts alone do not leave nothing."""
    taken: dict[int, bool] = {}
    shortest = [min((n, at) for at, (_, y, n) in enumerate(sizes) if y == label)[1] for label in (0, 1) if any(y == label for _, y, _ in sizes)]
    docs_left, words_left = {0: chain_docs, 1: chain_docs}, {0: chain_words // 2, 1: chain_words // 2}
    for at in dict.fromkeys([*shortest, *range(len(sizes))]):
        doc, y, n = sizes[at]
        must = at in shortest
        if n <= words or must:
            words -= n
            taken[doc] = must or (docs_left[y] > 0 and n <= words_left[y])
            if taken[doc]:
                docs_left[y] -= 1
                words_left[y] -= n
    return taken


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, words: int = SAMPLE_WORDS, chain_docs: int = CHAIN_DOCS, chain_words: int = CHAIN_WORDS) -> dict:
    """Marker features, chain weights and the document model, from a bounded sample of labelled rows.

    The sample has at most `toxic` and `clean` labelled documents, in the order of a hash of the id,
    with at most `words` words together; held-out ids are left out. Of these at most chain_docs of
    each kind, with chain_words words together, are the chains that give the gradient. A text that
    does not fit is passed over for the next one, and only the shortest of a kind is exempt. Whole texts stay on the executors: the driver gets counts, markers, and the chains as
    numbers. Without toxic documents every score is below 0.5. Rows that repeat an id are documents
    of their own; labels that repeat one count once.
    """
    none = {"weights": {}, "trans": np.zeros((2, 2)), "doc": np.array([-3.0, 0.0, 0.0])}
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.where("y = 1").orderBy(*order).limit(toxic).union(rows.where("y = 0").orderBy(*order).limit(clean))
    have = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    have = stored(have.select("y", "text", "doc_id", word_count(F.col("text")).alias("n")), "toxic-sample")
    # At most toxic + clean rows of numbers; repeated rows of an id are one entry.
    sizes = have.groupBy("doc_id", "y").agg(F.sum("n").alias("n"), F.first(F.xxhash64("doc_id")).alias("h")).collect()
    chosen = sample_within([(r["doc_id"], r["y"], r["n"]) for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"]))], words, chain_docs, chain_words)
    chosen = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, chain boolean")
    have = stored(have.join(F.broadcast(chosen), "doc_id").select("y", "text", "doc_id", "chain"), "toxic-fit")
    n = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return none
    bad, rest = n[1], max(1, n.get(0, 0))
    parts = max(1, min(16, (bad + rest) // 64))
    least = max(3, 0.01 * bad)
    names = have.select("y", "text").repartition(parts).mapInArrow(_counted, "name string, k long, c long").groupBy("name").agg(F.sum("k").alias("k"), F.sum("c").alias("c")).where(F.col("k") >= least)
    names = stored(names, "toxic-names")
    counts = [tuple(r) for r in names.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most bad * rest, few in fact
    _, more = marker_kinds(counts, bad, rest)
    wanted = docs.sparkSession.createDataFrame([(k, c, w) for (k, c), w in more.items()], "k long, c long, w double")
    weight = {r["name"]: r for r in names.join(F.broadcast(wanted), ["k", "c"]).collect()}  # features of a bounded sample
    sure_kinds, _ = marker_kinds(counts, bad, rest)
    sure = {name for name, r in weight.items() if (r["k"], r["c"]) in sure_kinds}
    left = [set(r["names"]) for r in have.where("y = 1").select("y", "text").mapInArrow(_unmarked(sure, set(weight)), "names array<string>").collect()]
    marks = sure | cover(left, {name: r["w"] for name, r in weight.items()}, least)
    chains = have.where("chain").select("y", "text", "doc_id").mapInArrow(_numbered, "doc_id long, y int, words array<string>, own binary").collect()
    chains = sorted(((r["doc_id"], r["y"], r["words"], r["own"]) for r in chains), key=lambda r: (r[0], r[3]))
    model = fit_chain([(y, own_words, np.frombuffer(own, np.int32)) for _, y, own_words, own in chains], marks)
    del chains
    told = have.select("doc_id", "y", summariser(model)(F.col("text")).alias("s")).collect()  # two numbers a document of the sample
    told = sorted((r["doc_id"], r["y"], *r["s"]) for r in told)
    model["doc"] = fit_documents(np.array([t[2:] for t in told]), np.array([t[1] for t in told], float))
    return model


def summariser(model: dict):
    """A vectorised function of texts that gives what the document model is fitted on."""

    @F.pandas_udf("array<double>")
    def summary(texts: pd.Series) -> pd.Series:
        cache = Weights(model["weights"])
        return pd.Series([list(x) for at in range(0, len(texts), 100) for _, x in _marginals([t or "" for t in texts[at : at + 100]], model, cache)], dtype=object)

    return summary


def toxicity_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.5), spans.

    Every text is scored whole; null, empty and white texts have no tokens, and the score of a
    document without any toxic token. Repeated rows get equal scores, an empty table an empty
    result; other columns are ignored. Without toxic labels every score is below 0.5.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(model, spans)(F.col(text_col)).alias("__s"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__s.score").alias("score"), (F.col("__s.score") >= 0.5).cast("int").alias("predicted"), F.col("__s.spans").alias("spans"))
