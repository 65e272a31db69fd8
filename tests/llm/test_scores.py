import zlib

import numpy as np
import pytest

from starmesh.llm import quality, queries, toxicity


def test_chain_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = np.array([100, 1, 64, 535])
    u, trans = rng.normal(size=700) * 3, np.array([[0.3, -1], [0.2, 0.5]])
    a, want, at, pairs = np.exp(trans), [], 0, np.zeros((2, 2))
    for n in lengths:
        e, f, b = np.exp(u[at : at + n]), [np.array([1.0, 0.0])], [np.ones(2)]
        for t in range(n):
            x = (f[-1] @ a) * [1, e[t]]
            f.append(x / x.sum())
        for t in range(n - 1, -1, -1):
            x = a @ (np.array([1, e[t]]) * b[-1])
            b.append(x / x.sum())
        b = b[::-1]
        for t in range(n):
            z = f[t + 1] * b[t + 1]
            want.append(z[1] / z.sum())
            xi = f[t][:, None] * a * (np.array([1, e[t]]) * b[t + 1])[None]
            pairs += xi / xi.sum()
        at += n
    got, expected = toxicity.Chain(trans).run(u, lengths, pairs=True)
    assert np.abs(got - want).max() < 1e-12 and np.abs(expected - pairs).max() < 1e-9


def test_word_weights_do_not_depend_on_the_cache():
    w = toxicity.Weights({"z": 0.5, "wabc": 1.0, "pabc": 2.0, "pabcd": 4.0, "sabc": 8.0})
    assert w["Abc,"] == 0.5 + 1 + 2 + 8 and w["abcde"] == 0.5 + 2 + 4 and w["ab"] == 0.5


def test_toxic_spans_and_edge_texts(docs_of, spark):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(plain, 40)) for _ in range(400)]
    toxic = [int(i % 4 == 0) for i in range(400)]
    learn = docs_of([(i, t + (" grumpf, word1 grumpf" if y else "")) for i, (t, y) in enumerate(zip(texts, toxic, strict=True))] + [(0, "repeated id"), (500, None)])
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(500, 0), (500, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(learn, labels)
    text = "  word5 grumpf\ngrumpf! word7"
    docs = docs_of([(1, text), (2, "word5 word7"), (3, None), (4, ""), (5, "word9 " * 40000), (5, "word9 " * 40000)])
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert [text[a:b] for a, b in got[1]["spans"]] == ["grumpf\ngrumpf!"] and got[1]["predicted"] == 1
    assert [got[i]["predicted"] for i in (2, 3, 4, 5)] == [0, 0, 0, 0] and got[3]["score"] == got[4]["score"]
    assert toxicity.toxicity_scores(docs, model).count() == 6
    assert toxicity.toxicity_scores(docs.where("false"), model).count() == 0
    none = toxicity.train(learn, labels.where("false"))
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    # A sample cut by its words still has whole documents, and the bound holds.
    small = toxicity.train(learn, labels, words=4000, chain_words=2000)
    assert set(small) == set(model) and abs(small["trans"]).max() < abs(model["trans"]).max()


def test_markers_are_not_chance():
    assert abs(np.exp(toxicity.unlikely(2, 3, 0.25)) - (3 * 0.25**2 * 0.75 + 0.25**3)) < 1e-12
    sure, more = toxicity.marker_kinds([(3, 0, 3000), (12, 0, 10), (40, 30, 5)], 50, 300)
    assert set(sure) == {(12, 0)} and set(more) == {(12, 0), (40, 30)}
    assert toxicity.cover([{"a", "b"}, {"a"}, {"b"}, {"c"}], {"a": 1.0, "b": 2.0, "c": 9.0}, 2) == {"b"}


def test_quality_edge_cases(docs_of, spark):
    docs = docs_of([(i, "good words in a row %d" % i if i % 2 else "$$$ %%% $$$ %%%") for i in range(60)] + [(100, None), (101, ""), (102, "x y " * 50000)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").where("doc_id < 60")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(60)) and got[100]["score"] == got[101]["score"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert quality.keep_good(docs, model).columns == docs.columns
    twice = docs.where("doc_id < 3").union(docs.where("doc_id < 3")).selectExpr("*", "'mine' as x", "'mine' as __y", "'mine' as predicted")
    assert sorted((r["doc_id"], r["score"]) for r in quality.quality_scores(twice, model).collect()) == sorted((i, got[i]["score"]) for i in (0, 1, 2) for _ in range(2))
    assert quality.keep_good(twice, quality.train(twice, labels.union(labels))).count() in (2, 6)
    empty = quality.train(docs, labels.where("false"))
    assert {r["predicted"] for r in quality.quality_scores(docs, empty).collect()} == {1}
    assert quality.quality_scores(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_quality_learns_all_pairs_of_all_labels(docs_of, spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    rng = np.random.default_rng(3)
    words, junk = [f"word{i}" for i in range(50)], ["$$", "WORD", "a1b2", "!!"]
    y = rng.random(2500) < 0.6
    texts = [" ".join([*rng.choice(words, rng.integers(5, 40)), *rng.choice(junk, rng.poisson(2 if good else 5))]) for good in y]
    texts[7] = "! " * 3000
    docs = docs_of(list(enumerate(texts)) + [(-1, "no label"), (None, "no id")])
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(y)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    used = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(y))])
    x, y = np.array([quality.features(t) for t in texts])[used], y[used]
    sd = x.std(0) + 1e-6
    z, w = (x - x.mean(0)) / sd, model["w"] * sd
    good, bad = z[y], z[~y]
    p = 1 / (1 + np.exp((good @ w)[:, None] - bad @ w))
    slope = (p.sum(1) @ good - p.sum(0) @ bad) / p.size - 1e-3 * w
    assert np.abs(w).max() > 0.5 and np.abs(slope).max() < 1e-6
    s, k = np.sort((x - model["mean"]) @ model["w"]), len(bad)
    assert s[k - 1] - 1e-9 <= model["cut"] <= s[k] + 1e-9 and abs(model["cut"] - (s[k - 1] + s[k]) / 2) < 1e-9


def test_a_value_by_its_rank(spark):
    values = [0.0, 1.0, 1.0, 1.0, 1.0 + 1e-15, 2.0, 1e9, -1e9, 1e-300]
    df, values = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
    assert [quality.by_rank(df, i) for i in range(8)] == list(zip(values, values[1:], strict=False))


@pytest.mark.parametrize(("query", "label", "sf", "least"), [(queries.op3_toxicity, "toxic", "sf0.01", 0.95), (queries.op3_toxicity, "toxic", "sf0.1", 0.97), (queries.op7_quality, "quality", "sf0.01", 0.97), (queries.op7_quality, "quality", "sf0.1", 0.97)])
def test_held_out_accuracy(spark, query, label, sf, least):
    data = f"/root/testdata/{sf}"
    scored = query(spark, data).join(queries.table(spark, data, "labels"), "doc_id").where("held_out").toPandas()
    right = (scored["predicted"] == scored[label]).mean()
    # Better than always telling the more frequent label.
    assert len(scored) > 40 and right >= least and right > max(scored[label].mean(), 1 - scored[label].mean())


def test_long_labelled_texts_do_not_switch_training_off(docs_of, spark):
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(300)]
    toxic = [int(i % 4 == 0) for i in range(400)]
    rows = [(i, " ".join(rng.choice(plain, 40)) + (" grumpf" if y else "")) for i, y in enumerate(toxic)]
    held, ids = [], iter(range(1000, 2000))
    while len(held) < 4:
        i = next(ids)
        held += [i] if zlib.crc32(str(i).encode()) % 5 else []
    long = [(i, "word7 " * 20_001 + "grumpf" * (n % 2)) for n, i in enumerate(held)]
    labels = spark.createDataFrame([*enumerate(toxic), *((i, n % 2) for n, i in enumerate(held))], "doc_id long, toxic int")
    asked = docs_of([(i, f"word{i} word{i + 1}" + (" grumpf" if i % 2 else "")) for i in range(40)])
    for words, chain in ((20_000, 1_000_000), (6_000_000, 20_000)):
        model = toxicity.train(docs_of(rows + long), labels, words=words, chain_words=chain)
        assert model["weights"]
        assert [r["predicted"] for r in toxicity.toxicity_scores(asked, model).orderBy("doc_id").collect()] == [i % 2 for i in range(40)]


def test_the_sample_passes_over_what_does_not_fit():
    sizes = [(1, 0, 90), (2, 1, 10), (3, 0, 500), (4, 0, 20), (5, 1, 15), (6, 0, 40)]
    assert toxicity.sample_within(sizes, 100, 9, 60) == {4: True, 2: True, 5: True, 6: False}
    assert toxicity.sample_within(sizes, 10**6, 1, 10**6) == {4: True, 2: True, 1: False, 3: False, 5: False, 6: False}
    assert toxicity.sample_within([(1, 1, 500), (2, 0, 400)], 10, 9, 10) == {1: True, 2: True}
    assert toxicity.sample_within([], 10, 9, 10) == {}
