import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmesh.llm import clustering, decontaminate, fim

TEXTS = [(1, "one two  three\tfour \n"), (2, None), (3, ""), (4, " \t "), (5, "has <M> inside"), (6, "naïve 🦊 fox " * 40), (7, "x" * 5000), (8, "a b " * 30000), (9, "<" * 30 + " <S <P "), (10, "same text"), (10, "same text"), (None, "no id")]


def plain_fim(i, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return i, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("bound", [fim.BROADCAST_ROWS, 3])
def test_fim_is_plain_cutting(docs_of, monkeypatch, bound):
    monkeypatch.setattr(fim, "BROADCAST_ROWS", bound)
    rows = TEXTS + [(100 + i, f"w{i} and  some  words\n" * (i % 7) + " " * (i % 3)) for i in range(60)]
    made = fim.fill_in_middle(docs_of(rows))
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(map(tuple, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=key)
    assert got == sorted((plain_fim(i, t) for i, t in rows), key=key)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fim.fill_in_middle(docs_of(TEXTS).where("false")).count() == 0


def plain_leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    grams = {(tuple(w[i : i + min(len(w), size)]), str("" if k is None else k)) for k, t in items if (w := words(t)) for i in range(max(1, len(w) - size + 1))}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for g, item in grams:
            for at in range(len(w) - len(g) + 1):
                if tuple(w[at : at + len(g)]) == g:
                    hit.update(range(at, at + len(g)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "The QUICK brown fox jumps over the lazy dog while seven éclairs cool slowly"
ITEMS = [(1, PASSAGE), (20, PASSAGE.lower() + " on a shelf"), (3, "two words"), (4, None), (5, "..."), (6, "solo"), (7, PASSAGE), (7, "another text of this id"), (None, "one two three four five six seven eight nine ten eleven")]
DOCS = [(1, f"start here. {PASSAGE}! the end"), (2, PASSAGE), (3, None), (4, ""), (5, "two, words and two-words; solo?"), (6, "the quick brown fox jumps over the lazy"), (7, "clean " * 3000), (8, " ".join([PASSAGE] * 3)), (8, " ".join([PASSAGE] * 3)), (None, "six words: solo"), (9, "quick brown fox jumps over the lazy dog while seven and one two three four five six seven eight nine ten"), (10, "a b c " * 5000 + PASSAGE)]


@pytest.mark.parametrize(("block", "window"), [(decontaminate.BROADCAST_BYTES, 10), (300, 10), (decontaminate.BROADCAST_BYTES, 3)])
def test_contamination_is_plain_search(spark, docs_of, monkeypatch, block, window):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n", F.lit("clash"))
    got = decontaminate.contamination(docs_of(DOCS), bench, window=window).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == plain_leaks(DOCS, ITEMS, window)


def test_contamination_without_items_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs_of(DOCS), none).collect()
    assert len(got) == len(DOCS) and not any(r["contaminated"] or r["n_items"] for r in got)
    assert decontaminate.contamination(docs_of(DOCS).where("false"), none).count() == 0


def test_decontaminated_documents_and_spans(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(DOCS)
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "6", "7"]
    cut = decontaminate.decontaminated(docs, bench, "spans")
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "start here. the end" and texts[2] == "" and texts[8] == "" and texts[3] is None and texts[6] == DOCS[5][1]
    assert texts[5] == "and " and texts[None] == "six words: "
    assert not any(r["contaminated"] for r in decontaminate.contamination(cut, bench).where("doc_id != 5").collect())
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, bench, "lines")


def plain_lloyd(rows, k, rounds):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [assign(v)[1] for _, v in good]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(good, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, assign(v)[1], assign(v)[0]) for i, v in good), key=str), centroids


@pytest.mark.parametrize("k", [5, 40])
def test_lloyd_is_plain_lloyd(spark, monkeypatch, k):
    monkeypatch.setattr(clustering, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(i % 4, 0.3, 4)]) for i in range(120)]
    # Ties, repeated rows and ids, and what is left out.
    rows += [(i, [0.0, 0.0, 0.0, 0.0]) for i in range(200, 230)] + [rows[3], (5, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [float("inf"), 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(5)
    assigned, centroids = clustering.clusters(table, k=k, rounds=4, dim=4)
    want, ends = plain_lloyd(rows, k, 4)
    assert sorted(map(tuple, assigned.collect()), key=str) == want and centroids.tolist() == ends
    told = clustering.summary(assigned, centroids).collect()
    per = {j: sum(d for _, c, d in want if c == j) for j in range(k)}
    for r in told:
        assert r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, ends[r["cluster"]])).encode()).hexdigest()


def test_lloyd_with_few_vectors_and_none(spark):
    table = spark.createDataFrame([(1, [1e30, -1e30]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assigned, centroids = clustering.clusters(table, dim=2)
    assert sorted((r["vec_id"], r["distance"]) for r in assigned.collect()) == [(1, 0), (2, 0)] and abs(centroids).max() == clustering.MOST
    assigned, centroids = clustering.clusters(table.where("false"), dim=2)
    assert clustering.summary(assigned, centroids).count() == 0 and not len(centroids)
