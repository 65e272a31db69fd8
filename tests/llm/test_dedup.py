import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmesh.llm import exact_dedup, mixing, near_dedup, queries
from starmesh.llm.common import WHITE


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate({ord(c): None for c in WHITE}), []).append((i, t or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0]))[0]
        out += [(i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "x y"), (8, "xy"), (9, "long " * 30000), (10, "long" * 30000), (11, "é"), (12, "a  b")]


def exact(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_groups(docs_of):
    assert exact(exact_dedup.exact_dedup(docs_of(ROWS))) == brute_exact(ROWS)


def test_exact_checks_bytes_when_digests_collide(docs_of):
    weak = lambda norm: F.unhex(F.lpad(F.hex(F.length(norm) % 3), 2, "0"))
    assert exact(exact_dedup.exact_dedup(docs_of(ROWS), digest=weak)) == brute_exact(ROWS)


def test_exact_hot_group_repeats_nulls_and_nothing(docs_of, spark):
    rows = [(i, "same text" + " " * (i % 4)) for i in range(300)] + [(1000 + i, f"t{i}") for i in range(100)]
    assert exact(exact_dedup.exact_dedup(docs_of(rows))) == brute_exact(rows)
    odd = docs_of([(5, "q"), (5, "q"), (None, "q"), (None, "z")])
    got = exact_dedup.exact_dedup(odd).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == [("5", "5", 3), ("5", "5", 3), ("None", "5", 3), ("None", "None", 1)]
    assert sum(r["kept"] for r in got) == 2
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 2
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0
    assert exact_dedup.exact_dedup(spark.range(3).selectExpr("id as doc_id", "'u' as text").distinct()).count() == 3


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    lab = {i: i for i in sets}

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                lab[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def near(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def near_rows(n_families=12, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(n_families):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200, 500]))]
        for c in range(rng.choice([1, 2, 5, 30])):
            own = [rng.choice(words) if c and rng.random() < rng.choice([0, 0.01, 0.04, 0.2]) else w for w in base]
            rows.append((len(rows) * 3 + f % 2, " ".join(own)))
    return rows + [(9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "one"), (9006, "two words"), (9007, "TWO  words"), (9008, "ÉTÉ a"), (9009, "été a")]


def test_near_groups_against_brute_force(docs_of):
    rows = near_rows()
    for size in (2, 5):
        assert near(near_dedup.near_duplicates(docs_of(rows), shingle=size)) == brute_near(rows, size, 80)


def test_near_representatives_and_nothing(docs_of):
    docs = docs_of([(3, "a b c d e f g h"), (1, "a b c d e f g H"), (2, "z"), (None, "z"), (4, None), (5, None)])
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 4, 5}
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0
    assert {r["kept"] for r in near_dedup.near_duplicates(docs.where("doc_id > 3")).collect()} == {True}


def test_large_region_is_ordered_in_parts_and_compared_whole(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 8)
    monkeypatch.setattr(near_dedup, "REGION", 4)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([f"v{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base])) for i in range(60)]
    assert near(near_dedup.near_duplicates(docs_of(rows), shingle=2)) == brute_near(rows, 2, 80)


def test_shingles_are_those_of_the_words():
    texts = ["A b c a B c", "", "one", "x  y", "é É é", "a\x0bb\x1cc d"]
    sets = near_dedup.shingle_sets([t.encode() for t in texts], 2)
    assert [len(s) for s in sets] == [3, 0, 1, 1, 2, 2]
    again = near_dedup.shingle_sets([b"a B c", *[t.encode() for t in texts]], 2)
    assert all((a == b).all() for a, b in zip(sets, again[1:], strict=True))
    assert np.isin(again[0], sets[0]).all()


def test_exact_extreme_ids_and_clashing_names(docs_of, spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (None, "ab"), (0, "c"), (None, "c ")]
    got = exact_dedup.exact_dedup(docs_of(rows)).collect()
    assert {(str(r["doc_id"]), r["keep_id"], r["kept"]) for r in got} == set([(str(-(2**63)), -(2**63), True), (str(2**63 - 1), -(2**63), False), ("None", -(2**63), False), ("0", None, False), ("None", None, True)])
    odd = docs_of(rows).withColumn("__place", F.lit("mine")).withColumn("__id", F.lit("mine")).withColumn("locator", F.lit("mine")).withColumn("__times", F.lit(1)).withColumn("__copy", F.lit(1))
    for stage in (exact_dedup.keep_first, near_dedup.keep_representatives, mixing.mixed):
        out = stage(odd)
        assert out.columns == odd.columns and {r["__place"] for r in out.collect()} == {"mine"}
        assert stage(odd.where("false")).count() == 0
    # A derived table, and one with a column of the name of Spark's hidden one.
    derived = odd.join(spark.range(1).withColumnRenamed("id", "one"), F.lit(True)).withColumn("_metadata", F.lit("mine"))
    assert exact_dedup.keep_first(derived).count() == 2 and exact_dedup.keep_first(derived).columns == derived.columns


def test_exact_state_outlives_a_run(docs_of, tmp_path):
    base = f"file://{tmp_path}/state"
    first = exact_dedup.exact_dedup(docs_of([(5, "a b"), (6, "x"), (7, "ab")]), state_dir=base).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in first} == {(5, 5, 2, True), (7, 5, 2, False), (6, 6, 1, True)}
    second = exact_dedup.exact_dedup(docs_of([(1, "ab"), (2, "a  b"), (9, "new")]), state_dir=base).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in second} == {(1, 2, 4, False), (2, 2, 4, True), (9, 9, 1, True)}
    third = exact_dedup.exact_dedup(docs_of([(3, "x"), (4, "ab")]), state_dir=base).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in third} == {(3, 3, 2, True), (4, 2, 5, False)}


def test_dense_template_and_repeated_ids(docs_of, spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(260):  # two thirds of each text are shared; some are near copies of others
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        if rows and rng.random() < 0.2:
            own = rng.choice(rows)[1].split()[120:]
            for _ in range(rng.randrange(1, 12)):
                own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i * 7 % 997 + 1000 * (i // 997), " ".join(base + own)))
    docs = docs_of(rows + [(20_000 + i, " ".join(base[:100] + [f"p{i}"])) for i in range(60)])
    assert near(near_dedup.near_duplicates(docs, shingle=2)) == brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], 2, 80)
    again = docs_of([(1, "a b c d e f g h"), (1, "x y z u v w s t"), (2, "x y z u v w s t"), (3, "a b c d e f g h"), (4, "long " * 50_000), (5, "long " * 60_000), (4, None)])
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(again, shingle=5).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_copies_around_a_centre_are_not_compared_with_each_other(docs_of, monkeypatch):
    rng = random.Random(8)
    base = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(400):  # the base, and copies with one to six other words; up to three are few enough for a link with it
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7) if i else 0):
            own[at] = f"e{rng.randrange(40)}"
        rows.append((i * 7, " ".join(own)))
    counts, stored, neighbours = {}, near_dedup.stored, near_dedup._neighbours

    def counted(df, name):
        out = stored(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    # The first pass leaves most sets apart.
    monkeypatch.setattr(near_dedup, "_neighbours", lambda regions, percent: neighbours(regions, percent).where("(a + b) % 5 = 0"))
    assert near(near_dedup.near_duplicates(docs_of(rows), shingle=5)) == brute_near(rows, 5, 80)
    assert counts["near-candidates"][0] < 25 * len(rows)


def exact_links(texts, size, percent):
    """Pairs of different sets at the similarity, by a plain prefix filter over all texts."""
    sets = sorted({frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or frozenset({tuple(w)}) for t in texts if (w := (t or "").encode().lower().split())}, key=lambda s: (len(s), sorted(s)[0]))
    often = Counter(x for s in sets for x in s)
    seen, found = {}, []
    for i, s in enumerate(sets):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) + (-percent * len(s)) // 100 + 1]:
            near.update(seen.setdefault(x, []))
            seen[x].append(i)
        found += [(sets[j], s) for j in near if 100 * len(sets[j]) >= percent * len(s) and 100 * len(s & sets[j]) >= percent * len(s | sets[j])]
    return found


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    data = f"/root/testdata/{sf}"
    rows = queries.table(spark, data, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in queries.op2_near_dedup(spark, data).collect()}
    assert len(got) == len(rows)
    of = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        of.setdefault(frozenset(tuple(w[k : k + 2]) for k in range(len(w) - 1)) or frozenset({tuple(w)}), []).append(i)
    links = exact_links([t for _, t in rows], 2, 80)
    lab = {i: i for i, _ in rows}

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    ties = [(own[0], j) for s, own in of.items() if s != {()} for j in own] + [(of[a][0], of[b][0]) for a, b in links]
    for a, b in ties:
        a, b = find(a), find(b)
        lab[max(a, b)] = min(a, b)
    assert len(links) > 10 and all(got[i] == find(i) for i, _ in rows)


@pytest.mark.parametrize("words", [500, 2000, 8000])
def test_centres_send_each_set_twice_at_most(spark, words):
    rng = random.Random(words)
    template = [f"t{i}" for i in range(words)]
    texts = [" ".join(f"o{d}x{i}" if i % 8 == 0 else w for i, w in enumerate(template)).encode() for d in range(200)]
    rng.shuffle(texts)
    sets = near_dedup.shingle_sets(texts, 5)
    dense = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cid long, shingles binary")
    rows = near_dedup._prefix_rows(dense, 80).withColumn("l", F.col("cid"))
    sent = near_dedup._members(rows).join(dense, "cid").agg(F.sum(F.length("shingles"))).first()[0] or 0
    assert sent <= 2 * sum(s.nbytes for s in sets)


def test_centres_of_parts(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    monkeypatch.setattr(near_dedup, "HOT", 8)
    monkeypatch.setattr(near_dedup, "CENTRE", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    rows = []
    for f in range(3):
        base = [f"b{f}x{i}" for i in range(80)] + [f"common{i}" for i in range(60)]
        rows += [(100 * f + i, " ".join([f"v{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in base])) for i in range(40)]
    assert near(near_dedup.near_duplicates(docs_of(rows), shingle=2)) == brute_near(rows, 2, 80)
