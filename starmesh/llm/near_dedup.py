"""Near-duplicate groups by an LSH forest over MinHash signatures, with links confirmed on full sets.

A forest has several trees. A tree sorts all distinct shingle sets by their sequence of minimum
hashes; sets that share its first DEPTH hashes form a region. Next neighbours in a region's order,
which have the longest common prefixes, are the first candidates; with them most sets of a group
are linked at little cost. What then lies in one region but in different components is searched
again, whole, in a way that depends on how dense the region is:

* In a region of at most REGION sets all such pairs are candidates.
* The sets of larger regions, such as those of documents that share a template, are joined by an
  exact prefix filter: their shingles are ordered by how many of these sets have them, rare ones
  first; of two sets of similarity t the smaller has one of its first n - ceil(2t / (1 + t) * n) + 1
  shingles among the first n - ceil(t * n) + 1 of the other, at places that leave enough shingles
  after them. A template's shingles come last: unless it alone makes sets so similar, what makes
  documents alike is found without comparing all of a region.
* Before that join, sets around a common centre are linked through one of them. Of the sets with one
  shingle in their prefixes a sample gives the centre, the shingles of most of them; a set takes part
  in two such groups at most. Two sets differ
  by no more shingles than they differ from the centre together; where that is little enough they are
  linked, and all sets of such pairs are linked with the one that is closest to the centre too. So a
  link with that one stands for all pairs, and the join needs to find only what is farther off.

Where two components have many candidates, the two closest are confirmed first, and the others only
if the components are still apart. So a pair is missed only if it shares no region in any tree, however dense a region is: at
exactly 0.8 the chance is 3e-6. Candidates pass two filters before whole sets are fetched: the
sets' sizes, which is exact, and a sketch of 256 one-bit minimum hashes, which drops a pair at 0.8
with a chance of about 2e-8 (binomial, 6 standard deviations). Links are confirmed by the 64-bit
hashes of all shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starmesh.operators.components import connected_components

from .common import BROADCAST_ROWS, free_name, giving_back, semi, small_batches, stored, text_chunks

TREES = 24
#: Minimum hashes of a region's prefix, and of the order in all.
DEPTH, PATH = 4, 8
#: In larger regions candidates come from the prefix filter.
REGION = 32
#: Larger regions are ordered in parts of about so many, each tied to the region's first set.
PART = 1024
#: Neighbours after each set of a region's order.
NEXT = 2
SKETCH_BITS = 256
#: Text bytes handled at once; arrays of up to 8 bytes a byte are made of them.
CHUNK = 1 << 19
#: A shingle in more prefixes than HOT has a centre, from about so many sets.
HOT, CENTRE = 128, 16
#: Buckets in which shingles are counted for the prefix filter's order, and rows of a block of its join.
BUCKETS, BLOCK = 1 << 20, 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n + 1:
        up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    A-Z are lower-cased, words lie between the six ASCII white characters. A text of fewer than
    `size` words is one shingle, a text without words none.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    if not len(data):
        return [np.empty(0, np.uint64)] * len(texts)
    data = _LOWER[data]
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)
    out = []
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = _mix(runs * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            one = np.zeros(1, np.uint64)
            for w in words[lo:hi]:
                one = _mix(one * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(_mix(one + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, TREES * PATH + SKETCH_BITS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * PATH + SKETCH_BITS, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for i in range(0, len(x), 256):
        part = (x[i : i + 256, None] * _A + _B).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def _tree_keys(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, TREES) keys of the regions, and what follows them in the trees' order, 16 bits a hash."""
    m = _mix(sigs[:, : TREES * PATH].reshape(len(sigs), TREES, PATH).astype(np.uint64))
    run = np.broadcast_to(_mix(np.arange(1, TREES + 1, dtype=np.uint64)), m.shape[:2]).copy()
    for d in range(DEPTH):
        run = _mix(run * np.uint64(0xD6E8FEB86659FD93) + m[:, :, d])
    path = np.zeros(m.shape[:2], np.uint64)
    for d in range(DEPTH, PATH):
        path = path << np.uint64(16) | m[:, :, d] >> np.uint64(48)
    return run.view(np.int64), path.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("s", pa.list_(pa.int64())), ("regions", pa.list_(pa.int64())), ("paths", pa.list_(pa.int64()))])


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, most=CHUNK):
                sets = shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                cols: list[list] = [[None] * len(sets) for _ in range(3)]
                if full:
                    sigs = np.stack([signature(sets[i]) for i in full])
                    bits = np.packbits(_mix(sigs[:, TREES * PATH :].astype(np.uint64)).astype(np.uint8) & 1, axis=1).view(np.int64)
                    for c, rows in zip(cols, (bits, *_tree_keys(sigs)), strict=True):
                        for k, i in enumerate(full):
                            c[i] = rows[k]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], schema=_SIGNED)

    return run


def _sets(size: int):
    """Rows doc_id, text: the keys of their sets, and the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, most=CHUNK):
                sets = [s for s in shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])

    return run


def _confirm(percent: int):
    """Rows a, b, set_a, set_b: those whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _alike(percent: int):
    """Filters over a_n, b_n, a_s, b_s: sizes can reach the similarity, and sketches do not rule it out."""
    j = percent / 100
    sd = (((1 + j) / 2) * ((1 - j) / 2) / SKETCH_BITS) ** 0.5
    most = int(SKETCH_BITS * ((1 - j) / 2 + 6 * sd))
    sizes = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return sizes & (_distance() <= most)


def _distance():
    bits = None
    for i in range(SKETCH_BITS // 64):
        x = F.bit_count(F.col("a_s")[i].bitwiseXOR(F.col("b_s")[i]))
        bits = x if bits is None else bits + x
    return bits


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= percent * all shingles of both; component_id
    is the smallest doc_id reachable over links. Null, empty and white texts have no shingles and
    are linked with nothing. Rows of equal sets are one class and take part once. A null id gets a
    null component and is kept; rows that repeat an id are linked with each other, whatever their
    texts. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    # Rows of shingles are long. All such steps are run in here.
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, shingle, percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = docs.mapInArrow(giving_back(_sign(shingle)), "doc_id long, n long, set_key binary, s array<long>, regions array<long>, paths array<long>")
    signed = stored(signed.withColumn("row_no", F.monotonically_increasing_id()), "near-signed")
    linked = signed.where("n > 0 and doc_id is not null")
    # Classes of equal sets, each with its smallest id and the number of one of its rows.
    classes = stored(linked.groupBy("set_key").agg(F.min("row_no").alias("cid"), F.min("doc_id").alias("least")), "near-classes")
    first = linked.join(classes.select(F.col("cid").alias("row_no")), "row_no", "left_semi").withColumnRenamed("row_no", "cid")
    regions = stored(_regions(first), "near-regions")
    wanted = stored(first.select("cid", "doc_id", "set_key").join(regions.select("cid").distinct(), "cid", "left_semi"), "near-wanted")
    found = semi(docs.where("doc_id is not null"), wanted.select("doc_id").distinct(), "doc_id").mapInArrow(giving_back(_sets(shingle)), "set_key binary, shingles binary")
    sets = stored(found.join(wanted.select("cid", "set_key"), "set_key").groupBy("cid").agg(F.max("shingles").alias("shingles")), "near-sets")

    def confirm(some: DataFrame) -> DataFrame:
        a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        full = some.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        return stored(full.mapInArrow(giving_back(_confirm(percent)), "a long, b long"), "near-links")

    # Each set's two closest neighbours first; then what lies in different components still.
    pairs = stored(_neighbours(regions, percent), "near-pairs")
    ends = pairs.select(F.col("a").alias("c"), "a", "b", "d").union(pairs.select(F.col("b"), "a", "b", "d"))
    closest = F.row_number().over(W.partitionBy("c").orderBy("d", "a", "b"))
    links = confirm(ends.withColumn("n", closest).where("n <= 2").select("a", "b").distinct())
    label = stored(connected_components(links, contract=True), "near-labels")
    stars = lambda of: of.select(F.col("id").alias("a"), F.col("component").alias("b"))
    named = _mixed(regions, label)
    found = _small_regions(named, percent)
    dense = stored(named.where(F.col("size") > REGION).select("cid").distinct().join(sets, "cid"), "near-dense")
    if not dense.isEmpty():
        prefixes = _prefix_rows(dense, percent)
        hubs = confirm(_hubs(_labelled(prefixes, named), dense, percent))
        if not hubs.isEmpty():
            label = stored(connected_components(stars(label).union(hubs), contract=True), "near-labels")
            named = _mixed(regions, label)
        found = _small_regions(named, percent).union(_large_regions(named, _labelled(prefixes, named), percent))
    found = stored(found.distinct(), "near-candidates")
    closest = F.row_number().over(W.partitionBy("l", "m").orderBy("d", "a", "b"))
    more = confirm(found.withColumn("n", closest).where("n <= 2"))
    if not more.isEmpty():
        label = stored(connected_components(stars(label).union(more), contract=True), "near-labels")
        at = lambda c: label.toDF(c, f"of_{c}")
        found = found.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    more = confirm(found)

    # Rows that repeat an id tie their classes together.
    own = linked.select("doc_id", "set_key").join(classes, "set_key")
    ties = own.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a != z").select("doc_id", "a")
    ties = stored(own.join(ties, "doc_id").where("a != cid").select("a", F.col("cid").alias("b")), "near-ties")
    more = more.union(ties)
    if not more.isEmpty():
        label = stored(connected_components(stars(label).union(more), contract=True), "near-labels")

    of = classes.join(label, classes.cid == label.id, "left").select("set_key", "least", F.coalesce("component", "cid").alias("c"))
    rep = of.select("set_key", "c").join(of.groupBy("c").agg(F.min("least").alias("component_id")), "c")
    out = signed.select("doc_id", "n", "set_key").join(rep, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _regions(first: DataFrame) -> DataFrame:
    """(region, path, size, cid, n, s) for sets that share a region with another."""
    rows = first.select("cid", F.explode(F.arrays_zip("regions", "paths")).alias("r")).select("cid", "r.regions", "r.paths").toDF("cid", "region", "path")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "region").join(first.select("cid", "n", "s"), "cid")


def _mixed(regions: DataFrame, label: DataFrame) -> DataFrame:
    """The regions whose sets lie in different components, with each set's component l."""
    named = regions.join(label.toDF("cid", "l"), "cid", "left").withColumn("l", F.coalesce("l", "cid"))
    mixed = named.groupBy("region").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo != hi").select("region")
    return stored(named.join(mixed, "region", "left_semi"), "near-mixed")


def _neighbours(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): distinct pairs next to each other in a region's order, and with the first set of a
    region that is ordered in parts; d is the sketches' distance."""
    part = F.when(F.col("size") > PART, F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / PART))).otherwise(0)
    order = W.partitionBy("region", "part").orderBy("path", "cid")
    one = F.struct("cid", "n", "s")
    rows = regions.withColumn("part", part)
    near = rows.select(one.alias("x"), F.array(*[F.lead(one, k).over(order) for k in range(1, NEXT + 1)]).alias("ys")).select("x", F.explode("ys").alias("y")).where("y is not null")
    large = regions.where(F.col("size") > PART)
    heads = large.groupBy("region").agg(F.min(one).alias("y"))
    tied = large.join(heads, "region").select(one.alias("x"), "y").where("x.cid != y.cid")
    return _pairs(near.union(tied), percent).distinct()


def _pairs(xy: DataFrame, percent: int) -> DataFrame:
    """(a, b, d) of pairs x, y that pass the filters, the smaller number first."""
    turned = xy.select(F.when(F.col("x.cid") < F.col("y.cid"), F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("p"))
    flat = turned.select(F.col("p.x.cid").alias("a"), F.col("p.y.cid").alias("b"), F.col("p.x.n").alias("a_n"), F.col("p.y.n").alias("b_n"), F.col("p.x.s").alias("a_s"), F.col("p.y.s").alias("b_s"))
    return flat.where(_alike(percent)).select("a", "b", _distance().alias("d"))


def _small_regions(named: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, l, m): all pairs of a region of at most REGION sets that lie in different
    components l and m and pass the filters."""
    some = named.where(F.col("size") <= REGION)
    side = lambda name: some.select("region", F.col("cid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "s", "l")])
    both = side("a").join(side("b"), "region").where((F.col("a") < F.col("b")) & (F.col("a_l") != F.col("b_l")))
    return _filtered(both, percent)


def _filtered(both: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs, with n, s and l of both, that pass the filters."""
    return both.where(_alike(percent)).select("a", "b", _distance().alias("d"), F.least("a_l", "b_l").alias("l"), F.greatest("a_l", "b_l").alias("m"))


def _labelled(prefixes: DataFrame, named: DataFrame) -> DataFrame:
    """The prefixes of the sets of the larger regions, with their components l."""
    return prefixes.join(named.where(F.col("size") > REGION).groupBy("cid").agg(F.max("l").alias("l")), "cid")


def _prefix_rows(dense: DataFrame, percent: int) -> DataFrame:
    """(cid, n, shingle, left, short): see _prefixes. Shingles are ordered by how many of these sets have them."""
    counted = dense.select("shingles").mapInArrow(giving_back(_bucket_counts), "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["k"].to_numpy()
    shared = dense.sparkSession.sparkContext.broadcast(counts)  # 8 bytes a bucket
    return stored(dense.select("cid", "shingles").mapInArrow(giving_back(_prefixes(shared, percent)), "cid long, n long, shingle long, left long, short boolean"), "near-prefixes")


def _members(rows: DataFrame) -> DataFrame:
    """(shingle, cid, l, k, part): the sets around at most two centres each, one for the set's most
    frequent and one for its rarest shingle of those that are in more prefixes than HOT, of several
    components. k counts the sets of a shingle that are left; these are dealt to parts. So however
    long texts are, a set is sent on twice at most, and centres are an eighth of the sets in number."""
    hot = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("l").alias("lo"), F.max("l").alias("hi")).where((F.col("k") > HOT) & (F.col("lo") != F.col("hi")))
    one = F.struct("k", "shingle")
    own = rows.select("shingle", "cid", "l").join(_few(hot.select("shingle", "k")), "shingle").groupBy("cid").agg(F.max("l").alias("l"), F.array_distinct(F.array(F.max(one), F.min(one))).alias("both"))
    own = stored(own.select(F.explode("both.shingle").alias("shingle"), "cid", "l"), "near-chosen")
    sizes = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= CENTRE)
    return stored(own.join(_few(sizes), "shingle").withColumn("part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("k") / BLOCK))), "near-hot")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    df = stored(df, "near-few")
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hubs(rows: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that a centre shows to be links, one for two components.

    The sets around a centre are compared with it; those that with the closest one differ from it by
    no more than a link may are paired with the closest one. Any centre is right.
    """
    members = _members(rows)
    some = members.where(F.pmod(F.xxhash64("cid"), F.ceil(F.col("k") / CENTRE)) == 0).select("shingle", "cid")
    held = some.join(dense, "cid").select("shingle", "shingles").mapInArrow(giving_back(_each), "shingle long, one long")
    often = held.groupBy("shingle", "one").agg(F.count(F.lit(1)).alias("k")).join(some.groupBy("shingle").agg(F.count(F.lit(1)).alias("of")), "shingle").where("2 * k > of")
    parts = members.select("shingle", "part").distinct()
    centres = stored(often.groupBy("shingle").agg(F.sort_array(F.collect_list("one")).alias("centre")).join(parts, "shingle"), "near-centres")
    far = members.join(dense, "cid").join(centres, ["shingle", "part"]).select("shingle", "part", "cid", "l", "shingles", "centre")
    far = stored(far.mapInArrow(giving_back(_off_centre(percent)), "shingle long, part long, cid long, l long, w long"), "near-off-centre")
    hub = far.groupBy("shingle").agg(F.min(F.struct("w", "cid", "l")).alias("h")).join(parts, "shingle")
    tied = far.join(hub, ["shingle", "part"]).where("w + h.w <= 0 and l != h.l")
    ends = tied.select(F.least("cid", "h.cid").alias("a"), F.greatest("cid", "h.cid").alias("b"), F.least("l", "h.l").alias("l"), F.greatest("l", "h.l").alias("m"))
    return ends.groupBy("l", "m").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows shingle, shingles: a row for each of the set's shingles."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column(0)[i].as_py())), pa.array(x)], names=["shingle", "one"])


def _off_centre(percent: int):
    """Rows shingle, part, cid, l, shingles, centre: w, so that two sets are linked if their sum is not over
    0. Sets of sizes n and m that differ by d shingles are linked if (100 + percent) * d is at most
    (100 - percent) * (n + m); d is at most the sum of what each differs from the centre by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64), batch.column(5)[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                off.append((100 + percent) * (len(x) + len(y) - 2 * both) - (100 - percent) * len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(off, pa.int64())], names=["shingle", "part", "cid", "l", "w"])

    return run


def _large_regions(named: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, l, m): pairs of sets of the larger regions, in different components l and m, that
    share a shingle of their prefixes and pass the filters.

    For each shingle the component with most of its sets is not compared with itself. Where many
    sets have a shingle in their prefix, both sides are dealt to parts, and each pair of parts is a block.
    """
    per = rows.groupBy("shingle", "l").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("shingle").agg(F.max(F.struct("k", "l")).alias("m"), F.sum("k").alias("k")).where("k > m.k")
    per = _few(per.select("shingle", F.col("m.l").alias("main"), F.ceil(F.col("k") / BLOCK).alias("parts")))
    rows = stored(rows.join(per, "shingle"), "near-shared")
    dealt = F.pmod(F.xxhash64("cid"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    own = ("cid", "l", "n", "left")
    smaller = rows.where("short").withColumn("i", dealt).withColumn("j", every).select("shingle", "i", "j", *[F.col(c).alias(f"x_{c}") for c in own], "main")
    larger = rows.withColumn("j", dealt).withColumn("i", every).select("shingle", "i", "j", *[F.col(c).alias(f"y_{c}") for c in own])
    fits = (F.col("x_l") != F.col("y_l")) & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_cid") != F.col("y_cid")))) & (100 * F.col("x_n") >= percent * F.col("y_n"))
    # The first shingle that both share leaves at least as many as they must share.
    fits = fits & ((100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_n") + F.col("y_n")))
    joined = lambda x, y: x.join(y, ["shingle", "i", "j"]).where(fits).select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b"))
    main = F.col("x_l") == F.col("main")
    others = larger.join(per.select("shingle", F.col("main").alias("y_main")), "shingle").where("y_l != y_main").drop("y_main")
    pairs = joined(smaller.where(~main), larger).union(joined(smaller.where(main), others)).distinct()
    sketches = stored(named.dropDuplicates(["cid"]).select("cid", "n", "s", "l"), "near-sketches")
    side = lambda c: sketches.toDF(c, f"{c}_n", f"{c}_s", f"{c}_l")
    return _filtered(pairs.join(side("a"), "a").join(side("b"), "b"), percent)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            counts[np.frombuffer(batch.column(0)[i].as_buffer(), np.uint64) & np.uint64(BUCKETS - 1)] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "k"])


def _prefixes(shared, percent: int):
    """The shingles of the sets' prefixes, rare ones first; left counts the set's shingles from this
    one on, short says if it is in the prefix that counts where the set is the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            at, n, own, left, short = [], [], [], [], []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                size = len(x) + (-percent * len(x)) // 100 + 1
                order = np.lexsort((x, counts[x & np.uint64(BUCKETS - 1)]))[:size]
                own.append(x[order].view(np.int64))
                at.append(np.full(size, i))
                n.append(np.full(size, len(x)))
                left.append(len(x) - np.arange(size))
                short.append(np.arange(size) < len(x) + (-2 * percent * len(x)) // (100 + percent) + 1)
            if at:
                where = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), *(pa.array(np.concatenate(c)) for c in (n, own, left, short))], names=["cid", "n", "shingle", "left", "short"])

    return run


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its near-duplicate group, with their columns,
    whatever their names. Null, empty and white texts have no group: they stay, as do rows without
    an id. Rows that repeat an id stay or go together. An empty table stays empty."""
    name = free_name(docs, "__id")
    found = near_duplicates(docs, id_col, text_col, shingle, percent)
    gone = stored(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    few = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return docs.join(few, docs[id_col].cast("long") == few[name], "left_anti")
