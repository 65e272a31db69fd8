"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

The schedule is a row of slots. Slot i has the golden-ratio point of i, which is mapped through
the cumulative weights to a source; a source's slots are ranked. A source's documents, shuffled
by a hash, form one row of tokens that is cut into blocks of equal length; the slot of rank r
takes block r, beginning again at the end, until the source's target is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, free_name, ranked, stored, word_count

#: Tokens of a block.
BLOCK = 128
#: Cells into which the unit interval is cut to find a point's source by an equality join.
CELLS = 1 << 14
#: The golden ratio's fraction in 48 bits, by halves, and a mask of 24 bits.
GOLDEN_HI, GOLDEN_LO, LOW = 0x9E3779, 0xB97F4B, (1 << 24) - 1
#: Slots that a source is dealt beyond those it needs. Of n points, an interval of length p has n * p to
#: within twice the sum of n's digits by the convergents of GOLDEN / 2 ** 48 (Denjoy-Koksma); the digits
#: are at most the partial quotients, whose sum is 127. Four more are for rounding.
SPARE = 2 * 127 + 4


def source_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds weight and target to (source, source_size).

    Sources in code point order, null last, weigh 3, 1, 2, repeating. They share total_share of
    all sizes by weight; none gets more than cap times its size, and what is above is shared by
    weight among the others. That is a common level: target = min(cap * size, level * weight).
    One row per source comes through the windows here, not one per document.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("__n"), F.lit(len(weights))) + 1).cast("int"))
    ordered = sizes.withColumn("__n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w.cast("double"))
    by_limit = W.partitionBy(F.lit(0)).orderBy(F.col("__limit"), F.col("__n"))
    done = by_limit.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy(F.lit(0))
    x = ordered.withColumn("__cap", cap * F.col("source_size")).withColumn("__limit", F.col("__cap") / F.col("weight"))
    x = x.withColumn("__before", F.coalesce(F.sum("__cap").over(done), F.lit(0.0)))
    x = x.withColumn("__rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
    x = x.withColumn("__level", (total_share * F.sum("source_size").over(all_rows) - F.col("__before")) / F.col("__rest"))
    # The level holds from the first source, by its limit, that it does not take above its limit.
    fits = F.col("__level") <= F.col("__limit")
    x = x.withColumn("__at", F.min_by(F.when(fits, F.col("__level")), F.when(fits, F.struct("__limit", "__n"))).over(all_rows))
    target = F.least("__cap", F.coalesce(F.col("__at") * F.col("weight"), F.col("__cap")))
    return x.select("source", "source_size", F.col("__n").alias("source_no"), "weight", target.alias("target"))


def schedule(targets: DataFrame, total: float, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, rank): the slots of the mix in order. total is the sum of the targets."""
    spark = targets.sparkSession
    n_slots = int(total / block * 1.01) + 64 if total else 0
    over = W.partitionBy(F.lit(0)).orderBy("source_no")
    share = targets.where("target > 0").withColumn("__hi", F.sum("target").over(over) / F.sum("target").over(W.partitionBy(F.lit(0))))
    share = share.withColumn("__lo", F.coalesce(F.lag("__hi").over(over), F.lit(0.0))).withColumn("__last", F.lead("__hi").over(over).isNull())
    cells = share.select("source_no", "__lo", F.when(F.col("__last"), 2.0).otherwise(F.col("__hi")).alias("__hi"), F.explode(F.sequence(F.floor(F.col("__lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("__hi") * CELLS)))).alias("cell"))
    # The fraction of i * (golden ratio) in 48 bits, exact for i below 2 ** 39.
    high = (F.col("id").bitwiseAND(LOW) * GOLDEN_HI).bitwiseAND(LOW)
    point = (high * (1 << 24) + F.col("id") * GOLDEN_LO).bitwiseAND((1 << 48) - 1) / float(1 << 48)
    slots = spark.range(n_slots).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(cells, "cell").where((F.col("u") >= F.col("__lo")) & (F.col("u") < F.col("__hi"))).select(F.col("id").alias("slot"), "source_no", F.floor(F.col("id") / 4096).alias("stretch"))
    # Ranks in a source: slots before the stretch, then those in it.
    per = slots.groupBy("source_no", "stretch").agg(F.count(F.lit(1)).alias("n"))
    per = per.select("source_no", "stretch", F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(W.partitionBy("source_no", "stretch").orderBy("slot")) - 1
    return slots.withColumn("inner", inner).join(per, ["source_no", "stretch"]).select("slot", "source_no", (F.col("before") + F.col("inner")).alias("rank"))


def needed(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, slots): the slots that take a source to its target. The last block of a round is
    partial, so these are blocks of whole rounds and of the rest, not the target by the block."""
    size, target = F.col("source_size"), F.floor("target")
    rounds = F.floor(target / size)
    slots = rounds * F.ceil(size / block) + F.ceil((target - rounds * size) / block)
    return targets.where("source_size > 0").select("source_no", slots.alias("slots"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size is the number of words of the whole text, 0 for null. taken counts the words that the
    mix takes, repeats included; no document has more than 2 times its size, and a source's sum
    is its target without the fraction, however small the source is beside the others. The order in a source is a hash of
    the id, so reruns agree; rows that repeat an id, or have none, are told apart by a row
    number that is stored once. A null source is a source of its own. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row_no"))
    # Written once: what follows reads the same row numbers however often it runs.
    rows = stored(rows, "mix-sizes")
    totals = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total_share, cap), "mix-targets")
    few = F.broadcast(targets) if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else targets
    rows = rows.join(few, rows.source.eqNullSafe(targets.source)).drop("source")
    order = [F.coalesce("doc_id", F.lit(-1)), F.col("size")]
    placed = stored(ranked(rows, ["source_no"], order, F.col("size"), "begin", totals[0]), "mix-placed")
    # Shares by the slots that sources need, and enough slots in all for each of them.
    dealt = needed(targets, block).select("source_no", ((F.col("slots") + SPARE) * block).cast("double").alias("target"))
    slots = schedule(dealt, dealt.agg(F.sum("target")).first()[0] or 0.0, block)
    # A slot's tokens of its block: all of them, less what is beyond the source's target.
    b = slots.join(few.select("source_no", "source_size", "target"), "source_no").withColumn("__blocks", F.ceil(F.col("source_size") / block))
    b = b.withColumn("block", F.pmod("rank", "__blocks")).withColumn("__round", F.floor(F.col("rank") / F.col("__blocks")))
    first = F.col("__round") * F.col("source_size") + F.col("block") * block
    b = b.withColumn("upto", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.floor(F.col("target")) - first)).where((F.col("upto") > 0) & (F.col("__round") < int(cap)))
    # A block is taken at most twice: whole or up to a place each time.
    blocks = b.groupBy("source_no", "block").agg(F.collect_list("upto").alias("takes"))
    pieces = placed.where("size > 0").select("row_no", "begin", "size", "source_no", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("begin") + F.col("size") - F.col("block") * block, F.lit(block))
    got = pieces.join(blocks, ["source_no", "block"]).withColumn("lo", lo).withColumn("hi", hi)
    got = got.select("row_no", F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + F.greatest(F.least(t, F.col("hi")) - F.col("lo"), F.lit(0))).alias("n"))
    got = got.groupBy("row_no").agg(F.sum("n").alias("taken"))
    out = placed.join(got, "row_no", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, in whole documents: taken / size, rounded.

    A source's schedule ends inside one document, so only that document and those that a block's
    end cuts in its last round are rounded. Rows that repeat an id, and all without one, share its
    numbers. Null, empty and white texts have no words to take and are left out. Other columns stay
    as they are, whatever their names; an empty table stays empty.
    """
    name, times, copy = (free_name(docs, x) for x in ("__id", "__times", "__copy"))
    taken = mix(docs, id_col, text_col, source_col).groupBy(F.col("doc_id").alias(name)).agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    copies = stored(taken.select(name, F.round(F.when(F.col("n") > 0, F.col("t") / F.col("n"))).cast("int").alias(times)).where(F.col(times) > 0), "mix-copies")
    few = F.broadcast(copies) if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else copies
    rows = docs.join(few, docs[id_col].cast("long").eqNullSafe(few[name]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
