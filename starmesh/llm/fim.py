"""Fill-in-the-middle examples: a text's parts in another order, cut between its units.

A unit is a word with the white space before it, or the white space at the end. Units are rows: their
lengths are summed up along a text, the sums at the units that are asked for are its two cuts, and
the text is taken apart there. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, stored

UNIT_REGEX = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are cut, and of 100 that are cut, how many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_requests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, text, n, form, first, last): each text, its number of units, what form it gets,
    and after how many units its prefix and its middle end."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT_REGEX)).cast("long"))
    plain = (F.col("text") == "") | (h3 % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))


def cut_offsets(cut: DataFrame) -> DataFrame:
    """(row_no, first_at, last_at): the cuts of texts, in code points."""
    # Texts are dealt before they become rows of units, so that these need no shuffle. A text's units
    # are no more than its characters; texts, not units, are what a task holds many of.
    lengths = F.transform(F.slice(F.regexp_extract_all("text", F.lit(UNIT_REGEX), F.lit(0)), F.lit(1), F.col("last").cast("int")), F.length)
    units = cut.where("last > 0").select("row_no", "text", "last").repartition("row_no").select("row_no", F.posexplode_outer(lengths).alias("unit", "length"))
    along = W.partitionBy("row_no").orderBy("unit").rowsBetween(W.unboundedPreceding, 0)
    units = units.withColumn("end", F.sum("length").over(along))
    asked = cut.select(F.col("row_no").alias("of"), "first", "last").repartition("of").hint("shuffle_hash")
    # Differences, not equal columns: rows of units stay where their text is.
    hit = (F.col("row_no") == F.col("of")) & ((F.col("unit") - F.col("first") == -1) | (F.col("unit") - F.col("last") == -1))
    found = units.join(asked, hit).groupBy("row_no").agg(F.max(F.when(F.col("unit") - F.col("first") == -1, F.col("end"))).alias("first_at"), F.max("end").alias("last_at"))
    return stored(found, "fim-offsets")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    Of 100 texts `rate` are cut, at two places that the id's hash draws: psm is prefix, suffix, middle
    and spm suffix, prefix, middle, each behind its mark. A text that is empty or holds a mark stays
    plain. Null is the empty text, and a null id draws as an empty one; repeated rows give equal
    results. Parts may be empty. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut_requests(docs, id_col, text_col, seed, rate, suffix_first)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    none = F.lit(None).cast("long")
    plain = rows.where("form = 'plain'").select("doc_id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    cut = stored(rows.where("form != 'plain'").withColumn("row_no", F.monotonically_increasing_id()), "fim-rows")
    offsets = cut_offsets(cut)
    if offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = cut.join(offsets, "row_no", "left").withColumn("first_at", F.coalesce("first_at", F.lit(0)).cast("int")).withColumn("last_at", F.coalesce("last_at", F.lit(0)).cast("int"))
    prefix = F.substring("text", F.lit(1), F.col("first_at"))
    middle = F.substring("text", F.col("first_at") + 1, F.col("last_at") - F.col("first_at"))
    suffix = F.substring("text", F.col("last_at") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    middle_chars, output = (F.col("last_at") - F.col("first_at")).cast("long"), F.when(F.col("form") == "psm", psm).otherwise(spm)
    return plain.union(rows.withColumn("prefix_chars", F.col("first_at").cast("long")).withColumn("middle_chars", middle_chars).withColumn("output", output).select(*names))


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form. No part holds a mark, so the first one of a kind is the mark."""
    body = F.substring(output, F.lit(4), F.length(output))
    ahead, then = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    one = F.position(ahead, body)
    two = F.position(then, body)
    a = F.substring(body, F.lit(1), one - 1)
    b = F.substring(body, one + 3, two - one - 3)
    middle = F.substring(body, two + 3, F.length(body))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def digests(formed: DataFrame) -> DataFrame:
    """formed with hashes of the output and of the text that is rebuilt from it, instead of the output."""
    return formed.withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256)).withColumn("output_sha256", F.sha2("output", 256)).drop("output")
