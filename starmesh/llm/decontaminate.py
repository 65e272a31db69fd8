"""Benchmark decontamination: windows of words of test items, looked up in all windows of documents.

The items' windows are a hash set that is broadcast, in blocks of a bounded size, and each block meets
all documents. A document's windows are hashed where its text is, and a window whose hash is in the
set is compared word by word before it counts. Only what is left is shuffled. DataFrame functions only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the text as written, and what stands between them.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of a block of windows that is broadcast, about, and what a window takes besides its words.
BROADCAST_BYTES, ROW_BYTES = 48 << 20, 100
#: Parts to which rows of one set of items are dealt where the sets are too large to be broadcast.
SALT = 32


def words_of(text: Column) -> Column:
    """A-Z lower-cased; words are runs of a-z, 0-9 and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORDS), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(gram, hash, len, set_id): the distinct windows of all items, and (set_id, items): the distinct
    sets of items that a window is in, ids as text, in order. Both are stored.

    An item of fewer words than a window, but not none, is one window. Null ids count as empty ones.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    grams = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.least(F.col("n"), F.lit(window))))).alias("words")).distinct()
    per = grams.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per = stored(per.select(F.array_join("words", " ").alias("gram"), F.xxhash64(_hashes(F.col("words"))).alias("hash"), F.size("words").alias("len"), "items"), "leak-grams")
    sets = stored(per.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()), "leak-sets")
    return stored(per.join(sets, "items").select("gram", "hash", "len", "set_id"), "leak-windows"), sets


def _scan(rows: DataFrame, block: DataFrame, lengths: list[int], sentinel: bool) -> DataFrame:
    """(row_no, doc_id, n, start, len, set_id): the windows of rows (row_no, doc_id, text) that are in
    block, and with sentinel a row without a window for each document."""
    held = rows.select("row_no", "doc_id", words_of(F.col("text")).alias("words")).withColumn("hashes", _hashes(F.col("words")))
    # An outer explode: for an inner one Spark would form the whole array once more, to see if it is empty.
    # A window that the text's end cuts short is that shorter window.
    of = lambda m: lambda _, i: F.xxhash64(F.slice("hashes", i + 1, F.lit(m)))
    each = [F.transform("hashes", of(m)) for m in lengths]
    each += [F.array(F.lit(None).cast("long"))] if sentinel else []
    held = held.select("row_no", "doc_id", "words", F.size("words").alias("n"), F.concat(*each).alias("all"))
    held = held.select("row_no", "doc_id", "words", "n", F.posexplode_outer("all").alias("pos", "h"))
    start = F.col("pos") % F.greatest(F.col("n"), F.lit(1))
    same = (F.col("h") == F.col("hash")) & (F.array_join(F.slice("words", start + 1, F.col("len")), " ") == F.col("gram"))
    met = held.join(F.broadcast(block), same, "left" if sentinel else "inner")
    if sentinel:
        met = met.where(F.col("set_id").isNotNull() | (F.col("pos") == F.col("n") * len(lengths)))
    return met.select("row_no", "doc_id", "n", F.when(F.col("set_id").isNotNull(), start).alias("start"), "len", "set_id")


def hits(rows: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """All occurrences of windows in rows (row_no, doc_id, text); see `_scan`. Each block of windows is
    of a bounded size; a benchmark of several blocks costs a pass over the documents for each."""
    size = windows.agg(F.sum(F.octet_length("gram") + ROW_BYTES), F.collect_set("len")).first()  # at most `window` lengths
    blocks, lengths = max(1, -(-(size[0] or 0) // BROADCAST_BYTES)), sorted(size[1]) or [window]
    if blocks > 1:
        rows = stored(rows, "leak-rows")
    out = None
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b)
        found = _scan(rows, block, lengths, b == 0)
        out = found if out is None else out.unionByName(found)
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items, contaminated.

    n_hit counts the words inside any occurrence of a window, items are the ids, as text and in
    order, of all items with an occurring window. Null and empty texts have no words; items without
    words have no window. Repeated rows of either table give equal results, repeated ids are
    documents of their own. An empty benchmark leaves all documents clean, an empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    windows, sets = windows_of(benchmark, item_col, item_text_col, window)
    found = hits(_numbered(docs, id_col, text_col), windows, window)
    spans = F.sort_array(F.collect_list(F.when(F.col("set_id").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))))
    per = found.groupBy("row_no").agg(F.max("doc_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), spans.alias("spans"), F.sort_array(F.collect_set("set_id")).alias("sig"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    more = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    per = stored(per.select("row_no", "doc_id", "n_words", F.aggregate("spans", nothing, more, lambda a: a["n"]).alias("n_hit"), "sig"), "leak-documents")
    # Documents with the same windows have the same items: these are listed once.
    sigs = per.where(F.size("sig") > 0).select("sig").distinct()
    listed = sigs.select("sig", F.explode("sig").alias("set_id")).join(sets, "set_id").select("sig", F.explode("items").alias("item")).distinct()
    listed = stored(listed.groupBy("sig").agg(F.sort_array(F.collect_list("item")).alias("items")), "leak-lists")
    n, held = listed.agg(F.count(F.lit(1)), F.sum(F.size("items") * 24 + F.size("sig") * 8 + ROW_BYTES)).first()
    if n <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES:
        out = per.join(F.broadcast(listed), "sig", "left")
    else:
        dealt = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        out = per.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALT))).join(dealt, ["sig", "salt"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of an item, or with remove="spans" without the
    words of these windows and what follows each up to the next word. Columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError('remove is "documents" or "spans"')
    name = free_name(docs, "__row")
    kept = stored(docs.withColumn(name, F.monotonically_increasing_id()), "leak-numbered")
    rows = kept.select(F.col(name).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows, _ = windows_of(benchmark, item_col, item_text_col, window)
    found = stored(hits(rows, windows, window).where("set_id is not null").select("row_no", "start", "len").distinct(), "leak-hits")
    bad = stored(found.select("row_no").distinct(), "leak-bad")
    few = (lambda df: F.broadcast(df)) if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    if remove == "documents":
        return kept.join(few(bad.withColumnRenamed("row_no", name)), name, "left_anti").drop(name)
    gone = found.select("row_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("word")).distinct()
    pieces = rows.join(few(bad), "row_no", "left_semi").select("row_no", F.rlike("text", F.lit(r"\A" + PIECES.split("|")[0])).alias("word_first"), F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("pos", "piece"))
    # Words and what is between them take turns; what follows a word goes with it.
    of = F.when(F.col("word_first"), F.floor(F.col("pos") / 2)).otherwise(F.floor((F.col("pos") - 1) / 2)).cast("int")
    left = pieces.withColumn("word", of).join(gone.withColumn("gone", F.lit(True)), ["row_no", "word"], "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "piece")))), lambda p: p["piece"]), "")
    texts = left.groupBy("row_no").agg(text.alias("__text")).withColumnRenamed("row_no", name)
    new = free_name(docs, "__new")
    out = kept.join(texts.withColumnRenamed("__text", new), name, "left")
    return out.withColumn(text_col, F.coalesce(F.col(new), F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
