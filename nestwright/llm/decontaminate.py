"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. An item's windows are its runs of 10 consecutive words, or all its words if it has
fewer. A window occurs in a document only if each of its words does, so its rarest word (by frequency over all
documents, ties by the word) is a prefix on which documents and windows are joined. A document offers the places of
prefix words with the words around them; a window whose prefix word stands at offset o can only start o words before
(positional bound) and must end inside the document (length bound). What is left is compared word by word.

Null and empty texts have no words, hits or items. Null item ids count as items without a name in the digest. Equal
items are told apart by their ids. Repeated rows each get their row. Empty tables of documents or of items give no
hits. Other columns are ignored or, by `decontaminate`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

WINDOW = 10
#: Up to so many prefix words go into the scan as a set; beyond that all places of documents go through the join.
MOST_PREFIX_WORDS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    return rows.select("doc_id", h1.alias("h1"), h2.alias("h2"), words_of(F.col("text")).alias("words"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, w (the window's words)."""
    rows = C.void_safe(items, {"item_id": "bigint", "text": "string"}).select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(size)))).alias("w")).distinct()


def prefixed(windows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Distinct windows with their rarest word p and its offset o."""
    distinct = windows.select("w").distinct()
    vocabulary = distinct.select(F.explode("w").alias("p")).distinct()
    # An inner join: a semi join would be pushed below the count, and every word of the corpus would be shuffled.
    counts = keyed.select(F.explode("words").alias("p")).groupBy("p").agg(F.count("*").alias("n")).join(vocabulary, "p")
    ranked = distinct.select("w", F.posexplode("w").alias("o", "p")).join(counts, "p", "left").select("w", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "p", "o").alias("x"))
    best = ranked.groupBy("w").agg(F.min("x").alias("x")).where("x.n > 0")
    return C.materialize(best.select("w", F.col("x.p").alias("p"), F.col("x.o").alias("o"), F.size("w").alias("len")))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, most_prefix_words: int = MOST_PREFIX_WORDS) -> DataFrame:
    """doc_id, h1, h2, start, len (of an occurrence, in words), item_id."""
    keyed = _keyed(docs)
    windows = C.materialize(item_windows(items, size))
    index = prefixed(windows, keyed)
    prefix = [r[0] for r in index.select("p").distinct().limit(most_prefix_words + 1).collect()]
    around = lambda i: F.struct(F.get("words", i).alias("p"), i.alias("at"), F.slice("words", F.greatest(i - (size - 1), F.lit(0)) + 1, F.lit(2 * size - 1)).alias("near"), F.greatest(i - (size - 1), F.lit(0)).alias("near0"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    if len(prefix) <= most_prefix_words:
        places = F.filter(places, lambda i: F.get("words", i).isin(prefix)) if prefix else F.array().cast("array<int>")
    offered = keyed.select("doc_id", "h1", "h2", F.explode(F.transform(places, around)).alias("x")).select("doc_id", "h1", "h2", "x.*")
    met = offered.join(index, "p").where((F.col("at") - F.col("o") >= 0) & (F.col("at") - F.col("o") - F.col("near0") + F.col("len") <= F.size("near")))
    same = met.where(F.slice("near", F.col("at") - F.col("o") - F.col("near0") + 1, F.col("len")) == F.col("w"))
    return same.select("doc_id", "h1", "h2", (F.col("at") - F.col("o")).alias("start"), "len", "w").distinct().join(windows, "w").drop("w")


def judged(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, h1, h2, n_hit (words inside occurrences), item_ids (sorted as strings) of documents with an occurrence."""
    with C.scratch() as keep:
        found = C.materialize(hits(docs, items, size))
        keep.append(found)
    # Occurrences of a document are bounded by its words; items are counted apart.
    spans = found.groupBy("doc_id", "h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["len"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["start"] + x["len"]).alias("end")), lambda a: a["n"].cast("bigint"))
    named = found.groupBy("doc_id", "h1", "h2").agg(F.count_distinct("item_id").alias("n_items"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    on = ["doc_id", "h1", "h2"]
    s, n = spans.select(*on, covered.alias("n_hit")).alias("s"), named.alias("n")
    return s.join(n, F.col("s.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("s.h1") == F.col("n.h1")) & (F.col("s.h2") == F.col("n.h2"))).select("s.doc_id", "s.h1", "s.h2", "n_hit", "n_items", "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    return C.packed(docs).join(C.named(judged(docs, items, size).select("doc_id", "h1", "h2")), C.met(), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")
    d, j = _keyed(docs).select("doc_id", "h1", "h2", F.size("words").cast("bigint").alias("n_words")).alias("d"), judged(docs, items).alias("j")
    met = d.join(j, F.col("d.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("d.h1") == F.col("j.h1")) & (F.col("d.h2") == F.col("j.h2")), "left")
    zero = F.lit(0).cast("bigint")
    return met.select("d.doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.concat_ws(",", F.coalesce("item_ids", F.array().cast("array<string>"))), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
