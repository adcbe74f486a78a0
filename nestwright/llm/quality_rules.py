"""Quality rules with a distribution test, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows. The method holds each document's
histograms of character classes and of common words against references of its language by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). References are sums over all documents of a language; a language
without a list of common words is held against all documents together, by character classes alone. Below a least
number of words a histogram says nothing and its test passes.

Null and empty texts have no words and fail the base. Null languages count as unlisted. Repeated rows fare alike.
An empty table gives no rows. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

SPACES = r"[\x20\x09-\x0D]+"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Most distance from the language's reference, and the words from which a histogram is long enough.
CLASS_DISTANCE, CLASS_WORDS, COMMON_DISTANCE, COMMON_WORDS = 0.25, 50, 0.31, 100
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Common words by language, in lower case as they stand inside sentences; as many as there are letters above at most.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he at are".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(hashes: Column, size: int = WINDOW) -> Column:
    """Hash of every window of `size` words, a power of two, from their hashes: of pairs of neighbours, and so on."""
    paired = lambda step: lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    out, step = hashes, 1
    while step < size:
        out, step = _let(out, paired(step)), step * 2
    return _let(out, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - size + 1, F.lit(0))))


def _repeats(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """rows with n_repeat_words, how many words stand in windows that occur twice or more, instead of hashes."""
    # The place goes into the low bits of a hash, so that one sort of longs brings equal windows together.
    place = F.pow(F.lit(2), F.length(F.bin(F.size("hashes")))).cast("bigint")
    rows = rows.withColumn("places", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.transform(F.sort_array(F.transform("hashes", lambda h, i: h - F.pmod(h, place) + i)), lambda v: F.pmod(v, place).cast("int"))))
    rows = rows.withColumn("ordered", F.transform("places", lambda v: F.get("hashes", v)))
    same = lambda i, j: F.coalesce(F.get("ordered", i) == F.get("ordered", j), F.lit(False))
    starts = F.sort_array(F.filter(F.transform("places", lambda v, j: F.when(same(j, j - 1) | same(j, j + 1), v)), lambda v: v.isNotNull()))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, v: F.struct((s["n"] + v + size - F.greatest(v, s["end"])).alias("n"), (v + size).alias("end")), lambda s: s["n"].cast("bigint")), F.lit(0).cast("bigint")))
    return rows.drop("places", "ordered", "hashes")


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def measured(docs: DataFrame, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """doc_id, lang (null if unlisted), the counts, and the histograms `classes` and `words_hist`."""
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string", "lang": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    lists = F.create_map(*(x for lang, w in sorted(common.items()) for x in (F.lit(lang), F.array(*(F.xxhash64(F.lit(x)) for x in w)))))
    split = rows.select("doc_id", "text", F.when(F.col("lang").isin(*common), F.col("lang")).alias("lang"), F.array_remove(F.split("text", SPACES), "").alias("words"))
    split = split.select("*", F.element_at(lists, F.col("lang")).alias("common"), F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", ""))
    # A common word, known by its hash, becomes a letter, so that one short string per document holds all that is counted.
    letters = F.array(*map(F.lit, ["", *_LETTERS]))
    letter = lambda h: F.get(letters, F.array_position("common", h).cast("int"))
    wide = _repeats(split.select(
        "doc_id", "lang", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), F.length("text").alias("n_chars"),
        only(r"#*$%&|<>").cast("bigint").alias("n_symbols"), only("A-Z").alias("n_upper"), only("0-9").alias("n_digits"), only(r".,;:!?'\"()\-").alias("n_points"), (F.octet_length("text") - F.length("text")).alias("n_wide"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.size("common").alias("n_common"), F.array_join(F.transform("word_hashes", letter), "").alias("letters"),
        _windows(F.col("word_hashes")).alias("hashes"),
    ))
    counts = F.when(F.col("lang").isNotNull(), F.transform(F.sequence(F.lit(1), F.col("n_common")), lambda i: (F.octet_length("letters") - F.octet_length(F.replace(F.col("letters"), F.substring(F.lit(_LETTERS), i, F.lit(1))))).cast("double")))
    rest = F.greatest(F.col("word_chars") - F.col("n_symbols") - F.col("n_upper") - F.col("n_digits") - F.col("n_points") - F.col("n_wide"), F.lit(0))
    classes = F.array(*(x.cast("double") for x in (F.col("n_chars") - F.col("word_chars"), F.col("n_symbols").cast("bigint"), F.col("n_upper"), F.col("n_digits"), F.col("n_points"), F.col("n_wide"), rest)))
    return wide.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", classes.alias("classes"), F.when(counts.isNotNull(), F.concat(counts, F.array(F.greatest(F.col("n_words") - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))).alias("words_hist"),
    )


def references(stats: DataFrame, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """lang (null: all documents), class_ref, word_ref: one row per listed language and one more."""
    n_class, n_word = 7, max(map(len, common.values())) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.coalesce(F.get("words_hist", F.lit(i)), F.lit(0.0))).alias(f"w{i}") for i in range(n_word)]
    shares = lambda x, n: _share(F.array(*(F.coalesce(F.col(f"{x}{i}"), F.lit(0.0)) for i in range(n))))
    out = lambda df: df.select("lang", shares("c", n_class).alias("class_ref"), shares("w", n_word).alias("word_ref"))
    return out(stats.where("lang is not null").groupBy("lang").agg(*sums)).unionByName(out(stats.agg(*sums).withColumn("lang", F.lit(None).cast("string"))))


def judge(docs: DataFrame, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """doc_id, the counts, class_distance, common_distance, base_failed, kept."""
    stats = C.materialize(measured(docs, common))
    refs = F.broadcast(references(stats, common).select(F.col("lang").alias("ref_lang"), "class_ref", "word_ref"))  # a row per listed language
    met = stats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    near = met.select("*", distance(_share(F.col("classes")), F.col("class_ref")).alias("class_distance"), F.when(F.col("words_hist").isNotNull(), distance(_share(F.col("words_hist")), F.col("word_ref"))).alias("common_distance"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    odd = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_DISTANCE)) | ((F.col("n_words") >= COMMON_WORDS) & (F.coalesce("common_distance", F.lit(0.0)) > COMMON_DISTANCE))
    return near.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "class_distance", "common_distance")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"))
