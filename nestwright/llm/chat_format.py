"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `[INST]role` line break `text[/INST]`. Inside roles and texts every backslash, `<` and `[` is written
`\\b`, `\\l`, `\\k` (and a line break in a role `\\j`), so no control string such as `</s>` or `[INST]` survives in a text,
and every text comes back exactly. A null role is `\\z`.

Prefix sums of turn tokens cut a conversation into windows at turn borders: a turn belongs to the window in whose
stride its first token falls. A window repeats the leading system turn, then the last turns before it that fit the
history budget, then its own turns. Loss falls on the texts of its own assistant turns; what is repeated is masked.
Tokens are counted as a quarter of the bytes and two marks a turn, not by a tokenizer.

One conversation may hold any share of the rows: rows are dealt out by ranges of their order, sums run inside a range,
and the sums of the ranges before are added, so that no task holds a conversation. Windows are bounded by their budgets
and one turn more, and only they are gathered. The digest of the contract is one hash over a whole conversation and
does gather it.

Order in a conversation: turn, role, text, nulls first; rows equal in all three are told apart by nothing and all stay.
Null texts are empty. Null conv_ids form one conversation. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm import common as C

OPEN, CLOSE = "[INST]", "[/INST]"
#: Tokens (four bytes each, and two marks a turn) that a window's own turns and its history may take.
STRIDE, HISTORY = 1024, 256


def _replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


_MARKS = [("\\", "\\b"), ("<", "\\l"), ("[", "\\k")]


def escaped(x: Column) -> Column:
    return _replaced(x, _MARKS)


def unescaped(x: Column) -> Column:
    return _replaced(x, [(b, a) for a, b in reversed(_MARKS)])


def role_written(role: Column) -> Column:
    return F.coalesce(F.replace(escaped(role), F.lit("\n"), F.lit("\\j")), F.lit("\\z"))


def role_read(x: Column) -> Column:
    return F.when(x != "\\z", unescaped(F.replace(x, F.lit("\\j"), F.lit("\n"))))


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, conv_id, role, text) and, without the texts, (row, conv_id, role, tokens, end, place): the tokens of the
    conversation up to and with the turn, and its place from 1."""
    rows = C.void_safe(turns, {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("any")).sortWithinPartitions(*order, F.col("any"))
    dealt = C.materialize(dealt.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), "conv_id", "role", "text"))
    bare = dealt.select("row", "part", "conv_id", "role", (F.ceil(F.octet_length("text") / 4).cast("bigint") + 2).alias("tokens"))
    run = Window.partitionBy("part", "conv_id").orderBy("row")
    summed = bare.withColumn("end", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("place", F.row_number().over(run).cast("bigint"))
    # As many rows for a conversation as there are ranges at most.
    before = Window.partitionBy("conv").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = bare.groupBy(F.col("part").alias("of_part"), F.col("conv_id").alias("conv")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    ranges = ranges.select("of_part", "conv", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    met = summed.join(ranges, (F.col("part") == F.col("of_part")) & F.col("conv_id").eqNullSafe(F.col("conv")))
    return dealt.drop("part"), met.select("row", "conv_id", "role", "tokens", (F.col("end") + F.col("t0")).alias("end"), (F.col("place") + F.col("n0")).alias("place"))


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns at its head that other windows own), loss (code-point spans of
    `formatted` under the loss mask)."""
    texts, bare = placed_turns(turns)
    is_system = (F.col("place") == 1) & F.coalesce(F.col("role") == "system", F.lit(False))
    bare = C.materialize(bare.select("row", "conv_id", "tokens", "end", "place", is_system.alias("is_system"), F.floor((F.col("end") - F.col("tokens")) / stride).cast("bigint").alias("window")))
    spans = bare.groupBy(F.col("conv_id").alias("conv"), F.col("window").alias("w")).agg(F.max("end").alias("closes"), F.min("place").alias("opens"))
    later = spans.select(F.col("conv").alias("conv2"), (F.col("w") - 1).alias("w2"), F.lit(True).alias("goes_on"))
    spans = C.materialize(spans.join(later, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("w") == F.col("w2")), "left").select("conv", "w", "closes", "opens", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    told = bare.join(spans, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("window") == F.col("w")))
    # A turn is history for the next window if what lies between its start and that window's start fits.
    back = F.col("goes_on") & (F.col("closes") - F.col("end") + F.col("tokens") <= history) & ~F.col("is_system")
    told = told.select("row", "place", "window", "is_system", back.alias("back")).join(texts, "row")
    written = F.concat(F.lit(OPEN), role_written(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE))
    head, none = F.length(F.concat(F.lit(OPEN), role_written(F.col("role")))) + 1, F.lit(-1)
    start = F.when(F.coalesce(F.col("role") == "assistant", F.lit(False)), head).otherwise(none)
    pieces = told.select("conv_id", "place", "window", "is_system", "back", written.alias("piece"), start.alias("start"), F.length(escaped(F.col("text"))).alias("size"))
    one = lambda window, rank, start: F.struct(window.cast("bigint").alias("window"), F.lit(rank).alias("rank"), start.alias("start"))
    uses = F.array(one(F.col("window"), 2, F.col("start")), F.when(F.col("back"), one(F.col("window") + 1, 1, none)))
    own = pieces.select("conv_id", "place", "piece", "size", F.explode(F.filter(uses, lambda x: x.isNotNull())).alias("u")).select("conv_id", "u.window", "u.rank", "place", "piece", "u.start", "size")
    # The leading system turn stands before every window but the first.
    lead = pieces.where("is_system").select(F.col("conv_id").alias("conv2"), "piece")
    heads = spans.where("opens > 1").join(lead, F.col("conv").eqNullSafe(F.col("conv2")))
    again = heads.select(F.col("conv").alias("conv_id"), F.col("w").alias("window"), F.lit(0).alias("rank"), F.lit(1).cast("bigint").alias("place"), "piece", none.alias("start"), F.lit(0).alias("size"))
    held = own.unionByName(again).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "piece", "start", "size"))).alias("turns"))
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda s, t: F.struct((s["at"] + F.length(t["piece"])).alias("at"), F.when(t["start"] >= 0, F.concat(s["spans"], F.array(F.struct((s["at"] + t["start"]).alias("start"), (s["at"] + t["start"] + t["size"]).alias("end"))))).otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])
    return held.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.size(F.filter("turns", lambda t: t["rank"] < 2)).alias("n_repeated"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns), loss_texts (unescaped), from windows()."""
    marked = F.split("formatted", r"\[/INST\]")
    parts = F.slice(marked, F.col("n_repeated") + 1, F.greatest(F.size(marked) - 1 - F.col("n_repeated"), F.lit(0)))
    turn = lambda p: F.struct(role_read(F.substring_index(F.substring(p, 7, 2**31 - 1), "\n", 1)).alias("role"), unescaped(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.lit(2**31 - 1))).alias("text"))
    losses = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", F.transform(parts, turn).alias("turns"), losses.alias("loss_texts"), F.length("formatted").cast("bigint").alias("n_chars"))


def digest(back: DataFrame) -> DataFrame:
    """The contract's columns. A digest runs over a whole conversation, so one task holds that one's text."""
    whole = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", x.alias("x")))), lambda w: w["x"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    both = back.select("conv_id", "window", F.size("turns").cast("bigint").alias("n"), said.alias("said"), loss.alias("loss"), "n_chars")
    out = both.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), whole(F.col("said")).alias("said"), whole(F.col("loss")).alias("loss"), F.sum("n_chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def query(spark, sf_dir: str) -> DataFrame:
    told = C.void_safe(C.table(spark, sf_dir, "conversations"), {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"})
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(read_back(windows(told.unionByName(own))))
