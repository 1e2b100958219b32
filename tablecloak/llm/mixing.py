"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame functions only.

Slot i of the mix is the golden-ratio point i * F44 mod F45 (both Fibonacci numbers, so the points are exact integers that
spread evenly over any prefix). The point is mapped through the cumulative target shares of the sources, which gives every
stretch of the mix each source's share to within a few blocks. The k-th slot of a source takes the k-th block of
``block_words`` words of that source's stream: its documents in shuffled (keyed hash) order, laid end to end twice.

Sources are numbered, slots ranked and streams added up with distributed running totals, so one source may hold any share.

Defined cases: a null or empty text has size 0 and is never taken; a null source is one source, the last; repeated rows are
separate pieces of the stream, each with its own result row; a null id is hashed as an empty text and keeps its row; empty input gives no
rows; a long text is cut into blocks like any other; ties in the shuffled order go by id and size. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total, with_row_index
from .frames import cut

# Consecutive Fibonacci numbers.
F44, F45 = 701408733, 1134903170
BLOCK_WORDS = 64
WEIGHTS = (3, 1, 2)
SIZE_SHARE = 1.5   # of all words, that the mix takes
MOST_LAPS = 2      # times a source is read at most
RANGES = 1024      # equal ranges of points in which intervals are looked up
CHUNK = 1 << 16    # slots that are ranked together


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SIZE_SHARE, laps: int = MOST_LAPS) -> DataFrame:
    """(source, rank, source_size, target): one row per source, with the weight of its place in code point order."""
    known = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(known.withColumn("last", F.col("source").isNull()), ["last", "source"], "rank").drop("last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * laps), "sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    # water level: what a weight of one gets; sources whose fill would be above their limit are set to it and leave
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("most")
        held, left, n = table.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)),
                                  F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == full or not left:
            break
        level, full = (total - held) / left, n
    return table.select("source", "rank", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")).alias("target"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, rank, block): the source of every slot of the mix, and which of its blocks the slot takes."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n = -(-int(round(total)) // block_words)
    # a source's interval is its share of the points; whole numbers add up alike in any order
    share = F.round(F.col("target") / F.lit(total or 1.0) * F45).cast("bigint")
    ends = running_total(sources.select("rank", share.alias("points")), ["rank"], F.col("points"), (), "upto")
    width = -(-F45 // RANGES)
    last = sources.agg(F.max("rank")).first()[0]
    spans = ends.select("rank", (F.col("upto") - F.col("points")).alias("lo"),
                        F.when(F.col("rank") == F.lit(last), F.greatest("upto", F.lit(F45))).otherwise(F.col("upto")).alias("hi")).where("hi > lo")
    spans = spans.withColumn("part", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % F45) * F44 % F45).alias("x"))
    slots = slots.withColumn("part", F.expr(f"x div {width}"))
    placed = slots.join(spans, "part").where("x >= lo AND x < hi").select("slot", "rank", F.expr(f"slot div {CHUNK}").alias("chunk"))
    sizes = placed.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    return placed.withColumn("inside", inside).join(offsets.hint("merge"), ["rank", "chunk"]).select("slot", "rank", (F.col("before") + F.col("inside")).alias("block"))


def streams(sized: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` (id, source, size, ...) with rank, source_size, target and ``start``: the first word of the document in its
    source's shuffled stream. One row per document that has words."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(str(seed))))
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("key", key)
    run = running_total(known.where("size > 0"), ["key", "id", "size"], F.col("size"), ["rank"], "upto")
    return run.withColumn("start", F.col("upto") - F.col("size")).drop("upto", "key")


def pieces(stream: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS, laps: int = MOST_LAPS) -> DataFrame:
    """(slot, rank, start, id, first_word, words): what each slot takes of which document."""
    lap = stream.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
    lap = lap.withColumn("at", F.col("start") + F.col("lap") * F.col("source_size"))
    blocks = lap.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))))
    lo = F.greatest("at", F.col("block") * block_words)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    # both sides grow with the words: never broadcast, however small their files look
    return blocks.select("rank", "block", "start", "id", (lo - F.col("at")).alias("first_word"), (hi - lo).alias("words")).join(
        slots.hint("merge"), ["rank", "block"]).select("slot", "rank", "start", "id", "first_word", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), taken (words the mix takes of it)."""
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = cut(targets(sized, weights), "targets")
    stream = cut(streams(sized, sources, seed), "streams")
    got = pieces(stream, schedule(sources, block_words), block_words).groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    some = stream.join(got.hint("merge"), ["rank", "start"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = sized.where("size = 0")
    none = none.join(sources, none["source"].eqNullSafe(sources["source"])).select("id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none).withColumnRenamed("id", id_col)
