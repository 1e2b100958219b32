"""Line dedup: a suffix array over the line-id sequences of all documents, built by distributed prefix doubling.

A suffix starts at line i of a document. Its rank at depth d is the place of its next d lines among all that occur at least
twice; suffixes whose prefix occurs once have a longest common prefix below d with any other and leave. One round ranks the
pairs (rank of the suffix, rank of the suffix d lines on), which doubles the depth. The groups of a round are the
longest-common-prefix intervals of that depth, each with its first position in (document, line) order. Doubling goes on
until every prefix is unique, so an interval's deepest round bounds the length of the repeated run.

A line is deleted where a run of ``min_lines`` lines that covers it also starts at an earlier position, or where it is long
and stands at an earlier position itself, whatever is around it. Long is a line of ``lone_words`` words or more, or, for scripts
without spaces, of ``LONE_CHARS`` characters other than spaces for each of them; with None no line is. Shorter lines that repeat
alone stay: headings, answers and blank lines are no copied passage. Runs to delete are the unions of both. Groups are counted and ranked as one row each, so a line may fill any share of the rows.

Defined cases: a null text has no lines and stays null, an empty one has one empty line; rows with the same id and text are
one document; a null id sorts after all others; ids that repeat with other texts are ordered by a hash of the text; of equal lines the
first by document and line stays; an empty table gives an empty one; a very long text is one row of line ids. Other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_row_index
from .frames import cut, digest, free_name

MIN_LINES = 2
LONE_WORDS = 5     # a single line of so many words is a passage of its own
LONE_CHARS = 10
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def _positions(docs: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    """(last, id, h, i, r, b): every suffix with two ids, of its first lines and of the lines up to ``min_lines``."""
    ids = F.transform(F.split(text_col, "\n", -1), lambda x: F.xxhash64(x))
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), ids.alias("ids"))
    windows = F.transform(F.sequence(F.lit(1), F.size("ids") - (min_lines - 1)), lambda k: F.struct(
        (k - 1).alias("i"), F.element_at("ids", k).alias("r"), F.xxhash64(F.slice("ids", k + 1, min_lines - 1)).alias("b")))
    return base.where(F.size("ids") >= min_lines).select("last", "id", "h", F.inline(windows)).distinct()


def _rank(suffixes: DataFrame) -> DataFrame:
    """The groups of equal (r, b) with two suffixes or more: r, b, their rank and their first position."""
    groups = suffixes.groupBy("r", "b").agg(F.count("*").alias("n"), F.min(F.struct("last", "id", "h", "i")).alias("first"))
    return with_row_index(groups.where("n > 1"), ["r", "b"], "rank").drop("n")


def suffix_rounds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """[(depth, frame)]: (last, id, h, i, rank, first) of the suffixes whose first ``depth`` lines occur elsewhere too."""
    suffixes, depth, out = cut(_positions(docs, id_col, text_col, min_lines), "suffixes"), min_lines, []
    while True:
        found = cut(suffixes.join(_rank(suffixes), ["r", "b"]).select("last", "id", "h", "i", "rank", "first"), "ranks")
        if found.isEmpty():
            return out or [(depth, found)]
        out.append((depth, found))
        ahead = Window.partitionBy("last", "id", "h").orderBy("i").rangeBetween(depth, depth)
        suffixes = found.select("last", "id", "h", "i", F.col("rank").alias("r"), F.first("rank").over(ahead).alias("b")).where("b IS NOT NULL")
        depth *= 2


def lone_round(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lone_words: int = LONE_WORDS) -> DataFrame:
    """(last, id, h, i, first): the long lines that stand elsewhere too, with the first position of each."""
    solid = lambda x: F.length(F.regexp_replace(x, SPACES, ""))
    long = lambda x: (F.regexp_count(x, F.lit(WORD)) >= lone_words) | (solid(x) >= LONE_CHARS * lone_words)
    parts = F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.when(long(x), F.xxhash64(x)).alias("r"))),
                     lambda x: x["r"].isNotNull())
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.inline(parts))
    lone = cut(base.distinct(), "lone_lines")
    groups = lone.groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("last", "id", "h", "i")).alias("first")).where("n > 1")
    return lone.join(groups, "r").select("last", "id", "h", "i", "first")


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                 lone_words: int | None = LONE_WORDS) -> DataFrame:
    """(id, h, runs): per document the maximal runs of lines to delete, (first line, length, depth) in order; depth is that of
    the deepest interval in the run, so the run repeats at least that many lines at once."""
    rounds = [(depth, min_lines, frame) for depth, frame in suffix_rounds(docs, id_col, text_col, min_lines)]
    if lone_words is not None:
        rounds.append((1, 1, lone_round(docs, id_col, text_col, lone_words)))
    here = F.struct("last", "id", "h", "i")
    later = None
    for depth, size, frame in rounds:
        part = frame.where(F.col("first") < here).select("last", "id", "h", "i", F.lit(depth).alias("depth"), (F.col("i") + size).alias("end"))
        later = part if later is None else later.unionByName(part)
    starts = later.groupBy("last", "id", "h", "i").agg(F.max("depth").alias("depth"), F.max("end").alias("end"))
    order = Window.partitionBy("last", "id", "h").orderBy("i")
    gap = F.when(F.col("i") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    islands = starts.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order))
    runs = islands.groupBy("last", "id", "h", "run").agg(F.min("i").alias("start"), (F.max("end") - F.min("i")).alias("length"), F.max("depth").alias("depth"))
    return runs.groupBy("last", "id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "length", "depth"))).alias("runs")).drop("last")


def _kept(lines, runs) -> F.Column:
    """The lines outside the runs: those between each run's end and the next one's start."""
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                report: bool = False, lone_words: int | None = LONE_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs and of long lines; those that had lines and lost all of them are dropped.

    With ``report`` a digest of every document instead: id, n_lines, n_removed, n_runs, longest_run, kept_sha256.
    """
    runs = removed_runs(docs, id_col, text_col, min_lines, lone_words).select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.col("runs").alias("_runs"))
    name = free_name(docs.columns, "runs")
    both = docs.join(runs, docs[id_col].eqNullSafe(runs["_i"]) & (F.xxhash64(docs[text_col]) == runs["_h"]), "left").select(
        *[docs[c] for c in docs.columns], runs["_runs"].alias(name))
    lines = F.split(text_col, "\n", -1)
    kept = F.when(F.col(name).isNull(), lines).otherwise(_kept(lines, F.col(name)))
    if report:
        n = F.coalesce(F.aggregate(name, F.lit(0), lambda a, r: a + r["length"]), F.lit(0)).cast("bigint")
        return both.select(
            F.col(id_col), F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("bigint").alias("n_lines"), n.alias("n_removed"),
            F.coalesce(F.when(F.col(name).isNotNull(), F.size(name)), F.lit(0)).cast("bigint").alias("n_runs"),
            F.coalesce(F.array_max(F.transform(name, lambda r: r["length"])), F.lit(0)).cast("bigint").alias("longest_run"),
            digest(F.coalesce(F.array_join(kept, "\n"), F.lit(""))).alias("kept_sha256"))
    left = both.where(F.col(name).isNull() | (F.size(kept) > 0))
    return left.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
