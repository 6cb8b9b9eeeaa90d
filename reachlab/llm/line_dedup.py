"""Line dedup over overlapping three-line windows.

Each run of three consecutive lines is hashed; windows that occur again anywhere
in the table keep their first occurrence, and every line covered by a later one
goes. Only hashes and positions are shuffled until the texts are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, rows_of, with_new_columns

WINDOW_LINES = 3


def _lines(text: Column) -> Column:
    """(place, line) of each line that has a word; blank lines are no part of a window."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, row, places) of the lines that later occurrences of windows cover.

    ``row`` is a hash of the text, which tells rows that repeat a doc_id apart;
    ``places`` are line numbers from 0, ascending. Documents without any are
    not listed.
    """
    docs = rows_of(documents, ["doc_id", "text"]).where("text is not null")
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), _lines(F.col("text")).alias("l"))
    starts = F.sequence(F.lit(0), F.size("l") - WINDOW_LINES)
    window = F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.lit(1), *[F.col("l")[i + j]["line"] for j in range(WINDOW_LINES)]).alias("h_1"),
        F.xxhash64(F.lit(2), *[F.col("l")[i + j]["line"] for j in range(WINDOW_LINES)]).alias("h_2"),
        i.alias("i"), F.array(*[F.col("l")[i + j]["at"] for j in range(WINDOW_LINES)]).alias("covers")))
    windows = materialise(
        lines.where(F.size("l") >= WINDOW_LINES).select("doc_id", "row", F.explode(window).alias("w"))
        .select("doc_id", "row", "w.*"), "windows")
    # a missing id comes last
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("i"))
    # a table of its own, so that the join below deals both sides and Spark can split a hot window
    first = materialise(windows.groupBy(F.col("h_1").alias("f_1"), F.col("h_2").alias("f_2")).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = windows.join(first, (F.col("h_1") == F.col("f_1")) & (F.col("h_2") == F.col("f_2"))) \
        .where(place > F.col("first"))
    return later.select("doc_id", "row", F.explode("covers").alias("at")).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set("at")).alias("places"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """Documents with the later occurrences of repeated three-line windows removed.

    Adds ``n_lines`` (lines of the text, blank ones too) and ``n_removed``;
    ``text`` has the remaining lines, ``n_chars``, if there is such a column,
    their length. Windows are made of three consecutive lines that have a word;
    they repeat if their lines are equal character by character. First is the
    least (doc_id, text hash, place), a missing id last; rows equal in both are
    one document and get the same result.

    Null texts stay null with 0 lines; texts of fewer than three lines with a
    word are left alone; a text may become empty and its row stays. Other
    columns pass through, but those named like new ones are replaced. An empty
    table gives an empty table.
    """
    base = with_new_columns(documents, ["n_lines", "n_removed"])
    repeated_id, repeated_row, repeated = (free_name(base, n) for n in ("_repeated_id", "_repeated_row", "_repeated"))
    gone = repeated_lines(documents).select(
        F.col("doc_id").alias(repeated_id), F.col("row").alias(repeated_row), F.col("places").alias(repeated))
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col(repeated_id))
                       & (F.xxhash64("text") == F.col(repeated_row)), "left")
    lines = F.split("text", "\n")
    kept = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains(repeated, i)))
    text = F.when(F.col(repeated).isNull(), F.col("text")).otherwise(kept)
    columns = []
    for c in base.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col(repeated).isNull(), F.col("n_chars")).otherwise(
                F.length(kept)).cast(base.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return joined.select(
        *columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(repeated).isNull(), 0).otherwise(F.size(repeated)).cast("long").alias("n_removed"))
