"""Sentences and segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.ranking import global_row_number


BLOCK = 1 << 16  # lines that a window spans


def number_sentences(rows: DataFrame, doc: str = "doc_id", order: str = "line_no",
                     blank: Column = None, block: int = BLOCK) -> DataFrame:
    """G1 on a line stream: ``sent_no`` = number of blank lines before the line.

    A running sum per block of ``block`` consecutive numbers of a document, plus the
    sums of the blocks before (one row per block), so no window spans a document.
    (Text files read by ``lexspark.sources.text`` are numbered as they are read.)
    """
    b = blank if blank is not None else (F.col("word").isNull())
    x = rows.withColumn("__b", F.coalesce(b.cast("int"), F.lit(0))).withColumn("__blk", F.floor(F.col(order) / block))
    inside = Window.partitionBy(doc, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(doc).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(doc, "__blk").agg(F.sum("__b").alias("__s")).withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    x = x.withColumn("__local", F.coalesce(F.sum("__b").over(inside), F.lit(0)))
    x = x.join(sums.select(doc, "__blk", "__off"), [doc, "__blk"])
    return x.withColumn("sent_no", (F.col("__off") + F.col("__local")).cast("int")).select(*rows.columns, "sent_no")


def eos_flags(tokens: DataFrame, sent=("part", "doc_id", "sent_no"), order: str = "word_no") -> DataFrame:
    """``eos`` = no later word in the same sentence (next row is a sentence end)."""
    w = Window.partitionBy(*sent).orderBy(order)
    return tokens.withColumn("eos", F.lead(order).over(w).isNull())


def char_ngrams(c: Column, n: int) -> Column:
    """Consecutive chunks of n code points from the left; the last may be shorter."""
    return F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % n), 0)


def chars(c: Column) -> Column:
    """Code points of a string (astral characters stay whole)."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))



def collapse_blanks(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", text: str = "line", block: int = BLOCK) -> DataFrame:
    """Runs of blank lines collapse to one and become '', the first line of the whole stream goes.

    The stream is the files one after the other, by ``doc``: a run may go on from
    one file to the next.  A line is blank when it has no fields (white space
    only).  Lines look back within blocks of ``block`` consecutive numbers; each
    block's last line reaches the next block through the blocks' global order (one
    row per block), so no window spans a file.
    """
    blank = F.trim(F.col(text), F.lit(" \t")) == ""
    x = lines.select(doc, order, text).withColumn("__b", blank).withColumn("__blk", F.floor(F.col(order) / block))
    ends = x.groupBy(doc, "__blk").agg(F.max_by("__b", order).alias("__end"))
    ends = global_row_number(ends, [F.col(doc), F.col("__blk")], "__rn")
    before = ends.select((F.col("__rn") + 1).alias("__rn"), F.col("__end").alias("__before"))
    carried = ends.select(doc, "__blk", "__rn").join(before, "__rn", "left").select(doc, "__blk", "__before")
    w = Window.partitionBy(doc, "__blk").orderBy(order)
    x = x.withColumn("__pb", F.lag("__b").over(w)).withColumn("__no", F.row_number().over(w)).join(carried, [doc, "__blk"])
    previous = F.when(F.col("__no") == 1, F.col("__before")).otherwise(F.col("__pb"))  # null: first line of the stream
    return x.where(previous.isNotNull() & ~(F.col("__b") & previous)).select(
        doc, order, F.when(F.col("__b"), F.lit("")).otherwise(F.col(text)).alias(text))
