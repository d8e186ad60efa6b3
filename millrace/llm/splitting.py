"""Cutting oversized text at natural boundaries, by bounded regular expressions (problem 5).

One pattern per limit consumes a text from left to right. Its alternatives are ordered by the
strength of the boundary they end at: line feed, sentence end, then any character. Each is bounded
by the limit, so a match never looks further than one piece ahead; the same match looks back over the
overlap. So the work grows with the text and its overlaps, never with its square.
Lengths are code points.

Null and empty texts give one piece, the text itself; a null limit leaves a text whole; an overlap
of the limit or more is cut down to one character less than the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

# The signs after which a sentence ends.
SENTENCE_ENDS = "。！？；!?"


def pattern(limit: Column) -> Column:
    """The pattern that cuts off the next piece of at most ``limit`` code points.

    The alternatives end at a line feed or the end of the text, at a sentence end, or anywhere; each
    takes as much as the limit allows. The line feed itself is consumed beyond the limit.
    """
    n, less = limit.cast("string"), (limit - 1).cast("string")
    line, sentence = F.concat(F.lit("(?s).{0,"), n, F.lit("}(?:\\n|\\z)")), F.concat(F.lit("|.{0,"), less, F.lit(f"}}[{SENTENCE_ENDS}]"))
    return F.concat(line, sentence, F.lit("|.{1,"), n, F.lit("}"))


def cuts(text: Column, limit: Column) -> Column:
    """The pieces of ``text`` in order, each with the line feed it was cut at, if any.

    An array of structs (piece, hard): ``hard`` tells that a piece was cut inside a stretch.
    """
    whole = F.regexp_extract_all(text, pattern(limit), F.lit(0))
    ends = f"(?s)(\\n|[{SENTENCE_ENDS}])\\z"
    flagged = lambda pieces: F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), ((i < F.size(pieces) - 1) & ~p.rlike(ends)).alias("hard")))
    return let(F.filter(whole, lambda p: p != ""), flagged)


def oversized(df: DataFrame, text: str, limit: str) -> DataFrame:
    """The rows whose text is longer than the limit, with ``cuts`` at full limit and whether one is ``hard``.

    Pieces begin at boundaries until one is cut inside a stretch, and none is cut inside a stretch
    that fits; so a hard cut appears exactly where some stretch is longer than the limit.
    """
    over = df.where((F.length(text) > F.col(limit)) & (F.col(limit) > 0))
    found = over.withColumn("cuts", cuts(F.col(text), F.col(limit)))
    return found.withColumn("hard", F.exists("cuts", lambda c: c["hard"]))


def split_pieces(df: DataFrame, text: str, limit: str, overlap: str) -> DataFrame:
    """One row per piece: the columns of ``df`` but its text, then ``part_index``, ``part_count`` and ``part_text``.

    A text within its limit is its own single piece. Else every piece after the first begins with the
    last ``overlap`` code points that stand before it, and no piece is longer than the limit. A line
    feed at a cut is dropped, so the pieces without their overlap make up the text but for those.
    """
    size = F.greatest(F.lit(1), F.col(limit))
    lap = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)), size - 1)
    fits = F.col(text).isNull() | F.col(limit).isNull() | (F.length(text) <= F.col(limit))
    # group 1 looks back for the overlap, shorter only at the text's start; the empty class makes Java count code points there
    back = F.when(lap > 0, F.concat(F.lit(r"(?s)(?<=(\A.{0,"), (lap - 1).cast("string"), F.lit("}|.{"), lap.cast("string"), F.lit("}|[😀&&[^😀]]))"))).otherwise("()")
    whole = F.concat(back, F.lit("("), pattern(size - lap), F.lit(")"))
    found = lambda group: F.regexp_extract_all(F.col(text), whole, F.lit(group))
    cut_off = F.transform(F.arrays_zip(found(1).alias("lap"), found(2).alias("own")), lambda z: F.struct(z["lap"].alias("lap"), F.regexp_replace(z["own"], r"\n\z", "").alias("own")))
    piece = F.transform(F.filter(cut_off, lambda z: z["own"] != ""), lambda z: F.concat(z["lap"], z["own"]))
    work = df.withColumn("_piece", F.when(fits, F.array(F.col(text))).otherwise(piece))
    return work.select(
        *[F.col(c) for c in df.columns if c not in (text, "part_index", "part_count", "part_text")],
        F.size("_piece").alias("part_count"),
        F.posexplode("_piece").alias("part_index", "part_text"),
    ).withColumn("part_index", F.col("part_index") + 1)


def unsound_parts(parts: DataFrame, unit: str, limit: int | Column) -> DataFrame:
    """Units whose stored parts disagree on their count, are not numbered 1 to that count once each, or exceed ``limit``."""
    top = F.max("part_count")
    sound = (
        (F.min("part_count") == top)
        & (F.count("part_count") == F.count("*"))
        & (F.count("part_index") == F.count("*"))
        & (F.count("*") == top)
        & (F.countDistinct("part_index") == top)
        & (F.min("part_index") == 1)
        & (F.max("part_index") == top)
        & (F.coalesce(F.max(F.length("table_raw")), F.lit(0)) <= limit)
    )
    return parts.groupBy(unit).agg(F.coalesce(sound, F.lit(False)).alias("sound")).where("NOT sound").select(unit)
