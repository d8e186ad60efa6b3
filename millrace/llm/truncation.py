"""Text cut off by field limits or on the way (problem 8).

Values are joined by prefix: a text that was cut ends in a fragment that is a strict prefix of longer
copies elsewhere. Whole texts are joined by the hashes of their prefixes, and so are their last stretches
(what stands behind the last comma, figure or sentence end), since a text that was cut seldom has a whole
longer copy while its last words nearly always have. Stretches are taken with figures and names masked,
and are cut after figures, so that copies are found in small corpora too.

For the fragment that a text ends in, the longer copies that go on with something other than a line end
are held against those that end a line or a text with it. Where going on prevails, the text is a
candidate (step ``stretch``). A fragment that no stretch goes on from is judged by its last ``WINDOW``
code points in the same way, against what follows them at any place of a stretch (step ``window``). A text
that a longer copy goes on from within a line is cut whatever its fragment tells (step ``whole``).

An estimate follows for the first two steps: a last line of a kind that mostly ends without a full stop
(headings, table rows, source and rating lines) is complete, and so is one that is the title itself; a
line's kind is told by its first ``HEAD`` signs and by whether a sentence ends within it. For the step ``whole`` only the title, table rows, source and rating lines are complete.

Marks that were set behind a cut (an ellipsis, a replacement character, a bracket that stays open) are
taken off first, and so is a table row in markup that breaks off; a deliberate ellipsis has no longer copies
without it. Markup is cut if a tag is open.

Null, empty and blank texts are complete. Equal texts count once, by one representative whose verdict goes
to all of them, each with its own title. Fragments and texts of any length are compared, by hashes of all
their prefixes, in time linear in the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.hashing import Texts, slices, summed, text_hashes
from millrace.session import broadcast_if_small, cut

WINDOW = 5
HEAD = 4
OPEN_SHARE, PRIOR_LINES = 0.5, 3
LOOK = 8
SMALL = 500_000

# Signs that end a text in good order, at the end of a last line.
_ENDED = r"(?:[。！？!?”」』]|[^\s.…]\.)[\s]*\z"
_END_SIGNS = "。！？!?”」』"
# What may stand behind a cut.
_MARKS = re.compile(r"(?:…+|\.{3,}|�+|\[|（[^（）\n]{0,8})\Z")
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cf") or c in "\t\n\v\f\r")
_OPEN_TAG = r"<[^<>\n]*\z"
_OPEN_ROW = re.compile(r"\n<[^\n]*<[^<>\n]*\Z")
_FIGURE = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_NAME = re.compile(r"[A-Z](?<!\w[A-Z])[a-z]+[A-Z][A-Za-z]*")
# After what a stretch ends (9 stands for a figure), and after which of them the text goes on.
_STRETCH_END = re.compile(r"[，。；！？!?;,\n]|\. |9(?!\n)")
_STOPS, _GOES_ON = "，。；！？!?;,\n", "，；;,9"
# Last lines that are whole though a longer text goes on behind them: table rows, source and rating lines; blanks before a line end.
_WHOLE_LINE = r"(?i)\A\s*(?:[^|\n]*(?:\|[^|\n]+)+|\|.*\||(?:数据来源|资料来源|来源|评级|投资评级|source|rating)\s*[:：].*)\z"
# Ends of sentences, within a line.
_SENTENCE_SIGNS, _SENTENCE = "。！？!?；", re.compile(r"(?:[。！？!?；]|\. )(?=[^\n]*\S)")
_RUNNING = "\x02"
_SPACES = " \t\v\f\r"
_SALT = np.int64(0x5BD1E9955BD1E995)


def _signs(signs: str) -> np.ndarray:
    """A table over all code points: whether each is one of ``signs``."""
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in signs]] = True
    return table


_IS_STOP, _IS_BLANK, _IS_SPACE, _IS_END, _IS_ON, _IS_SENTENCE = map(_signs, (_STOPS, _BLANKS, _SPACES, _END_SIGNS, _GOES_ON, _SENTENCE_SIGNS))
_IS_OPEN_DOT = _signs(" \t\n\v\f\r.…")  # behind these a full stop ends nothing


def masked(text: str) -> str:
    """``text`` with each figure as 9 and each name of inner capitals as one sign."""
    return _NAME.sub("某", _FIGURE.sub("9", text))


def _stops(t: Texts) -> np.ndarray:
    """Whether a stretch of masked text ends at each place."""
    p = t.points
    before, after = np.concatenate([[0], p[:-1]]), np.concatenate([p[1:], [0]])
    before[t.begins], after[t.ends - 1] = 0, 0
    return _IS_STOP[p] | ((p == ord(" ")) & (before == ord("."))) | ((p == ord("9")) & (after != ord("\n")))


def last_stretch(text: str) -> str:
    """The last stretch of a masked text that is not empty."""
    at, piece = 0, ""
    for m in _STRETCH_END.finditer(text):
        at, piece = m.end(), text[at : m.end()]
    return text[at:] or piece


def _trimmed(text: Column) -> Column:
    """Without blanks and invisible characters at the end."""
    return F.rtrim(text, F.lit(_BLANKS))


def _ended(text: Column) -> Column:
    """Whether a trimmed text ends in good order; its last signs tell."""
    return F.right(text, F.lit(4)).rlike(_ENDED)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, open, running) of the lines of masked texts that are not empty.

    ``open``: it does not end in good order; ``running``: a sentence ends before its last sign.
    """
    p, n = t.points, len(t.points)
    feeds = np.flatnonzero(p == ord("\n"))
    # every line has one begin and one end, and both come in the order of the lines
    begins, ends = np.sort(np.concatenate([t.begins, feeds + 1])), np.sort(np.concatenate([t.ends, feeds]))
    full = ends > begins
    begins, ends = begins[full], ends[full]
    seen = np.maximum.accumulate(np.where(_IS_BLANK[p], -1, np.arange(n)))[ends - 1]
    some = seen >= begins
    last = p[np.where(some, seen, 0)]
    dot = (last == ord(".")) & (seen > begins) & ~_IS_OPEN_DOT[p[np.maximum(seen - 1, 0)]]
    full_stop = _IS_SENTENCE[p] | ((p == ord(".")) & (np.concatenate([p[1:], [0]]) == ord(" ")))
    before = np.concatenate([[0], np.cumsum(full_stop)])
    return begins, ends, ~(some & (_IS_END[last] | dot)), some & (before[np.maximum(seen, begins)] > before[begins])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (run, head, n, n_open): the stretches but the last of each text, and the first signs of lines, counted.

    Lines in which a sentence ends count twice, for their head and for it with a mark: running text is a kind of its own.
    """
    for b in slices(batches, "text"):
        t = Texts([masked(x) for x in b.column(0).to_pylist()])
        stop = _stops(t)
        every = stop.copy()
        every[t.ends - 1] = True
        ends = np.flatnonzero(every) + 1
        begins = np.concatenate([[0], ends[:-1]])
        mid = stop[ends - 1]
        begins, ends = begins[mid], ends[mid]
        _, first, n = np.unique(t.hashes(begins, ends), return_index=True, return_counts=True)
        runs = [t.joined[x:y] for x, y in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
        at, to, is_open, running = _lines(t)
        run_on = np.flatnonzero(running)
        at, to, is_open = (np.concatenate([x, x[run_on]]) for x in (at, np.minimum(to, at + HEAD), is_open))
        marked = np.arange(len(at)) >= len(running)
        h = t.hashes(at, to) ^ np.where(marked, _SALT, 0)
        first = np.unique(h, return_index=True)[1]
        _, n_lines, n_open = summed(h, np.ones(len(h)), is_open)
        heads = [_RUNNING * z + t.joined[x:y] for x, y, z in zip(at[first].tolist(), to[first].tolist(), marked[first].tolist(), strict=True)]
        cols = [pa.array(runs + [None] * len(heads), pa.string()), pa.array([None] * len(runs) + heads, pa.string()), pa.array(np.concatenate([n, n_lines])), pa.array(np.concatenate([np.zeros(len(n), dtype=np.int64), n_open]))]
        yield pa.RecordBatch.from_arrays(cols, names=["run", "head", "n", "n_open"])


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, n) -> (fragment, n_on, n_line): how often each prefix of a stretch, and each window in it, goes on or ends a line.

    A stretch that ends at a figure or a comma also counts for itself, since it went on. Fragments are hashes,
    those of windows salted.
    """
    for b in slices(batches, "run"):
        t = Texts(b.column(0).to_pylist())
        p, size = t.points, t.ends - t.begins
        weight = np.repeat(b.column(1).to_numpy(), size)
        begin, end = np.repeat(t.begins, size), np.repeat(t.ends, size)
        behind = np.arange(len(p)) + 1
        follows = p[np.minimum(behind, len(p) - 1)]
        inner = behind < end
        line = inner & (follows == ord("\n"))
        on = (inner & ~line) | (~inner & _IS_ON[p])
        some = np.flatnonzero(on | line)
        parts = [(t.hashes(begin[some], behind[some]), on[some] * weight[some], line[some] * weight[some])]
        wide = np.flatnonzero(behind + WINDOW - 1 < end)  # a window and what follows it within the stretch
        stop = wide + WINDOW
        line = p[stop] == ord("\n")
        parts.append((t.hashes(wide, stop) ^ _SALT, ~line * weight[wide], line * weight[wide]))
        cols = summed(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["fragment", "n_on", "n_line"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, title) -> (key, title, line, head, fragment, window): what each text ends in, with and without marks behind a cut."""
    for b in slices(batches, "text"):
        spot, lines, heads, ends = [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            line = text.rsplit("\n", 1)[-1]
            two = masked("\n".join(text.rsplit("\n", 2)[-2:]))  # what a text ends in lies in its last two lines
            for end in dict.fromkeys((two, _MARKS.sub("", two), _OPEN_ROW.sub("", two))):
                if end:
                    spot.append(i)
                    lines.append(line)
                    heads.append((_RUNNING if _SENTENCE.search(line) else "") + masked(line[:32])[:HEAD])
                    ends.append(last_stretch(end))
        rows = b.take(pa.array(spot, pa.int64()))
        window = text_hashes([x[-WINDOW:] for x in ends]) ^ _SALT
        sizes = np.fromiter(map(len, ends), dtype=np.int32, count=len(ends))
        cols = [rows.column(0), rows.column(2), pa.array(lines, pa.string()), pa.array(heads, pa.string()), pa.array(text_hashes(ends)), pa.array(window, mask=sizes < WINDOW), pa.array(sizes)]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "title", "line", "head", "fragment", "window", "size"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, m, level, h, whole): the hashes of each text's prefixes of 1, 2, 4, ... code points; its own length and hash."""
    for b in slices(batches, "text"):
        t = Texts(b.column(1).to_pylist())
        size = t.ends - t.begins
        steps = np.frexp(size)[1]  # the powers of two up to the size
        row = np.repeat(np.arange(len(size)), steps)
        level = np.left_shift(1, np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps))
        h, whole = t.hashes(t.begins[row], t.begins[row] + level), t.hashes(t.begins, t.ends)
        cols = [b.column(0).take(pa.array(row)), pa.array(size[row]), pa.array(level.astype(np.int64)), pa.array(h), pa.array(whole[row])]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "m", "level", "h", "whole"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, levels) -> (m, whole, n_in_line): the prefixes of a text from each level up to the next, shorter than the text.

    ``n_in_line``: how many texts go on behind that prefix with something other than a line end.
    """
    for b in slices(batches, "text"):
        t = Texts(b.column(0).to_pylist())
        p, n = t.points, len(t.points)
        begins, sizes = [], []
        for begin, end, levels in zip(t.begins.tolist(), t.ends.tolist(), b.column(1).to_pylist(), strict=True):
            for level in levels:
                sizes.append(np.arange(level, min(2 * level, end - begin)))
                begins.append(np.full(len(sizes[-1]), begin))
        if not begins:
            continue
        m, begin = np.concatenate(sizes), np.concatenate(begins)
        at = begin + m
        seen = np.minimum.accumulate(np.where(_IS_SPACE[p], n, np.arange(n))[::-1])[::-1]  # the next sign that is no blank
        end = t.ends[np.searchsorted(t.ends, at, side="right")]
        sign = seen[at]
        in_line = (sign < np.minimum(at + LOOK, end)) & (p[np.minimum(sign, n - 1)] != ord("\n"))
        h = t.hashes(begin, at)
        first = np.unique(h, return_index=True)[1]
        whole, n_in = summed(h, in_line)
        yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.array(whole), pa.array(n_in)], names=["m", "whole", "n_in_line"])


def longer_copies(rows: DataFrame, short: DataFrame) -> DataFrame:
    """(key, in_line) of the rows of ``short`` whose whole text is a strict prefix of the text of another row of ``rows``; both (key, text).

    ``in_line`` tells whether a longer text goes on with something other than a line end. A short text of m
    code points is met by the hash of its first L, the greatest power of two up to m; the texts that share such
    a prefix then give the hashes of their prefixes from L up to 2 L, which are held against the short texts'.
    A prefix that many texts share is one row of each batch, so neither its texts nor its lengths multiply.
    """
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, m long, level long, h long, whole long"
    asked = cut(short.mapInArrow(_prefixes, schema).where("level * 2 > m"))
    least = broadcast_if_small(cut(asked.groupBy("level", "h").agg(F.min("m").alias("least"))), SMALL)
    shared = rows.mapInArrow(_prefixes, schema).join(least, ["level", "h"]).where("m > least")
    levels = cut(shared.groupBy("key").agg(F.collect_set("level").alias("levels")))
    met = rows.join(broadcast_if_small(levels, SMALL // 5), "key").select("text", "levels").mapInArrow(_places, "m long, whole long, n_in_line long")
    wanted = broadcast_if_small(cut(asked.select("m", "whole").distinct()), SMALL)
    longer = met.join(wanted, ["m", "whole"], "left_semi").groupBy("m", "whole").agg((F.sum("n_in_line") > 0).alias("in_line"))
    return asked.select("key", "m", "whole").join(longer, ["m", "whole"]).select("key", "in_line")


def _repeated(rows: DataFrame) -> DataFrame:
    """(key, rep, title) of the rows of ``rows`` (key, text, title) whose text has a lesser key too, the least of which is ``rep``; only hashes travel."""
    hashed = cut(rows.select("key", "title", F.md5("text").alias("hash")))
    groups = hashed.groupBy("hash").agg(F.min("key").alias("rep"), F.count("*").alias("n")).where("n > 1").select("hash", "rep")
    return hashed.join(groups, "hash").where("key != rep").select("key", "rep", "title")


def truncated(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, step, n_on, n_end): the rows whose text breaks off, by what step, with the longer and the complete copies of its last fragment."""
    kind = df.schema[key].dataType
    whole = _trimmed(F.col(text))
    shown = F.col(title) if title else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), whole.alias("text"), shown.alias("title")).where(F.length("text") > 0)
    repeated = cut(_repeated(rows))
    rows = rows.join(broadcast_if_small(repeated.select("key"), 200_000), "key", "left_anti")

    scanned = cut(rows.select("text").mapInArrow(_scan, "run string, head string, n long, n_open long"))
    runs = scanned.where("run IS NOT NULL").groupBy("run").agg(F.sum("n").alias("n"))

    open_end = rows.where(~_ended(F.col("text")) | (F.right("text", F.lit(3)) == "..."))
    fields = [T.StructField("key", kind), *[T.StructField(c, T.StringType()) for c in ("title", "line", "head")], *[T.StructField(c, T.LongType()) for c in ("fragment", "window")], T.StructField("size", T.IntegerType())]
    tails = cut(open_end.mapInArrow(_tails, T.StructType(fields)))

    both = tails.select(F.explode(F.array("fragment", "window")).alias("fragment")).where("fragment IS NOT NULL")
    wanted = broadcast_if_small(cut(both.distinct()), SMALL)
    found = runs.mapInArrow(_continuations, "fragment long, n_on long, n_line long").join(wanted, "fragment", "left_semi")
    known = found.groupBy("fragment").agg(F.sum("n_on").alias("n_on"), F.sum("n_line").alias("n_line"))
    last = tails.select("key", F.explode(F.array("fragment", "window")).alias("fragment")).where("fragment IS NOT NULL").distinct().groupBy("fragment").agg(F.count("*").alias("n_last"))
    counts = cut(last.join(known, "fragment", "left").select("fragment", "n_on", (F.coalesce("n_line", F.lit(0)) + F.col("n_last") - 1).alias("n_end")))
    keep = ["key", "line", "title", "head", "step", "n_on", "n_end"]
    first = cut(tails.join(counts, "fragment").withColumn("step", F.lit("stretch")))
    alone = first.where(F.col("n_on").isNull() & (F.col("size") > WINDOW)).drop("fragment", "n_on", "n_end")
    second = alone.withColumnRenamed("window", "fragment").join(counts, "fragment").withColumn("step", F.lit("window"))
    judged = first.select(*keep).unionByName(second.select(*keep)).where("n_on IS NOT NULL")

    heads = scanned.where("head IS NOT NULL").groupBy("head").agg(F.sum("n").alias("n_lines"), F.sum("n_open").alias("n_open"))
    judged = judged.join(heads, "head", "left")
    judged = cut(judged.unionByName(repeated.join(judged.drop("title").withColumnRenamed("key", "rep"), "rep").drop("rep")))
    # the line itself, which is open, is taken from both counts, and PRIOR_LINES that are not are added: few lines tell little
    of_open_kind = F.col("n_open") - 1 >= OPEN_SHARE * (F.col("n_lines") - 1 + PRIOR_LINES)
    complete = (F.coalesce(of_open_kind, F.lit(False)) | F.col("line").eqNullSafe(F.col("title"))) & ~F.col("line").rlike(_OPEN_TAG)
    by_fragment = judged.where((F.col("n_on") > F.col("n_end")) & ~complete)
    # a text with a longer whole copy breaks off whatever its last fragment tells; only what the kind of a line says exactly speaks against it
    texts = rows.select("key", "text")
    proven = longer_copies(texts, open_end.select("key", "text")).where("in_line").select("key").distinct().join(tails.select("key", "title", "line").distinct(), "key")
    proven = proven.unionByName(repeated.join(proven.drop("title").withColumnRenamed("key", "rep"), "rep").select("key", "title", "line"))
    whole_line = (F.col("line").rlike(_WHOLE_LINE) | F.col("line").eqNullSafe(F.col("title"))) & ~F.col("line").rlike(_OPEN_TAG)
    by_whole = proven.where(~whole_line).join(judged.select("key", "n_on", "n_end"), "key", "left")
    by_whole = by_whole.select("key", F.lit("whole").alias("step"), F.greatest(F.coalesce("n_on", F.lit(0)), F.lit(1)).alias("n_on"), F.coalesce("n_end", F.lit(0)).alias("n_end"))
    found = by_fragment.select("key", "step", "n_on", "n_end").unionByName(by_whole)
    # the step is the first of the alphabet that finds a row: stretch, then whole, then window
    return found.groupBy("key").agg(F.min("step").alias("step"), F.max("n_on").alias("n_on"), F.min("n_end").alias("n_end")).withColumnRenamed("key", key)
