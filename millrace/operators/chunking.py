"""From the units of documents to retrievable chunks.

Units are rows (doc_id, pos, text, section_title, unit_type, is_noise, page_number, ...); ``pos`` orders a
document's units. Work on sequences goes by document, whose units are bounded by the size of a report; no
operator gathers more than one document's units in a task's memory, and packing only their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import text as tx
from millrace.session import cut

# Sizes of chunks in tokens.
TARGET_MIN, TARGET_MAX, HARD_MAX, OVERLAP, MIN_TOKENS, TABLE_MAX = 120, 480, 512, 20, 40, 440
# Content that is no text of a page.
SKIPPED_TYPES = ("page_header", "page_footer", "page_number", "page_aside_text", "page_footnote")


def token_count(text: Column) -> Column:
    """Han characters and words of other letters and digits; a stand-in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(tx.text_or_empty(text), F.lit(r"[㐀-䶿一-鿿]|[A-Za-z0-9]+"), F.lit(0)))


def flatten_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page, pos, type, content) of ``documents`` (doc_id, pages: array of arrays of structs (type, content))."""
    pages = documents.select("doc_id", F.posexplode("pages").alias("page", "items"))
    items = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode("items").alias("pos", "item"))
    return items.select("doc_id", "page", "pos", "item.type", "item.content")


SPAN = "array<struct<type:string,content:string,children:string>>"


def spans_text(spans: Column, depth: int = 3) -> Column:
    """The text of spans in JSON; a link without text gives that of its children, down to ``depth`` levels. No spans give no text."""
    inner = (lambda c: spans_text(c, depth - 1)) if depth > 1 else (lambda c: F.lit(""))
    own = lambda x: F.when((x["type"] == "hyperlink") & (tx.text_or_empty(x["content"]) == ""), inner(x["children"])).otherwise(tx.text_or_empty(x["content"]))
    parts = F.transform(F.from_json(spans, SPAN), own)
    return tx.normalize_text(F.coalesce(F.array_join(parts, ""), F.lit("")))


# Under what name an item of each type keeps its spans.
LISTS = {"list": "list_items", "index": "index_items"}
PARTS = {"code": ("code_caption", "code_content", "code_footnote"), "algorithm": ("algorithm_caption", "algorithm_content", "algorithm_footnote")}


def parsed_items(items: DataFrame) -> DataFrame:
    """``items`` (type, content, ...) with ``text``, ``table_caption``, ``table_header``, ``table_rows`` and ``table_footnote``.

    Content that is nested JSON is flattened by the item's type; other content is text already. A table whose header names no
    years takes its first row as header if that does. Tables of other types are empty.
    """
    field = lambda f: F.get_json_object("content", f"$.{f}")
    lines = lambda *parts: tx.normalize_text(F.array_join(F.filter(F.array(*parts), lambda x: tx.text_or_empty(x) != ""), "\n"))
    spans = lambda f: spans_text(field(f))
    caption, footnote, body = tx.clean_markers(spans("table_caption")), spans("table_footnote"), tx.html_table_to_text(field("html"))

    def listed(f: str) -> Column:
        plain = F.from_json(field(f), "array<string>")
        one = lambda x: F.when(x.startswith("{"), spans_text(F.concat(F.lit("["), x, F.lit("]")))).otherwise(x)
        return tx.normalize_text(F.coalesce(F.array_join(F.transform(plain, one), "\n"), F.lit("")))

    equation = F.when(tx.text_or_empty(field("math_content")).startswith("["), spans("math_content")).otherwise(tx.normalize_text(field("math_content")))
    made = F.when(F.col("type") == "table", lines(caption, body, footnote)).when(F.col("type") == "chart", lines(spans("chart_caption"), tx.normalize_text(field("content")), spans("chart_footnote")))
    made = made.when(F.col("type") == "equation_interline", equation).when(F.col("type") == "title", spans("title_content"))
    for kind, name in LISTS.items():
        made = made.when(F.col("type") == kind, listed(name))
    for kind, parts in PARTS.items():
        made = made.when(F.col("type") == kind, lines(*map(spans, parts)))
    made = made.when(F.col("type") == "paragraph", spans("paragraph_content")).otherwise("")
    nested = tx.text_or_empty(F.col("content")).startswith("{")
    is_table = F.col("type") == "table"
    none = F.array().cast("array<string>")
    named = items.withColumn("_nested", nested).withColumn("text", F.when(nested, made).otherwise(tx.normalize_text(F.col("content")))).withColumn("_body", F.when(is_table, F.when(nested, body).otherwise(tx.html_table_to_text(F.col("content")))))
    named = named.withColumn("table_caption", F.when(is_table & F.col("_nested"), caption).otherwise("")).withColumn("table_footnote", F.when(is_table & F.col("_nested"), footnote).otherwise(""))
    named = named.withColumn("table_header", F.when(is_table, tx.table_header(F.col("_body"))).otherwise("")).withColumn("table_rows", F.when(is_table, tx.table_rows(F.col("_body"))).otherwise(none))
    first = F.coalesce(F.get("table_rows", F.lit(0)), F.lit(""))
    promote = (F.size(tx.year_columns(F.col("table_header"))) == 0) & (F.size(tx.year_columns(first)) > 0)
    named = named.withColumn("_promote", promote).withColumn("table_header", F.when(F.col("_promote"), first).otherwise(F.col("table_header")))
    return named.withColumn("table_rows", F.when(F.col("_promote"), F.slice("table_rows", 2, F.greatest(F.size("table_rows") - 1, F.lit(1)))).otherwise(F.col("table_rows"))).drop("_nested", "_body", "_promote")


def units_of(items: DataFrame) -> DataFrame:
    """Items with the title that stands last before them, tables numbered within their document."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("type") == "title", tx.normalize_text(F.col("content"))), ignorenulls=True).over(order)
    number = F.sum(F.when(F.col("type") == "table", 1).otherwise(0)).over(order)
    named = items.withColumn("section_title", F.coalesce(title, F.lit(""))).withColumn("table_seq", F.when(F.col("type") == "table", number).otherwise(0))
    id_ = F.when(F.col("table_seq") > 0, F.format_string("%s_t%02d", F.col("doc_id"), F.col("table_seq").cast("int"))).otherwise("")
    return named.where(~F.col("type").isin(*SKIPPED_TYPES)).withColumn("table_id", id_)


def first_by_position(items: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per group with the first value of each column that is neither null nor empty, in the given order."""
    place = F.struct(*order)
    given = lambda c: (F.col(c).isNotNull()) & (F.col(c).cast("string") != "")
    return items.groupBy(group).agg(*[F.min_by(F.when(given(c), F.col(c)), F.when(given(c), place)).alias(c) for c in values])


def _groups(sections: list, apart: list, single: list, sizes: list) -> list[int]:
    """The group numbers of one document's units in order.

    Units ``apart`` (tables, noise) and ``single`` (pieces of an oversized unit) stand alone. Others of one section
    fill a group up to ``TARGET_MAX`` tokens, up to ``HARD_MAX`` while it is under ``TARGET_MIN``. A text group under
    ``TARGET_MIN`` then joins the one before it, if that is text of the same section and both fit into ``HARD_MAX``.
    """
    groups: list[list] = []  # units, tokens, whether it is text, section
    is_open = False
    for section, alone, piece, n in zip(sections, apart, single, sizes, strict=True):
        last = groups[-1] if groups and is_open else None
        fits = last and not (alone or piece) and last[3] == section and last[1] + n <= (HARD_MAX if last[1] < TARGET_MIN else TARGET_MAX)
        if fits:
            last[0] += 1
            last[1] += n
        else:
            groups.append([1, n, not alone, section])
        is_open = not (alone or piece)
    out: list[int] = []
    before, number = None, 0
    for units, n, is_text, section in groups:
        if before and is_text and n < TARGET_MIN and before[1] and before[2] == section and before[0] + n <= HARD_MAX:
            before[0] += n
        else:
            number += 1
            before = [n, is_text, section]
        out += [number] * units
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, part, section, apart, single, n), the rows of a document together and in order -> (doc_id, pos, part, group_no)."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> pa.RecordBatch:
        group, doc = [], table.column("doc_id").to_pylist()
        cols = [table.column(c).to_pylist() for c in ("section", "apart", "single", "n")]
        edges = [0, *[i for i in range(1, len(doc)) if doc[i] != doc[i - 1]], len(doc)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            group += _groups(*[c[x:y] for c in cols])
        whole = table.combine_chunks()
        return pa.RecordBatch.from_arrays([*[whole.column(c).combine_chunks() for c in ("doc_id", "pos", "part")], pa.array(group, pa.int32())], names=["doc_id", "pos", "part", "group_no"])

    for b in batches:
        if not b.num_rows:
            continue
        doc = b.column("doc_id").to_pylist()
        stop = next((i for i in range(len(doc), 0, -1) if doc[i - 1] != doc[-1]), 0)  # the last document may go on
        before = pa.Table.from_batches([*held, b.slice(0, stop)])
        if held and held[0].column("doc_id")[0].as_py() == doc[-1]:
            held.append(b)
            continue
        if before.num_rows:
            yield numbered(before)
        held = [b.slice(stop)]
    if held:
        yield numbered(pa.Table.from_batches(held))


def pack_units(units: DataFrame) -> DataFrame:
    """``units`` with ``part`` and ``group_no``: text units of one section packed by ``_groups``; tables and noise stand alone.

    Text units beyond ``HARD_MAX`` tokens come in pieces, a row each. The packing is greedy in the order of a
    document; only positions, sizes and flags are sorted by document, and the numbers joined back once.
    """
    table = F.col("unit_type").eqNullSafe("table")
    split = units.where(~table & (token_count(F.col("text")) > HARD_MAX))
    kept = units.where(table | ~(token_count(F.col("text")) > HARD_MAX)).withColumn("part", F.lit(1))
    parts = kept.withColumn("single", F.lit(False)).unionByName(split_units(split).withColumn("single", F.lit(True)))
    parts = cut(parts)
    sized = parts.select("doc_id", "pos", "part", F.coalesce("section_title", F.lit("")).alias("section"), (table | F.coalesce("is_noise", F.lit(False))).alias("apart"), "single", token_count(F.col("text")).alias("n"))
    doc, pos = units.schema["doc_id"].dataType, units.schema["pos"].dataType
    schema = T.StructType([T.StructField("doc_id", doc), T.StructField("pos", pos), T.StructField("part", T.IntegerType()), T.StructField("group_no", T.IntegerType())])
    placed = sized.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "part").mapInArrow(_packed, schema)
    return parts.drop("single").join(placed, ["doc_id", "pos", "part"])


def numbered(doc_id: Column, number: Column) -> Column:
    """The id of a document's chunk: its number in at least four digits, never cut; null for a null document."""
    return F.concat(doc_id, F.lit("_"), F.format_string("%04d", number))


def chunk_groups(packed: DataFrame) -> DataFrame:
    """(doc_id, group_no, chunk_id, section_title, text, pages, unit_count, unit_types, is_noise, first_pos, token_count) of packed units."""
    has = lambda c, other: F.col(c) if c in packed.columns else other
    parts = packed.withColumns({"part": has("part", F.lit(1)), "unit_type": has("unit_type", F.lit("paragraph")), "is_noise": has("is_noise", F.lit(False))}).groupBy("doc_id", "group_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"), F.min_by("section_title", F.struct("pos", "part")).alias("section_title"),
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.array_sort(F.collect_set("page_number")).alias("pdf_page_numbers"), F.count("*").alias("unit_count"),
        F.array_sort(F.collect_set("unit_type")).alias("unit_types"), F.coalesce(F.bool_or("is_noise"), F.lit(False)).alias("is_noise"), F.min(F.struct("pos", "part")).alias("first_pos"),
    )
    text = F.array_join(F.filter("parts.text", lambda x: x != ""), "\n\n")
    chunk_id = numbered(F.col("doc_id"), F.col("group_no"))
    return parts.select("doc_id", "group_no", chunk_id.alias("chunk_id"), "section_title", text.alias("text"), "page_start", "page_end", "pdf_page_numbers", "unit_count", "unit_types", "is_noise", "first_pos").withColumn("token_count", token_count(F.col("text")))


def islands(rows: DataFrame, group: str, order: str, member: Column, key: str | None = None) -> DataFrame:
    """``rows`` with ``island``: consecutive members of a group share a number; every other row has its own."""
    w = Window.partitionBy(group).orderBy(order)
    previous = F.lag(member).over(w)
    same = F.lag(key).over(w).eqNullSafe(F.col(key)) if key else F.lit(True)
    starts = F.when(member & F.coalesce(previous, F.lit(False)) & same, 0).otherwise(1)
    return rows.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def merge_islands(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, island, text, n_rows, first): the rows of each island joined in order."""
    parts = rows.groupBy(group, "island").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    return parts.select(group, "island", F.array_join("p.t", "\n").alias(text), F.size("p").alias("n_rows"), F.element_at("p.o", 1).alias("first"))


def renumber(chunks: DataFrame, order: Column) -> DataFrame:
    """Chunks with ids numbered anew within their document."""
    w = Window.partitionBy("doc_id").orderBy(order, "chunk_id")
    return chunks.withColumn("chunk_id", numbered(F.col("doc_id"), F.row_number().over(w)))


def split_budget(text: str, budget: int, overlap: int) -> list[str]:
    """``text`` in pieces of at most ``budget`` tokens: paragraphs, else sentences, else tokens with overlap; joined where they fit."""
    import re

    token = re.compile(r"[㐀-䶿一-鿿]|[A-Za-z0-9]+")
    count = lambda s: len(token.findall(s))
    if count(text) <= budget:
        return [text]
    segments: list[str] = []
    for paragraph in filter(None, (p.strip() for p in text.split("\n"))):
        parts = [paragraph] if count(paragraph) <= budget else [s.strip() for s in re.split(r"(?<=[。！？；!?])\s*", paragraph) if s.strip()]
        for part in parts:
            ends = [m.end() for m in token.finditer(part)]
            if len(ends) <= budget:
                segments.append(part)
                continue
            first, begin = 0, 0
            while first < len(ends):
                stop = ends[min(first + budget, len(ends)) - 1] if first + budget < len(ends) else len(part)
                segments.append(part[begin:stop])
                if first + budget >= len(ends):
                    break
                first += max(1, budget - overlap)
                begin = ends[first - 1]
    out: list[str] = []
    for s in segments:
        if out and count(out[-1]) + count(s) <= budget:
            out[-1] += "\n" + s
        else:
            out.append(s)
    return out


def split_units(units: DataFrame, budget: int = HARD_MAX, overlap: int = OVERLAP, minimum: int = MIN_TOKENS) -> DataFrame:
    """Units beyond ``budget`` tokens as several rows with ``part``; parts under ``minimum`` tokens are dropped unless they are noise."""
    fields = units.schema.fields
    schema = T.StructType([*fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(text=[split_budget(t, budget, overlap) if t else [t] for t in b["text"]])
            b = b.assign(part=[list(range(1, len(t) + 1)) for t in b["text"]]).explode(["text", "part"])
            yield b.astype({"part": "int32"})

    large = units.where(token_count(F.col("text")) > budget).mapInPandas(run, schema)
    small = units.where(~(token_count(F.col("text")) > budget)).withColumn("part", F.lit(1))
    kept = large.where((token_count(F.col("text")) >= minimum) | F.coalesce("is_noise", F.lit(False)))
    return small.unionByName(kept)


def table_cells(tables: DataFrame, key: str) -> DataFrame:
    """(key, row_no, indicator, column_no, column, value): a table's cells by its header's value columns.

    Rows that are labelled by a year, and cells beyond the header's columns, say nothing and are left out.
    """
    columns = tx.value_columns(F.col("table_header"))
    rows = tables.select(key, columns.alias("columns"), F.posexplode("table_rows").alias("row_no", "row"))
    cells = rows.withColumn("cells", tx.cells_of(F.col("row"))).where(F.size("cells") > 1)
    values = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1)))
    pairs = cells.select(key, "row_no", F.get("cells", F.lit(0)).alias("indicator"), "columns", F.posexplode(values).alias("column_no", "value"))
    named = pairs.where((F.col("column_no") < F.size("columns")) & ~F.regexp_replace("indicator", " ", "").rlike(tx.YEAR_COLUMN))
    return named.select(key, "row_no", "indicator", "column_no", F.get("columns", F.col("column_no")).alias("column"), "value")


def cell_sentences(tables: DataFrame, key: str, unit: Column) -> DataFrame:
    """(key, row_no, column_no, sentence, value): a sentence for each cell that holds a figure."""
    cells = table_cells(tables, key).join(tables.select(key, unit.alias("table_unit")), key)
    value = tx.clean_number(F.col("value"))
    said = tx.narrative(F.col("column"), F.col("indicator"), F.col("value"), tx.indicator_unit(F.col("indicator"), F.col("table_unit"), value))
    return cells.select(key, "row_no", "column_no", said.alias("sentence"), "value")


def table_narrative(tables: DataFrame, key: str, unit: Column) -> DataFrame:
    """(key, narrative, n_sentences): what a table says, a sentence a cell, in the order of its rows and columns."""
    kept = cell_sentences(tables, key, unit).where(tx.narrative_is_valid(F.col("sentence"), F.col("value")))
    parts = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "column_no", "sentence"))).alias("p"))
    return parts.select(key, F.array_join("p.sentence", "；").alias("narrative"), F.size("p").alias("n_sentences"))


def validation(chunks: DataFrame, text: str) -> DataFrame:
    """One row: chunks, those beyond ``HARD_MAX`` tokens, and how many make each forbidden claim."""
    claims = [F.count_if(F.col(text).rlike(p)).alias(f"pattern_{i}") for i, p in enumerate(tx.FORBIDDEN_UNITS, 1)]
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(token_count(F.col(text)) > HARD_MAX).alias("n_over"), *claims)
