"""Tables as text, chunk records and synthetic chunks, prompts: what a retrieval store is filled with.

Tables are rows (key, table_caption, table_header, table_rows, table_footnote, section_title, page_number, ...);
narratives are built from their cells by position, so a table's rows may lie on several tasks until its
sentences are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx
from millrace.operators.chunking import TABLE_MAX, cell_sentences, chunk_groups, islands, numbered, pack_units, token_count
from millrace.session import cut

# How tables and sections of appendices are known, units of rows, labels that are no product.
FINANCIAL_TABLE = r"利润表|资产负债表|现金流量表|财务预测|盈利预测|估值|三大报表|附录|损益表|财务状况表|财务指标|比率分析|分产品|分业务"
SELF_TITLED = r"图\d+|表\d+|图表\d+|比率分析|分产品|分业务|盈利预测|财务指标|PE估值|三大报表"
MISLEADING_SECTION = r"风险提示|核心风险|免责声明|分析师|投资评级说明|比率分析"
APPENDIX = r"附录|三大报表|财务报表预测|盈利预测与估值"
ROW_UNITS = ("百万元", "亿元", "万元", "%", "％", "倍", "元", "元/股")
LISTED_HEADER = r"股票代码.*公司简称|EPS\s*[（(].*PE\s*[（(]"
MIXED_CELL, PLAIN_CELL = r"[一-鿿]{2,}.*[\d,.]+|[\d,.]+.*[一-鿿]{2,}", r"^[一-鿿A-Za-z0-9（）().\-\s]+$"
NO_PRODUCT = ("营收", "YoY", "占比", "毛利率", "销售毛利率")
# What an answer's prompt says by type of question.
TYPE_HINTS = {
    "factual": "请直接回答所问指标、评级或风险点；注意问题中的报告期（H1/全年/E 等），优先使用对应期间的数值。",
    "comparative": "这是对比题：请分别给出各主体的关键数值，最后一行必须以「结论：」开头，明确说明谁更高/更低或无法比较。",
    "summary": "请用 3–5 句话归纳要点，避免堆砌表格数据。",
}


def table_section(current: Column, caption: Column, first_line: Column) -> Column:
    """The title a table goes by: its caption or first line if they name a table, else the section, unless that misleads."""
    caption, current, first = tx.clean_markers(caption), tx.clean_markers(current), tx.stripped(tx.text_or_empty(first_line))
    named = lambda c: (c != "") & c.rlike(f"{FINANCIAL_TABLE}|{SELF_TITLED}")
    fallback = F.coalesce(F.nullif(caption, F.lit("")), F.nullif(first, F.lit("")))
    return (
        F.when(named(caption), caption).when(named(first), first)
        .when(current.rlike(MISLEADING_SECTION) & fallback.isNotNull(), fallback).otherwise(F.coalesce(F.nullif(current, F.lit("")), caption))
    )


def table_context(company: Column, code: Column, broker: Column, title: Column, section: Column, caption: Column, unit: Column, header: Column, page: Column) -> Column:
    """The lines that stand before every part of a table."""
    company, code, title = map(tx.text_or_empty, (company, code, title))
    name = F.coalesce(F.nullif(company, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))
    line = F.when(code == "", name).when(name == "", code).otherwise(F.concat(name, F.lit("("), code, F.lit(")")))
    labelled = [("公司：", line), ("券商：", broker), ("报告：", title), ("章节：", section), ("表格：", caption), ("单位：", unit), ("列头：", header)]
    parts = [F.when(tx.text_or_empty(c) != "", F.concat(F.lit(k), c)) for k, c in labelled]
    return F.concat_ws("\n", *parts, F.concat(F.lit("页码：第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页")))


def table_raw(caption: Column, header: Column, rows: Column, footnote: Column | None = None) -> Column:
    """Caption, header and rows on lines of their own, their figures without blanks."""
    cleaned = F.transform(F.coalesce(rows, F.array().cast("array<string>")), lambda r: tx.clean_numbers_in(r))
    parts = F.concat(F.array(tx.clean_numbers_in(caption), tx.clean_numbers_in(header)), cleaned, F.array(tx.text_or_empty(footnote if footnote is not None else F.lit(""))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def is_unit_column_table(header: Column) -> Column:
    return F.coalesce(F.get(tx.cells_of(header), F.lit(0)) == "单位", F.lit(False))


def is_complex_table(caption: Column, header: Column, rows: Column, section: Column) -> Column:
    """Whether a table has no plain reading by row and column."""
    comparable = tx.is_comparable_table(caption, header)
    label = F.concat_ws(" ", *map(tx.text_or_empty, (caption, section, header)))
    corrupt = F.exists(F.flatten(F.transform(F.coalesce(rows, F.array().cast("array<string>")), tx.cells_of)), lambda c: c.rlike(MIXED_CELL) & ~c.rlike(PLAIN_CELL))
    listed = tx.text_or_empty(header).rlike(LISTED_HEADER) | tx.text_or_empty(F.get(rows, F.lit(0))).rlike("股票代码")
    two = F.slice(F.coalesce(rows, F.array().cast("array<string>")), 1, 2)
    years = lambda r: F.size(tx.year_columns(r))
    multiples = tx.text_or_empty(header).rlike("EPS|PE") & F.coalesce(F.exists(two, lambda r: years(r) >= 4), F.lit(False))
    return ~comparable & ~is_unit_column_table(header) & (label.rlike("可比公司|PE估值") | listed | multiples | F.coalesce(corrupt, F.lit(False)))


def joined(sentences: DataFrame, key: str) -> DataFrame:
    """(key, narrative) of sentences (key, row_no, column_no, sentence), if the whole makes no claim whose unit cannot be right."""
    parts = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "column_no", "sentence"))).alias("p"))
    return parts.select(key, F.array_join("p.sentence", "；").alias("narrative")).where(tx.units_are_valid(F.col("narrative")))


def comparable_sentences(tables: DataFrame, key: str) -> DataFrame:
    """(key, row_no, column_no, sentence, value) of tables of comparable companies: three years of earnings and three of multiples for each."""
    years = tx.year_columns(F.col("table_header"))
    rows = tables.select(key, years.alias("years"), F.posexplode("table_rows").alias("row_no", "row")).withColumn("cells", tx.cells_of(F.col("row")))
    order = Window.partitionBy(key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.filter("cells", lambda c: F.regexp_replace(c, " ", "").rlike(tx.YEAR_COLUMN))
    rows = rows.withColumn("own_years", own)
    carried = F.first(F.when(F.size("own_years") >= 4, F.col("own_years")), ignorenulls=True).over(order)
    rows = rows.withColumn("years", F.when(F.size("years") >= 4, F.col("years")).otherwise(carried)).where((F.size("own_years") < 4) & (F.size("years") >= 6))
    mean = F.get("cells", F.lit(0)).isin("可比公司均值", "算术平均")
    listed = F.get("cells", F.lit(0)).rlike(r"(?i)\.(SH|SZ)")
    name = F.when(mean, "可比公司均值").when(listed & (F.size("cells") > 1), F.get("cells", F.lit(1))).otherwise(F.get("cells", F.lit(0)))
    values = F.when(mean & (F.size("cells") >= 7), F.slice("cells", -6, 6)).when(~mean & (F.size("cells") >= 9), F.slice("cells", 4, 6))
    named = rows.where(~F.get("cells", F.lit(0)).rlike("^(股票代码$|资料来源)")).select(key, "row_no", "years", name.alias("name"), F.posexplode(values).alias("column_no", "value"))
    kind = F.when(F.col("column_no") < 3, F.lit("EPS")).otherwise(F.lit("PE"))
    unit = F.when(F.col("column_no") < 3, F.lit("元/股")).otherwise(F.lit("倍"))
    said = F.concat("name", F.lit(" "), F.get("years", F.col("column_no")), F.lit(" "), kind, F.lit("为"), tx.clean_number(F.col("value")), unit)
    return named.select(key, "row_no", "column_no", said.alias("sentence"), "value")


def unit_column_sentences(tables: DataFrame, key: str) -> DataFrame:
    """(key, row_no, column_no, sentence, value) of tables whose rows carry their unit; a row of one cell names the product of those below it."""
    rows = tables.select(key, "table_caption", tx.year_columns(F.col("table_header")).alias("years"), F.posexplode("table_rows").alias("row_no", "row"))
    rows = rows.withColumn("cells", tx.cells_of(F.col("row"))).where((F.size("cells") > 0) & (F.size("years") > 0) & (F.get("cells", F.lit(0)) != "合计"))
    lone = (F.size("cells") == 1) & ~F.get("cells", F.lit(0)).isin(*NO_PRODUCT) & ~F.get("cells", F.lit(0)).rlike(tx.YEAR_COLUMN)
    order = Window.partitionBy(key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    product = F.coalesce(F.last(F.when(lone, F.get("cells", F.lit(0))), ignorenulls=True).over(order), tx.text_or_empty(F.col("table_caption")))
    rows = rows.withColumn("product", product).where((F.size("cells") >= 3) & F.get("cells", F.lit(1)).isin(*ROW_UNITS))
    unit = F.when(F.get("cells", F.lit(1)).isin("%", "％"), "%").otherwise(F.get("cells", F.lit(1)))
    cells = rows.select(key, "row_no", "years", F.concat("product", F.get("cells", F.lit(0))).alias("label"), unit.alias("unit"), F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("column_no", "value"))
    cells = cells.where(F.col("column_no") < F.size("years"))
    said = tx.narrative(F.get("years", F.col("column_no")), F.col("label"), F.col("value"), F.col("unit"))
    return cells.select(key, "row_no", "column_no", said.alias("sentence"), "value")


def key_value_sentences(tables: DataFrame, key: str) -> DataFrame:
    """(key, row_no, column_no, sentence, value) of tables whose columns are no years: each row's first cell and its last."""
    rows = tables.select(key, tx.unit_named_in(F.col("table_caption")).alias("table_unit"), F.posexplode("table_rows").alias("row_no", "row")).withColumn("cells", tx.cells_of(F.col("row"))).where(F.size("cells") >= 2)
    value, name = F.element_at("cells", -1), F.get("cells", F.lit(0))
    said = tx.narrative(F.lit(""), name, value, tx.indicator_unit(name, F.col("table_unit"), tx.clean_number(value)))
    return rows.select(key, "row_no", F.lit(0).alias("column_no"), said.alias("sentence"), value.alias("value"))


def sentences(tables: DataFrame, key: str) -> DataFrame:
    """(key, row_no, column_no, sentence) of every table that has a reading, by its kind.

    Complex tables and tables without years have none. Sentences without a figure or with a claim whose unit
    cannot be right are left out.
    """
    c, h, r, s = F.col("table_caption"), F.col("table_header"), F.col("table_rows"), F.col("section_title")
    is_year = lambda x: F.regexp_replace(tx.text_or_empty(x), " ", "").rlike(tx.YEAR_COLUMN)
    first = lambda row: F.regexp_extract(tx.text_or_empty(row), r"^\s*([^|]*?)\s*(?:\||$)", 1)
    years = F.exists(tx.value_columns(h), is_year) | F.coalesce(F.exists(r, lambda row: is_year(first(row))), F.lit(False))
    kind = (
        F.when(tx.is_comparable_table(c, h), "comparable").when(is_unit_column_table(h), "unit").when(is_complex_table(c, h, r, s), "none")
        .when(F.coalesce(years, F.lit(False)), "years").when(F.size(tx.year_columns(h)) > 0, "pairs").otherwise("none")
    )
    typed = tables.select(key, "table_caption", "table_header", "table_rows", kind.alias("_kind"))
    of = lambda k: typed.where(F.col("_kind") == k).drop("_kind")
    every = comparable_sentences(of("comparable"), key).unionByName(unit_column_sentences(of("unit"), key))
    every = every.unionByName(cell_sentences(of("years"), key, tx.unit_named_in(c))).unionByName(key_value_sentences(of("pairs"), key))
    return every.where(tx.narrative_is_valid(F.col("sentence"), F.col("value"))).drop("value")


def narratives(tables: DataFrame, key: str) -> DataFrame:
    """(key, narrative) of every table that has one, by its kind."""
    return joined(sentences(tables, key), key)


def table_parts(tables: DataFrame, key: str, said: DataFrame, budget: int = TABLE_MAX) -> DataFrame:
    """(key, part_index, part_count, rows, narrative): a table's rows in parts that, with the context before each, stay within ``budget`` tokens.

    ``tables`` has the context's size as ``context_tokens``; ``said``: its ``sentences``. A row counts with its
    sentences where the table has a reading, else with itself. Rows fill parts in order; a row too large for any
    part stands alone, and a table whose context leaves no room is one part.
    """
    spoken = said.groupBy(key, "row_no").agg(F.sum(token_count(F.col("sentence"))).alias("n_said"), F.array_sort(F.collect_list(F.struct("column_no", "sentence"))).alias("own"))
    spoken = spoken.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("row_no", F.struct("n_said", F.array_join("own.sentence", "；").alias("said"))))).alias("_said"))
    none = F.array().cast("array<string>")
    both = tables.join(spoken, key, "left").withColumn("_rows", F.coalesce("table_rows", none))
    rows = F.transform("_rows", lambda r, i: F.struct(r.alias("row"), F.try_element_at("_said", i).alias("own")))
    rows = F.transform(rows, lambda z: F.struct(z["row"].alias("row"), F.when(F.col("_said").isNull(), token_count(z["row"])).otherwise(F.coalesce(z["own"]["n_said"], F.lit(0)).cast("int")).alias("n"), z["own"]["said"].alias("said")))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, z: Column) -> Column:
        fits = (acc["part"] > 0) & ((acc["used"] + z["n"] <= F.col("_room")) | (F.col("_room") <= 0))
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(part.alias("part"), F.when(fits, acc["used"] + z["n"]).otherwise(z["n"]).alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    placed = both.select(key, rows.alias("_rows"), (F.lit(budget) - F.col("context_tokens")).alias("_room"))
    placed = placed.withColumn("_parts", F.aggregate("_rows", start, step, lambda a: a["parts"]))
    count = F.greatest(F.coalesce(F.array_max("_parts"), F.lit(0)), F.lit(1))
    each = placed.select(key, count.alias("part_count"), F.arrays_zip("_rows", "_parts").alias("_zip"), F.explode(F.sequence(F.lit(1), count)).alias("part_index"))
    own = F.filter("_zip", lambda z: z["_parts"] == F.col("part_index"))
    said_ = F.array_join(F.filter(F.transform(own, lambda z: z["_rows"]["said"]), lambda x: F.coalesce(x != "", F.lit(False))), "；")
    out = each.select(key, "part_index", "part_count", F.transform(own, lambda z: z["_rows"]["row"]).alias("rows"), said_.alias("narrative"))
    return out.withColumn("narrative", F.when(tx.units_are_valid(F.col("narrative")), F.col("narrative")).otherwise(""))


def trimmed(context: Column, body: Column, budget: int = TABLE_MAX) -> Column:
    """Context and body, the body cut behind as many tokens as ``budget`` leaves for it, 64 at least."""
    whole = F.concat_ws("\n\n", F.nullif(context, F.lit("")), F.nullif(body, F.lit("")))
    room = F.greatest(F.lit(budget - 1) - token_count(context), F.lit(64))
    head = F.concat(F.lit(r"(?s)\A(?:[^㐀-䶿一-鿿A-Za-z0-9]*+(?:[㐀-䶿一-鿿]|[A-Za-z0-9]++)){1,"), room.cast("string"), F.lit("}"))
    short = F.concat_ws("\n\n", F.nullif(context, F.lit("")), F.regexp_substr(body, head))
    return F.when(token_count(whole) > budget, short).otherwise(whole)


def text_chunks(units: DataFrame) -> DataFrame:
    """The chunks of a document's text units, packed, cleaned and told from noise; oversized units in pieces."""
    groups = chunk_groups(pack_units(units.where(~F.col("unit_type").eqNullSafe("table")).select("doc_id", "pos", "text", "section_title", "unit_type", "is_noise", "page_number")))
    made = groups.withColumn("p", tx.prepared(F.col("text"), F.col("is_noise")))
    return made.select(
        "doc_id", F.col("first_pos.pos").alias("pos"), F.col("first_pos.part").alias("part"), "section_title", "text", F.col("p.embedding_text").alias("embedding_text"), F.col("p.content_type").alias("content_type"),
        F.col("p.is_retrievable").alias("is_retrievable"), "pdf_page_numbers", "unit_count", "unit_types", F.lit("").alias("table_raw"), F.lit("").alias("table_id"), F.lit(0).alias("table_part_index"), F.lit(0).alias("table_part_count"),
    )


def table_chunks(units: DataFrame, documents: DataFrame, budget: int = TABLE_MAX) -> DataFrame:
    """The chunks of a document's tables: their rows in parts, each with its context, its raw text and what it says."""
    c = F.col
    fields = documents.select("doc_id", "company_name", "stock_code", "broker", "report_title")
    unit = F.coalesce(*[F.nullif(tx.unit_named_in(c(x)), F.lit("")) for x in ("table_caption", "table_header", "text")], F.lit(""))
    rows = units.where(c("unit_type") == "table").join(fields, "doc_id", "left").withColumn("_unit", unit)
    context = table_context(c("company_name"), c("stock_code"), c("broker"), c("report_title"), c("section_title"), c("table_caption"), c("_unit"), c("table_header"), c("page_number"))
    rows = cut(rows.withColumn("context", context).withColumn("context_tokens", token_count(context)).withColumn("unit_key", F.struct("doc_id", "pos")))
    parts = table_parts(rows, "unit_key", cut(sentences(rows, "unit_key")), budget)
    whole = rows.drop("table_rows").join(parts, "unit_key")
    last = c("part_index") == c("part_count")
    raw = F.when(F.size("rows") == 0, tx.text_or_empty(c("text"))).otherwise(table_raw(c("table_caption"), c("table_header"), c("rows"), F.when(last, c("table_footnote"))))
    plain = table_raw(c("table_caption"), c("table_header"), F.when(F.size("rows") > 0, c("rows")).otherwise(F.filter(F.array("table_header"), lambda x: tx.text_or_empty(x) != "")))
    body = F.coalesce(F.nullif(c("narrative"), F.lit("")), plain)
    noise = F.coalesce("is_noise", F.lit(False))
    kind = F.when(noise, "noise").when(tx.is_comparable_table(c("table_caption"), c("table_header")), "comparable_table").otherwise("table")
    return whole.select(
        "doc_id", "pos", c("part_index").alias("part"), "section_title", raw.alias("text"), trimmed(c("context"), body, budget).alias("embedding_text"), kind.alias("content_type"), (~noise).alias("is_retrievable"),
        F.when(c("page_number").isNull(), F.array().cast("array<int>")).otherwise(F.array("page_number")).alias("pdf_page_numbers"), F.lit(1).cast("long").alias("unit_count"), F.array("unit_type").alias("unit_types"), raw.alias("table_raw"),
        tx.text_or_empty(c("table_id")).alias("table_id"), c("part_index").alias("table_part_index"), c("part_count").alias("table_part_count"),
    )


def merged_appendices(chunks: DataFrame) -> DataFrame:
    """``chunks`` with consecutive retrievable ones of appendix sections as one: texts joined, pages united, the rest of the first."""
    member = F.coalesce(F.col("section_title").rlike(APPENDIX) & F.col("is_retrievable"), F.lit(False))
    numbered_ = islands(chunks.withColumn("_at", F.struct("pos", "part")), "doc_id", "_at", member)
    other = [x for x in chunks.columns if x not in ("doc_id", "pos", "part", "text", "embedding_text", "pdf_page_numbers", "unit_count")]
    texts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("embedding_text", F.lit("")).alias("embedding_text")))).alias("_texts")
    groups = numbered_.groupBy("doc_id", "island").agg(
        F.min("_at").alias("_at"), texts, F.array_sort(F.array_distinct(F.flatten(F.collect_list("pdf_page_numbers")))).alias("pdf_page_numbers"), F.sum("unit_count").alias("unit_count"),
        *[F.min_by(x, "_at").alias(x) for x in other],
    )
    joined_ = lambda x: F.array_join(F.filter(F.col(f"_texts.{x}"), lambda t: t != ""), "\n").alias(x)
    return groups.select("doc_id", F.col("_at.pos").alias("pos"), F.col("_at.part").alias("part"), joined_("text"), joined_("embedding_text"), "pdf_page_numbers", "unit_count", *other)


def document_chunks(units: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunk records of ``documents`` from their ``units`` (doc_id, pos, text, section_title, unit_type, page_number, table_...).

    Noise is told from the text anew. Text is packed, tables are read and split, appendices merged, chunks
    numbered in order; each document with a rating has a headline of its own before them. Texts of less than two
    characters are left out. Documents without units give their headline alone.
    """
    c = F.col
    legend = c("unit_type").eqNullSafe("table") & tx.is_rating_standard_table(c("text"), c("section_title"), c("table_caption"), c("table_header"))
    clean = units.withColumn("text", tx.normalize_text(c("text"))).where(F.length("text") >= 2).withColumn("is_noise", tx.is_noise_text(c("text"), c("section_title")) | legend)
    clean = cut(clean)
    body = merged_appendices(text_chunks(clean).unionByName(table_chunks(clean, documents)))
    w = Window.partitionBy("doc_id").orderBy("pos", "part")
    body = body.withColumn("chunk_id", numbered(c("doc_id"), F.row_number().over(w))).drop("pos", "part")
    head = rating_headlines(documents).withColumns({
        "embedding_text": tx.repair_units(tx.drop_analyst_lines(c("text"))), "is_retrievable": F.lit(True), "pdf_page_numbers": F.array(F.lit(1)), "unit_count": F.lit(1).cast("long"), "unit_types": F.array(F.lit("rating_headline")),
        "table_raw": F.lit(""), "table_id": F.lit(""), "table_part_index": F.lit(0), "table_part_count": F.lit(0),
    })
    return chunk_records(body.unionByName(head), documents)


def rating_headlines(documents: DataFrame) -> DataFrame:
    """A chunk for each document with a rating: what it is rated, by whom."""
    company = F.coalesce(F.nullif("company_name", F.lit("")), F.nullif("report_title", F.lit("")), F.lit("该公司"))
    code = tx.text_or_empty(F.col("stock_code"))
    text = F.concat(company, F.when(code != "", F.concat(F.lit("（"), code, F.lit("）"))).otherwise(""), F.lit(" 研报投资评级："), F.col("rating"), F.lit("。"),
                    F.when(tx.text_or_empty(F.col("broker")) != "", F.concat(F.lit(" 券商："), F.col("broker"), F.lit("。"))).otherwise(""))
    rated = documents.where(tx.text_or_empty(F.col("rating")) != "")
    return rated.select("doc_id", F.concat("doc_id", F.lit("_rating_headline")).alias("chunk_id"), F.lit("投资评级摘要").alias("section_title"), text.alias("text"), F.lit("rating_headline").alias("content_type"))


def chunk_records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's fields, pages and sizes: the record of a retrieval store."""
    c = F.col
    name = tx.display_name(*map(c, ("company_name", "stock_code", "report_title", "broker", "report_date", "rating", "industry_label", "filename")))
    own = ("filename", "industry", "industry_label", "source_pdf_path", "company_name", "stock_code", "broker", "report_title", "report_date", "rating")
    fields = documents.select("doc_id", *[tx.text_or_empty(c(x)).alias(x) for x in own]).withColumn("display_name", name)
    return chunks.join(fields, "doc_id", "left").withColumns({
        "chunk_method": F.lit("structure"), "page_start": F.array_min("pdf_page_numbers"), "page_end": F.array_max("pdf_page_numbers"), "contains_table": c("content_type") == "table",
        "char_count": F.length("text"), "token_count": token_count(c("text")), "embedding_char_count": F.length("embedding_text"), "embedding_token_count": token_count(c("embedding_text")),
    })


def prompt(query: Column, query_type: Column, blocks: Column, names: Column) -> Column:
    """The text a writer of answers is given: question, type, names, demand and the numbered passages."""
    kind = F.coalesce(query_type, F.lit("factual"))
    hint = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPE_HINTS.items()], F.lit(TYPE_HINTS["factual"]))
    about = F.when(F.size(names) > 0, F.concat(F.lit("涉及主体："), F.array_join(names, "、")))
    return F.concat_ws("\n", F.concat(F.lit("问题："), tx.text_or_empty(query)), F.concat(F.lit("题型："), kind), about, F.concat(F.lit("作答要求："), hint), F.concat(F.lit("\n资料：\n"), F.array_join(blocks, "\n\n")))


def context_block(index: Column, company: Column, section: Column, page: Column, passage: Column, limit: int = 1200) -> Column:
    named = lambda c, other: F.coalesce(F.nullif(tx.stripped(tx.text_or_empty(c)), F.lit("")), F.lit(other))
    head = F.concat(F.lit("["), index.cast("string"), F.lit("] 公司："), named(company, "未知公司"), F.lit(" | 章节："), named(section, "未知章节"), F.lit(" | 页码："), tx.text_or_empty(page))
    return F.concat(head, F.lit("\n"), F.substring(tx.text_or_empty(passage), 1, limit))


def answer_body(text: Column) -> Column:
    """A written answer without a list of references of its own, and without runs of empty lines."""
    cut = F.regexp_replace(tx.text_or_empty(text), r"(?s)(【参考文献】|参考文献[：:]).*\z", "")
    return tx.stripped(F.regexp_replace(cut, r"\n{3,}", "\n\n"))
