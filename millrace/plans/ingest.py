"""Queries of cleaning, chunking, tables, incremental loads and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audit, chunking
from millrace.plans.common import HITS, MANIFEST, UNITS, hits, manifest, units
from millrace.plans.search import _has
from millrace.sources import io
from millrace.sources.tables import latest, table


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    form = tx.normalize_text(F.col("text"))
    return units(spark, folder).select("unit_id", F.length(form).alias("n_chars"), F.md5(form).alias("digest"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with markup as text between bars."""
    rows = table(spark, folder, "documents").where(F.contains("text", F.lit("<t")))
    return rows.select("doc_id", F.md5(tx.html_table_to_text(F.col("text"))).alias("digest"))


def line_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Units by what the filter of analyst lines leaves, and whether they are noise."""
    rows = units(spark, folder).select("unit_type", F.size(tx.lines_of(F.col("text"))).alias("before"), F.size(tx.lines_of(tx.drop_analyst_lines(F.col("text")))).alias("after"), tx.is_noise_text(F.col("text"), F.col("section_title")).alias("noise"))
    return rows.groupBy("unit_type").agg(F.sum("before").alias("n_before"), F.sum("after").alias("n_after"), F.count_if("noise").alias("n_noise"))


def noise_sections(spark: SparkSession, folder: str) -> DataFrame:
    return units(spark, folder).groupBy(tx.is_noise_section(F.col("section_title")).alias("noise_section"), F.coalesce("is_noise", F.lit(False)).alias("is_noise")).agg(F.count("*").alias("n"))


def prepared_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = units(spark, folder).select("unit_id", tx.prepared(F.col("text"), F.coalesce("is_noise", F.lit(False))).alias("p"))
    return rows.select("unit_id", "p.content_type", "p.is_retrievable", F.length("p.embedding_text").alias("n_chars"))


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    name = tx.display_name(*[F.col(c) for c in ("company_name", "stock_code", "report_title", "broker", "report_date", "rating", "industry_label", "filename")])
    return manifest(spark, folder).select("doc_id", name.alias("name"))


def report_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Report dates in one spelling, empty where none can be read."""
    date = F.col("report_date")
    parts = [F.regexp_extract(F.coalesce(date, F.lit("")), r"^\s*(\d{4})\s*[-/.年]?\s*(\d{1,2})\s*[-/.月]?\s*(\d{1,2})", i) for i in (1, 2, 3)]
    iso = F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).otherwise("")
    return manifest(spark, folder).select("doc_id", iso.alias("report_day"))


def dates_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """The dates that units and the manifest's spellings name, with how often."""
    spelled = manifest(spark, folder).select(F.concat(F.lit("发布时间："), F.col("report_date")).alias("text")).unionByName(manifest(spark, folder).select(F.col("report_date").alias("text")))
    rows = units(spark, folder).select("text").unionByName(spelled)
    return rows.groupBy(tx.report_date_named_in(F.col("text")).alias("day")).agg(F.count("*").alias("n"))


def names_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Brokers and ratings that the headings of reports and the texts of units name, with how often."""
    heads = manifest(spark, folder).select(F.concat_ws(" ", "broker", "report_title", F.concat(F.lit("投资评级："), "rating")).alias("text"))
    both = units(spark, folder).select("text").unionByName(heads)
    rows = both.select(tx.broker_named_in(F.col("text")).alias("broker"), tx.rating_named_in(F.col("text")).alias("rating"))
    return rows.groupBy("broker", "rating").agg(F.count("*").alias("n"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = units(spark, folder).where("unit_type = 'paragraph'").select("unit_id", tx.sentences_of(F.col("text")).alias("s"))
    return rows.select("unit_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


def section_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Units under the title that stands last before them in their document."""
    items = units(spark, folder).select("doc_id", F.coalesce("page_number", F.lit(0)).alias("page"), "pos", F.col("unit_type").alias("type"), F.col("text").alias("content"))
    return chunking.units_of(items).select(F.col("pos").alias("unit_id"), "section_title", "table_id")


def doc_context_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first section, caption and page of each document."""
    rows = units(spark, folder).select("doc_id", "pos", "section_title", "table_caption", "page_number")
    return chunking.first_by_position(rows, "doc_id", ["pos"], ["section_title", "table_caption", "page_number"])


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    packed = chunking.pack_units(units(spark, folder).select("doc_id", "pos", "text", "section_title", "unit_type", "is_noise", "page_number"))
    return chunking.chunk_groups(packed).select("doc_id", "group_no", "chunk_id", "unit_count", "token_count", "page_start", "page_end")


def split_oversized(spark: SparkSession, folder: str) -> DataFrame:
    parts = chunking.split_units(units(spark, folder).where("unit_type <> 'table'").select("unit_id", "text", "is_noise"), budget=240, minimum=20)
    return parts.select("unit_id", "part", chunking.token_count(F.col("text")).alias("n_tokens"))


def appendix_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive tables of a document joined; every other unit alone."""
    rows = chunking.islands(units(spark, folder), "doc_id", "pos", F.col("unit_type") == "table")
    merged = chunking.merge_islands(rows, "doc_id", "pos", "text")
    return merged.select("doc_id", "island", "n_rows", F.col("first").alias("first_unit"), F.md5("text").alias("digest"))


def renumber(spark: SparkSession, folder: str) -> DataFrame:
    rows = units(spark, folder).select("doc_id", "unit_id", F.col("unit_id").cast("string").alias("chunk_id"))
    return chunking.renumber(rows, F.col("unit_id")).select("unit_id", "chunk_id")


def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    n = chunking.token_count(F.col("text"))
    return units(spark, folder).groupBy("unit_type").agg(F.count("*").alias("n"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"), F.count_if(n > chunking.HARD_MAX).alias("n_over"))


def chunk_validation(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.validation(units(spark, folder), "text")


def table_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all tables by indicator and column."""
    return chunking.table_cells(units(spark, folder).where("unit_type = 'table' AND table_header IS NOT NULL"), "unit_id")


def table_narratives(spark: SparkSession, folder: str) -> DataFrame:
    rows = units(spark, folder).where("unit_type = 'table' AND table_header IS NOT NULL")
    said = chunking.table_narrative(rows, "unit_id", tx.unit_named_in(F.col("table_caption")))
    return said.select("unit_id", "n_sentences", F.md5("narrative").alias("digest"))


def year_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = units(spark, folder).where("unit_type = 'table' AND table_header IS NOT NULL")
    return rows.select("unit_id", F.array_join(tx.year_columns(F.col("table_header")), ",").alias("years"), tx.is_comparable_table(F.col("table_caption"), F.col("table_header")).alias("comparable"))


def upsert_by_doc(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each document, replaced by later deliveries where there are any."""
    rows = table(spark, folder, "doc_manifest").select("doc_id", "updated_at", "chunk_count")
    first = rows.groupBy("doc_id").agg(F.min("updated_at").alias("updated_at"), F.min("chunk_count").alias("chunk_count"))
    later = latest(rows.join(first.select("doc_id", F.col("updated_at").alias("f")), "doc_id").where("updated_at > f").drop("f"), "doc_id", "updated_at")
    return io.upsert(first, later, "doc_id")


def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the manifest of which no chunk ever was the first after reranking."""
    return io.pending(manifest(spark, folder), hits(spark, folder).where("stage = 'rerank' AND rank = 1"), "doc_id").select("doc_id", "chunk_count")


def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.document_counts(manifest(spark, folder).select("doc_id", "chunk_count"), units(spark, folder))


def audit_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit.latest_state(table(spark, folder, "rag_requests"), "id", ["created_at", "finished_at", "status", "duration_ms"])
    return rows.select("id", "request_type", "status", "duration_ms")


def audit_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return audit.lifecycle(audit.latest_state(table(spark, folder, "rag_requests"), "id", ["created_at", "finished_at", "status", "duration_ms"]))


def audit_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit.hit_rows(hits(spark, folder).withColumnRenamed("query_id", "request_id"), 120)
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.length("text_preview")).alias("n_chars"), F.count_if(F.endswith("text_preview", F.lit("..."))).alias("n_cut"))


QUERIES = [
    normalize_text, html_to_text, line_filter, noise_sections, prepared_units, display_names, report_dates, dates_in_text, names_in_text, sentences, section_carry, doc_context_first, chunk_pack, split_oversized,
    appendix_islands, renumber, token_budget, chunk_validation, table_unpivot, table_narratives, year_columns, upsert_by_doc, pending_documents, document_counts,
    audit_latest_status, audit_lifecycle, audit_hits,
]

_TOKENS = "len(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿]|[A-Za-z0-9]+'))"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, finished_at DESC NULLS LAST, status DESC NULLS LAST, duration_ms DESC NULLS LAST) AS n FROM rag_requests) WHERE n = 1)"

_BLANK = r"[\s\p{Z}]"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _replace(text: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def _unescape(text: str) -> str:
    for a, b in tx.ENTITIES:
        text = f"replace({text}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return text


def _markers(text: str) -> str:
    steps = [
        (r"\[Table_StockAndRan([^\]\(]+)\(\s*(\d{6})", r"\1(\2"), (r"\[Table_Title\]", ""), (r"\[Table_Author\]\s*", ""), (r"\[T[^\]]*?ummary\]\s*", ""), (r"\[Table_[^\]]+\]", ""), (r"^\[Table_\S+", ""),
        (r"\[财[^\]]*比率[^\]]*\]", "财务报表和主要财务比率"), (r"^[lL]\s+", ""),
    ]
    return _strip(_replace(text, *steps))


def _normal(text: str) -> str:
    return _markers(_strip(_replace(_unescape(f"coalesce({text}, '')"), ("[　\u00a0]", " "), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))))


def _cells(row: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({row}, ''), '|'), lambda x: {_strip('x')}), lambda x: x <> '')"


_LEGAL = _has("t", tx.LEGAL_TEXTS)
_BROKER = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for p, n in tx.BROKERS) + " ELSE '' END"
_SALE = "regexp_matches(coalesce(text, ''), '股东减持|减持计划|减持比例|减持完毕|减持股份')"
_RATED = "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(coalesce(text, ''), '{p}', 1) <> '' AND NOT ({_SALE} AND regexp_extract(coalesce(text, ''), '{p}', 1) = '减持') THEN regexp_extract(coalesce(text, ''), '{p}', 1) || CASE WHEN regexp_extract(coalesce(text, ''), '{p}', 2) <> '' THEN '/' || regexp_extract(coalesce(text, ''), '{p}', 2) ELSE '' END END" for p in tx.RATINGS) + ", '')"

def _line_list(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


_KEPT = _normal(f"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '{tx.ANALYST_LINE}')), chr(10))")
_CONCLUSION = f"regexp_matches(coalesce(text, ''), '{tx.RATING_CONCLUSION}')"
_TITLE = "coalesce(section_title, '')"
_NOISE = f"""CASE WHEN (contains({_TITLE}, '风险提示') OR {_strip(_TITLE)} IN ('核心风险提示', 'l 风险提示')) AND contains(coalesce(text, ''), '风险') THEN false WHEN {_has(_TITLE, tx.NOISE_SECTIONS)} THEN true WHEN {_strip(_TITLE)} IN ('研究所', '电子组', '分析师介绍') THEN true
    WHEN {_strip(_TITLE)} IN ('投资评级', '上次评级') THEN NOT {_CONCLUSION} AND NOT contains(coalesce(text, ''), '评级') WHEN contains(coalesce(text, ''), '风险提示') AND NOT contains(coalesce(text, ''), '投资评级') THEN false ELSE ({" OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in tx.NOISE_TEXTS)}) AND NOT {_CONCLUSION} END"""

SQL = {
    "line_filter": f"WITH {UNITS}, k AS (SELECT unit_type, len({_line_list("coalesce(text, '')")}) AS a, len({_line_list(_KEPT)}) AS b, {_NOISE} AS noise FROM units) SELECT unit_type, CAST(sum(a) AS BIGINT) AS n_before, CAST(sum(b) AS BIGINT) AS n_after, count(*) FILTER (noise) AS n_noise FROM k GROUP BY unit_type",
    "normalize_text": f"WITH {UNITS}, n AS (SELECT unit_id, {_normal('text')} AS t FROM units) SELECT unit_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM n",
    "html_to_text": f"""SELECT doc_id, md5({_normal(_replace(_unescape("coalesce(text, '')"), (r"(?i)</tr>", chr(10)), (r"(?i)</t[dh]>", " | "), (r"<[^>]+>", "")))}) AS digest FROM documents WHERE contains(text, '<t')""",
    "sentences": f"""WITH {UNITS}, s AS (SELECT unit_id, coalesce(text, '') AS text, list_filter(list_transform(string_split({_replace("coalesce(text, '')", (r"([。！？；!?])\s*", chr(92) + "1" + chr(1)))}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM units WHERE unit_type = 'paragraph'),
        t AS (SELECT unit_id, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM s) SELECT unit_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest FROM t""",
    "section_carry": f"""WITH {UNITS}, o AS (SELECT doc_id, unit_id, unit_type, coalesce(last_value(CASE WHEN unit_type = 'title' THEN {_normal('text')} END IGNORE NULLS) OVER w, '') AS section_title, sum(CASE WHEN unit_type = 'table' THEN 1 ELSE 0 END) OVER w AS n FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY coalesce(page_number, 0), unit_id ROWS UNBOUNDED PRECEDING))
        SELECT unit_id, section_title, CASE WHEN unit_type = 'table' THEN doc_id || '_t' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') ELSE '' END AS table_id FROM o WHERE unit_type NOT IN ('page_header', 'page_footer', 'page_number', 'page_aside_text', 'page_footnote')""",
    "year_columns": f"""WITH {UNITS} SELECT unit_id, array_to_string(list_filter({_cells('table_header')}, lambda c: regexp_matches(replace(c, ' ', ''), '^\\d{{4}}[AEFH]?$')), ',') AS years, regexp_matches(coalesce(table_caption, '') || ' ' || coalesce(table_header, ''), '可比公司|PE估值') AS comparable FROM units WHERE unit_type = 'table' AND table_header IS NOT NULL""",
    "dates_in_text": f"""WITH {UNITS}, {MANIFEST}, a AS (SELECT coalesce(text, '') AS t FROM units UNION ALL SELECT coalesce('发布时间：' || report_date, '') FROM manifest UNION ALL SELECT coalesce(report_date, '') FROM manifest),
        d AS (SELECT t, regexp_extract(t, '发布时间[：:]\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS stamped, regexp_extract(t, '(\\d{{4}})\\s*年\\s*(\\d{{1,2}})\\s*月\\s*(\\d{{1,2}})\\s*日', ['y', 'm', 'd']) AS p FROM a)
        SELECT CASE WHEN {_LEGAL} THEN '' WHEN stamped <> '' THEN stamped WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') ELSE '' END AS day, count(*) AS n FROM d GROUP BY 1""",
    "names_in_text": f"WITH {UNITS}, {MANIFEST}, a AS (SELECT text FROM units UNION ALL SELECT concat_ws(' ', broker, report_title, '投资评级：' || rating) FROM manifest) SELECT {_BROKER} AS broker, {_RATED} AS rating, count(*) AS n FROM a GROUP BY 1, 2",
    "noise_sections": f"WITH {UNITS} SELECT {_has('coalesce(section_title, chr(32))', tx.NOISE_SECTIONS)} AS noise_section, coalesce(is_noise, false) AS is_noise, count(*) AS n FROM units GROUP BY 1, 2",
    "display_names": f"""WITH {MANIFEST}, p AS (SELECT *, CASE WHEN coalesce(company_name, '') <> '' THEN company_name || CASE WHEN coalesce(stock_code, '') <> '' THEN '（' || stock_code || '）' ELSE '' END END AS headline FROM manifest),
        h AS (SELECT *, concat_ws(' — ', headline, CASE WHEN coalesce(report_title, '') <> '' AND (coalesce(company_name, '') = '' OR (report_title <> company_name AND report_title <> headline)) THEN report_title END) AS head,
            concat_ws(', ', nullif(industry_label, ''), nullif(broker, ''), nullif(report_date, ''), nullif(rating, '')) AS meta FROM p)
        SELECT doc_id, CASE WHEN head <> '' THEN head WHEN coalesce(filename, '') <> '' THEN filename ELSE '未知文档' END || CASE WHEN meta <> '' THEN ' [' || meta || ']' ELSE '' END AS name FROM h""",
    "report_dates": f"""WITH {MANIFEST}, d AS (SELECT doc_id, regexp_extract(coalesce(report_date, ''), '^\\s*(\\d{{4}})\\s*[-/.年]?\\s*(\\d{{1,2}})\\s*[-/.月]?\\s*(\\d{{1,2}})', ['y', 'm', 'd']) AS p FROM manifest)
        SELECT doc_id, CASE WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') ELSE '' END AS report_day FROM d""",
    "doc_context_first": f"""WITH {UNITS} SELECT doc_id, arg_min(section_title, unit_id) FILTER (section_title <> '') AS section_title, arg_min(table_caption, unit_id) FILTER (table_caption <> '') AS table_caption,
        arg_min(page_number, unit_id) FILTER (page_number IS NOT NULL) AS page_number FROM units GROUP BY doc_id""",
    "appendix_islands": f"""WITH {UNITS}, f AS (SELECT doc_id, unit_id, coalesce(text, '') AS t, CASE WHEN unit_type = 'table' AND coalesce(lag(unit_type = 'table') OVER w, false) THEN 0 ELSE 1 END AS s FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id)),
        g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY unit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
        SELECT doc_id, island, CAST(count(*) AS INTEGER) AS n_rows, min(unit_id) AS first_unit, md5(string_agg(t, chr(10) ORDER BY unit_id)) AS digest FROM g GROUP BY doc_id, island""",
    "renumber": f"WITH {UNITS} SELECT unit_id, doc_id || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM (SELECT unit_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) AS n FROM units)",
    "token_budget": f"WITH {UNITS} SELECT unit_type, count(*) AS n, CAST(sum({_TOKENS}) AS BIGINT) AS n_tokens, CAST(max({_TOKENS}) AS INTEGER) AS longest, count(*) FILTER ({_TOKENS} > 512) AS n_over FROM units GROUP BY unit_type",
    "table_unpivot": f"""WITH {UNITS}, t AS (SELECT unit_id, list_filter(list_transform(string_split(table_header, '|'), lambda x: trim(x)), lambda x: x <> '') AS h, table_rows FROM units WHERE unit_type = 'table' AND table_header IS NOT NULL),
        c AS (SELECT unit_id, CASE WHEN len(h) <= 1 THEN [] WHEN regexp_matches(replace(h[1], ' ', ''), '^\\d{{4}}[AEFH]?$') THEN h ELSE h[2:] END AS cols, table_rows FROM t),
        r AS (SELECT unit_id, cols, unnest(range(1, len(table_rows) + 1)) AS i, table_rows FROM c),
        k AS (SELECT unit_id, cols, i, list_filter(list_transform(string_split(table_rows[i], '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM r),
        v AS (SELECT unit_id, cols, i, cells, unnest(range(1, len(cells))) AS j FROM k WHERE len(cells) > 1)
        SELECT unit_id, CAST(i - 1 AS INTEGER) AS row_no, cells[1] AS indicator, CAST(j - 1 AS INTEGER) AS column_no, cols[j] AS column, cells[j + 1] AS value FROM v
        WHERE j <= len(cols) AND NOT regexp_matches(replace(cells[1], ' ', ''), '^\\d{{4}}[AEFH]?$')""",
    "upsert_by_doc": """WITH f AS (SELECT doc_id, min(updated_at) AS updated_at, min(chunk_count) AS chunk_count FROM doc_manifest GROUP BY doc_id),
        l AS (SELECT DISTINCT ON (m.doc_id) m.doc_id, m.updated_at, m.chunk_count FROM doc_manifest m JOIN f ON f.doc_id = m.doc_id AND m.updated_at > f.updated_at ORDER BY m.doc_id, m.updated_at DESC)
        SELECT doc_id, updated_at, chunk_count, false AS replaced FROM f ANTI JOIN l USING (doc_id) UNION ALL SELECT doc_id, updated_at, chunk_count, true FROM l""",
    "pending_documents": f"WITH {MANIFEST} SELECT doc_id, chunk_count FROM manifest WHERE doc_id NOT IN (SELECT doc_id FROM retrieved_chunks WHERE doc_id IS NOT NULL AND stage = 'rerank' AND rank = 1)",
    "document_counts": f"WITH {MANIFEST}, {UNITS} SELECT doc_id, chunk_count, coalesce(n, 0) AS n_chunks FROM manifest LEFT JOIN (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) USING (doc_id)",
    "audit_latest_status": f"WITH {_LATEST} SELECT id, request_type, status, duration_ms FROM latest",
    "audit_lifecycle": f"""WITH {_LATEST}, t AS (SELECT *, CAST(trunc((epoch_us(finished_at) - epoch_us(created_at)) / 1000) AS BIGINT) AS ms FROM latest)
        SELECT request_type, status, count(*) AS n, count(*) FILTER (finished_at IS NULL) AS n_unfinished, round(avg(ms), 3) AS avg_ms, max(ms) AS max_ms FROM t GROUP BY request_type, status""",
    "audit_hits": f"""WITH {HITS}, p AS (SELECT stage, CASE WHEN length(text) > 120 THEN substring(text, 1, 117) || '...' ELSE text END AS t FROM hits)
        SELECT stage, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars, count(*) FILTER (ends_with(t, '...')) AS n_cut FROM p GROUP BY stage""",
}
