"""SQL for DuckDB that gives the same rows as some of the queries, written on its own."""

from __future__ import annotations

from millrace.llm.canonical import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

_ODD = GREEK_LOOKALIKES[0] + CYRILLIC_LOOKALIKES[0]
_SEEN = (
    r"[^\n\r \x{0021}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{1FFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2070}-\x{2DFF}\x{2E00}-\x{2E7F}\x{3001}-\x{3163}\x{3165}-\x{F8FF}"
    r"！（），：；？\x{FE10}-\x{FEFE}\x{FFE0}-\x{FFFD}\x{10000}-\x{1D3FF}\x{1D800}-\x{2F7FF}\x{30000}-\x{3FFFF}]"
)
_ONE = f"""(regexp_matches(v, '{_SEEN}') OR nfc_normalize(v) <> v
    OR len(list_filter(regexp_extract_all(v, '[\\p{{Latin}}\\p{{Greek}}\\p{{Cyrillic}}\\p{{M}}]+'), lambda w: regexp_matches(w, '[{_ODD}]') AND (regexp_matches(w, '\\p{{Latin}}') OR regexp_full_match(w, '[{_ODD}\\p{{M}}]+')))) > 0)"""
_BARE = r"regexp_replace(line, '[\p{Z}\p{Cc}\p{Cf}\s\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{180B}-\x{180F}]+', '', 'g')"
_REPEATED = f"""sources AS (SELECT DISTINCT doc_id, broker FROM doc_manifest WHERE broker IS NOT NULL),
    sizes AS (SELECT broker, count(DISTINCT doc_id) AS n FROM sources GROUP BY broker),
    units AS (SELECT DISTINCT unit_id, doc_id, text FROM content_units),
    split AS (SELECT unit_id, doc_id, string_split(text, chr(10)) AS parts FROM units WHERE text IS NOT NULL),
    numbered AS (SELECT unit_id, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM split),
    lines AS (SELECT broker, doc_id, unit_id, CAST(line_no AS INTEGER) AS line_no, {_BARE} AS bare FROM numbered JOIN sources USING (doc_id)),
    frequent AS (SELECT broker, bare FROM lines JOIN sizes USING (broker) WHERE bare <> '' GROUP BY broker, bare HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= 0.2 * min(n))"""
_ENDS = "。！？；!?"

SQL = {
    "p2_found": r"""WITH c AS (SELECT DISTINCT chunk_id, regexp_replace(text, '\s+', '', 'g') AS t FROM retrieved_chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        g AS (SELECT DISTINCT chunk_id, s FROM (SELECT chunk_id, unnest(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS s FROM c)),
        n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
        p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
        SELECT chunk_id_a, chunk_id_b FROM p JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE k / (x.n + y.n - k) >= 0.6""",
    "p3_found": f"""SELECT DISTINCT 'unit_text' AS field, unit_id AS row_id FROM (SELECT unit_id, text AS v FROM content_units) WHERE {_ONE}
        UNION ALL SELECT DISTINCT 'section_title', hit_id FROM (SELECT hit_id, section_title AS v FROM retrieved_chunks) WHERE {_ONE}""",
    "p4_found": f"WITH {_REPEATED} SELECT unit_id, line_no FROM lines JOIN frequent USING (broker, bare)",
    "p4_units": f"""WITH {_REPEATED}, cut AS (SELECT unit_id, line_no FROM lines JOIN frequent USING (broker, bare)),
        kept AS (SELECT unit_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM numbered ANTI JOIN cut USING (unit_id, line_no) GROUP BY unit_id)
        SELECT unit_id, CASE WHEN units.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM units LEFT JOIN kept USING (unit_id)""",
    "p5_found": f"""WITH u AS (SELECT DISTINCT unit_id, unit_type, text FROM content_units),
        over AS (SELECT unit_id, text, max_chars FROM u JOIN size_limits USING (unit_type) WHERE length(text) > max_chars),
        s AS (SELECT unit_id, max_chars, unnest(regexp_extract_all(text, '[^{_ENDS}\\n]*[{_ENDS}]?')) AS stretch FROM over),
        parts AS (SELECT unit_id, count(*) AS n, count(DISTINCT part_count) AS counts, max(part_count) AS top, count(DISTINCT part_index) AS places, min(part_index) AS low, max(part_index) AS high, max(length(table_raw)) AS longest FROM table_chunk_parts GROUP BY unit_id)
        SELECT unit_id, CASE WHEN max(length(stretch)) > min(max_chars) THEN 'hard' ELSE 'natural' END AS kind FROM s GROUP BY unit_id
        UNION ALL SELECT unit_id, 'bad_parts' FROM parts WHERE unit_id IN (SELECT unit_id FROM u WHERE unit_type = 'table')
            AND NOT (counts = 1 AND n = top AND places = top AND low = 1 AND high = top AND longest <= (SELECT max_chars FROM size_limits WHERE unit_type = 'table'))""",
}
