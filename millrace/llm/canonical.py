"""One written form for text that looks the same (problem 3).

Each Arrow batch of a partition is a table of an embedded DuckDB, where one SQL statement brings
every value to its form. Spark partitions the rows; nothing is shuffled but the reported cases.

The form: NFC; Latin letters, digits and ASCII signs narrow; U+0020 and line breaks as only blanks;
no invisible characters; radicals and compatibility ideographs as unified ideographs; Latin words
wholly in Latin letters. Chinese punctuation, circled numbers, Roman numerals, unit signs, Greek
symbols and real Cyrillic words stay.

Nulls stay null and are no case; empty text is in its form; a value is handled whole, whatever its
length; repeated rows give equal forms.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = "1GB"  # of each worker's embedded database

# Full-width signs that belong to Chinese punctuation and stay wide.
WIDE_PUNCTUATION = "！（），：；？"
# Letters that cannot be told from Latin ones, and those Latin letters.
GREEK_LOOKALIKES = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")
CYRILLIC_LOOKALIKES = ("АВЕЅІЈКМНОРСТУХӀаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXIaeopcyxsijhdqw")
# Radicals without a Unicode decomposition, and the ideographs they look like.
RADICALS = (
    "⺁⺄⺆⺈⺊⺋⺌⺍⺎⺐⺒⺓⺔⺖⺗⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺥⺦⺧⺨⺩⺪⺫⺬⺭⺯⺰⺱⺲⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乙冂刀卜㔾小小兀尣巳幺彑忄㣺扌攵旡月歺母民氵氺灬爫丬牛犭王疋罒示礻糹纟罓罒羊羊羋耂肀聿肉臼艹艹艹虎衤覀西见角𧢲讠贝足车辶辶辶邑钅長镸长门阝雨青韦页风飞食飠飠饣𩠐马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)

_BLANKS = "\t\v\f" + "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs") + "\u2800"
_LINES = "\x85\u2028\u2029"
_LETTER = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{M}"


def _foldings() -> tuple[str, str]:
    """Characters with a one-character compatibility form in the ranges that are folded, and those forms."""
    folded = [range(0x2F00, 0x2FD6), range(0xF900, 0xFB00), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x2F800, 0x2FA20)]
    pairs = {}
    for codes in folded:
        for c in map(chr, codes):
            form = unicodedata.normalize("NFKC", c)
            if form != c and len(form) == 1 and c not in WIDE_PUNCTUATION:
                pairs[c] = form
    pairs |= dict(zip(*RADICALS, strict=True)) | dict.fromkeys(_BLANKS, " ") | dict.fromkeys(_LINES, "\n") | {"µ": "μ"}
    return "".join(pairs), "".join(pairs.values())


def _invisible_class() -> str:
    """A character class of what shows nothing: controls, format characters, variation selectors, fillers."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cc", "Cf")]
    codes += [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0100, 0xE01F0)]
    keep = set(map(ord, "\n\r" + _BLANKS + _LINES))
    codes = sorted(set(codes) - keep)
    spans: list[list[int]] = []
    for c in codes:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def canonical_sql(value: str, source: str) -> str:
    """SQL for DuckDB: all columns of ``source`` and the form of its column ``value`` as ``form``."""
    folded, forms = map(_quoted, _foldings())
    odd = "".join(GREEK_LOOKALIKES[0] + CYRILLIC_LOOKALIKES[0])
    odd_, latin = _quoted(odd), _quoted(GREEK_LOOKALIKES[1] + CYRILLIC_LOOKALIKES[1])
    plain = r"[^\n\r -~\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}，。：；！？、（）“”‘’《》【】…—·•]"
    return f"""
        WITH narrow AS (
            SELECT *, CASE WHEN regexp_matches({value}, '{plain}')
                THEN nfc_normalize(translate(regexp_replace({value}, '{_invisible_class()}', '', 'g'), {folded}, {forms}))
                ELSE {value} END AS _narrow
            FROM {source}
        )
        SELECT * EXCLUDE (_narrow), CASE WHEN regexp_matches(_narrow, '[{odd}]')
            THEN nfc_normalize(array_to_string(list_transform(
                regexp_extract_all(_narrow, '[{_LETTER}]+|[^{_LETTER}]+'),
                lambda w: CASE WHEN regexp_matches(w, '\\p{{Latin}}') OR regexp_full_match(w, '[{odd}\\p{{M}}]+')
                    THEN translate(w, {odd_}, {latin}) ELSE w END), ''))
            ELSE _narrow END AS form
        FROM narrow"""


def canonicalize(df: DataFrame, value: str, form: str = "form", memory: str = MEMORY) -> DataFrame:
    """``df`` with a column ``form``: the one form of the string column ``value``.

    The batch is handed to DuckDB under positional names, so columns of any name may stand beside
    ``value``; a column already named ``form`` is replaced.
    """
    kept = df.drop(form) if form != value else df
    names = kept.columns
    inner = kept.toDF(*[f"c{i}" for i in range(len(names))])
    spot = f"c{names.index(value)}"
    schema = T.StructType([*inner.schema.fields, T.StructField("form", T.StringType())])
    sql = canonical_sql(spot, "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute(f"SET memory_limit = '{memory}'")
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                # DuckDB's types may be narrower or wider than Spark's: only the form is taken over
                made = pa.Table.from_batches([b]).append_column("form", out.column("form").cast(pa.string()))
                yield from made.combine_chunks().to_batches()

    # the rows keep their order within a batch, so the form may be set beside the batch's own columns
    out = inner.mapInArrow(run, schema)
    if form in names:  # the form replaces the value itself
        return out.select(*[F.col("form" if n == form else f"c{i}").alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("form").alias(form))


def canonical_cases(df: DataFrame, value: str) -> DataFrame:
    """The rows of ``df`` whose ``value`` is not in its form, with the form."""
    return canonicalize(df, value).where(~F.col("form").eqNullSafe(F.col(value)))
