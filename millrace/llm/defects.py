"""Defective pairs of question and answer (problem 1).

Each pair gets at most one defect, the first that holds of: ``empty``, ``copies_question``, ``refusal``,
``other_language``, ``truncated``. The columns that claim a refusal are not used.

Language: a naive Bayes model over character n-grams and scripts gives the posteriors of question and
answer. It is fitted on at most ``TRAIN_ROWS`` questions per script, a bounded sample, and on a few
sentences of every language given below. Refusal: where an answer has words of declining and no figure
but those that the question names, years and stock codes, a second model of the same kind, fitted on at
most ``TRAIN_ROWS`` answers of each side, tells whether the whole text declines or answers; neither its
length nor digits decide. Truncation: over all answers, how often a tail of n characters stands at the end
of a text, among all its occurrences; the estimate of each tail is smoothed with that of the shorter one
(``BACKOFF`` occurrences' worth, from one half), so that evidence of any amount counts for what it is. A
tail that is hardly ever final marks an answer that breaks off. Equal answers count once.

Null and blank answers are ``empty``. A null question has no language and is never copied. Very long
answers are scored whole. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import any_contained
from millrace.llm.hashing import SLICE_CHARS, Texts, mixed, passes, slices, summed, wanted_filter
from millrace.session import broadcast_if_small, cut

TRAIN_ROWS = 2_000
SURE_CHARS = 160  # only texts up to this length are examples of refusals; texts of any length are judged
TAILS = (2, 3, 5, 7, 9, 12)
BACKOFF = 10
END_SHARE = 0.05
MIN_LETTERS, MIN_LETTERS_ONE_SCRIPT = 8, 24
MIN_POSTERIOR = 0.9

# Plain sentences of each language, the model's first examples.
SENTENCES = {
    "zh": "公司预计今年的收入和利润都会增长。根据报告，毛利率有所下降，主要因为成本上升。请问这家公司的业务进展如何？市场份额是多少？需求端保持稳定，后续关注新产品。",
    "en": "The company expects revenue and profit to grow this year. According to the report, the margin fell because of higher costs. What are the main risks for the business? Share of sales rose from the prior quarter, mainly on new customers.",
    "fr": "La société prévoit une hausse du chiffre d'affaires et du bénéfice cette année. Selon le rapport, la marge s'établit en baisse à cause des coûts plus élevés, grâce à une meilleure maîtrise. Quels sont les principaux risques pour l'entreprise ? Les ventes ont augmenté par rapport au trimestre précédent.",
    "de": "Das Unternehmen erwartet in diesem Jahr einen höheren Umsatz und Gewinn. Laut dem Bericht ist die Marge wegen gestiegener Kosten gesunken, ein Plus von Millionen. Welche Risiken gibt es für das Geschäft? Der Absatz stieg gegenüber dem Vorquartal deutlich an.",
    "es": "La empresa espera que los ingresos y el beneficio crezcan este año. Según el informe, el margen bajó debido a los mayores costes. ¿Cuáles son los principales riesgos para el negocio? Las ventas aumentaron respecto al trimestre anterior.",
    "it": "La società prevede che i ricavi e gli utili crescano quest'anno. Secondo il rapporto, il margine è sceso a causa dei costi più alti. Quali sono i principali rischi per l'azienda? Le vendite sono aumentate rispetto al trimestre precedente.",
    "pt": "A empresa espera que a receita e o lucro cresçam neste ano. Segundo o relatório, a margem caiu por causa dos custos mais altos. Quais são os principais riscos para o negócio? As vendas aumentaram em relação ao trimestre anterior.",
    "ja": "会社は今年の売上高と利益の増加を見込んでいます。レポートによると、コストの上昇により利益率は低下しました。この事業の主なリスクは何ですか。前年比での見通しです。",
    "ko": "회사는 올해 매출과 이익이 증가할 것으로 예상합니다. 보고서에 따르면 비용 상승으로 이익률이 하락했습니다. 이 사업의 주요 위험은 무엇입니까? 증가율은 전분기보다 높아질 것으로 예상됩니다.",
    "ru": "Компания ожидает роста выручки и прибыли в этом году. Согласно отчёту, маржа снизилась из-за роста затрат. Каковы основные риски для бизнеса? Продажи выросли по сравнению с прошлым кварталом.",
}
# Plain refusals and plain answers, the first examples of the two sides.
REFUSAL_SENTENCES = {
    "refusal": [
        "抱歉，无法回答该问题。", "现有材料不足以支持结论，暂不作答。", "未检索到相关研报片段，无法可靠回答。", "这个问题超出了可用资料的范围，不能给出答案。", "您好，根据规则，此类请求不予处理。",
        "Sorry, I am unable to answer this question.", "The available evidence is insufficient, so no answer is given.", "I cannot provide that information based on the documents.",
    ],
    "answer": [
        "公司预计今年收入和净利润保持增长，毛利率有所提升。", "主要风险包括原材料价格波动、需求不及预期和竞争加剧。", "管理层认为订单难以在短期内恢复，但海外渠道放量。", "维持买入评级。",
        "The company expects revenue and profit to grow this year on stronger demand.", "Key risks are raw material prices and weaker demand.", "Margins could not recover as costs rose, while new customers lifted sales.",
    ],
}
# Words by which a question asks for a language.
ASKED = {
    "zh": "中文|汉语|Chinese", "en": "英文|英语|English", "fr": "法语|法文|French", "de": "德语|德文|German", "es": "西班牙语|Spanish",
    "it": "意大利语|Italian", "pt": "葡萄牙语|Portuguese", "ja": "日语|日文|Japanese", "ko": "韩语|韩文|Korean", "ru": "俄语|俄文|Russian",
}
_REQUEST = r"(?i)[（(]?\s*(?:请|麻烦)?\s*(?:用|以|使用)?\s*(?:LANG)\s*(?:来)?(?:回答|作答|答复|回复|说明|撰写|输出)\s*[）)]?\s*[。.:：，,]?|(?:please\s+)?(?:answer|reply|respond|write)(?:\s+\w+){0,2}?\s+in\s+(?:LANG)\s*[.。,，:：]?|translate\b.{0,40}\b(?:to|into)\s+(?:LANG)|(?:翻译|译)(?:成|为)\s*(?:LANG)"

# What stands before or instead of an answer without being one.
_SOURCES = r"(?s)(?:\A|\n)\s*(?:#+\s*)?(?:【)?(?:参考来源|参考资料|参考文献|数据来源|资料来源|引用来源|来源|References?|Sources?|Citations?)(?:】)?\s*[:：].*\z"
_CITATION = r"\[\s*\d+(?:\s*[,，、-]\s*\d+)*\s*\]|【\s*\d+\s*】|\^\d+"
_HEADING = r"【[^】\n]{1,8}】|(?i)(?:结论|要点|核心观点|观点|总结|摘要|回答|答案|答|分析|如下|conclusion|summary|answer|key points?)\s*[:：]|(?m:^#+\s*\S{1,8}\s*$)"
_PLACEHOLDER = r"(?i)\A(?:n/?a|nan|null|none|nil|undefined|empty|tbd|todo|unknown|无|空|暂无|没有|略|待补充|待定|无内容|无答案|无数据|暂无数据|no answer|no data)\z"
_LABEL = r"(?i)(?:问题|提问|问|用户问题|您问的是|你问的是|关于|原问题|question|query|q)\s*[:：]?"
_POLITE = r"(?i)(?:你好|您好|请问|麻烦问下|麻烦问一下|麻烦|想了解|帮我查下|帮我查一下|帮我看下|请教|谢谢|感谢|thanks|thank you|hello|hi|please)"
# Words by which an answer may decline, in lower case, and the one phrase with a gap.
_REFUSAL_WORDS = (
    "抱歉", "对不起", "遗憾", "无法", "不能", "不便", "难以", "恕", "拒绝", "不予", "不作答", "答不了", "不清楚", "没有把握", "没有足够把握", "先跳过", "未检索到", "没有检索到", "未找到", "没有找到", "找不到", "未达到作答要求",
    "不足以", "证据不足", "信息不足", "不输出答案", "不给出结论", "不给出答案", "无从", "暂不", "缺少", "换一种问法", "查阅原始",
    "sorry", "unable to", "cannot", "can't", "can not", "could not", "couldn't", "not able to", "decline", "refuse", "no supporting ", "no relevant ", "no sufficient ", "not enough", "insufficient", "below the required",
    "do not let", "do not allow", "do not contain", "do not provide", "do not cover", "does not let", "does not allow", "does not contain", "does not provide", "does not cover", "outside the scope", "outside my scope", "as an ai",
)
_REFUSAL_GAP = ("超出", "超出.{0,12}范围")
# Figures, those that tell nothing (years, stock codes), and remarks on scores in brackets.
_FIGURE = r"(?<![QqHh\d.,])\d+(?:[.,]\d+)*"
_NO_FIGURE = r"\A(?:(?:19|20)\d{2}|\d{6})\z"
_REMARK = r"(?i)[（(][^（）()]*(?:rerank|score|threshold|阈值|置信度|主体)[^（）()]*[）)]"
_CUT_MARKS = r"(?:…+|\.{3,}|�+|\[)\s*\z"
_CUT_MARK = re.compile(r"(?:…+|\.{3,}|�+|\[)\s*\Z")
_NAME, _FIGURES, _SPACE = re.compile(r"[A-Z](?<!\w[A-Z])[a-z]+[A-Z][A-Za-z]*"), re.compile(r"[0-9]+(?:[.,][0-9]+)*"), re.compile(r"[ \t\n\v\f\r]+")


def _letters(text: Column) -> Column:
    """The letters and digits of ``text``, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


@cache
def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _script(points: np.ndarray) -> np.ndarray:
    """A number beyond all code points for the script of each letter."""
    ranges = ((0x3040, 0x3100), (0xAC00, 0xD7B0), (0x3400, 0xA000), (0x400, 0x530))
    return 0x110000 + np.select([(points >= a) & (points < b) for a, b in ranges], [1, 2, 3, 4], 0)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, row, letters) of many texts at once: character n-grams of 1 to 3 within words, and the script of each letter.

    ``gram`` holds up to three code points in 63 bits, ``row`` is its text, ``letters`` how many each text has. A
    word of a script that sets blanks has a blank at either end.
    """
    t = Texts([" ", *[x.lower() + " " for x in texts]])
    is_letter = _letter_table()[t.points]
    c = np.where(is_letter, t.points, 32).astype(np.int64)
    row = np.repeat(np.arange(-1, len(texts)), t.ends - t.begins)
    near = is_letter & (c < 0x2E80)  # may stand beside a blank
    one = np.flatnonzero(is_letter)
    a, b = slice(None, -1), slice(1, None)
    two = np.flatnonzero((is_letter[a] & is_letter[b]) | (near[a] & ~is_letter[b]) | (~is_letter[a] & near[b]))
    first, last = is_letter[:-2] | near[1:-1], is_letter[2:] | near[1:-1]
    three = np.flatnonzero(is_letter[1:-1] & first & last)
    parts = [c[one], _script(c[one]), (c[two] << 21) | c[two + 1], (c[three] << 42) | (c[three + 1] << 21) | c[three + 2]]
    rows = np.concatenate([row[one], row[one], row[two + 1], row[three + 1]])
    # a blank between two texts belongs to the one before it
    return np.concatenate(parts), np.maximum(rows, 0), np.bincount(row[one], minlength=len(texts))


class LanguageModel:
    """Multinomial naive Bayes over character n-grams, for whole batches; its labels need not be languages."""

    SLOTS = 1 << 21

    def __init__(self, examples: dict[str, list[str]], alpha: float = 0.1):
        counted = {label: np.unique(grams(texts)[0], return_counts=True) for label, texts in examples.items()}
        self.langs = sorted(counted)
        keys = np.unique(np.concatenate([k for k, _ in counted.values()]))
        weights = np.empty((len(keys), len(self.langs)))
        for i, label in enumerate(self.langs):
            n = np.zeros(len(keys))
            n[np.searchsorted(keys, counted[label][0])] = counted[label][1]
            weights[:, i] = np.log((n + alpha) / (n.sum() + alpha * (len(keys) + 1)))
        # one n-gram a slot: of the few that meet in one, the last stays
        self.slots = np.full(self.SLOTS, -1, dtype=np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys))
        self.keys, self.weights = keys, weights

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def posteriors(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """(lang, posterior, letters) of each text; no language for a text without letters or known n-grams."""
        texts = [x or "" for x in texts]
        tables, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE_CHARS // 4):
                size += len(texts[stop])
                stop += 1
            tables.append(self._posteriors(texts[at:stop]))
            at = stop
        return pd.concat(tables, ignore_index=True) if tables else pd.DataFrame({"lang": [], "posterior": [], "letters": []})

    def _posteriors(self, texts: list[str]) -> pd.DataFrame:
        gram, row, letters = grams(texts)
        at = self.slots[self._slot(gram)]
        known = (at >= 0) & (self.keys[at] == gram)  # an n-gram unseen in any language tells nothing
        at, row = at[known], row[known]
        scores = np.stack([np.bincount(row, weights=self.weights[at, i], minlength=len(texts)) for i in range(len(self.langs))], axis=1)
        best = scores.max(axis=1)
        share = 1 / np.exp(np.maximum(scores - best[:, None], -700)).sum(axis=1)
        told = (np.bincount(row, minlength=len(texts)) > 0) & (letters > 0)
        names = np.array(self.langs, dtype=object)[scores.argmax(axis=1)]
        return pd.DataFrame({"lang": np.where(told, names, None), "posterior": np.where(told, share, 0.0), "letters": np.where(told, letters, 0).astype("int32")})

    def posterior(self, text: str | None) -> tuple[str | None, float, int]:
        """The same of one text."""
        lang, share, letters = self.posteriors([text]).iloc[0]
        return lang, float(share), int(letters)


def _sample(rows: DataFrame, text: str, n: int) -> list[str]:
    """At most ``n`` distinct texts, the same ones each time."""
    distinct = rows.where(F.col(text).isNotNull()).select(text).distinct()
    return [r[0] for r in distinct.orderBy(F.xxhash64(text), text).limit(n).collect()]


def fit_languages(questions: DataFrame, text: str, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from the sentences above and at most ``train_rows`` questions each of Han and of Latin script; ``text``: without what asks for a language."""
    rows = questions.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    han = F.length(F.regexp_replace("text", r"\P{IsHan}+", ""))
    latin = F.length(F.regexp_replace("text", r"\P{IsLatin}+", ""))
    labelled = cut(rows.withColumn("lang", F.when(han * 3 > latin, "zh").when((latin > 20) & (han == 0), "en")).where("lang IS NOT NULL"))
    examples = {lang: [s] * 5 for lang, s in SENTENCES.items()}
    for lang in ("zh", "en"):
        examples[lang] = examples[lang] + _sample(labelled.where(F.col("lang") == lang), "text", train_rows)
    return LanguageModel(examples)


def fit_refusals(answers: DataFrame, text: str, worded: Column, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of declining and of answering, from the sentences above and at most ``train_rows`` answers of each side.

    ``worded`` is true where the words of a refusal stand without a figure, false where no such word stands; what
    is learnt is how the rest of a refusal reads, so that neither length nor one word decides.
    """
    rows = answers.select(F.col(text).alias("text"), worded.alias("worded"))
    sides = {"refusal": rows.where("worded"), "answer": rows.where("NOT worded")}
    return LanguageModel({side: REFUSAL_SENTENCES[side] * 5 + _sample(labelled, "text", train_rows) for side, labelled in sides.items()})


def judged_texts(languages: LanguageModel, refusals: LanguageModel):
    """A column function: question, answer, body -> struct (q, q_sure, a, a_sure, a_letters, side); a null body has no side."""

    @F.pandas_udf("q string, q_sure double, a string, a_sure double, a_letters int, side string")
    def judge(question: pd.Series, answer: pd.Series, body: pd.Series) -> pd.DataFrame:
        q, a = languages.posteriors(question), languages.posteriors(answer)
        side = pd.Series([None] * len(body), dtype=object)
        given = np.flatnonzero(body.notna())
        if len(given):
            side[given] = refusals.posteriors(body.iloc[given])["lang"].to_numpy()
        return pd.DataFrame({"q": q["lang"], "q_sure": q["posterior"], "a": a["lang"], "a_sure": a["posterior"], "a_letters": a["letters"], "side": side})

    return judge


def shape(text: str) -> str:
    """``text`` from its start mark, with each figure as 9 and each name of inner capitals as one sign, blanks as one."""
    return "\x02" + _SPACE.sub(" ", _FIGURES.sub("9", _NAME.sub("某", text)))


def _own_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, answer, marked) -> (key, marked, size, tail): the hashes of the tails of each answer's shape, without marks behind a cut."""
    for b in slices(batches, "answer"):
        t = Texts([shape(_CUT_MARK.sub("", x)) for x in b.column(1).to_pylist()])
        n, k = b.num_rows, len(TAILS)
        size = np.tile(np.array(TAILS), n)
        tail = t.hashes(np.maximum(np.repeat(t.ends, k) - size, np.repeat(t.begins, k)), np.repeat(t.ends, k))
        row = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), pa.array(size.astype(np.int32)), pa.array(tail)], names=["key", "marked", "size", "tail"])


def _tail_counts(wanted: bytes):
    """A map (answer) -> (size, tail, n, n_end) of the tails at all places of the answers' shapes that ``wanted`` lets through, and those at an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "answer"):
            t = Texts([shape(x) for x in b.column(0).to_pylist()])
            lengths = t.ends - t.begins
            begin, end = np.repeat(t.begins, lengths), np.repeat(t.ends, lengths)
            to = np.arange(len(t.points)) + 1
            at = np.flatnonzero(to - begin >= 2)
            begin, end, to = begin[at], end[at], to[at]
            for size in TAILS:
                tail = t.hashes(np.maximum(to - size, begin), to)
                some = passes(wanted, tail ^ np.int64(size))
                tails, n, n_end = summed(tail[some], np.ones(int(some.sum())), (to == end)[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tails), size, dtype=np.int32)), pa.array(tails), pa.array(n), pa.array(n_end)], names=["size", "tail", "n", "n_end"])

    return run


def end_shares(answers: DataFrame, tails: DataFrame) -> DataFrame:
    """(size, tail, n, n_end): of each wanted tail, its occurrences in the shapes of all ``answers``, and those at the end of one.

    Tails are hashes. Each batch counts its own, and only those that a bitmap of fixed size lets through; then
    those are held against the wanted ones.
    """
    wanted = cut(tails.select("size", "tail").distinct())
    bitmap = wanted_filter(wanted.select(F.col("tail").bitwiseXOR(F.col("size").cast("long")).alias("tail")), "tail")
    counted = answers.mapInArrow(_tail_counts(bitmap), "size int, tail long, n long, n_end long")
    met = counted.join(broadcast_if_small(wanted, 200_000), ["size", "tail"], "left_semi")
    return met.groupBy("size", "tail").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def defective_pairs(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(key, defect) of the defective rows; ``key`` must be unique."""
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    rows = rows.withColumn("answer", F.regexp_replace("answer", r"[\s\p{Z}\p{Cf}]+\z", ""))
    body = F.regexp_replace("answer", _SOURCES, "")
    rows = rows.withColumn("body", F.trim(F.regexp_replace(body, _CITATION, "")))
    # every heading has one of these signs
    core = F.when(F.col("body").rlike("[【:：#]"), F.regexp_replace("body", _HEADING, "")).otherwise(F.col("body"))

    every = "|".join(ASKED.values())
    speaks = F.coalesce(F.col("question").rlike(every), F.lit(False))  # only then can it ask for a language
    asked = F.when(speaks, F.coalesce(*[F.when(F.col("question").rlike(_REQUEST.replace("LANG", words)), lang) for lang, words in ASKED.items()]))
    spare = F.when(speaks, F.regexp_replace("question", _REQUEST.replace("LANG", every), " ")).otherwise(F.col("question"))

    empty = F.col("answer").isNull() | ~core.rlike(r"[\p{L}\p{N}]") | F.trim(core).rlike(_PLACEHOLDER) | F.trim("body").rlike(_PLACEHOLDER)
    q = F.regexp_replace(_letters(F.regexp_replace("question", _POLITE, "")), r"\s", "")
    a = _letters(F.regexp_replace(F.regexp_replace(core, _POLITE, ""), _LABEL, ""))
    asked_again = _letters(F.regexp_replace(F.regexp_replace("question", _POLITE, ""), _LABEL, ""))
    rest = F.replace(a, asked_again, F.lit(""))
    copies = (F.length(asked_again) >= 4) & ((rest == "") | ((F.length(a) >= 6) & (F.length(a) >= 0.7 * F.length(q)) & q.contains(a)))
    # figures that the question names, years and stock codes are no answer, nor is what a refusal says of its scores
    said = F.regexp_replace(F.regexp_replace("body", _CITATION, ""), _REMARK, "")
    own_figure = F.exists(F.array_except(F.regexp_extract_all(said, F.lit(_FIGURE), F.lit(0)), F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(_FIGURE), F.lit(0))), lambda x: ~x.rlike(_NO_FIGURE))
    words = F.coalesce(any_contained(F.lower("body"), _REFUSAL_WORDS) | (F.contains("body", F.lit(_REFUSAL_GAP[0])) & F.col("body").rlike(_REFUSAL_GAP[1])), F.lit(False))
    # an answer that names something of the question, as one of two choices, is short but whole
    named = F.coalesce(q.contains(a) & (F.length(a) >= 2), F.lit(False))
    early = F.when(empty, "empty").when(copies, "copies_question")
    read = cut(rows.select("key", "answer", "body", spare.alias("spare"), asked.alias("asked"), F.regexp_replace(core, r"\d+", " ").alias("core"), early.alias("early"), named.alias("named"), (words & ~own_figure).alias("worded"), words.alias("words")))

    worded = F.when(F.col("worded") & (F.length("body") <= SURE_CHARS), True).when(~F.col("words"), False)
    judge = judged_texts(fit_languages(read, "spare"), fit_refusals(read.where("answer != ''"), "body", worded))
    langs = read.withColumn("by", judge(F.col("spare"), F.col("core"), F.when(F.col("worded"), F.col("body"))))
    refusal = F.col("by.side").eqNullSafe("refusal")
    latin = ("de", "en", "es", "fr", "it", "pt")
    enough = F.when(F.col("by.q").isin(*latin) & F.col("by.a").isin(*latin), MIN_LETTERS_ONE_SCRIPT).otherwise(MIN_LETTERS)
    sure = (F.col("by.q_sure") >= MIN_POSTERIOR) & (F.col("by.a_sure") >= MIN_POSTERIOR) & (F.col("by.a_letters") >= enough)
    other = sure & (F.col("by.q") != F.col("by.a")) & ~F.coalesce(F.col("by.a") == F.col("asked"), F.lit(False))
    first = F.coalesce("early", F.when(refusal, "refusal").when(other, "other_language"))
    judged = cut(langs.select("key", "answer", "named", first.alias("defect")))
    whole = judged.where("answer IS NOT NULL AND answer != ''").withColumn("marked", F.col("answer").rlike(_CUT_MARKS))

    # an answer that ends in a full stop is whole, however rare its last words are
    ended = F.col("answer").rlike(r"[。！？!?]\z|[A-Za-z%)]\.\z") & ~F.col("marked")
    tails = cut(whole.where(F.col("defect").isNull() & ~F.col("named") & ~ended).select("key", "answer", "marked").mapInArrow(_own_tails, f"key {dict(df.dtypes)[key]}, marked boolean, size int, tail long"))
    # copies of one answer are one text among the occurrences, else those of a cut answer would vote that it is whole
    distinct = whole.where("NOT marked").select("answer").distinct()
    known = tails.join(end_shares(distinct, tails), ["size", "tail"])
    # an answer's own end is not counted for it; one behind which a mark was set is not among the ends
    own_end = F.when(F.col("marked"), 0).otherwise(1)
    seen = known.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("size", (F.col("n") - own_end).alias("n"), (F.col("n_end") - own_end).alias("n_end")))).alias("seen"))
    share = F.aggregate("seen", F.lit(0.5), lambda p, t: (t["n_end"] + BACKOFF * p) / (t["n"] + BACKOFF))
    broken = seen.where(share < END_SHARE).select("key", F.lit("truncated").alias("late"))
    out = judged.join(broken, "key", "left").select(F.col("key").alias(key), F.coalesce("defect", "late").alias("defect"))
    return out.where("defect IS NOT NULL")
