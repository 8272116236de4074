"""Column functions that take apart texts of question files: explanations, tips, laboratory lines, numbered stems, similarity of questions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspark.functions.text import clean_text, split_paragraphs

#: Units of laboratory data in an option, and the lengths below which such an option is data.
LAB_UNITS = r"(g/dL|mg/dL|mEq/L|U/L|mm3|/mm3|°C|°F|mmHg|/hpf|ng/mL|pg/cell|/L|/dL|/mL|IU/L)"
#: Marks of the part of an explanation that is about the other options; what stands for an option without a text.
OTHERS = r"(?i)(?:Incorrect\s+Answers?|Incorrect\s+Choices?|Other\s+Answers?)\s*:"
NO_TEXT = "This option is incorrect."
#: Marks of an option's explanation, and what stands for one that has none.
OPTION_MARKS = (r"(?is)\*\*选项{k}：?\*\*[：:]?\s*(.*?)(?=\*\*选项|\z)", r"(?is)选项{k}：?\s*(.*?)(?=选项[A-Z]：|\z)", r"(?is){k}[：:]\s*(.*?)(?=[A-Z][：:]|\z)")
RIGHT_TEXT, WRONG_TEXT = "正确答案。", "此选项不正确。"


def _got(text: Column, pattern: Column | str, group: int = 1) -> Column:
    """The group of the pattern's first match, null without one."""
    return F.get(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(group)), F.lit(0))


def is_lab_datum(option: Column) -> Column:
    """A short option that is a value with a unit, or a name with a value, is laboratory data."""
    n = F.length(F.trim(option))
    unit = option.rlike(r"(?i)\d+\.?\d*\s*" + LAB_UNITS) & (n < 15)
    named = option.contains(":") & option.rlike(r"[A-Za-z]+\s*:\s*\d+") & (n < 20)
    return F.coalesce(unit | named, F.lit(False))


def tip(text: Column) -> Column:
    """What stands after ``Tip:`` up to a blank line or the end; null where there is none."""
    return F.trim(_got(text, r"(?is)Tip\s*:\s*(.*?)(?:\n\s*\n|\z)"))


def whole_page(text: Column, options: Column) -> Column:
    """A page holds a whole question: an answer is given, the stem doesn't start in small letters, and there are two options or more."""
    return F.coalesce(text.contains("Correct Answer:") & ~F.ltrim(text).rlike(r"^[a-z]") & (F.size(options) >= 2), F.lit(False))


def numbered_parts(text: Column) -> Column:
    """A file's text cut before numbered stems: at stems with an age, else at numbers before a capitalised word; what has no number is dropped."""
    aged = F.split(text, r"(?i)(?=(?<!\d)\d+\.\s+A\s+\d+-year-old\s+(?:man|woman|boy|girl|patient|person))")
    loose = F.split(text, r"(?=(?<!\d)\d+\.\s+[A-Z][a-z]{2,})")
    return F.filter(F.when(F.size(aged) > 1, aged).otherwise(loose), lambda p: F.trim(p).rlike(r"^\d+\.\s+"))


def explanation_map(explanation: Column, options: Column, answer: Column) -> Column:
    """Map of option letter to its explanation: the first mark of the option that is found, else a text for a right or a wrong option."""
    text = F.coalesce(explanation, F.lit(""))

    def of(k: Column) -> Column:
        found = F.coalesce(*(_got(text, F.replace(F.lit(m), F.lit("{k}"), k)) for m in OPTION_MARKS))
        whole = F.when(text != "", F.left(text, F.lit(500))).otherwise(RIGHT_TEXT)
        return F.coalesce(F.regexp_replace(found, r"^\s+|\s+$", ""), F.when(k == answer, whole).otherwise(WRONG_TEXT))

    return F.transform_values(options, lambda k, _: of(k))


def option_explanations(explanation: Column, options: Column, answer: Column) -> Column:
    """Map of option letter to its explanation from a text with a part about the other options.

    What stands before that part explains the answer; in it a paragraph that begins with an option's
    letter explains that option, together with the paragraphs that follow it up to the next one.
    """
    text = F.regexp_replace(F.coalesce(explanation, F.lit("")), r"\r\n?", "\n")
    cut = F.split(text, OTHERS, 2)
    right = F.array_join(F.transform(split_paragraphs(F.get(cut, F.lit(0))), clean_text), "\n\n")
    rest = F.regexp_replace(F.trim(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))), r"^[A-J](?:\s*,\s*[A-J])*[.:]?\s*", "")
    start = r"^(?:(?i:Choice|Option)\s+([A-Ja-j])(?:\s*[).:])?|([A-J])[).:]\s)\s*"
    paragraphs = F.filter(F.transform(F.split(rest, r"\n\n+"), F.trim), lambda p: p != "")
    # A paragraph with a letter opens a run; the runs are found by a fold that keeps (letter, text) pairs.
    empty = F.expr("cast(array() as array<struct<k:string,v:string>>)")

    def step(runs: Column, p: Column) -> Column:
        letter = F.upper(F.concat(F.regexp_extract(p, start, 1), F.regexp_extract(p, start, 2)))
        body = F.regexp_replace(p, start, "")
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["k"].alias("k"), F.concat(last["v"], F.lit(" "), p).alias("v"))))
        return F.when(letter != "", F.concat(runs, F.array(F.struct(letter.alias("k"), body.alias("v"))))).when(F.size(runs) > 0, longer).otherwise(runs)

    runs = F.aggregate(paragraphs, empty, step)
    last_of = lambda k: F.element_at(F.filter(runs, lambda r: r["k"] == k), -1)["v"]
    held = lambda k: F.size(F.filter(runs, lambda r: r["k"] == k)) > 0
    given = lambda k: F.nullif(F.when(held(k), clean_text(last_of(k))), F.lit(""))
    of = lambda k, _: F.coalesce(given(k), F.when((k == answer) & (right != ""), right), F.lit(NO_TEXT))
    return F.when(text != "", F.transform_values(options, of)).otherwise(F.transform_values(options, lambda k, _: F.lit(NO_TEXT)))


def lab_lines(text: Column) -> Column:
    """Laboratory data one value a line: the list is cut at commas and semicolons (not within a number), ``name: value unit`` is spaced evenly."""
    parts = F.split(text, r"\s*(?:;|,(?!\d{3}))\s*")
    even = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"\s*:\s*", ": "), r"(\d)([A-Za-z%°µ])", "$1 $2"), r"\s{2,}", " ")
    return F.array_join(F.filter(F.transform(parts, even), lambda x: x != ""), "\n")


#: Groups of phrases of which each stands for one kind of question, and words that count for nothing.
KINDS = (
    ("基本概念", "基础概念", "核心概念", "概念"), ("应用于临床场景", "应用在临床", "临床应用", "临床应用场景", "临床"), ("关键特征", "主要特征", "重要特征", "特征"), ("常见症状", "典型症状", "症状"),
    ("严重程度", "严重性", "程度"), ("治疗方案", "治疗方法", "治疗", "处理"), ("是什么", "什么是"), ("为什么", "为何"), ("如何", "怎样", "怎么"), ("哪些", "什么"), ("区别", "不同", "差异"),
)
COMMON = (
    "what", "the", "is", "are", "how", "why", "when", "where", "this", "that", "these", "those", "a", "an", "in", "on", "at", "to", "for", "of", "with", "from", "by", "and", "or", "but", "can", "does", "do", "will", "would",
    "could", "should", "这里", "这个", "这些", "那些", "什么", "如何", "为什么", "是", "的", "了", "和", "与", "或", "但", "在", "从", "到",
)


def questions_alike(a: Column, b: Column, least: float = 0.3) -> Column:
    """Whether two questions ask the same: equal without punctuation, one within the other, most words of the shorter shared, the same kind of a short question, or similar words."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"[!-/:-@\[-`{-~]", "")
    x, y = bare(a), bare(b)
    words = lambda t: F.filter(F.array_distinct(F.split(t, r"\s+")), lambda w: w != "")
    nx, ny = F.length(x), F.length(y)
    short, long = F.when(nx < ny, x).otherwise(y), F.when(nx < ny, y).otherwise(x)
    counted = F.size(F.filter(F.split(short, r"\s+"), lambda w: w != ""))
    inside = (nx > 10) & (ny > 10) & (F.length(short) >= 15) & (long.contains(short) | ((counted >= 4) & (F.size(F.array_intersect(words(short), words(long))) >= 0.7 * F.size(words(short)))))

    def of_kind(group: tuple[str, ...]) -> Column:
        has = lambda t: reduce(or_, (t.contains(p) for p in group))
        core = lambda t: reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), group, t)
        return has(x) & has(y) & F.length(core(x)).between(1, 25) & F.length(core(y)).between(1, 25)

    wx, wy = (F.array_except(words(t), F.array(*map(F.lit, COMMON))) for t in (x, y))
    one_empty = (F.size(wx) == 0) | (F.size(wy) == 0)
    ux, uy = F.when(one_empty, words(x)).otherwise(wx), F.when(one_empty, words(y)).otherwise(wy)
    similar = F.size(F.array_intersect(ux, uy)) >= least * F.size(F.array_union(ux, uy))
    both_empty = (F.size(wx) == 0) & (F.size(wy) == 0)
    told = (x == y) | inside | reduce(or_, map(of_kind, KINDS)) | both_empty | (similar & (F.size(F.array_union(ux, uy)) > 0))
    return F.coalesce((a != "") & (b != "") & told, F.lit(False))
