"""Column functions on text: cleaning, validity tests, word sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and the marks that count for nothing in a text.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS = ". ,!?。，！？"
_PUNCT_ONLY = r"^[\s\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*$"

#: Stop words of the clarification similarity.
STOP_WORDS = tuple(
    "the a an is are was were be been have has had do does did will would this that these those it its they them"
    " to of in on at for with by from and or but if then when where why how let me clarify clarification explain explanation"
    " understand understanding concept concepts key important please respond help can you your now".split()
)


#: Patterns taken out of a text, in this order, and what stands for them: page tags, white space, links, banners, noise at the end, lines to fill.
CLEANED = (
    (r"\[PAGE:\d+\]", ""),
    (r"\s+", " "),
    (r"https://t\.me/\S+", ""),
    (r"(?i)Previous\s+Next.*?Pause", ""),
    (r"(?i)Score\s+Report.*?Pause", ""),
    (r"""\\["']\s*[,~]\s*[A-Za-z]?["']?\s*[rR]?\s*[-~]?\s*[rR]?\s*["']?\s*[,~]?\s*["']?\s*$""", ""),
    (r"""\s*[rR]?\s*["']?\s*[,~]\s*[~-]?\s*[rR]?\s*[-~]+\s*[rR]?\s*["']?\s*[,~]?\s*["']?\s*$""", ""),
    (r"""\s*["']?\s*[,~]\s*[A-Za-z]?["']?\s*[rR]\s*[-~]?\s*[rR]?\s*["']?\s*[,~]?\s*["']?\s*$""", ""),
    (r"""\s*["',~-]+\s*$""", ""),
    (r"\s+[rR]\s*$", ""),
    (r"[,\s]*_{3,}\s*$", ""),
    (r"[,\s]*_\s+_{1,}\s*$", ""),
    (r"[,\s]+_+\s*$", ""),
)


def clean_text(text: Column) -> Column:
    """Page tags, link and navigation residue removed, white space collapsed, noise and lines to fill taken off the end."""
    for pattern, by in CLEANED:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def split_paragraphs(text: Column) -> Column:
    """Paragraphs of a text: at blank lines and after a sentence's end before a capital letter; empty ones dropped."""
    marked = F.regexp_replace(text, r"([.!?])\s+([A-Z])", "$1\n\n$2")
    return F.filter(F.transform(F.split(marked, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def valid_question_text(text: Column) -> Column:
    """At least five characters, none of the template questions, three characters that are no marks, a word of two letters."""
    t = F.trim(text)
    low = F.lower(t)
    template = (
        low.contains("key clinical features mentioned in this question about")
        | low.contains("how do these clinical features relate to the different answer options")
        | (low.contains("what are the key concepts") & (F.length(text) < 80))
    )
    meaningful = F.length(F.translate(t, MARKS, "")) >= 3
    words = F.exists(F.split(t, r"\s+"), lambda w: F.length(w) > 1)
    return F.coalesce((F.length(t) >= 5) & ~template & ~t.rlike(_PUNCT_ONLY) & meaningful & words, F.lit(False))


def valid_text_field(text: Column, least: int = 10) -> Column:
    """At least so many characters, three that are no marks, not only single letters."""
    t = F.trim(text)
    words = F.exists(F.split(t, r"\s+"), lambda w: F.length(w) > 1)
    return F.coalesce((F.length(t) >= least) & ~t.rlike(_PUNCT_ONLY) & (F.length(F.translate(t, MARKS, "")) >= 3) & words, F.lit(False))


def valid_clarification_text(text: Column) -> Column:
    """A clarification with content: long enough, several words, no bare template, no repeated template phrase."""
    t = F.trim(text)
    low = F.lower(t)
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 1)
    cjk = t.rlike("[。，：；！？]")
    spaces = F.size(F.split(t, r"\s+")) - 1
    jumble = (spaces < 2) & (F.length(t) > 10) & ~cjk
    ends = t.rlike("[。，：；！？]$") & (F.length(F.trim(F.regexp_replace(t, ".$", ""))) < 5)
    repeats = (F.size(F.split(low, "clarify")) - 1 > 2) | (F.size(F.split(low, "key concepts")) - 1 > 2)
    meaningful = F.length(F.translate(t, MARKS + "：:", "")) >= 5
    # Of the template phrases only the signs can stand within a word; at most half of the words may hold one.
    signs = F.size(F.filter(words, lambda w: w.rlike("[💡🔍💬]"))) <= 0.5 * F.size(words)
    return F.coalesce((F.length(t) >= 20) & ~t.rlike(_PUNCT_ONLY) & meaningful & ~ends & ~jumble & (F.size(words) >= 5) & ~repeats & signs, F.lit(False))


def word_set(text: Column, stop: list[str] | None = None, longer: int = 0) -> Column:
    """Distinct ASCII words (letters, digits, underscore) of the lower-cased text, without stop words and short ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))
    if longer:
        words = F.filter(words, lambda w: F.length(w) > longer)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; null where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def issues(question: Column, options: Column, answer: Column, explanation: Column, tip: Column) -> Column:
    """Codes of what is wrong with a question of the bank, in a fixed order; nulls read as empty."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    n = F.coalesce(F.size(options), F.lit(0))
    entries = F.coalesce(F.map_values(options), F.expr("cast(array() as array<string>)"))
    letter = F.upper(text(answer))
    keyword = r"because|since|due to|as a result|therefore|thus|moreover|furthermore|additionally|incorrect|correct"
    any_option = lambda test: F.exists(entries, lambda v: F.coalesce(test(F.trim(v)), F.lit(False)))
    rules = [
        ("question_short", F.length(text(question)) < 20),
        ("few_options", n < 2),
        ("many_options", n > 10),
        ("no_answer", letter == ""),
        ("answer_not_an_option", (letter != "") & ~F.coalesce(F.array_contains(F.map_keys(options), letter), F.lit(False))),
        ("option_empty", F.exists(entries, lambda v: F.coalesce(F.trim(v), F.lit("")) == "")),
        ("option_long", any_option(lambda v: F.length(v) > 200)),
        ("option_sentences", any_option(lambda v: F.length(v) - F.length(F.translate(v, ".!?", "")) > 2)),
        ("option_lines", any_option(lambda v: v.contains("___") | (F.length(v) - F.length(F.translate(v, "_", "")) > 5))),
        ("option_explains", any_option(lambda v: F.lower(v).rlike(keyword) & (F.length(v) > 50))),
        ("no_explanation", text(explanation) == ""),
        ("explanation_short", (text(explanation) != "") & (F.length(text(explanation)) < 20)),
        ("tip_apart", (text(tip) != "") & ~F.coalesce(F.contains(question, text(tip)), F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in rules)))
