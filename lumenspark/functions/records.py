"""Column functions on records: options, scores, times, names and JSON held in text."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def option_lines(text: Column) -> Column:
    """Map of letter to text from lines like ``A) text``; later lines win, texts of three characters or fewer are dropped."""
    lines = F.filter(F.split(text, r"\s*\n\s*"), lambda x: x.rlike(r"^[A-J][).]\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.left(x, F.lit(1)).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[A-J][).]\s*", ""), r"[,\s]*_{2,}\s*$", "")).alias("v")))
    kept = F.filter(pairs, lambda p: F.length(p["v"]) > 3)
    # Of equal letters the last stays: an entry is dropped where its letter comes again.
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def first_score(answer: Column, *labels: str) -> Column:
    """The score under the first label that gives one other than 0, else that of the last."""
    scores = [label_score(answer, x) for x in labels]
    return F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in scores[:-1]), scores[-1])


def label_score(answer: Column, label: str) -> Column:
    """The first number after the label's first occurrence (up to its next); without the label, the first number of all."""
    parts = F.split(answer, label)
    part = F.when(F.contains(answer, F.lit(label)), F.get(parts, F.lit(1))).otherwise(answer)
    return F.nullif(F.regexp_extract(part, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def duration(seconds: Column) -> Column:
    """``1.5s``, ``2m 3.0s`` or ``1h 2m``."""
    m, h = F.floor(seconds / 60).cast("string"), F.floor(seconds / 3600).cast("string")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.concat(m, F.format_string("m %.1fs", seconds % 60)))
        .otherwise(F.concat(h, F.lit("h "), F.floor((seconds % 3600) / 60).cast("string"), F.lit("m")))
    )


def safe_name(user: Column) -> Column:
    """A user name fit for a file: outer blanks and the prefix ``user:`` off, path characters replaced, 64 characters, else ``unknown``."""
    s = F.regexp_replace(F.trim(F.coalesce(user, F.lit("unknown"))), "^user:", "")
    s = F.left(F.regexp_replace(s, r'[<>:"/\\|?*]', "_"), F.lit(64))
    return F.when(s == "", "unknown").otherwise(s)


def masked_name(user: Column) -> Column:
    return F.when(F.length(user) > 16, F.concat(F.left(user, F.lit(16)), F.lit("..."))).otherwise(user)


def salvaged(text: Column) -> Column:
    """The object held in a reply: fences off, then from the first brace to the last; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)```.*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def container(json: Column) -> Column:
    """Which container a reply's JSON is: its root or the key that holds the list."""
    value = F.try_parse_json(json)
    under = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")).startswith("ARRAY")
    return (
        F.when(value.isNull(), "invalid")
        .when(F.schema_of_variant(value).startswith("ARRAY"), "list")
        .when(F.coalesce(under("domains"), F.lit(False)), "domains")
        .when(F.coalesce(under("data"), F.lit(False)), "data")
        .otherwise("other")
    )


def lab_values(text: Column) -> Column:
    """Laboratory values like ``sodium 161 mmol/L`` as an array of texts; a comma between digits belongs to the number."""
    return F.regexp_extract_all(text, F.lit(r"[a-z]+ (?:count )?\d[\d,]*(?:\.\d+)? (?:mg/dL|g/dL|mmol/L|mU/L|U/L|ng/mL|ng/L|per mm3)"), F.lit(0))


def percent_options(text: Column) -> Column:
    """Options with the share of answers behind them (``Aspirin 12%``) as an array of (option, pct); of equal shares the first stays, ten at most are letters."""
    pattern = r"([A-Z][^%\n]{2,200}?|\d+[^%\n]{1,200}?)\s+(\d{1,2})%"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    shares = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    both = F.zip_with(names, shares, lambda n, p: F.struct(F.trim(n).alias("option"), p.cast("int").alias("pct")))
    return F.slice(F.filter(both, lambda x, i: ~F.exists(F.slice(both, F.lit(1), i), lambda y: y["pct"] == x["pct"])), 1, 10)


def argmax_letter(options: Column) -> Column:
    """Letter of the option with the greatest share, the first of ties; ``A`` where there is none."""
    best = F.array_max(F.transform(options, lambda x, i: F.struct(x["pct"].alias("pct"), (-i).alias("at"))))
    return F.when(F.size(options) > 0, F.chr(F.lit(65) - best["at"])).otherwise("A")


#: Words that mark a clarification.
CLARIFIES = ("clarification", "clarify", "clarifying", "clarified", "澄清", "说明", "解释", "let me clarify", "let me explain", "🔍", "💡", "💬")


def is_clarification(text: Column) -> Column:
    """A substantial text with a clarifying word that is not just a question."""
    t = F.trim(text)
    periods = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    low = F.lower(text)
    word = F.lit(False)
    for w in CLARIFIES:
        word = word | low.contains(w)
    return F.coalesce(word & (F.length(t) > 20) & ~(t.endswith("?") & (periods < 2)), F.lit(False))


#: Kinds of error by the words a message holds, the first that does. A rule is true if one of its parts is; a part, if each of its groups has a word in the message.
ERROR_RULES = (
    ("key", ((("api",), ("key", "invalid", "incorrect")),)),
    ("billing", ((("billing",),), (("account",), ("not active",)))),
    ("quota", ((("quota", "insufficient", "exceeded", "429", "cost limit"),),)),
    ("rate", ((("rate",), ("limit",)),)),
    ("timeout", ((("timeout", "timed out"),),)),
    ("connection", ((("connection", "refused", "unreachable"),),)),
    ("format", ((("json", "parse"),),)),
    ("length", ((("context",), ("length",)),)),
)


def error_kind(message: Column) -> Column:
    """The first kind whose words the message holds, wherever in it and on whatever lines; else the message, cut at 80 characters."""
    low, out = F.lower(message), None
    for kind, rule in ERROR_RULES:
        test = reduce(or_, (reduce(and_, (reduce(or_, (low.contains(w) for w in any_)) for any_ in all_)) for all_ in rule))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(F.when(F.length(message) > 80, F.concat(F.left(message, F.lit(80)), F.lit("..."))).otherwise(message))


def question_lines(text: Column) -> Column:
    """Lines of a question cleaned one by one: inner spaces collapsed, blank lines to fill stripped, at most one blank line in a row."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"_{3,}\s*$", "")))
    kept = F.filter(lines, lambda x, i: (x != "") | F.coalesce(F.get(lines, i - 1) != "", F.lit(False)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")
