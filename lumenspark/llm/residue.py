"""Template residue, filler and failed deliveries in documents, found by what recurs.

A text is masked (addresses, dates and numbers become ``#``) and cut into messages:
the sentences of each line, and the sentences across line breaks. Every message of
every document is hashed, equal hashes are grouped over all sources, and each
different message is classified once, by phrase and placeholder rules that also say
in how many sources it must recur. The kinds then go back to the documents by the
hash. Texts are masked and cut in Arrow batches, whole columns at a time, none is
skipped; only the different messages meet the rules.

A rule is a pair: a literal the message holds and a pattern it matches. Rules that
are certain by themselves (a placeholder's syntax, a status line) take a message of
one source; vague ones ("Please try again later.") only one that recurs.

Messages are partly aggregated before they are exchanged, so a notice that stands
in a third of all documents is one row of a task's aggregate.

Defined cases: null and empty texts are no cases; null sources count as one
source; very long texts are read whole; repeated texts are found each under its
own id, repeated rows once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[\w#. -]{1,60}"
#: Unfilled parts of a template by their syntax; digits are masked by then.
_PLACEHOLDER = "|".join(
    [
        rf"\{{\{{\s*{_NAME}\s*\}}\}}",
        rf"\{{%-?\s*{_NAME}\s*-?%\}}",
        rf"[$#]\{{\s*{_NAME}\s*\}}",
        r"%\([\w#]{1,60}\)[sdif]",
        r"<<\s*\w[\w# ]{0,60}>>",
        r"\[\[\s*[A-Za-z][\w#]{0,40}(?:[ _][\w#]{1,40}){0,4}\s*\]\]",
        r"@@[\w#]{1,60}@@",
        r"(?<![\w$#{}\\])\{[a-z][a-z0-9#]{1,30}(?:_[a-z0-9#]{1,30}){0,4}\}(?!\})",
        r"__[A-Z][A-Z0-9#]*(?:_[A-Z0-9#]+){0,4}__",
        r"\$[A-Z][A-Z0-9#]*(?:_[A-Z0-9#]+){0,4}\$",
        r"%[A-Z]{2,}(?:_[A-Z0-9#]+){0,4}%",
        r"\[(?:INSERT|ENTER|ADD|YOUR|FILL IN|TBD|TO DO|TODO)\b[^\[\]]{0,60}\]",
        r"(?i:\[(?:your|insert|enter|add|fill in) [^\[\]]{1,60}\])",
        rf"<%=?\s*{_NAME}\s*%>",
        r"(?<!\w)<[A-Z][A-Z0-9#]{1,}(?:_[A-Z0-9#]+){0,4}>",
    ]
)
#: A placeholder that is only spoken of.
_MENTION = rf"(?i:\b(?:such as|like|called|named|field|variable|tag|token|placeholder|syntax|marker|for example|e\.g\.))[\s,:]+[\"“'‘`]*(?:{_PLACEHOLDER})"
#: Word stems of the customary pseudo-Latin filler.
LATIN = (
    "lorem", "ipsum", "dolor", "dolen", "amet", "sitam", "consec", "consel", "adipis", "elit", "sed", "eiusmod", "tempor", "incidid", "labor", "magna", "magnis", "aliqu", "enim", "minim", "veniam", "quis", "nostrud",
    "exercit", "ullam", "nisi", "commod", "conseq", "irure", "reprehend", "volupt", "velit", "esse", "cillum", "fugiat", "nulla", "pariatur", "cupidat", "nunc", "vitae", "varius", "port", "posuer", "viver", "luct", "fring",
    "matti", "pellent", "vestib", "vestra", "egest", "curabit", "maecen", "praesent", "phasell", "vivam", "fusce", "congue", "sagitt", "ornare", "rhonc", "sodal", "suspend", "ultric", "volutp",
)

_THING = r"(?:page|site|document|file|handout|resource|url|link|article|content)"
_STATUS = r"(?:^|\b(?:error|http|status|code)[ :]*)#[ :-]+(?:page )?"
#: (kind, literals of which the lower-cased message holds one, pattern it matches, sources it must recur in)
RULES: tuple[tuple[str, str, str, int], ...] = (
    ("filler", "lorem|ipsum|sit amet", r"\blorem\b|\bipsum dolor\b|\bdolor sit amet\b", 1),
    ("filler", "|".join(LATIN), rf"(?:\b(?:{'|'.join(LATIN)})[a-z]*\b[ ,.]*){{4,}}", 1),
    ("filler", "xxx", r"(?:\bx{3,}\b[ ,.]*){2,}", 1),
    ("filler", "text", r"(?:\btext\b[ ,.]*){3,}|\b(?:sample|dummy|placeholder|example) text[.!]?$|\byour text (?:goes )?here\b", 1),
    ("filler", "bla", r"(?:\bblah?\b[ ,.]*){3,}", 1),
    ("filler", "asdf|qwer|jkl|zxcv", r"(?:\b(?:asdf|qwer|jkl|zxcv)\w*\b[ ,.]*){2,}", 1),
    ("filler", " here", r"\byour (?:content|title|name|message|words) (?:goes )?here\b", 1),
    ("filler", "add |insert|enter|write|type|put ", r"\b(?:add|insert|enter|write|type|put) (?:a|an|the|your) [\w ]{1,60}\b(?:here|in this (?:box|field|space))[.!]?$", 1),
    ("filler", "replace this", r"\breplace this (?:paragraph|text|sentence|section|line)\b", 1),
    ("filler", "to edit|to add", r"\b(?:click|tap) (?:here )?to (?:edit|add) (?:this|your|the|a)?\b", 1),
    ("filler", "placeholder for", r"^\W*placeholder for\b|[.:] placeholder for\b", 1),
    ("filler", "placeholder for", r"placeholder for\b", 2),
    ("filler", "escrib|texto de|título de", r"escrib[ae] aquí|(?:texto|título) de (?:ejemplo|relleno)", 1),
    ("filler", "écrivez|saisissez|votre texte|texte à", r"écrivez (?:votre \w+ )?ici|saisissez votre|votre texte ici|texte à (?:compléter|insérer)", 1),
    ("filler", "text ein", r"\bhier (?:ihren )?text (?:eingeben|einfügen)\b", 1),
    ("filler", "填写|输入|示例文本|占位", r"此处填写|在此(?:处)?(?:填写|输入)|请(?:在此)?输入(?:内容|文字|文本)|示例文本|占位", 1),
    ("notice", "not found", _STATUS + r"not found|# not found[.!]?$|^\W*" + _THING + r" not found[.!]?$", 1),
    ("notice", "forbidden", _STATUS + r"forbidden|\baccess forbidden\b|^forbidden[.!]?$", 1),
    ("notice", "unauthorized", _STATUS + r"unauthorized|^unauthorized[.!]?$", 1),
    ("notice", "server error|bad gateway|gateway time", r"\binternal server error\b|\bbad gateway\b|\bgateway time-?out\b", 1),
    ("notice", "unavailable", r"\b(?:service|server|site|page) (?:is )?(?:temporarily |currently )?unavailable[.!]?$", 1),
    ("notice", "timed out", r"\b(?:request|connection|gateway|server) (?:has )?timed out\b", 1),
    ("notice", "connection", r"\bconnection (?:reset by peer|refused|was (?:reset|closed))\b", 1),
    ("notice", "failed to", r"\bfailed to (?:fetch|load|retrieve) (?:the )?" + _THING + r"\b", 1),
    ("notice", "http #|error code #|error #:|erreur #|código #|código de error #|错误", r"\bhttp #|\berror code #|\berror #:|\berreur # ?:|código (?:de error )?#|错误(?:代码)?[：: ]?#", 1),
    ("notice", "denied", r"\b(?:access|permission) (?:is |was )?denied[.!]?$", 1),
    ("notice", "you do", r"\byou (?:do not|don't) have (?:the )?(?:permission|access|rights) to (?:view|access|open|see|read)\b", 1),
    ("notice", "you requested|looking for", rf"\b{_THING} (?:that )?you (?:requested|are looking for|were looking for)\b", 1),
    ("notice", "requested ", rf"\brequested {_THING} (?:does not exist|could not be found|was not found|cannot be found|is not available)\b", 1),
    ("notice", "moved|deleted|no longer", rf"\bthis {_THING} (?:has been|was|is) (?:moved|deleted|removed|no longer)\b", 1),
    ("notice", "session", r"\byour session (?:has )?(?:expired|timed out|ended)\b", 1),
    ("notice", "log in|sign in", r"\bplease (?:log|sign) in(?: again)? to (?:continue|read|view|access|see)\b|\byou (?:need|have|must) (?:to )?(?:log|sign) in(?: again)? (?:to|before)\b", 1),
    ("notice", "went wrong", r"\bsomething went wrong (?:while|when|on our)\b", 1),
    ("notice", "maintenance", r"\b(?:is|are|is currently) down for (?:\w+ )?maintenance\b|\bunder maintenance[.!]?$", 1),
    ("notice", "too many requests", r"\btoo many requests\b", 1),
    ("notice", "javascript|java script|script|cookie", r"\b(?:enable|activate|allow|turn on|switch on) (?:java ?script|scripts|scripting|cookies)\b|\bjava ?script (?:is|must be|needs to be|has to be) (?:disabled|required|enabled|turned off|turned on|blocked|not enabled|not supported)\b", 1),
    ("notice", "javascript|java script|script|cookie", r"\b(?:requires?|needs?) (?:java ?script|scripts|cookies)\b(?= to (?:run|work|load|display|view)|[.!]?$)|\bwithout (?:scripting|java ?script)[.!]?$|\bnoscript\b", 1),
    ("notice", "your browser", r"\byour browser (?:is (?:not supported|out of date|outdated|too old)|does not support|blocks|has (?:scripts|cookies|java ?script))|\bupdate your browser\b|\bchecking your browser\b", 1),
    ("notice", "human|robot|captcha|unusual traffic", r"\b(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a |not a )?(?:human|robot)\b|\bcomplete the captcha\b|\bunusual traffic from your\b", 1),
    ("notice", "traceback|error: |exception|stack trace|segmentation", r"\btraceback \(most recent call last\)|\b(?:key|type|value|name|attribute|index|import|runtime|syntax)error: |\bnullpointerexception\b|\bexception in thread\b|\bstack trace:|\bsegmentation fault\b", 1),
    ("notice", "javascript|cookies", r"\bactive java ?script\b|\bhabilite (?:java ?script|las cookies)\b", 1),
    ("notice", "página|acceso|servicio|sesión", r"no se (?:ha )?(?:encontrado|encuentra|encontró) la página|página no encontrada|\bacceso denegado[.!]?$|\bservicio no disponible|su sesión ha (?:caducado|expirado)", 1),
    ("notice", "activ|page|accès|service|session", r"\b(?:activer|activez) (?:les scripts|java ?script|les cookies)\b|\bpage (?:demandée )?(?:est )?(?:introuvable|n'existe pas)|accès (?:refusé|interdit)[.!]?$|\bservice indisponible\b|\bvotre session a expiré", 1),
    ("notice", "javascript|seite|zugriff", r"\baktivieren sie java ?script\b|\bseite (?:wurde )?nicht gefunden\b|\bzugriff verweigert[.!]?$", 1),
    ("notice", "请|服务器|页面|访问|会话|网络", r"请(?:启用|开启|打开)(?:脚本|java ?script|cookie)|服务器(?:暂时)?(?:无法|没有)响应|服务器错误|页面(?:不存在|未找到|已被删除)|访问被拒绝|会话已过期|请(?:重新)?登录后|网络连接(?:失败|超时)", 1),
    # What stands beside a notice: short requests to a reader before a screen, where they recur.
    ("notice", "again|reload|refresh|page|continue|browser", r"^(?:please )?(?:try|wait|go|turn|update|reload|refresh|return|log|sign)\b[\w #]{0,60}\b(?:again|later|reload|refresh|(?:start|home) ?page|to continue|browser settings)[.!]?$", 2),
    ("notice", "oops", r"^oops\b", 2),
    ("notice", "稍后", r"请稍后再试", 2),
)
_UNFINISHED = r"(?:^|[.:>]\s|\s)(?:TODO|FIXME|TBD)(?::|\b[ ]+(?:add|write|fill|insert|update|check|finish|complete|describe|replace|this|figure|text))"
_MARK = re.compile(r"[{<\[%$]|@@|__|TODO|FIXME|TBD")
_MENTIONED, _PLACED, _OPEN_TASK = (re.compile(x) for x in (_MENTION, _PLACEHOLDER, _UNFINISHED))
# Patterns without look-around, for the vectorised engine.
_MASKED = r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.\w{2,}|\d+(?:[.,:/-]\d+)*"
_ENDS = r"[.!?]+(?:\s+|$)|[。！？]+|\n"
_CUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("message", pa.string())])


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole columns are masked and cut at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            plain = pc.replace_substring_regex(pc.replace_substring(part.column("text"), "**", ""), _MASKED, "#")
            flat = pc.replace_substring_regex(plain, r"\n[>\s]*", " ")
            cut = [pc.split_pattern_regex(x, _ENDS) for x in (plain, flat)]
            row = np.concatenate([pc.list_parent_indices(x).to_numpy(zero_copy_only=False) for x in cut])
            message = pc.utf8_trim_whitespace(pa.concat_arrays([pc.list_flatten(x) for x in cut]))
            # A document's message counts once.
            code = message.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.unique((row.astype(np.int64) << 32) | code, return_index=True)[1]
            kept = pa.array(at[pc.utf8_length(message.take(pa.array(at))).to_numpy(zero_copy_only=False) > 0])
            rows = pa.array(row).take(kept)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("source").take(rows), message.take(kept)], schema=_CUT)


def occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, source, h, g, message) of the masked messages of every document, each once; h and g are its hash.

    Messages are the sentences of a text's lines and its sentences across line breaks, without their stops.
    """
    rows = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("source"), "text")
    cut = rows.mapInArrow(_messages, "doc_id bigint, source string, message string")
    return cut.select("doc_id", "source", F.xxhash64("message").alias("h"), F.hash("message").alias("g"), "message")


class _Rules:
    """The rules with all their literals sought in one pass over a message."""

    def __init__(self) -> None:
        self.rules = [(name, re.compile(pattern), least) for name, _, pattern, least in RULES]
        at: dict[str, list[int]] = {}
        for i, (_, words, _, _) in enumerate(RULES):
            for w in words.split("|"):
                at.setdefault(w, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, of in at.items():
            self.automaton.add_word(w, of)
        self.automaton.make_automaton()

    def __call__(self, message: str, recurs: bool) -> str | None:
        if _MARK.search(message):
            if _PLACED.search(_MENTIONED.sub(" ", message)):
                return "placeholder"
            if _OPEN_TASK.search(message):
                return "filler"
        low = message.lower()
        for i in sorted({i for _, of in self.automaton.iter(low) for i in of}):
            name, pattern, least = self.rules[i]
            if (recurs or least < 2) and pattern.search(low):
                return name
        return None


_KINDS = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("message", pa.string()), ("recurs", pa.bool_()), ("kind", pa.string())])


def _classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = _Rules()
    for b in batches:
        kinds = [rules(m, r) for m, r in zip(b.column("message").to_pylist(), b.column("recurs").to_pylist())]
        at = pa.array([i for i, k in enumerate(kinds) if k], pa.int64())
        if len(at):
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in _KINDS.names[:-1]), pa.array([k for k in kinds if k], pa.string())], schema=_KINDS)


def classified(found: DataFrame) -> DataFrame:
    """(h, g, message, recurs, kind) of the different messages that a rule takes."""
    # Two sources or more are told by the least and the greatest, so no set of sources is gathered.
    groups = found.groupBy("h", "g").agg(F.first("message").alias("message"), (F.min("source") != F.max("source")).alias("recurs"))
    return groups.select("h", "g", "message", "recurs").mapInArrow(_classify, "h bigint, g int, message string, recurs boolean, kind string")


def recurring_messages(documents: DataFrame) -> DataFrame:
    """(message, kind, n_messages, n_sources): the messages that a rule takes and how widely they recur."""
    found = occurrences(documents)
    taken = found.select("h", "g", "source").join(classified(found), ["h", "g"])
    by_source = taken.groupBy("h", "g", "source").agg(F.count(F.lit(1)).alias("n"), F.first("message").alias("message"), F.first("kind").alias("kind"))
    return by_source.groupBy("h", "g").agg(F.first("message").alias("message"), F.first("kind").alias("kind"), F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_sources")).drop("h", "g")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents with residue, filler or a notice."""
    found = occurrences(documents)  # cut twice, to group and to bring the kinds back, which costs less than to write all messages
    return found.select("doc_id", "h", "g").join(classified(found).select("h", "g"), ["h", "g"]).select("doc_id").distinct()


def residue_report(documents: DataFrame) -> DataFrame:
    """(kind, n_documents, n_recurring): documents with a message of the kind, and with one that stands in two sources or more."""
    found = occurrences(documents)
    each = found.select("doc_id", "h", "g").join(classified(found).select("h", "g", "kind", "recurs"), ["h", "g"]).groupBy("kind", "doc_id").agg(F.max(F.col("recurs").cast("int")).alias("recurs"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("recurs").cast("bigint").alias("n_recurring"))
