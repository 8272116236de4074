"""Defective answers in student-tutor conversations.

Each pair is judged by itself, where its row lies, so the only exchange of rows
is that of the few defective ones. An answer is examined by
  * a mark test for answers with no words in them,
  * greedy string tiling of the answer over the student's text (copies),
  * a refusal grammar over the answer's sentences,
  * script and function-word checks of both languages,
  * a pushdown parser over fences, brackets, quotations and lists (truncation).

Defined cases: a null or blank student text is no case, whatever the answer; a
null answer is empty; null messages and null lists count for nothing, neither do
role/content messages that are no user message followed by an assistant one; later
saves and repeated rows of a conversation give one row for a pair (should saves disagree,
the kind that comes first in the alphabet); texts are read
whole, however long; extra columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- empty

_TAG = re.compile(r"<[^<>]*>")
_INVISIBLE = re.compile(r"[­​-‏ - ⁠-⁤﻿￼]")
#: Words that stand for a missing answer when nothing else is there.
_NOTHING = {
    "null", "none", "nil", "nan", "n a", "na", "undefined", "empty", "blank", "missing", "no response", "no answer", "no reply",
    "no content", "not available", "not answered", "no output", "error", "sin respuesta", "pas de réponse", "keine antwort", "无", "空", "无回答",
}


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _INVISIBLE.sub("", _TAG.sub(" ", html.unescape(answer)))
    words = re.findall(r"\w+", bare.replace("_", " "))
    return not words or " ".join(words).casefold() in _NOTHING


# ---------------------------------------------------------------- copy

_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
#: Words of a frame around a repeated text.
_FRAME = {"you", "asked", "your", "question", "student", "user", "the", "said", "wrote", "message", "here", "is", "q", "tutor", "answer", "usted", "preguntó", "pregunta", "su", "vous", "avez", "demandé", "votre", "sie", "fragten", "你", "问", "您", "的", "题", "是", "学", "生", "说", "提"}
_MIN_TILE = 2


def _near(a: str, b: str) -> bool:
    """Equal but for one slip: a letter changed, dropped, added or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def tiles(answer: list[str], text: list[str], least: int = _MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in answer, start in text, length), the longest match of unmarked tokens first; a token lies in one tile at most, on either side."""
    where: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(text) - least + 1):
        where.setdefault(tuple(text[j : j + least]), []).append(j)
    heap = []

    def longest(i: int) -> None:
        """The longest match from i over tokens unmarked on both sides."""
        best = at = 0
        for j in where.get(tuple(answer[i : i + least]), ()):
            n = 0
            while i + n < len(answer) and j + n < len(text) and answer[i + n] == text[j + n] and not taken[i + n] and not given[j + n]:
                n += 1
            if n > best:
                best, at = n, j
        if best >= least:
            heapq.heappush(heap, (-best, i, at))

    taken, given, out = bytearray(len(answer)), bytearray(len(text)), []
    for i in range(len(answer) - least + 1):
        longest(i)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        if any(taken[i : i + n]) or any(given[j : j + n]):
            longest(i)  # part of it went to a longer tile
            continue
        out.append((i, j, n))
        taken[i : i + n] = given[j : j + n] = b"\1" * n
    return out


def is_copy(user: str, answer: str) -> bool:
    """The answer gives back the text, once or again and again, framed or slightly changed, and nothing else."""
    text, said = _TOKEN.findall(user.casefold()), _TOKEN.findall(answer.casefold())
    if len(text) < 3 or not said:
        return False
    limit, common = max(1, len(text) // 10), set(text)
    framing = sum(t in _FRAME and t not in common for t in said)
    # A text given back again and again is so many texts to tile with.
    times = max(1, round((len(said) - framing) / len(text)))
    allowed = max(2, len(text) // 5) * times
    # A word of neither text nor frame is a slip or an addition, and these are counted below; with more there is nothing to tile.
    if sum(t not in common and t not in _FRAME for t in said) > limit + allowed:
        return False
    twice = text * times
    left, open_text = bytearray(b"\1" * len(said)), bytearray(b"\1" * len(twice))
    for i, j, n in tiles(said, twice):
        left[i : i + n] = open_text[j : j + n] = bytes(n)
    rest, missing, extra = [k for k, x in enumerate(left) if x], [j for j, x in enumerate(open_text) if x], 0
    for k in rest:
        slip = next((j for j in missing if _near(said[k], twice[j])), None)
        if slip is not None:
            missing.remove(slip)
        elif said[k] not in _FRAME:
            extra += 1
    return extra <= limit and len(missing) <= allowed


# ---------------------------------------------------------------- refusal

_SENTENCE = re.compile(r"[^.!?。？！\n]+[.!?。？！\n]*")
_NOT_ABLE = r"(?:can(?:no|')t|can not|could(?:n't| not)|won't|will not|am (?:not able|unable)|'m (?:not able|unable)|am not (?:allowed|permitted|in a position)|'m not (?:allowed|permitted)|must not|may not|do(?:n't| not) (?:have (?:the )?permission|feel comfortable)|am afraid i can(?:no|')t)"
_SPEAK = r"(?:answer|help|assist|comment|discuss|talk|speak|respond|reply|provide|give (?:you )?(?:any )?(?:medical |legal |an? )?(?:advice|information|answer|opinion|diagnosis)|offer|share|engage|say anything|do that|complete this|fulfil?l|comply|continue|address)"
#: A sentence that declines. Each is a rule of the grammar: who declines, that it is declined, what is declined.
_DECLINE = re.compile(
    "|".join(
        [
            rf"\bi(?: really| simply)?\s*{_NOT_ABLE}(?: to)?(?: \w+){{0,2}} {_SPEAK}\b",
            rf"\bi(?:'m| am) (?:sorry|afraid)[^.]*\b{_NOT_ABLE}(?: to)? {_SPEAK}\b",
            r"\bi (?:have|need|am going) to (?:pass|decline)\b|\bi must (?:decline|refuse|pass)\b|\bi (?:respectfully |politely )?(?:decline|refuse)\b",
            r"\bi(?:'d| would) (?:rather|prefer) not(?: to)?\b",
            r"\b(?:go|goes|be) against my (?:guidelines|policy|policies|rules|programming)\b|\bmy (?:guidelines|policy|rules) (?:do not|don't|prohibit|forbid|prevent)\b",
            r"\b(?:outside|beyond) (?:of )?(?:what i (?:may|can|am)|my (?:scope|role|remit|abilities|capabilities|competence|expertise))",
            r"\b(?:request|question|message|query) (?:was|has been|is|cannot be|could not be|can't be|couldn't be|will not be) (?:declined|refused|rejected|blocked|answered|processed|denied)\b",
            r"\b(?:it would be|it is|it's) (?:inappropriate|not appropriate|unethical|improper) for me to\b",
            r"\bno comment\b",
            r"\bi (?:do not|don't) have (?:the )?permission\b|\bnot (?:something|a topic) i (?:can|may)\b",
            r"\bno (?:puedo|podré|podría|me es posible|estoy autorizad[oa]|tengo permiso)\b[^.]{0,20}\b(?:ayudar|responder|contestar|ofrecer|dar|hablar|comentar|proporcionar|opinar)",
            r"\blamento no poder\b|\bno estoy autorizad[oa]\b|\bme es imposible\b|\bdebo (?:rechazar|declinar)\b|\bno me corresponde\b|\bprefiero no\b|\bsupera mis\b|\bfuera de mi\b",
            r"\bje ne (?:peux|puis|suis|saurais|souhaite)\b[^.]{0,30}\b(?:répondre|aider|donner|fournir|parler|commenter|autorisée?)",
            r"\bil m'est (?:impossible|interdit)\b|\bje (?:dois|préfère) (?:refuser|décliner|ne pas)\b|\bje ne suis pas (?:autorisée?|en mesure)\b|\bdépasse mes\b|\bhors de mon\b",
            r"\b(?:ich kann|kann ich|ich darf|darf ich)\b[^.]{0,40}\b(?:nicht|keine[rn]?)\b[^.]{0,40}\b(?:beantworten|helfen|geben|antworten|äußern|sprechen)|\bich muss (?:leider )?ablehnen\b",
            r"(?:无法|不能|不便|不可以|没法|不方便)(?:为您|为你|对此)?(?:回答|提供|讨论|帮助|协助|评论|谈论|答复|给出)|超出了?我的|不在我的|恕我|拒绝(?:回答|提供)|不被允许|没有权限",
        ]
    )
)
#: A sentence that may stand beside a declining one and gives no help either.
_POLITE = re.compile(
    r"^(?:(?:i(?:'m| am) )?(?:very |so |truly )?sorry|i apologi[sz]e|my apologies|apologies|unfortunately|regrettably|thank you|thanks)\b[^,:]*$"
    r"|^(?:i hope you understand|please understand|try (?:a different|another) question|(?:please )?(?:ask|consult|see|contact|speak (?:to|with)|talk to) (?:a|an|your|with|the) .*"
    r"|is there (?:something|anything) else.*|how else can i.*|what else.*|let me know if.*|feel free to .*|as an? (?:\w+ )?(?:ai|assistant|language \w+|model)\b.*)$"
    r"|^(?:lo siento|lamento|perdón|disculpe|désolée?|je regrette|pardon|leider|es tut mir leid|tut mir leid|抱歉|对不起|很遗憾|不好意思).*$"
    r"|^(?:consulte|pregunte|consultez|demandez|veuillez consulter|bitte (?:fragen|wenden)|请咨询|请向|请询问|espero que|j'espère|ich hoffe|希望您|请谅解|请理解).*$"
)

def is_refusal(answer: str) -> bool:
    declines = False
    for s in _SENTENCE.findall(answer):
        s = re.sub(r"[’‘]", "'", s.casefold()).strip(" .!?。？！\n\t\"“”")
        if not s:
            continue
        if _DECLINE.search(s):
            declines = True
        elif not _POLITE.search(s):
            return False
    return declines


# ---------------------------------------------------------------- language

#: Function words that mark a language, each word given to one language only.
_FUNCTION = {
    "en": "the and is are was were of to with that this for you it not be on as by at from which before after or if when would should does how why what because has have there more than about but may can means case".split(),
    "es": "el los las del que por para con se una es hay como cuando aunque antes después debe más su sus al ambas conviene suele entre qué cómo está son pero sin sobre también lo si durante mejora ser".split(),
    "fr": "le les des du et est une dans il ne pas avec sur au aux ce cette qui pour après avant devant même quand faut vous je où plus sont par souvent chez comment pourquoi comprends pouvez distinguer toujours évoque".split(),
    "de": "der die das und ist nicht mit ein eine einen dem den des zu auf für von bei nach vor aus wird sich auch als oder wenn man sollte über ohne im zum zur werden müssen kann".split(),
    "pt": "o os não uma com são ao mais também você é em nos das dos pela pelo isso".split(),
    "it": "il gli della di che non con una sono nel più anche è per dei alla".split(),
}
_OF_WORD: dict[str, tuple[str, ...]] = {}
for _l, _ws in _FUNCTION.items():
    for _w in _ws:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _l)
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("zh", re.compile(r"[㐀-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")))
_ELISION = re.compile(r"\b(?:l|d|qu|n|s|j|c|m)['’](?=[a-zàâéèêëîïôœùûh])", re.I)


def language(text: str) -> str | None:
    """The language of most of a text; None where it can't be told."""
    plain = text.isascii()
    if not plain:
        latin = len(re.findall(r"[A-Za-zÀ-ɏ]+", text))
        for name, script in _SCRIPTS:
            n = len(script.findall(text))
            if n >= 2 and n > latin * (1.2 if name in ("zh", "ja") else 3):
                return name
    score = {"fr": 0.0, "es": 0.0, "de": 0.0}
    low = text.casefold()
    words = _LETTERS.findall(low)
    for w in words:
        if w in _OF_WORD:
            held = _OF_WORD[w]
            for lang in held:
                score[lang] = score.get(lang, 0) + 1 / len(held)
    if "'" in low or "’" in low:
        score["fr"] += 1.0 * len(_ELISION.findall(low))
    if not plain:
        score["fr"] += 0.5 * len(re.findall(r"[çœèêâîôû]", low))
        score["es"] += 2.0 * len(re.findall(r"[ñ¿¡]", low)) + 0.4 * len(re.findall(r"[áíóú]", low))
        score["de"] += 0.7 * len(re.findall(r"[ßäöü]", low))
    ranked = sorted(score.items(), key=lambda x: -x[1])
    (best, top), second = ranked[0], ranked[1][1]
    if top < 2 or top < 1.5 * second or top < 0.1 * len(words):
        return None
    return best


_NAMED = {
    "en": r"\benglish\b|\binglés\b|\banglais\b|\benglisch\b|英文|英语",
    "es": r"\bspanish\b|\bespañol\b|\bcastellano\b|\bespagnol\b|\bspanisch\b|西班牙",
    "fr": r"\bfrench\b|\bfrançais\b|\bfrancés\b|\bfranzösisch\b|法文|法语",
    "de": r"\bgerman\b|\bdeutsch\b|\balemán\b|\ballemand\b|德文|德语",
    "zh": r"\bchinese\b|\bmandarin\b|\bchino\b|\bchinois\b|\bchinesisch\b|中文|汉语|普通话",
    "pt": r"\bportuguese\b|\bportugués\b|\bportugais\b|葡萄牙",
    "it": r"\bitalian\b|\bitaliano\b|\bitalien\b|意大利",
    "ja": r"\bjapanese\b|\bjaponés\b|\bjaponais\b|日文|日语",
    "ko": r"\bkorean\b|韩语|韩文",
    "ru": r"\brussian\b|\bruso\b|\brusse\b|俄语",
    "ar": r"\barabic\b|\bárabe\b|\barabe\b|阿拉伯",
    "el": r"\bgreek\b",
}
_ASKED = {k: re.compile(v) for k, v in _NAMED.items()}


def is_other_language(user: str, answer: str) -> bool:
    own = answer.replace(user.strip(), " ") if len(user.strip()) > 8 else answer
    asked, given = language(user), language(own)
    if asked is None or given is None or asked == given:
        return False
    return not _ASKED[given].search(user.casefold())


# ---------------------------------------------------------------- truncation

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
_CLOSE = set(_OPEN.values())
_LABELLED = re.compile(r"^(?:(?:the )?(?:correct )?(?:option|answer|choice|letter)(?: is)?[:\s]+)?\(?[A-J]\)?$", re.I)
_STOPS = ".!?。？！؟।｡"
_BULLET = re.compile(r"^\s*(?:[-*•‣–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?:\s+(.*))?$")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_MARKUP = re.compile(r"\[\d+\]|<[^<>]*>|[*_`~]+")
_WORD = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W_]+(?:['’.-][^\W_]+)*\.?|[^\s\w]|_")
#: Words that want another after them: determiners, prepositions, conjunctions, relatives, copulas; and abbreviations that do.
_WANTS = frozenset(
    "and or but nor the a an of to with for in on at from by as into onto than that which who whose when while because since although if is are was were be been has have had can could may might must should will would do does did not very more most"
    " y o u de del la el los las un una en con por para que es son está al su se lo como cuando porque aunque et ou le les des du une dans avec sur pour par qui est sont au aux ce cette quand parce und oder der die das den dem ein eine einen mit auf für von bei zu ist sind nicht weil wenn dass".split()
) | {"e.g.", "i.e.", "vs.", "vs", "eg", "cf.", "approx.", "incl.", "esp.", "z.b.", "p.ej.", "ca."}
#: Words that may end an answer although others want more after them ("Yes, it is", "No, do not", "I would").
_CLOSES = frozenset("is are was were be been has have had can could may might must should will would do does did not más es son está sí est sont ist sind nicht".split())
#: Finite verbs by which a short text is a clause and no fragment.
_FINITE = frozenset("is are was were has have had can could may might must should will would do does did es son está hay debe puede suele conviene est sont a ont faut doit peut ist sind hat haben kann muss soll wird".split())
#: Words of a fragment that stands as a full answer, at most.
FRAGMENT = 6
_ABBREVIATED = frozenset("e.g. i.e. vs. cf. approx. incl. esp. z.b. p.ej. ca.".split())


class Pushdown:
    """A pushdown parser of an answer: what is opened is pushed, what closes it pops it, and an answer is whole if nothing is left.

    Symbols: a code fence; a bracket or quotation of a paragraph (its closer); ``item``, a list
    mark without content; ``clause``, a sentence from its first word to its stop; ``more``, a
    word that wants another after it (a preposition, "e.g.", a comma), to the next word. A line
    of a list, a heading and a row of a table close their clause at the line's end, prose does
    so at a blank line only if it has no clause before it and is a fragment or a label.
    """

    def __init__(self, text: str):
        self.fence: str | None = None
        self.stack: list[str] = []
        self.words: list[str] = []  # of the open clause
        self.clauses = 0  # closed in this paragraph
        lines = text.split("\n")
        for k, line in enumerate(lines):
            mark = line.strip()[:3]
            if mark in ("```", "~~~"):
                self.fence = None if self.fence == mark else self.fence or mark
                self.end_clause()  # the block is what a colon before it announced
                if "more" in self.stack:
                    self.stack.remove("more")
                continue
            if self.fence is None:
                if not line.strip():
                    self.stack.clear()  # nothing stays open over a blank line
                    self.words, self.clauses = [], 0
                    continue
                item = _BULLET.match(line)
                if item or _HEADING.match(line) or _ROW.match(line):
                    self.end_clause()
                if item and len(lines) > 1:
                    self.stack.append("item")
                    line = item[1] or ""
                self.line(line, quoted=line.lstrip().startswith(">"))
                if (item and len(lines) > 1 or _HEADING.match(line) or _ROW.match(line)) and "more" not in self.stack:
                    self.end_clause()

    def end_clause(self) -> None:
        while "clause" in self.stack:
            self.stack.remove("clause")
        self.words = []
        self.clauses += 1

    def line(self, line: str, quoted: bool = False) -> None:
        bare = _MARKUP.sub(" ", line)
        for m in _WORD.finditer(bare):
            w, i = m.group(), m.start()
            low = w.casefold()
            if w == '"':
                inch = i and bare[i - 1].isdigit() and '"' not in self.stack
                if '"' in self.stack:
                    while self.stack.pop() != '"':
                        pass
                elif not inch:
                    self.stack.append('"')
            elif w in _OPEN:
                self.stack.append(_OPEN[w])
            elif w in _CLOSE:
                if w in self.stack:
                    if "more" in self.stack:
                        self.stack.remove("more")
                    while self.stack.pop() != w:
                        pass
            elif w in _STOPS or w == "…":
                if "more" in self.stack:
                    self.stack.remove("more")
                self.end_clause()
            elif not w[0].isalnum():
                if w in ",;:&+=/、，；：–—" and "more" not in self.stack:
                    self.stack.append("more")
            else:
                stop = w.endswith(".")
                if "item" in self.stack:
                    self.stack.remove("item")
                if "more" in self.stack:
                    self.stack.remove("more")
                if "clause" not in self.stack:
                    self.stack.append("clause")
                self.words.append(low.rstrip("."))
                if low in _ABBREVIATED or (not stop and low in _WANTS):
                    self.stack.append("more")
                elif stop:
                    self.end_clause()

    @property
    def open(self) -> str | None:
        """What the text leaves open, or None."""
        if self.fence is not None:
            return "fence"
        for s in self.stack:
            if s not in ("clause", "more"):
                return s
        if "more" in self.stack:
            short = self.words and self.words[-1] in _CLOSES and len(self.words) <= FRAGMENT and not self.clauses
            return None if short else "more"
        if "clause" in self.stack:
            cjk = any(re.match(r"[㐀-鿿]", w) for w in self.words)
            fragment = len(self.words) <= FRAGMENT and not self.clauses and (cjk and len(self.words) <= 4 or not cjk and not _FINITE.intersection(self.words[1:]))
            return None if fragment else "clause"
        return None


_PLAIN = re.compile(r"[^\"“”«»「」『』（）【】《》‹›()\[\]{}`~\n|]*[.!?。？！]")


def is_truncated(answer: str) -> bool:
    """The text ends in a broken character or a mark of omission, or leaves something open."""
    text = _INVISIBLE.sub("", answer).rstrip()
    if text.endswith("�"):
        return True
    if re.search(r"(?:\.\.+|…|\. \.)[\s\"'”’»)\]}）】]*$", text):
        return not re.search(r"(?:and so on|etc|and so forth|等等?)\s*(?:\.\.+|…)", text[-24:], re.I)
    if _LABELLED.match(text.strip()):
        return False
    # A paragraph without brackets, quotations or markup that ends in a stop leaves nothing open, as the parser would find.
    if _PLAIN.fullmatch(text) and text.rsplit(None, 1)[-1].casefold() not in _ABBREVIATED:
        return False
    return Pushdown(text).open is not None


def defect(user: str | None, answer: str | None) -> str | None:
    """The kind of an answer's defect, or None."""
    if user is None or not _INVISIBLE.sub("", user).strip():
        return None
    if is_empty(answer):
        return "empty"
    if is_copy(user, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    if is_other_language(user, answer):
        return "language"
    return None


# ---------------------------------------------------------------- Spark

_OUT = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("defect", pa.string())])


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, kinds = [], []
        users, answers = b.column("user"), b.column("assistant")
        for i in range(b.num_rows):
            if kind := defect(users[i].as_py(), answers[i].as_py()):
                keep.append(i)
                kinds.append(kind)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("conv_id").take(at), b.column("turn_no").take(at), pa.array(kinds, pa.string())], schema=_OUT)


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, user, assistant): the pairs of every saved row, numbered from 1."""
    pairs = """
      filter(transform(filter(messages, m -> m is not null), (m, i) -> case
        when m.role is null then named_struct('u', m.`user`, 'a', m.assistant)
        when lower(trim(m.role)) = 'user' and lower(trim(get(filter(messages, x -> x is not null), i + 1).role)) = 'assistant'
          then named_struct('u', m.content, 'a', get(filter(messages, x -> x is not null), i + 1).content) end), p -> p is not null)"""
    return conversations.selectExpr("conv_id", f"posexplode({pairs}) as (pos, p)").selectExpr("conv_id", "cast(pos + 1 as bigint) as turn_no", "p.u as `user`", "p.a as assistant")


def defective_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, defect) of every pair that can't be used because of its answer."""
    judged = conversation_pairs(conversations).mapInArrow(_judge, "conv_id bigint, turn_no bigint, defect string")
    return judged.groupBy("conv_id", "turn_no").agg(F.min("defect").alias("defect"))


def defect_report(conversations: DataFrame) -> DataFrame:
    """Defective pairs by kind."""
    return defective_pairs(conversations).groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))
