"""Evaluation passages in documents, verbatim or with other values in their slots.

Words (runs of a-z and 0-9 in the lower-cased text) are canonicalised: numbers,
units and names become typed placeholders, a name being any word that the items
write with a capital inside a sentence or before a dose, or that they don't use at all. Windows of twelve template words are
hashed and joined with the windows of the items; the words in the slots of each
joined window are then compared. Equal words throughout are a verbatim leak; other
values in the slots, with one name for one name, are the item with other values. This
is judged for each occurrence (the windows of one alignment of document and item), and
one that holds is enough; a number may be given different values in different places.

The items are a given, fixed set: their windows and words are handed to every task
only up to checked numbers. Beyond SHARED_WINDOWS all document windows are exchanged
and joined by hash; beyond SHARED_WORDS only the words most frequent in the items are
handed out, the others are joined with the other words of each text, and the text goes
on with those that are no names. Both change what is exchanged, not one row of a result.

Defined cases: null and empty texts, questions and rationales have no windows; texts
of fewer than twelve words neither; windows never span a question and a rationale;
repeated rows and repeated passages give one row for document and item; very long
texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.session import cut_lineage

WINDOW = 12
#: Item windows that are handed to every task, at most (about 100 bytes each).
SHARED_WINDOWS = 500_000
#: Words of a template window that are no placeholders, at least, for a re-parameterised match.
PLAIN = 6
#: Words of the items that are handed to every task, at most; further ones are joined.
SHARED_WORDS = 500_000
#: Share of an item's windows that an occurrence holds, at least.
COVER = 0.5

_WORD = re.compile(r"[a-z0-9]+")
_RAW = re.compile(r"[A-Za-z0-9]+")
#: Units of measurement as words.
_UNITS = frozenset("mg g kg mcg ug ng l dl ml mmol mol nmol umol meq u iu mu mm cm m mm3 hg percent degrees celsius c f bpm hours hour days day weeks week months month years year minutes minute seconds second mllh mmhg per".split())
_NUM, _UNIT, _NAME = "0", "1u", "1n"  # placeholders; no word of letters and digits holds these roles


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lexicon:
    """Template of a word. plain: the items' words that are no names; None: every word stands for itself."""

    def __init__(self, plain: Iterable[str] | None):
        self.plain = None if plain is None else frozenset(plain)

    def template(self, word: str) -> str:
        if word.isdigit():
            return _NUM
        if word in _UNITS:
            return _UNIT
        return word if self.plain is None or word in self.plain else _NAME


_DOSE = re.compile(r"([A-Za-z][A-Za-z0-9-]*)\s+(?:at\s+|\(\s*)?\d+(?:[.,]\d+)*\s*([A-Za-z]+)")


def _word_roles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, low, capital, dosed, n) of the items' words: written small within a text; written as a name (with a capital inside a sentence, or before a dose); occurrences."""
    for b in batches:
        seen: dict[str, list[int]] = {}
        for text in b.column("text").to_pylist():
            dosed = {m[1].lower() for m in _DOSE.finditer(text) if m[2].lower() in _UNITS}
            for m in _RAW.finditer(text):
                w = m.group()
                start = text[max(0, m.start() - 8) : m.start()].rstrip()
                role = seen.setdefault(w.lower(), [False, False, False, 0])
                role[0] |= w[0].islower()
                role[1] |= bool(w[0].isupper() and start and start[-1] not in ".!?:")
                role[2] |= w.lower() in dosed
                role[3] += 1
        roles = [pa.array([r[k] for r in seen.values()], pa.int64() if k == 3 else pa.bool_()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *roles], names=["word", "low", "capital", "dosed", "n"])


def plain_words(parts: DataFrame) -> DataFrame:
    """(word, n): the items' words that are no names, with their occurrences."""
    roles = parts.select("text").mapInArrow(_word_roles, "word string, low boolean, capital boolean, dosed boolean, n bigint")
    every = roles.groupBy("word").agg(F.max("low").alias("low"), F.max("capital").alias("capital"), F.max("dosed").alias("dosed"), F.sum("n").alias("n"))
    return every.filter("NOT dosed AND (low OR NOT capital)").select("word", "n")


def lexicon(parts: DataFrame, most: int = SHARED_WORDS, slots: bool = True) -> tuple[Lexicon, DataFrame | None]:
    """The items' words that are no names: those for every task and, with more than most of them, a table of the others.

    The most frequent ones are shared then, so that few words of a text are left to be joined. Where no slots are wanted
    every word stands for itself then.
    """
    plain = plain_words(parts)
    held = [r[0] for r in plain.select("word").limit(most + 1).collect()]
    if len(held) <= most:
        return Lexicon(held), None
    if not slots:
        return Lexicon(None), None
    plain = cut_lineage(plain)
    least, n = None, 0
    for r in sorted(plain.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        n += r.words
        if n > most:
            break
        least = r.n
    if least is None:
        return Lexicon([]), plain.select("word")
    return Lexicon(r[0] for r in plain.filter(F.col("n") >= least).select("word").collect()), plain.filter(F.col("n") < least).select("word")


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _code(word: str) -> int:
    """A 64-bit code of a template word, the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def window_hashes(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Hash of every run of width codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * _BASE + codes[k : k + n] * _MULT
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


class _Coder:
    """Template codes of words, kept between texts."""

    def __init__(self, lexicon: Lexicon):
        self.plain = lexicon.plain
        self.known = {w: np.uint64(_code(lexicon.template(w))) for w in lexicon.plain or ()}
        self.num, self.name = np.uint64(_code(_NUM)), np.uint64(_code(_NAME))
        self.known |= {u: np.uint64(_code(_UNIT)) for u in _UNITS}
        self.known |= {w: self.num for w in self.known if w.isdigit()}

    def codes(self, ws: list[str], own: Iterable[str] | None = None) -> np.ndarray:
        """own: further plain words among them."""
        known, num, name = self.known, self.num, self.name
        if self.plain is None:
            return np.fromiter((known[w] if w in known else num if w.isdigit() else np.uint64(_code(w)) for w in ws), np.uint64, len(ws))
        if own:
            more = {w: np.uint64(_code(w)) for w in own}
            return np.fromiter((known[w] if w in known else more[w] if w in more else num if w.isdigit() else name for w in ws), np.uint64, len(ws))
        return np.fromiter((known[w] if w in known else num if w.isdigit() else name for w in ws), np.uint64, len(ws))


_ARROW = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64()), ("win", pa.string())])
_SCHEMA = "id bigint, part int, pos int, hash bigint, win string"


def _windows(lexicon: Lexicon, wanted: np.ndarray | None):
    """Windows of (id, part, text) rows, or of (id, part, text, own) with the text's further plain words; only those with a wanted hash, if such are given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(lexicon)
        for b in batches:
            ids, parts, texts = b.column("id"), b.column("part"), b.column("text")
            further = b.column("own") if "own" in b.schema.names else None
            lo = 0
            while lo < b.num_rows:
                # Some hundred thousand words at a time, so that long arrays are hashed and looked up at once.
                rows, held, n = [], [], 0
                while lo < b.num_rows and n < 200_000:
                    text = texts[lo].as_py()
                    ws = words(text) if text else []
                    if len(ws) >= WINDOW:
                        rows.append(lo)
                        held.append(ws)
                        n += len(ws)
                    lo += 1
                if not rows:
                    continue
                every = [w for ws in held for w in ws]
                codes = coder.codes(every) if further is None else np.concatenate([coder.codes(ws, further[row].as_py()) for row, ws in zip(rows, held)])
                hashes = window_hashes(codes)
                ends = np.cumsum([len(ws) for ws in held])
                own = np.repeat(np.arange(len(held)), [len(ws) for ws in held])[: len(hashes)]
                good = np.arange(len(hashes)) + WINDOW <= ends[own]  # a window lies within one text
                if wanted is not None:
                    k = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
                    good &= wanted[k] == hashes if len(wanted) else False
                at = np.flatnonzero(good)
                begin = ends - [len(ws) for ws in held]
                for piece in range(0, len(at), 50_000):
                    p = at[piece : piece + 50_000]
                    row = pa.array(np.asarray(rows)[own[p]])
                    wins = pa.array([" ".join(every[i : i + WINDOW]) for i in p.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(row), parts.take(row), pa.array((p - begin[own[p]]).astype(np.int32)), pa.array(hashes[p]), wins], schema=_ARROW)

    return run


def _other_words(shared: Lexicon):
    """(key, word) of (key, text) rows: the words of a text whose template the shared words leave open, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("key"), b.column("text")
            rows, found = [], []
            for row in range(b.num_rows):
                other = {w for w in words(texts[row].as_py()) if w not in shared.plain and w not in _UNITS and not w.isdigit()}
                rows += [row] * len(other)
                found += other
                if found and (len(found) > 100_000 or row == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(found, pa.string())], names=["key", "word"])
                    rows, found = [], []

    return run


def with_own_words(texts: DataFrame, shared: Lexicon, others: DataFrame) -> DataFrame:
    """texts and a column own: their words that are among the others, by joins. Texts of one key would only see each other's plain words, which changes nothing."""
    keyed = texts.filter(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    found = keyed.select("key", "text").mapInArrow(_other_words(shared), "key bigint, word string").join(others, "word", "left_semi")
    return keyed.join(found.groupBy("key").agg(F.collect_set("word").alias("own")), "key", "left").drop("key")


def _parts(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("id"), F.posexplode(F.array("question", "rationale")).alias("part", "text")).filter(F.col("text").isNotNull()).distinct()


def shared_windows(documents: DataFrame, items: DataFrame, windows: int = SHARED_WINDOWS, most_words: int = SHARED_WORDS, slots: bool = True) -> DataFrame:
    """(doc_id, item_id, part, doc_pos, item_pos, doc_win, item_win): windows with one template.

    The same rows whatever the limits of what is shared. Without slots only equal windows are sure to be among them.
    """
    parts = _parts(items)
    known, others = lexicon(parts, most_words, slots)
    texts = documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("part"), "text")
    if others is not None:
        parts, texts = with_own_words(parts, known, others), with_own_words(texts, known, others)
    of_items = parts.mapInArrow(_windows(known, None), _SCHEMA)
    n = of_items.limit(windows + 1).count()
    wanted = None
    if n <= windows:
        wanted = np.unique(np.array([r[0] for r in of_items.select("hash").distinct().collect()], np.int64))
    of_docs = texts.mapInArrow(_windows(known, wanted), _SCHEMA)
    i = of_items.select("hash", F.col("id").alias("item_id"), "part", F.col("pos").alias("item_pos"), F.col("win").alias("item_win"))
    if wanted is not None:
        i = F.broadcast(i)
    d = of_docs.select("hash", F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), F.col("win").alias("doc_win"))
    return d.join(i, "hash").drop("hash")


def leaked(documents: DataFrame, items: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, item_id): documents that hold at least twelve consecutive words of an item; the same rows whatever the limits of what is shared."""
    return shared_windows(documents, items, slots=False, **limits).filter(F.col("doc_win") == F.col("item_win")).select("doc_id", "item_id").distinct()


def reparameterised(documents: DataFrame, items: DataFrame, plain: int = PLAIN, cover: float = COVER, **limits: int) -> DataFrame:
    """(doc_id, item_id, n_windows, n_changed): items found with other values in their slots, the renaming being consistent.

    A place of a document is held against the items most like it there only (the most equal words; all of them if several
    are), an occurrence needs a share cover of the windows of the item's question or rationale, and in it a name stands for
    one name, both ways. The same rows whatever the limits of what is shared.
    """
    pairs = F.arrays_zip(F.split("doc_win", " ").alias("d"), F.split("item_win", " ").alias("i"))
    both = shared_windows(documents, items, **limits).withColumn("z", pairs).withColumn("same", F.size(F.filter("z", lambda x: x["d"] == x["i"])))
    # Frames that many items share: a group is the items' windows of one template.
    most = Window.partitionBy("doc_id", "doc_pos")
    slots = both.withColumn("most", F.max("same").over(most)).filter((F.col("same") == F.col("most")) & (F.col("same") >= plain))
    # Windows of one alignment are one occurrence of the item; it is judged by itself.
    place = ["doc_id", "item_id", "part", "shift"]
    changes = slots.select("doc_id", "item_id", "part", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "item_pos", F.posexplode("z").alias("k", "z"))
    # A place of the item has one word in an occurrence, so a set of them is no longer than the item.
    words_at = F.collect_set(F.struct((F.col("item_pos") + F.col("k")).alias("slot"), F.col("z.d").alias("d"), F.col("z.i").alias("i")))
    found = changes.groupBy(*place).agg((F.count(F.lit(1)) / WINDOW).cast("bigint").alias("n"), words_at.alias("s"))
    whole_item = _parts(items).select(F.col("id").alias("item_id"), "part", (F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))) - WINDOW + 1).alias("of"))
    found = found.join(whole_item, ["item_id", "part"]).filter(F.col("n") >= cover * F.col("of"))
    # A name stands for one thing wherever it is repeated; equal numbers and units need not mean the same.
    names = F.filter("s", lambda x: ~x["i"].rlike("^[0-9]+$") & ~x["i"].isin(*sorted(_UNITS)))
    different = lambda body: F.size(F.array_distinct(F.transform(names, body)))
    renamed = different(lambda x: F.struct(x["i"], x["d"]))
    found = found.filter(F.exists("s", lambda x: x["d"] != x["i"]))  # a verbatim occurrence is no other version
    consistent = found.filter((renamed == different(lambda x: x["i"])) & (renamed == different(lambda x: x["d"])))
    changed = F.transform(F.filter("s", lambda x: x["d"] != x["i"]), lambda x: F.struct(F.col("part"), x["slot"]))
    # Slots changed in any occurrence, each place of the item once.
    whole = consistent.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(changed))).alias("c"))
    return whole.select("doc_id", "item_id", "n_windows", F.size("c").cast("bigint").alias("n_changed"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_documents): every item with the number of documents it leaked into, none included."""
    counts = leaked(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))
