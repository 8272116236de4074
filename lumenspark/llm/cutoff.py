"""Texts cut off before their end.

Pure SQL. Words are runs without white space, lower-cased, digits masked; they are
hashed, and the trigrams of every place of every different text are counted as
numbers in one pass: how often a sentence or text goes on after one and how often
one ends there. The final trigrams of all texts, whatever they end in, are looked up
by an equi-join; a text is cut where its last trigram is frequent inside sentences
and (almost) never ends one. Where that doesn't decide,
  * a bracket or quotation opened in the last sentence and never closed, a comma or
    other joining mark at the end, and a broken character leave a text unfinished;
  * a full stop settles it;
  * the last word may be half a word: the trigram as it stands is (nearly) unknown,
    but trigrams with a longer last word are known;
  * a trigram that ends some sentences and not others is looked up with four and five
    words and with the sentence's opening, which are counted for such trigrams only;
  * where a trigram is rare, the last two words, then the last one, decide.
A mark of omission is taken off first; it proves nothing by itself ("and so on...").

All counts are over all different texts: copies of a text count once, so that those of
a cut one don't vouch for each other. They are partly aggregated before the exchange.
Two of n different keys share a 64-bit number with a probability of n^2 / 2^65.

Defined cases: null and blank texts are no cases; texts of one or two words are
judged by what they have; null sources form a source of their own; repeated rows of
a question give one row; the report counts each (question, letter) once; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.session import cut_lineage

_MARK = r"(?:\\s*(?:…|\\.{2,}|\\[\\s*(?:…|\\.{2,})\\s*\\]|(?:\\.\\s){2,}\\.))+\\s*$"
_NUMBER = "[0-9]+(?:[.,:/-][0-9]+)*"

#: frequent enough to decide; share of ends below which a trigram doesn't end a text, and above whose complement it does
LEAST, SHARE = 8, 0.08

_CLOSERS = "\"”’)]"

#: The sentences of each text. Only a text whose last characters may be a mark of omission is searched for one.
_SENTENCES = """
SELECT h, marked, posexplode(sentences) AS (at, sentence), size(sentences) AS many
FROM (
  SELECT h, marked, split(regexp_replace(trim(translate(CASE WHEN marked THEN regexp_replace(text, '{mark}', '') ELSE text END, '\\n\\t\\r', '   ')), '([.!?。！？]["”’)\\\\]]*) ', '$1\\n'), '\\n') AS sentences
  FROM (SELECT h, text, CASE WHEN right(bare, 1) = '…' OR right(bare, 2) IN ('..', '.]', '…]', ' .', ' ]') THEN text RLIKE '{mark}' ELSE false END AS marked FROM (SELECT h, text, rtrim(text) AS bare FROM {texts})))
"""

#: Their words, the stop taken off the last one, and as numbers.
_WORDS = f"""
SELECT *, transform(word, v -> xxhash64(v)) AS w FROM (
  SELECT h, marked, at = many - 1 AS last, stopped, size(word) AS n, word, CASE WHEN contains(sentence, ': ') THEN coalesce(array_position(transform(word, v -> endswith(v, ':')), true), 0) ELSE 0 END AS colon,
    CASE WHEN at = many - 1 THEN sentence RLIKE '[,;:(\\\\[/&+=–—-]$|�' END AS joining,
    CASE WHEN at = many - 1 AND sentence RLIKE '[("“]' THEN regexp_replace(sentence, '\\\\([^()]*\\\\)|"[^"]*"|“[^“”]*”', '') RLIKE '[("“]' ELSE false END AS opened
  FROM (
    SELECT *, split(lower(regexp_replace(CASE WHEN contains(bare, '  ') THEN regexp_replace(bare, ' +', ' ') ELSE bare END, '{{number}}', '#')), ' ') AS word
    FROM (
      SELECT h, marked, at, many, sentence, stopped, CASE WHEN stopped THEN rtrim(left(closed, length(closed) - 1)) ELSE sentence END AS bare
      FROM (SELECT *, right(closed, 1) IN ('.', '!', '?', '。', '！', '？') AS stopped FROM (SELECT h, marked, at, many, trim(sentence) AS sentence, rtrim('{_CLOSERS}', trim(sentence)) AS closed FROM {{sentences}})))
    WHERE bare <> ''))
"""

#: Word i of a sentence as numbers: label before it or not, its two words before (ka) or one (kb), itself (c); what follows.
_PLACE = """
SELECT *, colon > 0 AND colon < i AS label,
  xxhash64(colon > 0 AND colon < i, get(w, i - 3), get(w, i - 2)) AS ka, xxhash64(colon > 0 AND colon < i, get(w, i - 2)) AS kb, get(w, i - 1) AS c,
  i = n AND stopped AS stop, i = n AND last AS final
FROM {words}
"""

#: The longer contexts of a trigram: the sentence's opening, the five words and the four words up to i.
_LONGER = """array(
  xxhash64(1, ka, c, CASE WHEN i >= 2 THEN get(w, 0) END, get(w, CASE WHEN i >= 2 THEN 1 ELSE 0 END)),
  xxhash64(2, ka, c, CASE WHEN i >= 5 THEN get(w, i - 5) END, CASE WHEN i >= 5 THEN get(w, i - 4) END),
  xxhash64(3, ka, c, CASE WHEN i >= 4 THEN get(w, i - 4) END))"""
_COUNT = "count_if(NOT stop AND NOT final) AS inside, count_if(stop) AS ends, count_if(final AND NOT stop) AS bare"


def _sql(df: DataFrame, text: str, view: str) -> DataFrame:
    own = {"{mark}": _MARK, "{number}": _NUMBER}
    for name, pattern in own.items():  # braces of a pattern are no parameters
        text = text.replace(name, pattern.replace("{", "{{").replace("}", "}}"))
    return df.sparkSession.sql(text.replace("{texts}", "{" + view + "}"), **{view: df})


def explanation_texts(generated: DataFrame, bank: DataFrame) -> DataFrame:
    """(question_id, letter, source, text): all letters of generated questions, letter A of the bank."""
    made = generated.select("question_id", "source", F.explode("explanations").alias("letter", "text"))
    kept = bank.select("question_id", "source", F.lit("A").alias("letter"), F.element_at("explanations", F.lit("A")).alias("text"))
    return made.select("question_id", "letter", "source", "text").unionByName(kept.select("question_id", "letter", "source", "text")).filter(F.col("text").isNotNull())


def judged(texts: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(question_id, letter, source, cut, rule) of every text that isn't blank; rule names what decided."""
    # Copies are found by a digest; each different text is counted and judged once.
    rows = texts.filter("trim(text) <> ''").withColumn("h", F.unhex(F.md5("text")))
    verdicts = _verdicts(rows.groupBy("h").agg(F.first("text").alias("text")), least, share)
    return rows.select("question_id", "letter", "source", "h").join(verdicts, "h").select("question_id", "letter", "source", "cut", "rule")


def _verdicts(texts: DataFrame, least: int, share: float) -> DataFrame:
    """(h, cut, rule) of different texts (h, text)."""
    spark = texts.sparkSession
    given = {"least": int(least), "share": float(share)}
    words = cut_lineage(_sql(_sql(texts, _SENTENCES, "texts"), _WORDS, "sentences"))  # texts are cut into words once
    places = _sql(spark.sql("SELECT last, stopped, n, colon, w, explode(sequence(1, n)) AS i FROM {w}", w=words), _PLACE, "words")
    grams = cut_lineage(spark.sql(f"SELECT label, ka, kb, c, {_COUNT} FROM {{p}} GROUP BY label, ka, kb, c", p=places))
    final = _sql(spark.sql("SELECT *, n AS i FROM {w} WHERE last", w=words), _PLACE, "words")
    final = spark.sql(f"SELECT h, marked, stopped, joining, opened, label, ka, kb, c, get(word, n - 1) AS word, {_LONGER} AS k FROM {{f}}", f=final)
    final = cut_lineage(final)
    add = "sum(inside) AS inside, sum(ends + bare) AS ends"
    asked = cut_lineage(
        spark.sql(
            f"""
WITH g AS (SELECT * FROM {{grams}}),
asked AS (SELECT DISTINCT label, ka, kb, c, word FROM {{final}}),
vocabulary AS (SELECT word, xxhash64(word) AS c FROM (SELECT DISTINCT explode(word) AS word FROM {{words}})),
-- the words that go on where a final word stops
longer AS (
  SELECT q.c, o.c AS o FROM (SELECT DISTINCT word, c, left(word, 3) AS p FROM asked) q
  JOIN (SELECT word, c, explode(array_distinct(array(left(word, 1), left(word, 2), left(word, 3)))) AS p FROM vocabulary) o
  ON q.p = o.p AND startswith(o.word, q.word) AND length(o.word) > length(q.word)),
pairs AS (SELECT kb, c, {add} FROM g GROUP BY kb, c),
alone AS (SELECT label, c, {add} FROM g GROUP BY label, c),
ones AS (SELECT c, sum(inside + ends) AS n FROM alone GROUP BY c),
halves AS (
  SELECT q.ka, q.c, sum(g.inside + g.ends + g.bare) AS n
  FROM asked q JOIN longer l ON q.c = l.c JOIN g ON g.ka = q.ka AND g.c = l.o GROUP BY q.ka, q.c),
wide AS (
  SELECT q.kb, q.c, sum(p.inside + p.ends) AS n
  FROM (SELECT DISTINCT kb, c FROM asked) q JOIN longer l ON q.c = l.c JOIN pairs p ON p.kb = q.kb AND p.c = l.o GROUP BY q.kb, q.c),
-- words that nobody else uses but that begin a word that is used
begun AS (
  SELECT DISTINCT l.c FROM longer l JOIN ones s ON l.c = s.c AND s.n <= 1 JOIN ones o ON l.o = o.c AND o.n > 1)
SELECT q.ka, q.c, coalesce(g.inside, 0) AS i3, coalesce(g.ends + g.bare, 0) AS e3, coalesce(p.inside, 0) AS i2, coalesce(p.ends, 0) AS e2,
  coalesce(o.inside, 0) AS i1, coalesce(o.ends, 0) AS e1, coalesce(h.n, 0) AS h3, coalesce(w.n, 0) AS h2, u.c IS NOT NULL AND length(q.word) > 1 AS begun
FROM asked q
LEFT JOIN g ON q.ka = g.ka AND q.c = g.c
LEFT JOIN pairs p ON q.kb = p.kb AND q.c = p.c
LEFT JOIN alone o ON q.label = o.label AND q.c = o.c
LEFT JOIN halves h ON q.ka = h.ka AND q.c = h.c
LEFT JOIN wide w ON q.kb = w.kb AND q.c = w.c
LEFT JOIN begun u ON q.c = u.c""",
            grams=grams, final=final, words=words,
        )
    )
    # Trigrams that end some sentences and not others: longer contexts of these alone are counted, in a second look at the words.
    unclear = spark.sql("SELECT ka, c FROM {asked} WHERE e3 + i3 >= {least} AND e3 >= {share} * (e3 + i3) AND i3 >= {share} * (e3 + i3)", asked=asked, **given)
    wider = spark.sql(f"SELECT p.stop, p.final, explode({_LONGER.replace('ka', 'p.ka').replace('c,', 'p.c,')}) AS k FROM {{p}} p LEFT SEMI JOIN {{u}} u ON p.ka = u.ka AND p.c = u.c", p=places, u=unclear)
    longer = spark.sql(f"SELECT k, inside, ends + bare AS ends FROM (SELECT k, {_COUNT} FROM {{wider}} GROUP BY k)", wider=wider)
    return spark.sql(
        """
WITH f AS (SELECT f.*, q.* EXCEPT (ka, c) FROM {final} f JOIN {asked} q ON f.ka = q.ka AND f.c = q.c),
-- only texts without a full stop ask for longer contexts
three AS (SELECT h, posexplode(k) AS (at, k) FROM f WHERE NOT stopped OR marked),
seen AS (
  SELECT h, max(CASE WHEN at = 0 THEN l.inside END) AS is, max(CASE WHEN at = 0 THEN l.ends END) AS es, max(CASE WHEN at = 1 THEN l.inside END) AS i5, max(CASE WHEN at = 1 THEN l.ends END) AS e5,
    max(CASE WHEN at = 2 THEN l.inside END) AS i4, max(CASE WHEN at = 2 THEN l.ends END) AS e4
  FROM three t JOIN {longer} l ON t.k = l.k GROUP BY h),
-- the text's own end is no evidence
e AS (
  SELECT f.h, marked, stopped, joining, opened, label, i3, e3 - 1 AS e3, i2, e2 - 1 AS e2, i1, e1 - 1 AS e1, h3, h2, begun,
    coalesce(is, 0) AS is, coalesce(es - 1, 0) AS es, coalesce(i5, 0) AS i5, coalesce(e5 - 1, 0) AS e5, coalesce(i4, 0) AS i4, coalesce(e4 - 1, 0) AS e4
  FROM f LEFT JOIN seen s ON f.h = s.h),
v AS (
  SELECT h, CASE
    WHEN i3 + e3 >= {least} AND e3 < {share} * (i3 + e3) THEN 'trigram'
    WHEN joining OR opened THEN 'open'
    -- a full stop settles what no frequent trigram speaks against
    WHEN stopped AND NOT marked THEN '-stop'
    -- half a word: what stands there is hardly ever a word of its own after the same words
    WHEN begun THEN 'half'
    WHEN h3 >= {least} AND i3 + e3 < {share} * h3 THEN 'half'
    WHEN is + es >= {least} AND (es < {share} * (is + es) OR is < {share} * (is + es)) THEN IF(es < is, '', '-') || 'opening'
    WHEN i5 + e5 >= {least} AND (e5 < {share} * (i5 + e5) OR i5 < {share} * (i5 + e5)) THEN IF(e5 < i5, '', '-') || 'five'
    WHEN i4 + e4 >= {least} AND (e4 < {share} * (i4 + e4) OR i4 < {share} * (i4 + e4)) THEN IF(e4 < i4, '', '-') || 'four'
    WHEN i3 + e3 >= {least} THEN '-trigram'
    WHEN h2 >= {least} AND i2 + e2 < {share} * h2 THEN 'half'
    WHEN i3 + e3 >= 2 AND (i3 = 0 OR e3 = 0) THEN IF(e3 = 0, '', '-') || 'trigram'
    WHEN i2 + e2 >= 2 AND (i2 = 0 OR e2 = 0) THEN IF(e2 = 0, '', '-') || 'two'
    WHEN i2 + e2 >= {least} THEN IF(e2 < {share} * (i2 + e2), '', '-') || 'two'
    WHEN i1 + e1 >= {least} THEN IF(e1 < {share} * (i1 + e1), '', '-') || 'one'
    WHEN label OR NOT marked THEN '-rare' ELSE 'mark' END AS rule FROM e)
SELECT h, NOT startswith(rule, '-') AS cut, rule FROM v""",
        final=final, asked=asked, longer=longer, **given,
    )


def cut_texts(texts: DataFrame) -> DataFrame:
    """(question_id, letter) of the texts cut before their end."""
    return judged(texts).filter("cut").select("question_id", "letter").distinct()


def cut_report(texts: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share_cut) of every source."""
    each = judged(texts).groupBy("source", "question_id", "letter").agg(F.max(F.col("cut").cast("int")).alias("cut"))
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("cut").cast("bigint").alias("n_cut"), F.round(F.avg("cut"), 6).alias("share_cut")
    )
