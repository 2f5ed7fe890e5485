"""Line-first cleaning and rejection of documents, in DataFrame functions only.

Each line is judged by its punctuation, as navigation and as boilerplate; lines
that fail are removed, and a document that loses too much of its text is
rejected, as is one that fails the base rules.

Arrays that a lambda looks into by index are bound by ``_let``: inside a lambda
an outer expression would be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# Symbols, or runs of ! and ?, per 100 words of a line.
MAX_NOISE_PERCENT = 30
# Words per part of a line cut by separators, up to which it is navigation.
NAVIGATION_WORDS = 4
MAX_REMOVED_PERCENT = 50

BLANK = r"[\x20\x09-\x0D]"
# Marks that end a sentence, by script: Latin, Greek, Armenian, Arabic, Urdu, Devanagari, Tibetan, Burmese, Ethiopic,
# Khmer, Mongolian, CJK.
STOPS = ".!?…‽\u037e\u0589\u061f\u06d4।॥\u0f0d\u104a\u104b\u1362\u1367\u17d4\u17d5\u1803。！？．｡"
# A sentence ends somewhere in the line.
SENTENCE_END = rf"[{STOPS}][\"'”’»)\]」』）】》]*([\x20\x09-\x0D]|$)"
# A line begins within a sentence: in lower case.
WITHIN_SENTENCE = r"^[\x20\x09-\x0D]*\p{Ll}"
SEPARATORS = "[|»›•·>]"
SEPARATOR = rf"(^|[\x20\x09-\x0D]){SEPARATORS}($|[\x20\x09-\x0D])"
SHOUT = r"[!?]{2,}"
# The phrase begins where no letter stands before, so most places are passed by at once.
BOILERPLATE = (r"(?i)(^|[^a-z])(all rights reserved|cookies? (policy|settings)|accept (all )?cookies|terms of (use|service)"
               r"|privacy policy|sign (in|up)|log ?in to|subscribe to|click here|enable javascript|javascript is"
               r"|lorem ipsum|powered by|licensed under|released under the|copyright ©|skip to content)")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _symbols(text: Column) -> Column:
    return _count(text, f"[{SYMBOLS}]")


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash.  A plain sort of the hashes tells most
    documents that they repeat nothing; only the others sort pairs of hash and position.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def within(p: Column) -> Column:
            last = F.size(p)
            places = F.filter(F.sequence(F.lit(0), last - 1), lambda k: (
                F.when(k > 0, p[k - 1]["h"] == p[k]["h"]).otherwise(False)
                | F.when(k < last - 1, p[k + 1]["h"] == p[k]["h"]).otherwise(False)))
            marked = F.flatten(F.transform(places, lambda k: F.transform(
                F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: p[k]["i"] + d)))
            return F.size(F.array_distinct(marked))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(pairs, within))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, 0).otherwise(_let(windows, covered))


def line_passes(line: Column, after: Column) -> Column:
    """Whether a line with at least one word is kept; ``after``: the next such line, or null.

    A line that is wrapped within a sentence, which goes on in lower case on the
    next line, is treated like one with an end of a sentence.
    """
    words = _count(line, common.WORD)
    parts = F.when(line.rlike(SEPARATORS), _count(line, SEPARATOR)).otherwise(0)
    noise = F.greatest(_symbols(line), _count(line, SHOUT))
    navigation = (parts >= 3) & (words <= NAVIGATION_WORDS * (parts + 1) + parts)
    whole = line.rlike(SENTENCE_END) | F.coalesce(after.rlike(WITHIN_SENTENCE), F.lit(False))
    return (whole & ~navigation & ~line.rlike(BOILERPLATE)
            & (noise * 100 <= words * MAX_NOISE_PERCENT))


def verdict(text: Column) -> Column:
    """Struct of the base figures, the verdict and the cleaned text."""

    def figures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(common.WORD))

        def judged(lines: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _symbols(text).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(words).cast("long").alias("n_repeat_words"),
                F.size(lines).alias("n_lines"), F.filter(
                    lines, lambda line, i: line_passes(line, F.get(lines, i + 1))).alias("clean"))

        return _let(lines, judged)

    def decided(f: Column) -> Column:
        failed = ((f["n_words"] < MIN_WORDS)
                  | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEATED_PERCENT))
        clean = F.array_join(f["clean"], "\n")
        removed = F.when(F.size(f["clean"]) == f["n_lines"], F.lit(0).cast("long")).otherwise(
            f["n_words"] - common.count_words(clean))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

        def judged(removed: Column) -> Column:
            return F.struct(*[f[n].alias(n) for n in names], clean.alias("clean_text"), failed.alias("base_failed"),
                            removed.alias("n_removed_words"),
                            (~failed & (removed * 100 <= f["n_words"] * MAX_REMOVED_PERCENT)).alias("kept"))

        return _let(removed, judged)

    return _let(_let(_words(text), figures), decided)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_removed_words, clean_text, a row per row of ``docs``.

    Uses doc_id and text; further columns are ignored.  A null text has no words
    and fails; null and repeated doc_ids are kept as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "n_removed_words", "clean_text")
    return (common.take(docs, "doc_id", "text").select("doc_id", verdict(text).alias("v"))
            .select("doc_id", *[F.col("v")[n].alias(n) for n in names]))


def keep(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned text, in the columns doc_id, text, lang, source, n_chars.

    The verdict is filtered within a generator: a filter of its own would be
    pushed below it and make Spark compute the verdict twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    passed = F.explode(F.filter(F.array(verdict(text)), lambda v: v["kept"])).alias("v")
    return (common.take(docs, "doc_id", "text", "lang", "source").select("doc_id", "lang", "source", passed)
            .select("doc_id", F.col("v.clean_text").alias("text"), "lang", "source",
                    F.length("v.clean_text").cast("long").alias("n_chars")))


def op4_quality_rules(spark, folder):
    """Quality verdicts of all documents."""
    return judge(common.table(spark, folder, "documents")).drop("clean_text")


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, {_duck(common.WORD)}) AS w FROM docs),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM docs),
judged AS (
  SELECT rid, line, lead(line) OVER (PARTITION BY rid ORDER BY n) AS after, len(regexp_extract_all(line, {_duck(common.WORD)})) AS words,
    len(regexp_extract_all(line, {_duck(SEPARATOR)})) AS parts,
    greatest(len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g')),
             len(regexp_extract_all(line, {_duck(SHOUT)}))) AS noise
  FROM lines WHERE regexp_matches(line, {_duck(common.WORD)})),
per_line AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(CASE WHEN (regexp_matches(line, {_duck(SENTENCE_END)})
        OR coalesce(regexp_matches(after, {_duck(WITHIN_SENTENCE)}), false))
      AND NOT (parts >= 3 AND words <= {NAVIGATION_WORDS} * (parts + 1) + parts)
      AND NOT regexp_matches(line, {_duck(BOILERPLATE)})
      AND noise * 100 <= words * {MAX_NOISE_PERCENT} THEN words ELSE 0 END) AS left_words
  FROM judged GROUP BY rid),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT rid, i FROM (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w) - coalesce(left_words, 0) AS BIGINT) AS n_removed_words
  FROM split LEFT JOIN per_line USING (rid) LEFT JOIN repeated USING (rid)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} AS base_failed
  FROM base)
SELECT *, NOT base_failed AND n_removed_words * 100 <= n_words * {MAX_REMOVED_PERCENT} AS kept FROM failed
"""
