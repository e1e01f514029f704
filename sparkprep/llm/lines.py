"""Line-first cleaning.

Every line is judged by itself on its punctuation, as navigation and as boilerplate; lines that fail go, and a document
that loses too much of its text that way is rejected. Only column functions are used.

Defined cases: a null or empty text has no words and fails; a line without a word is neutral: it neither stays in the
clean text nor counts as lost; white space at the end of a line (of CRLF too) says nothing of how it ends; equal documents
get equal results; very long texts are read whole; other columns are kept by ``clean`` and ignored by the query; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, text_of

#: The rules of a line.
END = tuple(".!?:;…\"”»')]。！？।॥؟۔؛։")
SPACE = " \t\n\x0b\x0c\r\u00a0"
SYMBOLS = r"[^#*$%&|<>{}~^=_\\]+"
SEPARATOR = r"[^|»>•]+"
NAVIGATION = r"^\W*(home|menu|next|previous|prev|back|top|login|log in|sign in|sign up|register|search|share|contact|contact us|about|about us|help|faq|sitemap|read more|more|subscribe|skip to content)\W*$"
NAVIGATION_CHARS = 40
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright ©", "copyright (c)", "enable javascript",
    "click here", "lorem ipsum", "powered by", "follow us on", "subscribe to our", "accept cookies", "accept all cookies",
)
#: A line fails beyond these: share of symbols among its characters, and separators ("|", "»", ">") for each word.
SYMBOL_SHARE = 0.10
SEPARATORS = 0.34
#: A line of this many words or more that ends without punctuation fails the punctuation rule.
OPEN_WORDS = 30
#: A document is rejected when more than this share of its word characters was in failing lines.
LOST = 0.5
#: The contract's base rules.
LEAST_WORDS = 10
WINDOW = 5
REPEATED = 20


SPACE_RUN, WORD_RUN = r"[\x20\x09-\x0D]+", WORD


def words_of(text: Column) -> Column:
    """The words; a text without one has none."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def spaces(text: Column) -> Column:
    """How many characters of white space a text has."""
    return F.length(F.regexp_replace(text, WORD_RUN, ""))


def fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule."""

    def judged(v: Column) -> Column:
        chars, gaps, low = v["chars"], v["gaps"], v["low"]
        breaks = F.length(F.regexp_replace(line, SEPARATOR, ""))
        symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
        navigation = (breaks >= 2) & (breaks > F.lit(SEPARATORS) * gaps) | (F.length(line) <= NAVIGATION_CHARS) & low.rlike(NAVIGATION)
        punctuation = (symbols > F.lit(SYMBOL_SHARE) * chars) | (gaps >= OPEN_WORDS) & ~F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1)).isin(*END)
        boilerplate = low.contains(BOILERPLATE[0])
        for phrase in BOILERPLATE[1:]:
            boilerplate = boilerplate | low.contains(phrase)
        return punctuation | navigation | boilerplate

    gap = spaces(line)
    return let(F.struct(gap.alias("gaps"), (F.length(line) - gap).alias("chars"), F.lower(line).alias("low")), judged)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside a window of ``size`` words that the text has twice or more, the first time included.

    Windows are compared by 64-bit hashes. In most texts all differ, and the count is 0. Else hashes are sorted with
    their places; the places with an equal neighbour are those of repeated windows, and cover ``size`` words each, or as
    many as lie before the next one.
    """

    def hashes(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(size)]))

    def places_of(found: Column) -> Column:
        same = lambda i, j: F.get(found, i)["h"] == F.get(found, j)["h"]
        at = F.sequence(F.lit(0), F.size(found) - 1)
        repeated = F.filter(at, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(repeated, lambda i: F.get(found, i)["at"]))

    def covered(found: Column) -> Column:
        gaps = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def count(h: Column) -> Column:
        sorted_ = F.sort_array(F.zip_with(h, F.sequence(F.lit(1), F.size(h)), lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(sorted_, places_of), covered))

    # the words are bound too: an optimizer that moves a filter on the result would else split the text for every word
    return let(words, lambda w: F.when(F.size(w) <= size, 0).otherwise(let(hashes(w), count))).cast("long")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the contract, ``__clean`` (the lines that stay) and ``__lost`` (share of word characters)."""
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = lambda c: F.length(c) - spaces(c)
    return (
        docs.withColumn("__lines", lines)
        .withColumn("__words", words_of(text_of(text)))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", length(text_of(text)).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text_of(text), r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("__words")))
        .withColumn("__clean", F.array_join(F.filter("__lines", lambda x: ~fails(x)), "\n"))
        .withColumn("__lost", F.when(F.col("word_chars") == 0, 1.0).otherwise(1 - length(F.col("__clean")) / F.col("word_chars")))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("__lost") <= LOST))
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with ``text`` cut to the lines that stay; other columns as they are."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("__row"), F.col(text))
    kept = judge(packed, text).where("kept")
    return kept.select(*[(F.col("__clean") if c == text else F.col("__row")[c]).alias(c) for c in names])


def verdicts(docs: DataFrame) -> DataFrame:
    """The query's digest by document."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("__lost", 6).alias("lost")
    )
