"""Text functions as column expressions: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of search terms. Fixed values.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "der", "die", "en", "for", "from", "in", "is", "it", "la", "of", "on", "or", "that", "the", "to", "und", "was", "with")

#: A name of up to 64 signs that begins with a letter or digit, labels of up to 63 without hyphens at their ends, and letters.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"
#: The same for Java's patterns: no sign of a name is an @, so nothing is found by giving signs back.
EMAIL_ONCE = EMAIL.replace("{0,63}@", "{0,63}+@", 1)
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
LONG_NUMBER = r"\b[0-9]{13,19}\b"
SECRET = r"(password=[A-Za-z0-9]{8,}|token = \"[0-9a-f]{16,}\"|AKIA[0-9A-Z]{16})"


def count_of(text: Column, pattern: str, sign: str) -> Column:
    """How often a pattern is met; texts without a sign that every match holds are not searched. Null of null."""
    return F.when(~F.contains(text, F.lit(sign)), F.lit(0)).otherwise(F.regexp_count(text, F.lit(pattern))).cast("long")


def whitespace_normalised(text: Column) -> Column:
    """One space for each stretch of blanks in a line, no blanks around lines, at most one blank line."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def match_normalised(text: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, single blanks."""
    plain = F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", " ")
    return F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " "))


def cache_key(text: Column) -> Column:
    """What equal questions have in common: case, blanks and closing marks don't count."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r]+", " ")), "[?.! ]+$", "")


def dehyphenated(text: Column) -> Column:
    """Words that were cut at a line's end, joined again."""
    return F.regexp_replace(text, "([a-z])-\n([a-z])", "$1$2")


def words(text: Column) -> Column:
    """Words as they stand, between blanks."""
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Search terms: lower-case words of letters and digits, without stop words, plural endings folded."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(plain, lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.transform(
        kept,
        lambda w: F.when(w.rlike("[a-z]{2}ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("[a-z]{3}[^s]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w),
    )


def token_estimate(text: Column) -> Column:
    """About how many tokens: four ASCII signs, four other bytes or two digits make one."""
    digits = F.regexp_count(text, F.lit("[0-9]"))
    plain = F.regexp_count(text, F.lit("[\\x00-\\x7F]")) - digits
    rest = F.octet_length(text) - F.regexp_count(text, F.lit("[\\x00-\\x7F]"))
    return F.ceil(digits / 2 + plain / 4 + rest / 4).cast("long")


def word_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of words; the last window is the first to reach the end."""
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * (size - overlap))).otherwise(F.array().cast("array<int>"))


def shingles(tokens: Column, width: int) -> Column:
    """Distinct runs of words; all words as one if there are fewer.

    The words are joined with their neighbours place by place: a slice for each run would copy all words for each.
    """
    count = F.greatest(F.size(tokens) - width + 1, F.lit(1))
    runs = F.slice(tokens, F.lit(1), count)
    for j in range(1, width):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(j + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(runs)


def bucket(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 that follows from the key and the seed alone."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / float(16**12)


def noisy_or(signals: list[tuple[Column, float]]) -> Column:
    """The chance that at least one of some independent signals, each with a weight, is right."""
    rest = F.lit(1.0)
    for holds, weight in signals:
        rest = rest * F.when(holds, F.lit(1.0 - weight)).otherwise(F.lit(1.0))
    return 1.0 - rest
