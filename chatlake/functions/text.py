"""Scalar text functions as Spark Column expressions (JVM side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split()/str.strip() see it: the Unicode
# White_Space set ((?U)\s in Java regex) plus the four information
# separators U+001C..U+001F. Possessive runs keep the matcher linear.
WS_CLASS = r"\s\x1C-\x1F"
NON_WS_RUN = rf"(?U)[^{WS_CLASS}]++"
# the look-behind lets only the first character of an inner run try the end
STRIP_RE = rf"(?U)\A[{WS_CLASS}]++|(?<![{WS_CLASS}])[{WS_CLASS}]++\z"
# Word tokens for message normalisation: letters/digits, an optional leading
# '@' (so a mention like '@my.bot' survives) and inner . _ ' - joins.
TOKEN_RE = r"@?[\p{L}\p{N}]+(?:[._'-][\p{L}\p{N}]+)*"
# Terms for TF-IDF: plain letter/digit runs.
TERM_RE = r"[\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text) -> Column:
    """Number of whitespace-separated words; empty or blank text gives 0 (STR-6)."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(NON_WS_RUN)), F.lit(0)).cast("long")


def strip(text) -> Column:
    """Python-style strip of leading and trailing whitespace (STR-9)."""
    return F.regexp_replace(_c(text), STRIP_RE, "")


def remove_newlines(text) -> Column:
    return F.regexp_replace(_c(text), "\n", "")


def normalize(text) -> Column:
    """Lower-case, keep word tokens, drop punctuation, join with one space (STR-1)."""
    return F.array_join(F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_RE), 0), " ")


def terms(text) -> Column:
    """Array of lower-cased letter/digit terms (for TF-IDF and hashed vectors)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM_RE), 0)


def line(sender, message) -> Column:
    """'sender: message' (STR-2)."""
    return F.concat(_c(sender), F.lit(": "), _c(message))


def split_lines(text) -> Column:
    return F.split(_c(text), "\n")


def clean_content(content, mentions) -> Column:
    """A message's text with its '<@id>' tokens as '@name', by the (id, name) pairs
    that the message itself carries (STR-13); other ids stay as they are. The text
    is cut at its tokens once, so a name that looks like one is not read again."""
    token = r"<@!?(\d+)>"
    parts = F.split(_c(content), token.replace("(", "").replace(")", ""), -1)
    ids = F.regexp_extract_all(_c(content), F.lit(token), 1)
    said = F.regexp_extract_all(_c(content), F.lit(token), 0)

    def named(i, as_is):
        known = F.filter(_c(mentions), lambda m: (m["id"] == i) & m["name"].isNotNull())
        return F.coalesce(F.concat(F.lit("@"), F.get(known, F.lit(0))["name"]), as_is)

    shown = F.zip_with(F.zip_with(ids, said, lambda i, s: F.struct(i.alias("i"), s.alias("s"))), F.slice(parts, 2, 1 << 30),
                       lambda x, rest: F.concat(named(x["i"], x["s"]), rest))
    return F.when(F.size(ids) == 0, _c(content)).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(shown, "")))


def parse_command_user(text) -> Column:
    """User name of a command line (STR-10).

    Words = whitespace split. If word 0 starts with '!' and there are at
    least two words, the first two are dropped; the user is word 0 of what is
    left, NULL when nothing is left.
    """
    words = F.regexp_extract_all(_c(text), F.lit(NON_WS_RUN), 0)
    drop = (F.size(words) >= 2) & F.startswith(F.element_at(words, 1), F.lit("!"))
    rest = F.when(drop, F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(1))))\
        .otherwise(words)
    rest = F.when(drop & (F.size(words) == 2), F.array().cast("array<string>")).otherwise(rest)
    return F.try_element_at(rest, F.lit(1))


def command_rest(text) -> Column:
    """The text after the user word of a command line, words joined by one space."""
    words = F.regexp_extract_all(_c(text), F.lit(NON_WS_RUN), 0)
    drop = (F.size(words) >= 2) & F.startswith(F.element_at(words, 1), F.lit("!"))
    start = F.when(drop, F.lit(4)).otherwise(F.lit(2))
    n = F.size(words) - start + 1
    return F.when(n > 0, F.array_join(F.slice(words, start, F.greatest(n, F.lit(1))), " "))\
        .otherwise(F.lit(""))


def split_once(text, sep: str = ":") -> Column:
    """Split on the first separator only: array of 1 or 2 parts (STR-5)."""
    return F.split(_c(text), sep, 2)


def iso_text(ts) -> Column:
    """ISO-8601 text as Python's datetime.isoformat() writes it: the fraction
    is left out when the microseconds are zero (DT-1)."""
    base = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(_c(ts), ".SSSSSS")
    return F.when(frac == ".000000", base).otherwise(F.concat(base, frac))
