"""Scalar column expressions for message texts, addresses and chat names.

Everything here is a built-in Spark expression (JVM side, whole-stage
codegen); no Python runs per row.
"""

from __future__ import annotations

import functools
import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference for equal results.
# ---------------------------------------------------------------------------
# Link pattern. The reference writes it as an alternation of single-character
# classes plus percent-escapes under `+`; the union of those classes is the
# one class below (space, "!", the range "$" to "_", and "a" to "z"), so this
# flat form matches the same text. The flat form matters: Java regex recurses
# once per repetition of an alternation and overflows its stack on long links.
LINK_PATTERN = r"https?://[ !$-_a-z]+"
# A "word" character is the reference's Unicode-aware \w (letters, numbers,
# underscore). It is built from the rule below (``word_class``): Java's
# plain \w is ASCII only and its \p{L} follows an older Unicode version.
# Line terminators recognised by str.splitlines(), in regex form:
# CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR.
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"
# Separator between sender and text in a formatted line.
SENDER_SEPARATOR = ": "
# Phone numbers must have 10 to 15 digits after cleaning.
PHONE_MIN_DIGITS = 10
PHONE_MAX_DIGITS = 15
# Messages of this associated_message_type are plain texts.
STANDARD_MESSAGE_TYPE = 0
# ---------------------------------------------------------------------------


def _class_from_rule(pred) -> str:
    """Regex class body listing every code point for which ``pred`` holds.

    Built from a rule instead of a hand-written table; the syntax
    ``\\x{...}`` is understood by Java regex and by RE2.
    """
    ranges: list[tuple[int, int]] = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if pred(chr(cp)):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1] = (ranges[-1][0], cp)
            else:
                ranges.append((cp, cp))
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


@functools.lru_cache(maxsize=None)
def digit_class() -> str:
    """Characters that count as digits for phone cleaning (str.isdigit):
    decimal digits plus superscript, subscript and circled digits."""
    extra = _class_from_rule(lambda c: c.isdigit() and not c.isdecimal())
    return r"\p{Nd}" + extra


@functools.lru_cache(maxsize=None)
def word_class() -> str:
    """Characters that the reference's ``\\w`` matches, as explicit ranges
    (used as is by RE2 in the SQL oracles)."""
    word = re.compile(r"\w")
    return _class_from_rule(lambda c: word.match(c) is not None)


_JAVA_WORD = r"\p{L}\p{N}_"


@functools.lru_cache(maxsize=4)
def _jvm_word_class(jvm_id: int) -> str:
    """The same set for Java regex, fast: Java's native letter/number
    classes plus the few code points it does not know (its Unicode tables
    are older), consulted only above the lowest of them. Computed once on
    the driver JVM with two ``replaceAll`` calls; falls back to the explicit
    ranges if Java counts a character the rule does not."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.getActiveSession().sparkContext._jvm
    word = re.compile(r"\w")
    chars = [chr(cp) for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF]
    words = "".join(c for c in chars if word.match(c))
    others = "".join(c for c in chars if not word.match(c))
    pattern = jvm.java.util.regex.Pattern
    missing = pattern.compile(f"[{_JAVA_WORD}]").matcher(jvm.java.lang.String(words)).replaceAll("")
    extra = pattern.compile(f"[^{_JAVA_WORD}]").matcher(jvm.java.lang.String(others)).replaceAll("")
    if extra:
        return word_class()
    if not missing:
        return _JAVA_WORD
    present = set(missing)
    lo = min(ord(c) for c in missing)
    return _JAVA_WORD + f"[\\x{{{lo:x}}}-\\x{{10ffff}}&&[{_class_from_rule(lambda c: c in present)}]]"


def spark_word_class() -> str:
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    if active is None:
        return word_class()
    try:
        return _jvm_word_class(id(active.sparkContext._jvm))
    except Exception:  # no JVM (e.g. Spark Connect): explicit ranges
        return word_class()


def word_char() -> str:
    """One word character, for Spark (Java regex)."""
    return f"[{spark_word_class()}]"


def non_word_run() -> str:
    """A run of non-word characters, for Spark (Java regex)."""
    return f"[^{spark_word_class()}]+"


def portable_word_char() -> str:
    return f"[{word_class()}]"


def portable_non_word_run() -> str:
    return f"[^{word_class()}]+"


@functools.lru_cache(maxsize=None)
def whitespace_class() -> str:
    """Characters that str.isspace() accepts (Unicode \\s of the reference)."""
    return _class_from_rule(str.isspace)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- addresses (H1-H3) ------------------------------------------------------

def clean_phone(c) -> Column:
    """Keep only the digits of a phone number."""
    return F.regexp_replace(_col(c), f"[^{digit_class()}]", "")


def phone_status(cleaned) -> Column:
    """'ok', 'too short' (<10 digits) or 'too long' (>15 digits)."""
    n = F.length(_col(cleaned))
    return (
        F.when(n < PHONE_MIN_DIGITS, F.lit("too short"))
        .when(n > PHONE_MAX_DIGITS, F.lit("too long"))
        .otherwise(F.lit("ok"))
    )


def is_email(c) -> Column:
    return _col(c).contains("@")


def clean_address(c) -> Column:
    """Emails (anything with '@') unchanged, phone numbers reduced to digits."""
    return F.when(is_email(c), _col(c)).otherwise(clean_phone(c))


def address_status(c) -> Column:
    return F.when(is_email(c), F.lit("ok")).otherwise(phone_status(clean_phone(c)))


# --- chat names (H4, H5) ----------------------------------------------------

def chat_slug(c) -> Column:
    """Folder-safe name: whitespace runs become '_', non-word characters go.

    An empty result falls back to the first 16 hex digits of SHA-256 of the
    name (stable across processes, unlike a salted in-process hash).
    """
    name = _col(c)
    underscored = F.regexp_replace(name, f"[{whitespace_class()}]+", "_")
    slug = F.regexp_replace(underscored, non_word_run(), "")
    return F.when(slug == "", F.substring(F.sha2(name, 256), 1, 16)).otherwise(slug)


# --- message texts (B5, B6, H6, H7) -------------------------------------------

def has_word_char(c) -> Column:
    return _col(c).rlike(word_char())


def remove_links(c) -> Column:
    return F.regexp_replace(_col(c), LINK_PATTERN, "")


def flatten_lines(c) -> Column:
    """``' '.join(text.splitlines())``: one trailing terminator is dropped,
    every other terminator becomes a space."""
    no_tail = F.regexp_replace(_col(c), LINE_BREAK + r"\z", "")
    return F.regexp_replace(no_tail, LINE_BREAK, " ")


def format_line(sender, text) -> Column:
    """``sender: text`` on one line (null if either part is null)."""
    return flatten_lines(F.concat(_col(sender), F.lit(SENDER_SEPARATOR), _col(text)))


def like_literal(c) -> Column:
    """Escape the escape character so a LIKE pattern treats backslashes as
    ordinary characters (the store's LIKE has no escape character)."""
    return F.regexp_replace(_col(c), r"\\", r"\\\\")
