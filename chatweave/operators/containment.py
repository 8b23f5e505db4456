"""Exact substring-containment join without a nested loop.

``text ILIKE '%' || pattern || '%'`` is a theta join; planned directly it
becomes a broadcast nested-loop join costing |texts| x |patterns|. Here it
is an equi-join on one literal gram per pattern followed by the exact
predicate, so the work is proportional to the candidate pairs:

1. every distinct pattern lists its literal windows (no ``%``/``_``) of one
   width: the longest of ``LADDER`` that its longest literal run holds. A full
   phone number has at least ten digits, so it is looked up by 10-grams, which
   are selective where the thousand digit trigrams are not; shorter widths are
   for patterns that are too short;
2. texts emit their distinct substrings of just the widths some pattern uses,
   and only those that are a window of some pattern are kept (semi-join), so
   a gram that nobody looks for never reaches the verification;
3. every pattern picks the window that is rarest among the kept grams, joins
   the texts on it, and a pair stays only if the real predicate holds.
   Patterns without a literal character use the empty gram, which every text
   has; it is emitted only if there are such patterns, and is salted.

Any text containing the pattern contains each of its literal windows, so no
match is lost. Join strategies are left to adaptive execution: it broadcasts
a side only when its measured shuffle output is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions.text import like_literal
from chatweave.session import materialize

WILDCARDS = r"[%_]"
# Window widths, widest first.
LADDER = (10, 6, 4, 3, 2, 1)
# Salt values of the empty gram (used only by patterns without a literal
# character, which are replicated over all of them).
EMPTY_GRAM_SALTS = 64


def _windows(s: Column, length: Column) -> Column:
    """All substrings of ``s`` of ``length`` (empty array if too short)."""
    n = F.length(s)
    return F.when(
        (length > 0) & (n >= length),
        F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.substring(s, i, length)),
    ).otherwise(F.array().cast("array<string>"))


def pattern_windows(patterns: DataFrame, pattern_col: str, literal: bool) -> DataFrame:
    """``(_p, _width, _key)``: the candidate windows of every distinct
    lower-case pattern; width 0 and an empty key without a literal character."""
    p = F.lower(F.col(pattern_col))
    distinct = patterns.select(p.alias("_p")).where(F.col("_p").isNotNull()).distinct()
    runs = F.array(F.col("_p")) if literal else F.split(F.col("_p"), WILDCARDS)
    longest_run = F.aggregate(runs, F.lit(0), lambda acc, s: F.greatest(acc, F.length(s)))
    width = F.lit(0)
    for w in reversed(LADDER):
        width = F.when(longest_run >= w, F.lit(w)).otherwise(width)
    windows = _windows(F.col("_p"), F.col("_width"))
    if not literal:
        windows = F.filter(windows, lambda w: ~w.rlike(WILDCARDS))
    keys = F.when(F.col("_width") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(windows))
    return distinct.withColumn("_width", width).select("_p", "_width", F.explode(keys).alias("_key"))


def text_grams(texts: DataFrame, text_col: str, widths: list[int]) -> DataFrame:
    """``texts`` plus ``_t`` (lower-case text) and one row per distinct gram
    ``_gram`` of the given widths."""
    t = F.lower(F.col(text_col))
    grams = F.array_distinct(F.concat(
        F.array(F.lit("")) if 0 in widths else F.array().cast("array<string>"),
        *[_windows(t, F.lit(w)) for w in widths if w],
    ))
    return texts.withColumn("_t", t).withColumn("_gram", F.explode(grams))


def containment_join(
    texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str, literal: bool = False
) -> DataFrame:
    """All pairs (texts row, patterns row) with ``text ILIKE '%pattern%'``.

    ``%`` and ``_`` inside a pattern stay wildcards (with ``literal=True`` they
    are ordinary characters); a backslash is an ordinary character. Columns of
    both inputs are kept (names must differ).
    """
    windows = materialize(pattern_windows(patterns, pattern_col, literal))
    widths = sorted(r["_width"] for r in windows.select("_width").distinct().collect())  # at most len(LADDER) + 1
    wanted = windows.select(F.col("_key").alias("_gram")).distinct()
    grams = text_grams(texts, text_col, widths).join(wanted, "_gram", "left_semi")
    freq = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = (
        windows.join(freq, windows["_key"] == freq["_gram"], "left")
        .groupBy("_p")
        .agg(F.min(F.struct(F.coalesce(F.col("_n"), F.lit(0)).alias("n"), F.col("_key").alias("k"))).alias("_best"))
        .select("_p", F.col("_best.k").alias("_key"))
    )
    inside = F.instr(F.col("_t"), F.col("_p")) > 0
    if literal:
        verify = inside
    else:
        like = F.like(F.col("_t"), F.concat(F.lit("%"), like_literal(F.col("_p")), F.lit("%")))
        verify = F.when(F.col("_p").rlike(WILDCARDS), like).otherwise(inside)
    salt = F.when(F.col("_gram") == "", F.pmod(F.xxhash64("_t"), F.lit(EMPTY_GRAM_SALTS)).cast("int"))
    salted = grams.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    salts = F.when(
        F.col("_key") == "", F.sequence(F.lit(0), F.lit(EMPTY_GRAM_SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    keys = keys.withColumn("_ksalt", F.explode(salts))
    matched = (
        keys.join(salted, (keys["_key"] == salted["_gram"]) & (keys["_ksalt"] == salted["_salt"]), "inner")
        .where(verify)
        .drop("_key", "_gram", "_t", "_ksalt", "_salt")
    )
    pats = patterns.withColumn("_p", F.lower(F.col(pattern_col)))
    return pats.join(matched, "_p", "inner").drop("_p")
