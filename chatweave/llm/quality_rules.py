"""Operator 2: quality rules with risk-controlled thresholds (native).

Each document gets word statistics and a few rule values (symbols per word,
share of repeated lines, ...). A rule rejects values above its cutoff. The
cutoff is chosen per stratum (language) from labelled holdout documents: a
cutoff is *certified* if the exact binomial test rejects, at a corrected
level, that more than ``alpha`` of the stratum's good documents would be
rejected by it. P(Bin(n, alpha) <= k) <= level holds exactly if the
Clopper-Pearson upper bound for k of n is at most alpha. Correction: each
rule's share of ``alpha`` is alpha / rules, each (stratum, rule) is tested at
delta / (strata * rules) (Bonferroni), and within it the cutoffs are tested
from lenient to strict up to the first failure (fixed sequence, which needs no
further correction). So with probability 1 - ``delta`` no stratum loses more
than ``alpha`` of its good documents to the rules. Of the certified cutoffs
the one that gains most is taken (bad holdout documents it catches, less
``FALSE_COST`` for each good one), the most lenient of equals; a rule without a
gain is not used.

Defined results: null or empty text has no words and fails the base rules;
null language is a stratum of its own; a stratum without enough labels keeps
all that passes the base rules; labels that contradict each other, or are
null, are not used; an empty table gives an empty table; repeated rows are
judged alike. 3-word windows are compared by 64-bit hash within one text.
Everything is DataFrame functions; only words of one text are held at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import SPACE, join_small, let, stored

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Accepted false rejections among good documents of a stratum, and the
#: probability that any stratum exceeds it.
ALPHA, DELTA = 0.02, 0.05
#: How many caught documents a false rejection outweighs.
FALSE_COST = 10

#: rule -> (value, cutoffs from lenient to strict); rejected if value > cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / n_words", [4.0, 2.0, 1.0, 0.5, 0.35, 0.25, 0.15, 0.1]),
    "repeat_words": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines_per_word": ("n_dup_lines / n_words", [0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0]),
    "short_words": ("-word_chars / n_words", [-1.2, -1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5]),
}


def word_list(text: Column) -> Column:
    """The words of a text in order (empty for null)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice: sort the
    windows' (hash, position), keep those equal to a neighbour, and add up
    what each adds to the cover of the one before."""

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))))

    return let(words, of)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``STATISTICS`` (long) and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        word_list(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    symbols = (F.octet_length(t) - F.octet_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
    out = docs.withColumns({"_stats": stats, "n_symbols": symbols, "n_dup_lines": dup})
    out = out.withColumns({c: F.col("_stats")[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_stats")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Exact P(Bin(n, p) <= k), summed in logarithms; 1 from the mean on,
    where no test at a level below one half can reject."""
    odds = p / (1 - p)
    first = n * F.log1p(F.lit(-p))
    log_sum = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, j: let(
            a["term"] + F.log(F.greatest(n - j + 1, F.lit(1)).cast("double") / j * odds),
            lambda t: F.struct(t.alias("term"), (F.greatest(t, a["total"]) + F.log1p(F.exp(-F.abs(t - a["total"])))).alias("total")),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(F.exp(log_sum))


def select_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: ``_stratum`` and a cutoff per rule (null: not used).

    ``stats`` has doc_id, the stratum column and ``with_statistics``'s columns;
    ``labels`` has doc_id and quality (1 good, 0 bad)."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_good"), F.max("quality").alias("_max"))
        .where("_good = _max")
        .select("doc_id", "_good")
    )
    steps = F.flatten(F.array(*[
        F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.expr(value) > c).alias("hit"))
            for i, c in enumerate(cutoffs)
        ])
        for rule, (value, cutoffs) in RULES.items()
    ]))
    good, hit = F.col("_good") == 1, F.col("x.hit")
    counts = (
        stats.where(~F.col("base_failed"))
        .select("doc_id", F.coalesce(F.col(stratum), F.lit("und")).alias("_stratum"), *STATISTICS)
        .join(marks, "doc_id")
        .select("_stratum", "_good", F.explode(steps).alias("x"))
        .groupBy("_stratum", "x.rule", "x.step", "x.cutoff")
        .agg(F.count_if(good).alias("n_good"), F.count_if(good & hit).alias("false_hits"), F.count_if(~good & hit).alias("caught"))
    )
    families = W.partitionBy(F.lit(0))  # over strata x rules x cutoffs, not over documents
    sequence = W.partitionBy("_stratum", "rule").orderBy("step")
    tested = (
        counts.withColumn("_level", delta / (F.size(F.collect_set("_stratum").over(families)) * len(RULES)))
        .withColumn("_p", binomial_cdf(F.col("false_hits"), F.col("n_good"), alpha / len(RULES)))
        .withColumn("_failed", F.max((F.col("_p") > F.col("_level")).cast("int")).over(sequence))
        .withColumn("gain", F.col("caught") - FALSE_COST * F.col("false_hits"))
        .where("_failed = 0 AND gain > 0")
    )
    best = tested.groupBy("_stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    return best.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` and ``failed_rules`` (names) to rows with statistics."""
    joined = join_small(stats.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("und"))), cutoffs, ["_stratum"])
    fired = [F.when(F.expr(value) > F.col(f"_cut_{rule}"), F.lit(rule)) for rule, (value, _) in RULES.items()]
    failed = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*fired)))
    return joined.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0).drop("_stratum", *[f"_cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Columns ``keep`` of ``docs`` with statistics, ``base_failed``,
    ``failed_rules`` and ``kept``. Statistics are computed once and stored."""
    wanted = list(dict.fromkeys([*keep, "doc_id", stratum]))
    stats = stored(with_statistics(docs).select(*wanted, *STATISTICS, "base_failed"), "quality")
    cutoffs = stored(select_cutoffs(stats, labels, stratum, alpha, delta), "cutoffs")
    return judge(stats, cutoffs, stratum)
