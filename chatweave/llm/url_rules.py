"""Operator 6: URL rules by a sort-merge range join.

A url is read as host and path, and a rule as host and path prefix. With the
host's labels reversed ("com.example.www") and a separator before the path, a
rule covers one interval of keys: those that begin with its own key. As a
rule also covers subdomains with a path prefix, a url is filed under each of
its host's ancestors ("com", "com.example", ...) with its whole path.

Keys are dealt to ranges cut at quantiles of a bounded hash sample; ties are
cut by row number, so one hot url spreads over ranges. A rule goes to every
range its interval meets: only nested rules meet a cut, so that adds at most
a rule per cut and level of nesting. In a range, rules and urls are swept in
key order with a stack of the active nested rules; its top is the longest rule
for a key. The longest over a url's ancestors wins (ties: longer host first).

Defined results: a null url, or one without "://", has empty host and path;
no rule fits an empty host; urls that no rule fits get ``DEFAULT``; equal
rules that disagree: block wins; null rules are ignored; repeated rows get
equal verdicts; an empty table gives an empty table; without rules all urls
get the default.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import stored

SEPARATOR, DEFAULT = "\x01", "allow"
RANGE_ROWS, SAMPLE_PER_RANGE, MOST_RANGES = 20_000, 20, 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = chr(0x10FFFF)


def split_url(url: Column) -> tuple[Column, Column]:
    def group(k: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))

    return F.translate(group(1), UPPER, LOWER), group(2)


def ancestor_keys(host: Column, path: Column) -> Column:
    """A key per ancestor of the host, the host itself last."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(SEPARATOR), path))


def rule_rows(rules: DataFrame) -> DataFrame:
    """rules: (rule, verdict), a rule being host and path ("org/", "a.b/c")."""
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEPARATOR), path)
    return rules.where("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict")).select("rule", "verdict", key.alias("key"))


def _bytes(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")  # Spark and Python then sort alike


def sweep(rules: list[tuple[str, str, str]], urls: list[tuple[str, int]]):
    """(row, rule, verdict) for each url key with an active rule."""
    rules, stack, at = sorted(rules), [], 0
    for key, row in sorted(urls):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if stack:
            yield row, stack[-1][1], stack[-1][2]


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = DEFAULT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Columns ``keep`` of every page with host, path, rule and verdict."""
    host, path = split_url(F.col(url))
    rows = stored(pages.select(F.struct(*keep).alias("_keep"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row")), "urls")
    keys = rows.where("host <> ''").select("_row", F.explode(ancestor_keys(F.col("host"), F.col("path"))).alias("key"))
    total = keys.count()
    ranges = max(1, min(MOST_RANGES, -(-total // range_rows)))
    sample = keys.orderBy(F.xxhash64("key", "_row"), "key", "_row").limit(ranges * SAMPLE_PER_RANGE).collect()
    picked = sorted((r["key"], r["_row"]) for r in sample)
    cuts = [picked[i * len(picked) // ranges] for i in range(1, ranges)] if picked else []
    held = pages.sparkSession.sparkContext.broadcast(cuts)  # at most MOST_RANGES keys

    def place(batches):
        for batch in batches:
            parts = [bisect_right(held.value, x) for x in zip(batch["key"].to_pylist(), batch["_row"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch["key"], batch["_row"]], names=["part", "key", "_row"])

    def spread(batches):
        for batch in batches:
            out = {"part": [], "key": [], "rule": [], "verdict": []}
            for r in batch.to_pylist():
                low, high = bisect_left(held.value, (r["key"], -1)), bisect_right(held.value, (r["key"] + _TOP, 1 << 62))
                for part in range(low, high + 1):
                    for c, v in zip(out, (part, r["key"], r["rule"], r["verdict"])):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))

    dealt = keys.select("key", "_row").mapInArrow(place, "part int, key string, _row long")
    covering = rule_rows(rules).select("key", "rule", "verdict").mapInArrow(spread, "part int, key string, rule string, verdict string")

    def swept(urls: pa.Table, own: pa.Table) -> pa.Table:
        found = list(sweep(
            list(zip(own["key"].to_pylist(), own["rule"].to_pylist(), own["verdict"].to_pylist())),
            list(zip(urls["key"].to_pylist(), urls["_row"].to_pylist())),
        ))
        return pa.table({"_row": pa.array([f[0] for f in found], pa.int64()), "rule": pa.array([f[1] for f in found], pa.string()), "verdict": pa.array([f[2] for f in found], pa.string())})

    matched = dealt.groupBy("part").cogroup(covering.groupBy("part")).applyInArrow(swept, "_row long, rule string, verdict string")
    order = F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)), "rule")
    best = matched.groupBy("_row").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    out = rows.join(best, "_row", "left")
    return out.select(*[F.col("_keep")[c].alias(c) for c in keep], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
