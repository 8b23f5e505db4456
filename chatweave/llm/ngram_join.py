"""Operator 8: exact n-gram Jaccard self-join by universe-partition pigeonhole.

A document's set is its distinct shingles of ``words`` words (64-bit hashes).
Two sets link when 100 * |both| >= percent * |either|; the caller gives both
numbers. Linked sets of sizes a and b differ in at most H(a + b) shingles.

Signatures. Sizes are cut into bands; a set is filed under its own band and,
if a partner can lie there, under the next. In a band the hash universe is cut
into m segments, each with an allowance v of 0 or 1. If the allowances plus
one add up to H + 1 + e, a linked pair agrees, in segments worth at least
e + 1, up to v shingles. A segment of allowance 0 emits the hash of its subset;
one of allowance 1 also emits the subset with any one shingle left out, so two
subsets at distance one share a key. m, the allowances and the slack e are
allocated per band by a cost model (keys written against candidates met by
accident). Subsets without a rare shingle (empty, or made of shingles common
in a bounded sample) are skipped up to the slack e; a set that would have to
skip more skips none, so no linked pair is lost. The sample only steers cost.

Allocation by record. Each set also leaves out its most frequent keys as far
as its slack goes (a prefix filter over keys in one global order of
frequency: a linked pair agrees in more segments than either may leave out,
and the rarest of these survives in both). So passages and lines that many
documents share cost few candidates.

Candidates. Equal sets are one class first, so copies are never paired. Per
key a running window pairs each class with the hub, the member that has most
keys in common with others, and with its predecessor: linear in the group,
also for groups of thousands. These pairs are verified on the full sets.
What may be left are links of classes in different components that share a
hub. For hubs of at most ``FEW`` members these pairs are verified too. For
larger ones, let D be a member's symmetric difference to the hub: members x, y
can only link if D_x and D_y share (|D_x| + |D_y| - H) / 2 elements, so only
members that meet in a prefix of their differences, rarest element first, are
verified. How long a prefix must be depends on both members: they are filed
under bands of |D| less their part of H, and each has a prefix per band of
partners. So near copies that share no more than the hub's text do not meet, and
every link is either verified or implied by verified ones, without
all pairs of a group. Components come from large-star / small-star rounds over
stored tables.

Defined results: null, empty or white-space texts have an empty set and link
with nothing; with fewer words than a shingle has the whole sequence is the
one shingle; a row without id gets no component; rows that share an id are one
document; repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import discard, join_small, stored

#: a shingle's words and the least similarity, unless the caller says otherwise
WORDS, PERCENT = 4, 85
#: ratio of band starts; larger where 100 / percent is
BAND = 1.3
CACHE = 1 << 18  #: word hashes kept per worker
SAMPLE, HOT_SHARE, HOT_LEAST, HOT_MOST = 2000, 0.005, 5, 1 << 15
#: cost model: classes that share half of a set, and cost of a set beyond the slack
HALF_SHARED, BEYOND = 64.0, 4000.0
#: beyond this need all segments are narrow, with this share of it as slack
WIDE_NEED, SLACK = 8, 0.25
#: copies, and members of candidate pairs, of which there are at most so many
#: are found by a broadcast of their ids (and hashes: at most 32 bytes each)
FEW_IDS = 500_000
#: pairs whose differences are held at once
SLICE = 500
#: members of a hub up to which all its open pairs are verified
FEW = 16
#: bands of differences per reach of a hub
BANDS = 4

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return (x ^ (x >> np.uint64(29))) * _A


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(found))
    k = len(found) - width + 1
    s = mix(h[:k] + np.uint64(width))
    for i in range(1, width):
        s = mix(s + h[i : k + i])
    return np.unique(s)


def linked(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return inter > 0 and 100 * inter >= percent * (a + b - inter)


def hamming(total: int, percent: int = PERCENT) -> int:
    """Most shingles in which linked sets of this total size can differ."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=None)
def band_starts(percent: int = PERCENT) -> np.ndarray:
    """A set's partners lie at most one band on."""
    starts, at = [], 1
    while at < 1 << 40:
        starts.append(at)
        at = max(at, int(at * BAND), 100 * at // percent) + 1
    return np.array(starts, dtype=np.int64)


@lru_cache(maxsize=None)
def plan(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments, of these the first so many with allowance 1, slack e)."""
    starts = band_starts(percent)
    low, high = int(starts[band]), int(starts[band + 1]) - 1
    need = max(hamming(t, percent) for t in range(max(2, 2 * high - 2 * 100 // percent - 10), 2 * high + 1)) + 1
    best = None
    slacks = (0, 1, 2, 3, 4) if need <= WIDE_NEED else (math.ceil(need * SLACK),)
    for e in slacks:
        for share in (0.0, 0.5, 1.0) if need <= WIDE_NEED else (0.0,):
            wide = math.ceil((need + e) / 2) if share == 1.0 else int(share * (need + e) / 2)
            m = wide + max(0, need + e - 2 * wide)
            size = low / m
            rare = [math.exp(-size), math.exp(-size) * (1 + size + size * size / 2)]
            skipped = (m - wide) * rare[0] + 2 * wide * rare[1]
            fits = sum(math.exp(-skipped + i * math.log(max(skipped, 1e-300)) - math.lgamma(i + 1)) for i in range(e + 1))
            accident = HALF_SHARED * 0.5**size
            cost = (m - wide) * (1 + accident) + wide * (1 + size) * (1 + accident) + BEYOND * max(0.0, 1 - fits)
            if best is None or cost < best[0]:
                best = (cost, m, wide, e)
    return best[1:]


@lru_cache(maxsize=None)
def _edges(m: int) -> np.ndarray:
    return np.array([-(-(i << 64) // m) for i in range(1, m)], dtype=np.uint64)


def signatures(s: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """Keys of a sorted set under its own and the next band; the lowest bit of
    a key is its band's. Also how many more keys may be left out, by that bit."""
    spare = [0, 0]
    if not len(s):
        return np.zeros(0, dtype=np.int64), spare
    starts, n = band_starts(percent), len(s)
    own = int(np.searchsorted(starts, n, "right")) - 1
    bands = [own] + [own + 1] * (100 * n >= percent * int(starts[own + 1]))
    weight = mix(s ^ _A)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
    common = np.zeros(n, dtype=bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        common = hot[at] == s
    rares = np.concatenate([[0], np.cumsum(~common)])
    out = []
    for band in bands:
        m, wide, e = plan(band, percent)
        cut = np.concatenate([[0], np.searchsorted(s, _edges(m)), [n]])
        content, rare = sums[cut[1:]] - sums[cut[:-1]], rares[cut[1:]] - rares[cut[:-1]]
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        is_wide = np.arange(m) < wide
        skipped = int((rare[~is_wide] == 0).sum() + 2 * (rare[is_wide] <= 2).sum())
        keep = (rare > is_wide) if skipped <= e else np.ones(m, dtype=bool)
        keys = [mix(content[keep] ^ salt[keep])]
        if wide:
            seg = np.repeat(np.arange(m), np.diff(cut))
            out_of = is_wide[seg] & keep[seg]
            keys.append(mix((content[seg[out_of]] - weight[out_of]) ^ salt[seg[out_of]]))
        elif skipped <= e:
            spare[band & 1] = e - skipped
        out.append((np.concatenate(keys) & ~np.uint64(1)) | np.uint64(band & 1))
    return np.unique(np.concatenate(out)).view(np.int64), spare


def _texts(batch, *others):
    return zip(*(batch[c].to_pylist() for c in others), (x.as_py() for x in batch["_text"]))


def hot_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles common in a sample of about ``SAMPLE`` documents (cost only)."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit(8), "_id"), F.lit(1 << 30)) < share * (1 << 30)).select("_text")

    def sets(batches):
        for batch in batches:
            got = [shingle_set(x.as_py(), words) for x in batch["_text"]]
            got = [g for g in got if len(g)]
            yield pa.RecordBatch.from_pydict({"f": pa.array([int(mix(g).sum(dtype=np.uint64).view(np.int64)) for g in got], pa.int64()), "s": pa.array([g.view(np.int64) for g in got], pa.list_(pa.int64()))})

    distinct = stored(some.mapInArrow(sets, "f long, s array<long>").dropDuplicates(["f"]), "hot")
    least = max(HOT_LEAST, HOT_SHARE * distinct.count())
    top = distinct.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(HOT_MOST)
    return np.sort(np.array([r["s"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def signed_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(_id, n, f1, f2, keys, spare0, spare1) of every row of (_id, _text)."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, words))
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("spare0", pa.int32()), ("spare1", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = {c: [] for c in schema.names}
            for i, text in _texts(batch, "_id"):
                s = shingle_set(text, words)
                f1, f2 = mix(s).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)
                keys, spare = signatures(s, hot.value, percent)
                for c, v in zip(rows, (i, len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), keys, *spare)):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.mapInArrow(run, "_id long, n long, f1 long, f2 long, keys array<long>, spare0 int, spare1 int")


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("_id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("_id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, ok): symmetric difference, and whether they link, of each pair."""

    def run(batches):
        for batch in batches:
            rows = {"a": batch["a"], "b": batch["b"], "d": [], "ok": []}
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                k = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                rows["d"].append(len(x) + len(y) - 2 * k)
                rows["ok"].append(linked(k, len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([rows["a"], rows["b"], pa.array(rows["d"], pa.int64()), pa.array(rows["ok"], pa.bool_())], names=list(rows))

    return _paired(pairs, sets).mapInArrow(run, "a long, b long, d long, ok boolean")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, _id, x, d, n, e, w, least, far): a row per element x of the symmetric
    difference of hub and member, its size d, the member's size n, and

    * ``e``: d less the member's part of the reach, times 100 + percent. Members
      x, y that link share at least (e_x + e_y) / (2 * (100 + percent)) elements,
      as H(a + b) is at most (a + b) * (100 - percent) / (100 + percent);
    * ``w``: the width of the hub's bands of e;
    * ``least``: what it shares at least with a member that does not link to the hub;
    * ``far``: that it does not link to the hub itself."""

    def run(batches):
        names = ["hub", "_id", "xs", "d", "n", "e", "w", "least", "far"]
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                batch = big.slice(at, SLICE)
                both, rows = [], []
                for h, y in zip(batch["sa"], batch["sb"]):
                    h, y = np.frombuffer(h.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    x = np.setxor1d(h, y, assume_unique=True)
                    d, n = len(x), len(y)
                    # a partner lies beyond the hub's own reach, which moves by one
                    # per step and never down twice in a row, so they share this much
                    least = max(1, -(-(1 + d - max(0, n - len(h))) // 2))
                    both.append(x.view(np.int64))
                    rows.append((d, n, d * (100 + percent) - n * (100 - percent), max(1, (100 - percent) * len(h) // BANDS), least, not linked((len(h) + n - d) // 2, len(h), n, percent)))
                cols = [pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(both, pa.list_(pa.int64())), *cols], names=names)

    made = _paired(pairs, sets).mapInArrow(run, "hub long, _id long, xs array<long>, d long, n long, e long, w long, least long, far boolean")
    return made.select("hub", "_id", F.explode("xs").alias("x"), "d", "n", "e", "w", "least", "far")


def banded(prefixes: DataFrame, far: bool, percent: int) -> DataFrame:
    """Prefix elements of far members, or of all as near ones, once per band of
    partners: (hub, x, far_band, near_band, _id, root). An element of rank
    ``nth`` belongs to the prefix for partners with so small an ``e`` that it may
    be the first one shared."""
    p, own, other = percent, ("far_band", "near_band")[not far], ("far_band", "near_band")[far]
    most = f"floor((2 * {100 + p} * (d - nth + 1) - e) / w)"
    # sizes and differences of linked members lie in each other's reach
    low = f"floor(greatest(e - 2 * {100 - p} * n * 100 / {p}, -{100 - p} * n * 100 / {p}) / w) - 1"
    high = f"least({most}, floor((e + 2 * {100 - p} * n) / w) + 1)"
    rows = prefixes.where("far" if far else "nth <= d - least + 1")
    bands = F.expr(f"filter({'bands' if far else 'far_bands'}, b -> b >= {low} AND b <= {high})")
    return rows.select("hub", "x", F.floor(F.col("e") / F.col("w")).alias(own), F.explode(bands).alias(other), "_id", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v); root is the smallest node.
    Rounds of large-star and small-star until the stored edges stay equal."""

    def toward_least(e: DataFrame, own: bool) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        if own:  # large star: larger neighbours go to the least of u and its neighbours
            return e.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v")))

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(toward_least(both, True).distinct(), "large")
        e = stored(toward_least(large, False).distinct(), "small")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _few(ids: DataFrame) -> DataFrame:
    """With a broadcast hint if there are at most ``FEW_IDS`` rows."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, report: dict | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. ``report`` gets the
    numbers of verified pairs."""
    if words < 1 or not 1 <= percent <= 100:
        raise ValueError("words must be at least 1, percent 1 to 100")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    signed = stored(signed_sets(rows, words, percent), "signed")
    light = stored(signed.drop("keys"), "light")
    some = "_id IS NOT NULL AND n > 0"
    full = light.where(some)
    classes = stored(full.groupBy("n", "f1", "f2").agg(F.min("_id").alias("rep"), F.count("*").alias("_size")), "classes")
    # all but one row of each class leave before the keys are dealt out
    shared = classes.where("_size > 1").select("n", "f1", "f2", "rep")
    extra = stored(full.select("_id", "n", "f1", "f2").join(_few(shared), ["n", "f1", "f2"]).select("_id", "n", "f1", "f2", "rep").distinct(), "copies")
    others = _few(extra.where("_id <> rep").select("_id", "n", "f1", "f2"))
    keyed, with_keys = (x.join(others, ["_id", "n", "f1", "f2"], "left_anti") for x in (full, signed.where(some)))
    keys = with_keys.select("_id", F.explode("keys").alias("key"))
    group = W.partitionBy("key").orderBy("_id")
    near = keys.withColumns({"_before": F.lag("_id").over(group), "_after": F.lead("_id").over(group)})
    near = stored(near.where("(_before IS NOT NULL OR _after IS NOT NULL) AND NOT (_before <=> _id)").select("_id", "key"), "near")
    discard(signed)
    counted = near.join(near.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "key")
    # the most frequent keys are left out as far as the slack goes; one shuffle
    # by id serves the join and both windows
    spare = keyed.groupBy("_id").agg(F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))
    bit = F.pmod("key", F.lit(2))
    nth = F.row_number().over(W.partitionBy("_id", "bit").orderBy(F.desc("f"), "key"))
    ranked = counted.join(spare, "_id").withColumn("bit", bit).withColumn("_nth", nth)
    kept = ranked.where(F.col("_nth") > F.when(F.col("bit") == 0, F.col("spare0")).otherwise(F.col("spare1")))
    kept = kept.select("_id", "key", F.sum("f").over(W.partitionBy("_id")).alias("score"))
    by_score = W.partitionBy("key").orderBy(F.desc("score"), "_id")
    met = kept.withColumns({"hub": F.first("_id").over(by_score.rowsBetween(W.unboundedPreceding, 0)), "prev": F.lag("_id").over(by_score)})
    met = stored(met.where("prev IS NOT NULL").groupBy("hub", "_id").agg(F.collect_set("prev").alias("prevs")), "met")
    discard(near)
    hubs = met.select(F.col("hub").alias("a"), F.col("_id").alias("b"))
    chain = met.select("hub", F.explode("prevs").alias("a"), F.col("_id").alias("b")).where("a <> hub").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star = hubs.unionByName(chain).distinct()
    members = met.select("_id").unionByName(met.select(F.col("hub").alias("_id"))).distinct()

    def sets_of(batches):
        for batch in batches:
            ids, sets = [], []
            for i, t in _texts(batch, "_id"):
                ids.append(i)
                sets.append(shingle_set(t, words).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["_id", "s"])

    sets = stored(rows.join(_few(stored(members, "members")), "_id", "left_semi").mapInArrow(sets_of, "_id long, s binary").distinct(), "sets")
    tested = stored(verified(star, sets, percent), "tested")
    # rows that share an id are one document
    same_id = extra.groupBy("_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).select("u", "v")
    own_id = extra.select(F.col("_id").alias("u"), F.col("rep").alias("v")).join(keyed.select(F.col("_id").alias("u")).distinct(), "u", "left_semi")
    implied = same_id.unionByName(own_id)
    first_links = tested.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(implied)
    roots = stored(components(first_links), "roots")

    placed = (
        tested.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("ok").alias("ok")).withColumnRenamed("a", "hub").withColumnRenamed("b", "_id")
        .join(met.select("hub", "_id"), ["hub", "_id"])
        .join(roots.withColumnRenamed("node", "_id"), "_id", "left").withColumn("root", F.coalesce("root", "_id"))
    )
    per_hub = placed.groupBy("hub").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hub", "c")
    open_ = stored(placed.join(per_hub, "hub").select("hub", "_id", "ok", "root", "c"), "open")

    def pairs_of(far: DataFrame, near: DataFrame, on: list[str]) -> DataFrame:
        x = far.select(*on, F.col("_id").alias("a"), F.col("root").alias("ra"))
        y = near.select(*on, F.col("_id").alias("b"), F.col("root").alias("rb"))
        return x.join(y, on).where("a <> b AND ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    few = open_.where(f"c <= {FEW}")
    many = open_.where(f"c > {FEW}")
    parts = stored(differences(many.select(F.col("hub").alias("a"), F.col("_id").alias("b")), sets, percent), "differences")
    # rarest elements first; those of one member only have a rank, but no partner
    rare = W.partitionBy("hub", "_id").orderBy("f", "x")
    counted = parts.join(parts.groupBy("hub", "x").agg(F.count("*").alias("f")).where("f > 1"), ["hub", "x"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    ranked = counted.withColumn("nth", F.row_number().over(rare)).where("f > 1").drop("f")
    band = F.floor(F.col("e") / F.col("w"))
    ranked = stored(ranked.join(many.select("hub", "_id", "root"), ["hub", "_id"]), "prefixes")
    of_hub = ranked.groupBy("hub").agg(F.collect_set(band).alias("bands"), F.collect_set(F.when(F.col("far"), band)).alias("far_bands"))
    prefixes = join_small(ranked, stored(of_hub, "bands"), ["hub"], "inner")
    on = ["hub", "x", "far_band", "near_band"]
    rest = pairs_of(few.where("NOT ok"), few, ["hub"]).unionByName(pairs_of(banded(prefixes, True, percent), banded(prefixes, False, percent), on))
    rest = stored(rest.distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"), "rest")
    discard(parts, ranked)
    if report is not None:
        report.update(star=tested.count(), rest=rest.count())
    if rest.limit(1).count():
        more = verified(rest, sets, percent).where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")

    out = light.select("_id", "n", "f1", "f2").join(extra.select("_id", "n", "f1", "f2", "rep"), ["_id", "n", "f1", "f2"], "left").withColumn("node", F.coalesce("rep", "_id"))
    out = out.join(roots, "node", "left")
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "node")).alias("component_id"))
