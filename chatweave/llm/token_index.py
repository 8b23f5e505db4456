"""Operator 11: token ids in binary shards with a minimal perfect hash index.

Shards. Documents are range-sorted by key, encoded in that order and written as
raw little-endian ids, 16 bytes of header before them, a new file after at most
``SHARD_IDS`` ids. A task writes files of names of its own; the stored table of
entries names those of the tasks that ended well, so a lost or repeated task
leaves unused files only.

Index. Row keys (the document's key, and its number among rows of that key) are
dealt by hash to index files of about ``FILE_KEYS`` keys at most. In a file, keys
fall into small buckets; the largest first, a bucket takes the first pilot
number that sends its keys to free slots, and a bucket of one key names its
slot itself. So n keys fill n slots, and a slot holds (fingerprint, shard,
offset, length). A key is found by three reads: header, pilot, slot; the
fingerprint tells keys that were never written (but for one in 2**32).

``TokenIndex.get`` reads one document by these three reads and one of ids.
``TokenIndex.read`` does the same for a table of keys: keys go to the tasks of
their index files, what was found goes in order of place to tasks that read
runs of ids. Nothing but the list of files (a row per file) is gathered, and
tables beyond ``SMALL_ROWS`` files are joined by a shuffle.

Files are opened with ``pyarrow.fs`` below the shared folder of
``spark.checkpoint.dir`` (local, HDFS or an object store).

Defined results: a null or empty text is the end id alone; rows without key
sort first and are found by the key None; rows that share a key have
occurrence 0, 1, ... in the order of their texts' hash, equal rows included; an empty table gives no files and finds nothing; any other
columns are left alone.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm import word_tokens
from chatweave.llm.common import join_small, stored
from chatweave.operators.sequence import default_partitions
from chatweave.session import scratch_path

END = 1  #: the id that ends a document
SHARD_IDS, FILE_KEYS = 1 << 26, 1 << 18
SHARD_MAGIC, INDEX_MAGIC = b"CWSHARD1", b"CWINDEX1"
SHARD_HEAD, SHARD_START = "<8sII", 16  # magic, bytes per id, 0
INDEX_HEAD, INDEX_START = "<8sQQQ", 32  # magic, keys, buckets, seed
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
KEYS_PER_BUCKET = 2
PILOTS = 64  #: pilots tried at once, doubled up to MOST_PILOTS
MOST_PILOTS = 1 << 14
#: reads that lie so near each other are one, up to so many bytes
GAP, RUN = 1 << 16, 1 << 23

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def key_hashes(keys: list[str], occurrences, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes per row key."""
    raw = b"".join(xxhash.xxh3_128_digest(f"{n}:{k}".encode("utf-8", "surrogatepass"), seed) for k, n in zip(keys, occurrences))
    both = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def key_text(key) -> str:
    """A row key's text; None has one of its own."""
    return "" if key is None else f"={key}"


def key_column(name: str):
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def slots_of(second: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (_mix(second + pilots.astype(np.uint64) * _A) % np.uint64(n)).astype(np.int64)


def perfect_hash(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(pilot per bucket, slot per key) of a minimal perfect hash: a pilot below
    0 is the slot -(pilot + 1) of its bucket's only key. None if two keys of a
    bucket have one second hash (take another seed then)."""
    n = len(first)
    m = n // KEYS_PER_BUCKET + 1
    bucket = (first % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    pilots, slot, taken = np.zeros(m, dtype="<i8"), np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size < 2:
            break
        members = order[starts[b] : starts[b + 1]]
        h = second[members][:, None]
        if len(np.unique(h)) < size:
            return None
        at, width = 0, PILOTS
        while True:
            to = slots_of(h, np.arange(at, at + width)[None, :], n)
            free = ~taken[to].any(axis=0)
            if size > 1 and free.any():
                ranked = np.sort(to, axis=0)
                free &= (ranked[1:] != ranked[:-1]).all(axis=0)
            good = int(free.argmax())
            if free[good]:
                break
            at, width = at + width, min(2 * width, MOST_PILOTS)
        pilots[b], slot[members] = at + good, to[:, good]
        taken[to[:, good]] = True
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(~taken)
    pilots[single] = -(left + 1)
    slot[order[starts[single]]] = left
    return pilots, slot


def index_bytes(keys: list[str], occurrences, shard, offset, length) -> bytes:
    """The content of one index file."""
    seed = 0
    while (made := perfect_hash(*(hashes := key_hashes(keys, occurrences, seed)))) is None:
        seed += 1
    pilots, slot = made
    table = np.zeros(len(keys), dtype=SLOT)
    table["print"][slot] = hashes[0] >> np.uint64(32)
    for name, values in (("shard", shard), ("offset", offset), ("length", length)):
        table[name][slot] = values
    return struct.pack(INDEX_HEAD, INDEX_MAGIC, len(keys), len(pilots), seed) + pilots.tobytes() + table.tobytes()


def find_in(content: bytes, keys: list[str], occurrences) -> tuple[np.ndarray, np.ndarray]:
    """(slot records, found) of row keys in an index file's content."""
    _, n, m, seed = struct.unpack_from(INDEX_HEAD, content)
    pilots = np.frombuffer(content, "<i8", m, INDEX_START)
    table = np.frombuffer(content, SLOT, n, INDEX_START + 8 * m)
    first, second = key_hashes(keys, occurrences, seed)
    pilot = pilots[(first % np.uint64(m)).astype(np.int64)]
    records = table[np.where(pilot < 0, -(pilot + 1), slots_of(second, np.maximum(pilot, 0), n))]
    return records, records["print"] == (first >> np.uint64(32)).astype(np.uint32)


def _write_shards(rows: DataFrame, key: str, folder: str, vocabulary: str, shard_ids: int) -> DataFrame:
    """(file, part, seq, key, at, offset, n) of rows of (key, _text) in order,
    whose texts are encoded and appended to this task's files."""

    def run(batches):
        enc = word_tokens.encoder(vocabulary)
        width, end = enc.dtype.itemsize, np.array([END], dtype=enc.dtype).tobytes()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, name, out = TaskContext.get().partitionId(), uuid.uuid4().hex, None
        seq = written = at = 0
        try:
            for batch in batches:
                cols = {c: [] for c in ("file", "seq", "at", "offset", "n")}
                for text in batch["_text"]:
                    ids = enc.ids(text.as_py()) + end
                    n = len(ids) // width
                    if out is not None and written + n > shard_ids:
                        out.close()
                        out, seq = None, seq + 1
                    if out is None:
                        file, written, at = f"{part}-{seq}-{name}.ids", 0, 0
                        out = fs.open_output_stream(f"{base}/{file}", compression=None)
                        out.write(struct.pack(SHARD_HEAD, SHARD_MAGIC, width, 0))
                    out.write(ids)
                    for c, v in zip(cols, (file, seq, at, written, n)):
                        cols[c].append(v)
                    written, at = written + n, at + 1
                longs = {c: pa.array(cols[c], pa.int64()) for c in ("seq", "at", "offset", "n")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["file"], pa.string()), pa.array([part] * batch.num_rows, pa.int64()), longs["seq"], batch[key], longs["at"], longs["offset"], longs["n"]],
                    names=["file", "part", "seq", key, "at", "offset", "n"])
        finally:
            if out is not None:
                out.close()

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"file string, part long, seq long, `{key}` {kind}, at long, offset long, n long")


def _hashed(rows: DataFrame, files: int) -> DataFrame:
    """Rows with the index file that their (_k, occurrence) falls to."""

    def run(batches):
        for batch in batches:
            first, _ = key_hashes(batch["_k"].to_pylist(), batch["occurrence"].to_pylist())
            yield batch.append_column("index", pa.array((_mix(first) % np.uint64(files)).astype(np.int64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, index long")


def _write_index(rows: DataFrame, folder: str) -> DataFrame:
    """(index, file, keys) of the index files of rows dealt by ``index``."""

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by("index")
        numbers = table["index"].to_numpy()
        edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:]):
            part = table.slice(low, high - low)
            file = f"{numbers[low]}-{uuid.uuid4().hex}.mph"
            with fs.open_output_stream(f"{base}/{file}", compression=None) as out:
                out.write(index_bytes(part["_k"].to_pylist(), part["occurrence"].to_pylist(), *(part[c].to_numpy() for c in ("shard", "offset", "n"))))
            yield pa.RecordBatch.from_pydict({"index": [int(numbers[low])], "file": [file], "keys": [high - low]}, schema=pa.schema([("index", pa.int64()), ("file", pa.string()), ("keys", pa.int64())]))

    return rows.mapInArrow(run, "index long, file string, keys long")


@dataclass(frozen=True)
class TokenIndex:
    """What ``write`` made: two folders, and the tables that name their files."""

    folder: str
    shards: DataFrame  # shard, file, base (ids of all documents before it)
    indexes: DataFrame  # index, file, keys
    files: int  # index files that keys are dealt to
    width: int  # bytes per id

    def get(self, key, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document: four reads at known places."""
        first, second = key_hashes([key_text(key)], [occurrence])
        named = self.indexes.where(F.col("index") == int(_mix(first)[0] % np.uint64(self.files))).select("file").first()
        if named is None:
            return None
        fs, base = file_system(f"{self.folder}/index")
        with fs.open_input_file(f"{base}/{named.file}") as f:
            _, n, m, seed = struct.unpack(INDEX_HEAD, f.read_at(INDEX_START, 0))
            if seed:
                first, second = key_hashes([key_text(key)], [occurrence], seed)
            pilot = int.from_bytes(f.read_at(8, INDEX_START + 8 * int(first[0] % np.uint64(m))), "little", signed=True)
            slot = -(pilot + 1) if pilot < 0 else int(slots_of(second, np.array([pilot]), n)[0])
            record = np.frombuffer(f.read_at(SLOT.itemsize, INDEX_START + 8 * m + SLOT.itemsize * slot), SLOT)[0]
        if record["print"] != first[0] >> np.uint64(32):
            return None
        file = self.shards.where(F.col("shard") == int(record["shard"])).select("file").first().file
        fs, base = file_system(f"{self.folder}/shards")
        with fs.open_input_file(f"{base}/{file}") as f:
            return np.frombuffer(f.read_at(int(record["length"]) * self.width, SHARD_START + int(record["offset"]) * self.width), f"<u{self.width}")

    def lookup(self, keys: DataFrame, key: str) -> DataFrame:
        """(key, occurrence, shard, offset, n_tokens) of the rows of
        (key, occurrence) that are in the index."""
        folder, kind = f"{self.folder}/index", keys.schema[key].dataType.simpleString()
        asked = _hashed(keys.select(key, "occurrence", key_column(key).alias("_k")), self.files)
        dealt = join_small(asked, self.indexes.select("index", "file"), ["index"], "inner").repartition(self.files, "index")

        def run(batches):
            fs, base = file_system(folder)
            content: dict[str, bytes] = {}
            for batch in batches:
                names = batch["file"].to_numpy(zero_copy_only=False)
                for file in dict.fromkeys(names):
                    if file not in content:
                        if len(content) > 8:
                            content.clear()
                        with fs.open_input_file(f"{base}/{file}") as f:
                            content[file] = f.read()
                    part = batch.filter(pa.array(names == file))
                    records, known = find_in(content[file], part["_k"].to_pylist(), part["occurrence"].to_pylist())
                    found = [pa.array(records[c].astype(np.int64)) for c in ("shard", "offset", "length")]
                    out = pa.RecordBatch.from_arrays([part[key], part["occurrence"], *found], names=[key, "occurrence", "shard", "offset", "n_tokens"])
                    yield out.filter(pa.array(known))

        return dealt.mapInArrow(run, f"`{key}` {kind}, occurrence long, shard long, offset long, n_tokens long")

    def read(self, keys: DataFrame, key: str) -> DataFrame:
        """(key, occurrence, start, n_tokens, ids) of the rows of
        (key, occurrence) in the index; ids as little-endian unsigned 32 bit."""
        folder, width, kind = f"{self.folder}/shards", self.width, keys.schema[key].dataType.simpleString()
        placed = stored(self.lookup(keys, key), "places")
        rows = join_small(placed, self.shards, ["shard"], "inner")
        rows = rows.repartitionByRange(default_partitions(placed), "shard", "offset").sortWithinPartitions("shard", "offset")

        def run(batches):
            fs, base = file_system(folder)
            name, file = None, None
            for batch in batches:
                names, offset, n = batch["file"].to_pylist(), batch["offset"].to_numpy(), batch["n_tokens"].to_numpy()
                low, high = SHARD_START + offset * width, SHARD_START + (offset + n) * width
                at = 0
                while at < len(names):
                    to = at + 1
                    while to < len(names) and names[to] == names[at] and low[to] - high[to - 1] <= GAP and high[to] - low[at] <= RUN:
                        to += 1
                    if names[at] != name:
                        if file is not None:
                            file.close()
                        name, file = names[at], fs.open_input_file(f"{base}/{names[at]}")
                    run = file.read_at(int(high[to - 1] - low[at]), int(low[at]))
                    ids = [np.frombuffer(run, f"<u{width}", int(n[i]), int(low[i] - low[at])).astype("<u4").tobytes() for i in range(at, to)]
                    part = batch.slice(at, to - at)
                    start = pa.array((part["base"].to_numpy() + part["offset"].to_numpy()))
                    yield pa.RecordBatch.from_arrays([part[key], part["occurrence"], start, part["n_tokens"], pa.array(ids, pa.binary())], names=[key, "occurrence", "start", "n_tokens", "ids"])
                    at = to
            if file is not None:
                file.close()

        return rows.mapInArrow(run, f"`{key}` {kind}, occurrence long, start long, n_tokens long, ids binary")


def row_keys(docs: DataFrame, key: str) -> DataFrame:
    """(key, occurrence) of every row of ``docs``."""
    counts = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("occurrence"))


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = word_tokens.NAME, shard_ids: int = SHARD_IDS, file_keys: int = FILE_KEYS) -> TokenIndex:
    """Encode ``docs`` and write shards in ascending order of ``key``, and
    their index."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    width = word_tokens.encoder(vocabulary).dtype.itemsize
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col(key).asc_nulls_first(), "_hash", "_row"]
    ranged = rows.repartitionByRange(default_partitions(docs), *order).sortWithinPartitions(*order)
    entries = stored(_write_shards(ranged.select(key, "_text"), key, f"{folder}/shards", vocabulary, shard_ids), "entries")
    # a row per file: bases of ids and of documents
    sizes = entries.groupBy("part", "seq", "file").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    numbered = stored(sizes.select(
        "file", (F.row_number().over(W.orderBy("part", "seq")) - 1).cast("long").alias("shard"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first")), "shards")
    placed = join_small(entries, numbered, ["file"], "inner").withColumn("_k", key_column(key)).withColumn("_pos", F.col("first") + F.col("at"))
    shared = stored(placed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_least")).where("_n > 1").select("_k", "_least"), "shared")
    rows = join_small(placed, shared, ["_k"]).select("_k", F.coalesce(F.col("_pos") - F.col("_least"), F.lit(0)).alias("occurrence"), "shard", "offset", "n")
    # as many index files as fill the tasks, more where they would hold too many keys
    files = max(-(-entries.count() // file_keys), int(spark.conf.get("spark.sql.shuffle.partitions")))
    indexes = stored(_write_index(_hashed(rows, files).repartition(files, "index"), f"{folder}/index"), "indexes")
    return TokenIndex(folder, numbered.select("shard", "file", "base"), indexes, files, width)
