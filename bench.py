"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line. Each query is executed in
full with the ``noop`` sink (no rows are brought to the driver). ``bind``
is the one-time write of the message store derived from the test tables.
Before timing, every headline query runs once on the smallest test scale
(untimed) so JIT compilation and Python worker start-up are not charged to
whichever query happens to run first; ``warmup_sec`` reports that pass.
``*_1m`` are positions and greedy chunks of a million messages (the
conversations repeated, a third of them in one chat).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from chatweave.operators.chunking import chunk_greedy  # noqa: E402
from chatweave.operators.sequence import with_positions  # noqa: E402
from chatweave.plans import catalog  # noqa: E402
from chatweave.session import get_session  # noqa: E402
from chatweave.sources import testdata  # noqa: E402
from tools.scale_check import repeated_lines  # noqa: E402

HEADLINE = [
    "load_messages",
    "unknown_senders",
    "contact_handles",
    "default_clean",
    "chunk_greedy",
    "chunk_grid",
    "embed_hashed",
    "similarity_topk",
    "index_build",
    "generate_context",
    "incremental_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="chatweave-bench-")
    spark = get_session(
        f"local[{cpus}]",
        app_name="chatweave-bench",
        shuffle_partitions=max(2, cpus),
        extra_conf={
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": scratch,
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        },
    )
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    tw = time.time()
    if os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir:
        for name in HEADLINE:
            catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - tw, 3)
    times: dict[str, float] = {}
    t0 = time.time()
    testdata.bind(spark, sf_dir)
    times["bind"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    # the same distributed folds on a million messages, a third in one chat
    lines = repeated_lines(spark, sf_dir, 1_000_000, os.path.join(scratch, "lines"))
    scaled = {
        "positions_1m": lambda: with_positions(lines.withColumn("_len", F.length("line")), ["chat_key", "batch_id"], ["time", "message_id"], "_len"),
        "chunk_greedy_1m": lambda: chunk_greedy(lines),
    }
    for name, query in scaled.items():
        t = time.time()
        query().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "warmup_sec": warmup,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
