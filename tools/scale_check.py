"""Positions and greedy chunks of at least a million messages, a third of
them in one chat: seconds, and agreement with the window and fold forms.

    python tools/scale_check.py [cpus] [rows] [--compare]

The messages are the ``conversations`` table, repeated.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chatweave.operators import chunking, sequence  # noqa: E402
from chatweave.session import get_session  # noqa: E402


def repeated_lines(spark, sf_dir: str, rows: int, path: str):
    """``rows`` chat lines or more, a third of them in the chat 'hot'."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    times = -(-rows // max(1, conv.count()))
    lines = conv.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).select(
        F.when(F.pmod(F.xxhash64("conv_id", "copy"), F.lit(3)) == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("c"), F.pmod("conv_id", F.lit(500)).cast("string"))).alias("chat_key"),
        F.lit(0).cast("long").alias("batch_id"),
        (F.col("copy") * 1_000_000 + F.col("conv_id") * 100 + F.col("turn")).alias("time"),
        (F.col("copy") * 1_000_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.concat("role", F.lit(": "), F.regexp_replace("text", r"\s+", " ")).alias("line"),
    )
    lines.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(f):
    t = time.time()
    f().write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 2)


def main(argv):
    cpus, rows = int(argv[1]) if len(argv) > 1 else 8, int(argv[2]) if len(argv) > 2 else 1_000_000
    scratch = tempfile.mkdtemp(prefix="chatweave-scale-")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=32, extra_conf={"spark.driver.memory": "12g", "spark.checkpoint.dir": scratch})
    lines = repeated_lines(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), rows, f"{scratch}/lines")
    out = {"cpus": cpus, "messages": lines.count()}

    def positions():
        return sequence.with_positions(lines.withColumn("_len", F.length("line")), ["chat_key", "batch_id"], ["time", "message_id"], "_len")

    out["positions_s"], out["chunk_greedy_s"] = run(positions), run(lambda: chunking.chunk_greedy(lines))
    if "--compare" in argv:
        w = Window.partitionBy("chat_key", "batch_id").orderBy("time", "message_id")
        start = F.coalesce(F.sum(F.col("_len") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out["positions_wrong"] = positions().withColumns({"p": F.row_number().over(w) - 1, "o": start}).where("p <> _pos OR o <> _offset").count()
        groups = defaultdict(list)
        pdf = lines.toPandas().sort_values(["chat_key", "batch_id", "time", "message_id"], kind="stable")
        for key, line in zip(pdf.chat_key, pdf.line):
            groups[key].append(line)
        want = [(k, c) for k in sorted(groups) for c in chunking.greedy_fold(groups[k])]
        got = chunking.chunk_greedy(lines).toPandas().sort_values(["chat_key", "chunk_no"], kind="stable")
        out["chunks"], out["chunks_equal"] = len(got), list(zip(got.chat_key, got.text)) == want
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
