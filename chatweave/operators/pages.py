"""The joined text of a chat as pages of fixed size.

A chat's lines, joined by newlines, may be too large for one row, so the text
is cut every ``PAGE`` characters: pages in order concatenate to the joined text
exactly. Each line knows its offset in that text (:func:`chunking.line_offsets`,
without putting a chat into one task), so a page's pieces follow by
arithmetic: a line gives each page it touches one substring. A page has at most
``page`` pieces, as every line brings at least its newline, so no group grows
with the chat.

Defined results: a chat whose joined text is empty (one empty line) has no
page; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.operators.chunking import GROUP, LINE_JOINER, line_offsets

PAGE = 8192


def join_pages(lines: DataFrame, page: int = PAGE, num_partitions: int | None = None) -> DataFrame:
    """``(chat_key, batch_id, page_no, text)``, pages counted from 0."""
    rows = line_offsets(lines, num_partitions)
    # every line but the first brings the newline before it
    rows = rows.select(
        *GROUP, "line_no",
        F.when(F.col("line_no") == 0, F.col("line")).otherwise(F.concat(F.lit(LINE_JOINER), "line")).alias("t"),
        F.when(F.col("line_no") == 0, F.lit(0).cast("long")).otherwise(F.col("offset") - 1).alias("at"),
    ).where(F.length("t") > 0)
    last = F.floor((F.col("at") + F.length("t") - 1) / page)
    pieces = rows.withColumn("page_no", F.explode(F.sequence(F.floor(F.col("at") / page), last)))
    start = F.greatest(F.col("page_no") * page - F.col("at"), F.lit(0))
    piece = F.substring("t", start.cast("int") + 1, F.least(F.lit(page), (F.col("page_no") + 1) * page - F.col("at") - start).cast("int"))
    pieces = pieces.select(*GROUP, "page_no", "line_no", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(*GROUP, "page_no").agg(joined.alias("text"))
