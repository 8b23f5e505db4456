"""Embed texts into vectors (K2).

The built-in embedding is a hashed bag of words: tokens are cut in the
JVM, bucket counts are taken over Arrow batches (no shuffle). A user model runs
as an iterator pandas UDF: the model is loaded once per task and fed Arrow
batches, so it scales with the executors like any other map.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.functions.vectors import DEFAULT_DIM, tokens

# (df, text column, output column) -> df with the embedding column
EmbedFn = Callable[[DataFrame, str, str], DataFrame]


def _bucket_vectors(dim: int):
    """Arrow-batched helper: token lists -> L2-normalised bucket counts.

    A token's bucket is the first 32 bits of its MD5 modulo ``dim``. Counts
    are small integers, so the norm is exact whatever the summation order.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(tokens: pd.Series) -> pd.Series:
        lists = [t if t is not None else () for t in tokens]
        lens = np.fromiter((len(t) for t in lists), dtype=np.int64, count=len(lists))
        counts = np.zeros((len(lists), dim), dtype=np.float64)
        if lens.sum():
            flat = np.concatenate([np.asarray(t, dtype=object) for t in lists if len(t)])
            codes, uniques = pd.factorize(flat)
            ubuckets = np.fromiter(
                (int.from_bytes(hashlib.md5(u.encode("utf-8")).digest()[:4], "big") % dim for u in uniques),
                dtype=np.int64, count=len(uniques),
            )
            rows = np.repeat(np.arange(len(lists)), lens)
            flat_idx = rows * dim + ubuckets[codes]
            counts = np.bincount(flat_idx, minlength=len(lists) * dim).reshape(len(lists), dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        safe = np.where(norms > 0, norms, 1.0)
        vecs = (counts / safe[:, None]).astype(np.float32)
        return pd.Series(list(vecs))

    return vectors


def embed_hashed(df: DataFrame, text_col: str = "text", out_col: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``out_col``: L2-normalised hashed token counts (``array<float>``).

    Lower-casing and splitting into word tokens run in the JVM; counting
    the token buckets -- a histogram, which Spark SQL has no array primitive
    for -- runs over Arrow batches in numpy.
    """
    return df.withColumn(out_col, _bucket_vectors(dim)(tokens(F.col(text_col))))


def embed_with_model(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "text",
    out_col: str = "embedding",
) -> DataFrame:
    """Add ``out_col`` from a user model: ``load_model()`` returns a function
    mapping a list of texts to a 2-D array; it is called once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))

    return df.withColumn(out_col, _embed(F.col(text_col)))
