"""Vector column expressions: hashed bag-of-words embedding and distances.

All are built-in higher-order functions over ``array<float|double>``; no
Python per row. Sums are left folds in double precision, so any engine that
folds in the same order gets bit-identical results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatweave.functions.text import non_word_run

DEFAULT_DIM = 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case word tokens (runs of letters, numbers and underscore)."""
    return F.array_remove(F.split(F.lower(_col(text)), non_word_run()), "")


def _normalise(vec: Column) -> Column:
    """Divide by the L2 norm, computed once (the fold's finish step)."""
    return F.aggregate(
        vec,
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x * x,
        lambda acc: F.transform(
            vec, lambda x: F.when(acc > 0, x / F.sqrt(acc)).otherwise(F.lit(0.0)).cast("float")
        ),
    )


def normalise(vec) -> Column:
    """Unit-length copy (float); the zero vector stays zero."""
    return _normalise(F.transform(_col(vec), lambda x: x.cast("double")))


def squared_l2(a, b) -> Column:
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_distance(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)

