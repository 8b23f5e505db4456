"""Cleaning rules: frame-to-frame functions with bound keyword arguments.

A rule is any ``Callable[[DataFrame, ...], DataFrame]``; the built-in ones
are column expressions, so a chain of rules collapses into one projection
and filter inside whole-stage codegen.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions import text as T


@dataclass(frozen=True)
class Rule:
    """A frame-to-frame function and the keyword arguments to call it with."""

    func: Callable[..., DataFrame]
    kwargs: dict[str, Any] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self.func, **self.kwargs)


def apply_rules(df: DataFrame, *rules: Rule) -> DataFrame:
    """Apply rules in order, each to the result of the previous one."""
    return functools.reduce(lambda acc, rule: rule(acc), rules, df)


# --- built-in rules ---------------------------------------------------------

def remove_non_alphanumeric_messages(messages: DataFrame) -> DataFrame:
    """Keep messages whose text has at least one word character."""
    return messages.where(T.has_word_char("text"))


def remove_non_standard_messages(messages: DataFrame) -> DataFrame:
    """Keep plain texts (type 0): drops reactions, stickers, games."""
    return messages.where(F.col("type") == T.STANDARD_MESSAGE_TYPE)


def remove_links(messages: DataFrame) -> DataFrame:
    """Delete links inside texts; the message itself stays."""
    return messages.withColumn("text", T.remove_links("text"))


def remove_member(messages: DataFrame, member: str) -> DataFrame:
    """Drop messages of one sender (a parametrised rule)."""
    return messages.where(F.col("sender") != F.lit(member))


def reverse_order(messages: DataFrame) -> DataFrame:
    """Newest first (a reordering rule); ties by message id, newest first."""
    return messages.orderBy(F.col("time").desc(), F.col("message_id").desc())


# Default cleaning pipeline. Order matters: links go first so that a message
# that was only a link no longer has a word character and is dropped.
DEFAULT_RULES = (
    Rule(remove_links),
    Rule(remove_non_standard_messages),
    Rule(remove_non_alphanumeric_messages),
)


def default_clean(messages: DataFrame) -> DataFrame:
    return apply_rules(messages, *DEFAULT_RULES)
