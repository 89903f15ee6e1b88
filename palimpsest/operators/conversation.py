"""Conversation turns as entries with the turns before them as context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_context(messages: DataFrame, conversation: str, order: list[str], text: str, turns: int = 2, at: str | None = None) -> DataFrame:
    """``context``: the last ``turns`` texts before the row, joined by " | ", with the month of ``at`` in words at the end.

    Empty and null texts give no row and do not enter the window.
    """
    live = messages.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    w = Window.partitionBy(conversation).orderBy(*order).rowsBetween(-turns, -1)
    before = F.collect_list(text).over(w)
    words = F.array(F.date_format(F.col(at), "MMMM yyyy")) if at else F.array().cast("array<string>")
    return live.withColumn("context", F.array_join(F.concat(before, F.filter(words, lambda x: x.isNotNull())), " | "))
