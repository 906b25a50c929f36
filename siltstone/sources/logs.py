"""Logs and chats: the tail of a log, chats as Markdown, records as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def log_tail(log: DataFrame, order: list[str], level_col: str, least: str, limit: int) -> DataFrame:
    """Of the last three times ``limit`` rows those of at least a level, and of those the last ``limit``. Both steps are top-k."""
    desc = [F.desc(c) for c in order]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(level_col)), F.lit(0))
    return log.orderBy(*desc).limit(3 * limit).where(rank >= LEVELS.index(least) + 1).orderBy(*desc).limit(limit)


def chat_markdown(turns: DataFrame, chat_col: str, turn_col: str, role_col: str, text_col: str, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """(chat, n_turns, markdown): each chat's turns of the given roles in order, under a heading each. A chat is one row, so it must fit one."""
    said = turns.where(F.col(role_col).isin(*roles) & (F.trim(F.coalesce(text_col, F.lit(""))) != ""))
    part = F.concat(F.lit("## "), F.initcap(role_col), F.lit("\n\n"), F.trim(F.col(text_col)), F.lit("\n"))
    each = said.groupBy(chat_col).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), part.alias("p")))).alias("l"))
    return each.select(chat_col, F.size("l").cast("bigint").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["p"]), "\n").alias("markdown"))


def xml_escape(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_record(root: str, values: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """One XML element with an element for each value, and item elements for lists."""
    parts = [F.concat(F.lit(f"<{k}>"), xml_escape(F.coalesce(v.cast("string"), F.lit(""))), F.lit(f"</{k}>")) for k, v in values.items()]
    parts += [F.concat(F.lit(f"<{k}>"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("<item>"), xml_escape(x), F.lit("</item>"))), ""), F.lit(f"</{k}>")) for k, v in (lists or {}).items()]
    return F.concat(F.lit(f"<{root}>"), *parts, F.lit(f"</{root}>"))
