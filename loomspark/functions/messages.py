"""Columns of message lists, ``ARRAY<STRUCT<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contents_of(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def first_content(messages: Column, role: str) -> Column:
    """Content of the first message of a role; null without one."""
    return F.get(contents_of(messages, role), 0)


def last_content(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null without one."""
    return F.try_element_at(contents_of(messages, role), F.lit(-1))
