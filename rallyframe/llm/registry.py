"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("suffix_dedup", "chat", "language", "secrets", "quality", "mixing", "token_files", "pitman_yor", "simhash", "decontaminate", "merkle", "repair", "main_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in map(lambda x: import_module(f"{__package__}.{x}"), MODULES)}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in map(lambda x: import_module(f"{__package__}.{x}"), MODULES) if m.SQL}
