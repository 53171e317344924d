"""Operations by name, as a client asks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import search, store


def _search(books: DataFrame, keyword: str, search_type: str) -> DataFrame:
    if search_type == "content":
        return search.by_content(books, keyword)
    if search_type in ("title", "author"):
        return search.by_field(books, search_type, keyword)
    raise ValueError(f"no such search: {search_type}")


OPERATIONS: dict[str, Callable[..., DataFrame]] = {"getAll": store.scan, "get": store.get, "range": store.key_range, "add": store.insert, "put": store.upsert, "delete": store.delete, "search": _search}


def perform(operation: str, books: DataFrame, **data) -> DataFrame:
    """The operation's result; an unknown name is an error."""
    if operation not in OPERATIONS:
        raise ValueError(f"no such operation: {operation}")
    return OPERATIONS[operation](books, **data)
