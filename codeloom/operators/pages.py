"""Total orders, keyset pagination and cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import InvalidCursor, InvalidLimit, StaleIndexGeneration

SYMBOL_ORDER = ["id"]
REFERENCE_ORDER = ["site_file", "site_line", "site_col", "predicate", "source", "target"]
IMPORT_ORDER = ["site_line", "site_col", "target"]
MATCH_ORDER = ["path", "anchor_line", "anchor_col", "pattern_index", "digest"]


def encode_cursor(generation: int, key: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([generation, key]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, list]:
    try:
        generation, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except (ValueError, TypeError, AttributeError) as e:
        raise InvalidCursor("not a cursor of this index") from e
    if not isinstance(generation, int) or not isinstance(key, list):
        raise InvalidCursor("not a cursor of this index")
    return generation, key


def check_limit(limit: int) -> None:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise InvalidLimit("limit must be positive")


def after(df: DataFrame, order: list[str], key: list | None, reverse: bool = False) -> DataFrame:
    """Rows strictly behind ``key``."""
    if key is None:
        return df
    kinds = dict(df.dtypes)
    fits = len(key) == len(order) and all(isinstance(v, str if kinds[c] == "string" else int) and not isinstance(v, bool) for c, v in zip(order, key))
    if not fits:
        raise InvalidCursor("the cursor belongs to another query")
    here, there = F.struct(*[F.col(c) for c in order]), F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, key)])
    return df.where(here < there if reverse else here > there)


def page_df(df: DataFrame, order: list[str], limit: int, key: list | None = None, reverse: bool = False) -> DataFrame:
    return after(df, order, key, reverse).orderBy(*[F.desc(c) if reverse else F.asc(c) for c in order]).limit(limit)


def page(df: DataFrame, order: list[str], limit: int, generation: int, cursor: str | None, pinned: bool = True, reverse: bool = False) -> tuple[list, int, bool, str | None]:
    """(rows, total count, truncated, next cursor); a cursor of another generation is stale."""
    check_limit(limit)
    key = None
    if cursor is not None:
        of, key = decode_cursor(cursor)
        if pinned and of != generation:
            raise StaleIndexGeneration(f"the index went from generation {of} to {generation}")
    rows = page_df(df, order, limit + 1, key, reverse).collect()
    total = df.count()
    shown = rows[:limit]
    more = len(rows) > limit
    return shown, total, more, encode_cursor(generation, [shown[-1][c] for c in order]) if more else None
