"""Reconciling a batch of indexed files with the live and history tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import RELATION_CONTENT, RELATION_KEY, SYMBOL_CONTENT, SYMBOL_KEY


@dataclass
class Changes:
    """What a batch does to one table: the next live rows, and the history rows that it appends."""

    live: DataFrame
    appended: DataFrame
    removed: DataFrame


def differs(key_content: list[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for c in key_content:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return ~same


def diff(live: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Full outer join by key with ``action``: insert, change, refresh (only seen again) or keep."""
    old, fresh = live.alias("old"), new.dropDuplicates(key).alias("new")
    joined = old.join(fresh, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full_outer")
    action = F.when(F.col(f"old.{key[0]}").isNull(), "insert").when(F.col(f"new.{key[0]}").isNull(), "keep").when(differs(content, "old", "new"), "change").otherwise("refresh")
    return joined.withColumn("action", action)


def numbered(rows: DataFrame, start: int, key: list[str], buckets: int = 1024) -> DataFrame:
    """History ids above ``start``, without gaps; a batch has one row of a key, so any order will do.

    Rows are numbered within hashed buckets, and each bucket begins where those before it end; only the
    ``buckets`` counts meet in one task. ``rows`` is read twice, so it should be a table.
    """
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    local = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(*key, "tombstone")))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c")).select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    return local.join(first, "_bucket").withColumn("history_id", F.col("_n") + F.col("_first") + F.lit(start)).drop("_bucket", "_n", "_first")


def reconcile(live: DataFrame, new: DataFrame, prior: Column, key: list[str], content: list[str], observed_at: str, extra_removed: DataFrame | None = None) -> Changes:
    """Upsert ``new``; rows of ``live`` for which ``prior`` holds and that ``new`` lacks are removed.

    Live rows take every observation; history only inserts, changes and tombstones (whose content
    is null). ``extra_removed``: further keys to remove.
    """
    joined = diff(live, new, key, content)
    upserted = joined.where("action <> 'keep'").select("action", *[F.col(f"new.{c}").alias(c) for c in live.columns])
    gone = live.where(prior).select(*key).join(new.select(*key), key, "left_anti")
    if extra_removed is not None:
        gone = gone.unionByName(extra_removed.select(*key)).distinct()
    untouched = joined.where("action = 'keep'").select(*[F.col(f"old.{c}").alias(c) for c in live.columns])
    next_live = untouched.unionByName(upserted.drop("action")).join(gone, key, "left_anti").select(*live.columns)
    told = upserted.where("action IN ('insert', 'change')").drop("action").withColumn("tombstone", F.lit(False))
    tomb = gone.select(*[F.col(c) if c in key else F.lit(observed_at).alias(c) if c == "observed_at" else F.lit(None).cast(live.schema[c].dataType).alias(c) for c in live.columns]).withColumn("tombstone", F.lit(True))
    return Changes(next_live, told.unionByName(tomb), gone)


def stale_inbound(relations: DataFrame, removed_symbols: DataFrame, already: DataFrame) -> DataFrame:
    """Keys of live relations onto removed symbols, but those already removed."""
    onto = relations.join(removed_symbols.select(F.col("id").alias("target")), "target", "left_semi").select(*RELATION_KEY)
    return onto.join(already.select(*RELATION_KEY), RELATION_KEY, "left_anti")


def index_batch(symbols: DataFrame, relations: DataFrame, new_symbols: DataFrame, new_relations: DataFrame, paths: DataFrame, observed_at: str, prune_inferred: bool = True) -> tuple[Changes, Changes]:
    """Both tables after (re)indexing the files ``paths`` (one column ``path``), in one plan each.

    Without ``prune_inferred``, inferred relations of the files survive unless a removed symbol was their
    target.
    """
    touched = paths.select(F.col("path").alias("_p")).distinct().withColumn("_touched", F.lit(True))

    def marked(df: DataFrame, c: str) -> DataFrame:
        return df.join(touched, df[c] == touched["_p"], "left").select(df["*"], F.coalesce("_touched", F.lit(False)).alias("_touched"))

    sym = reconcile_marked(marked(symbols, "path"), new_symbols, SYMBOL_KEY, SYMBOL_CONTENT, observed_at)
    own = marked(relations, "site_file")
    if not prune_inferred:
        own = own.withColumn("_touched", F.col("_touched") & (F.col("confidence") != "INFERRED"))
    first = own.where("_touched").select(*RELATION_KEY).join(new_relations.select(*RELATION_KEY), RELATION_KEY, "left_anti")
    after = relations.select(*RELATION_KEY).unionByName(new_relations.select(*RELATION_KEY)).distinct()
    stale = stale_inbound(after, sym.removed, first)
    rel = reconcile_marked(own, new_relations, RELATION_KEY, RELATION_CONTENT, observed_at, stale)
    return sym, rel


def reconcile_marked(live: DataFrame, new: DataFrame, key: list[str], content: list[str], observed_at: str, extra: DataFrame | None = None) -> Changes:
    """``reconcile`` with the prior rows marked by a column ``_touched`` of ``live``."""
    plain = live.drop("_touched")
    gone = live.where("_touched").select(*key).join(new.select(*key), key, "left_anti")
    gone = gone if extra is None else gone.unionByName(extra.select(*key)).distinct()
    return reconcile(plain, new, F.lit(False), key, content, observed_at, gone)
