"""Enrichment: stub calls, composed mixins, the worklist and the merge policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RELATION_KEY, RELATIONS, STUB_PROVIDER, STUB_VERSION, names
from .resolution import SITE, unresolved
from .scans import symbols_at_position
from .tables import written


def is_stub_relation():
    return (F.col("predicate") == "calls") & (F.col("provenance_provider") == STUB_PROVIDER) & (F.col("provenance_version") == STUB_VERSION)


def _told(rows: DataFrame, over: list[str], observed_at: str) -> DataFrame:
    many = F.count(F.lit(1)).over(Window.partitionBy(*over))
    out = rows.withColumn("predicate", F.lit("calls")).withColumn("confidence", F.when(many == 1, "INFERRED").otherwise("AMBIGUOUS"))
    return out.withColumns({"provenance_provider": F.lit(STUB_PROVIDER), "provenance_version": F.lit(STUB_VERSION), "observed_at": F.lit(observed_at)}).select(*names(RELATIONS))


def stub_calls(symbols: DataFrame, relations: DataFrame, observed_at: str) -> DataFrame:
    """Calls of a protocol's stub method, as calls of the methods that implement it.

    Call, stub, the class that declares it (by ``defines`` in the same file, else by name), the classes
    that inherit from that directly, and their own methods of the same name that are no stubs.
    """
    stubs = symbols.where("is_stub").where(F.contains("qualname", F.lit("."))).select(F.col("id").alias("stub"), F.col("path").alias("stub_path"), X.owner("qualname").alias("owner"), X.leaf("qualname").alias("method_name"))
    classes = symbols.where("kind = 'class'")
    defined = relations.where("predicate = 'defines'").select(F.col("target").alias("stub"), F.col("source").alias("declaring"))
    by_edge = stubs.join(defined, "stub").join(classes.select(F.col("id").alias("declaring"), F.col("path").alias("stub_path")), ["declaring", "stub_path"], "left_semi").select("stub", "declaring", "method_name")
    by_name = stubs.join(by_edge, "stub", "left_anti").join(classes.select(F.col("path").alias("stub_path"), F.col("qualname").alias("owner"), F.col("id").alias("declaring")), ["stub_path", "owner"]).select("stub", "declaring", "method_name")
    inherits = relations.where("predicate = 'inherits' AND source <> target").select(F.col("target").alias("declaring"), F.col("source").alias("implementer"))
    below = by_edge.unionByName(by_name).join(inherits, "declaring").join(classes.select(F.col("id").alias("implementer"), F.col("path").alias("m_path"), F.col("qualname").alias("c_name")), "implementer")
    methods = symbols.where("kind = 'method' AND NOT is_stub").select(F.col("path").alias("m_path"), F.col("qualname").alias("m_name"), F.col("id").alias("method"))
    targets = below.withColumn("m_name", F.concat("c_name", F.lit("."), "method_name")).join(methods, ["m_path", "m_name"]).select("stub", "method").distinct()
    calls = relations.where("predicate = 'calls'").select(*SITE, F.col("target").alias("stub")).distinct()
    return _told(calls.join(targets, "stub").withColumn("target", F.col("method")), [*SITE, "stub"], observed_at)


def mixin_calls(sites: DataFrame, symbols: DataFrame, relations: DataFrame, observed_at: str) -> DataFrame:
    """Self-calls of a mixin, as calls of the methods of the other bases of the classes that compose it.

    ``sites``: source, enclosing_class, method_name and the site. One level only; a base counts with
    the method in its own file.
    """
    inherits = relations.where("predicate = 'inherits'")
    composed = inherits.select(F.col("target").alias("enclosing_class"), F.col("source").alias("composer")).distinct()
    bases = inherits.select(F.col("source").alias("composer"), F.col("target").alias("base")).distinct()
    known = symbols.select(F.col("id").alias("base"), F.col("path").alias("m_path"), F.col("qualname").alias("b_name"))
    methods = symbols.where("kind = 'method'").select(F.col("path").alias("m_path"), F.col("qualname").alias("m_name"), F.col("id").alias("target"))
    met = sites.select(*SITE, "enclosing_class", "method_name").distinct().join(composed, "enclosing_class").join(bases, "composer").where("base <> enclosing_class")
    found = met.join(known, "base").withColumn("m_name", F.concat("b_name", F.lit("."), "method_name")).join(methods, ["m_path", "m_name"])
    return _told(found.select(*SITE, "enclosing_class", "method_name", "target").distinct(), [*SITE, "enclosing_class", "method_name"], observed_at)


def worklist(relations: DataFrame, deferred: DataFrame, symbols: DataFrame, extracted: DataFrame) -> DataFrame:
    """Sites to look at again: ``kind`` (site or mixin), the site, predicate, enclosing_class, method_name.

    Live ambiguous calls and inheritances but those of stubs, and deferred facts without a candidate. An
    unresolved self-call in a class is a mixin site, unless another fact resolved that very site; a
    mixin site stands in for a plain one there.
    """
    open_ = written(unresolved(deferred, symbols))  # used three times below
    ambiguous = relations.where("predicate IN ('calls', 'inherits') AND confidence = 'AMBIGUOUS'").where(~is_stub_relation())
    nothing = F.lit(None).cast("string")
    plain = ambiguous.select(*SITE, "predicate").unionByName(open_.where("deferred_kind <> 'self_call' OR enclosing_class IS NULL").select(*SITE, F.when(F.col("deferred_kind") == "inherit", "inherits").otherwise("calls").alias("predicate"))).distinct()
    selfish = deferred.where("deferred_kind = 'self_call'")
    key = F.struct("enclosing_class", "method_name", "module_path", "base_name", *SITE)
    unmet = open_.where("deferred_kind = 'self_call'")
    met = selfish.withColumn("_key", key).join(unmet.select(key.alias("_key")).distinct(), "_key", "left_anti").select(*SITE)
    told = extracted.where("predicate = 'calls'").select(*SITE)
    mixins = unmet.where("enclosing_class IS NOT NULL").join(told, SITE, "left_anti").join(met, SITE, "left_anti")
    mixins = mixins.select(*SITE, "enclosing_class", "method_name").distinct()
    rest = plain.join(mixins.select(*SITE), SITE, "left_anti")
    return rest.select(F.lit("site").alias("kind"), *SITE, "predicate", nothing.alias("enclosing_class"), nothing.alias("method_name")).unionByName(
        mixins.select(F.lit("mixin").alias("kind"), *SITE, F.lit("calls").alias("predicate"), "enclosing_class", "method_name")
    )


def accepted(incoming: DataFrame, live: DataFrame) -> DataFrame:
    """Incoming relations that no live row of the same key outranks."""
    now = live.select(*RELATION_KEY, X.confidence_rank("confidence").alias("_rank"))
    both = incoming.join(now, RELATION_KEY, "left")
    return both.where(F.col("_rank").isNull() | (X.confidence_rank("confidence") <= F.col("_rank"))).select(*incoming.columns)


def retired(taken: DataFrame, live: DataFrame, preserve_siblings: bool = False) -> DataFrame:
    """Live ambiguous rows that accepted ones stand in for: same source, site and predicate, another
    target; beside an ambiguous one, only targets that this pass does not name."""
    if preserve_siblings:
        return live.limit(0)
    site = [c for c in RELATION_KEY if c != "target"]
    targets = taken.groupBy(*site).agg(F.min(X.confidence_rank("confidence")).alias("_best"), F.collect_set("target").alias("_targets"), F.collect_set(F.when(F.col("confidence") != "AMBIGUOUS", F.col("target"))).alias("_sure"))
    both = live.where("confidence = 'AMBIGUOUS'").join(targets, site)
    certain = (F.col("_best") < 2) & ((F.size("_sure") > 1) | ~F.array_contains("_sure", F.col("target")))
    unnamed = ~F.array_contains("_targets", F.col("target"))
    return both.where(certain | unnamed).select(*live.columns)


def merge(live: DataFrame, incoming: DataFrame, preserve_siblings: bool = False) -> DataFrame:
    """The live relations after an enrichment pass."""
    new = accepted(incoming, live)
    gone = retired(new, live, preserve_siblings).select(*RELATION_KEY).unionByName(new.select(*RELATION_KEY)).distinct()
    return live.join(gone, RELATION_KEY, "left_anti").select(*live.columns).unionByName(new.select(*live.columns))


_RANGE = "struct<start:struct<line:int,character:int>>"
_REPLY = f"array<struct<uri:string,range:{_RANGE},targetUri:string,targetSelectionRange:{_RANGE}>>"


def uri_path(uri: Column, root: str) -> Column:
    """The path below ``root`` that a ``file://`` address names; null for others and for what lies outside."""
    base = root.rstrip("/") + "/"
    path = F.when(F.startswith(uri, F.lit("file://")), F.try_url_decode(F.replace(F.substring(uri, 8, 1 << 20), F.lit("+"), F.lit("%2B"))))
    inside = F.startswith(path, F.lit(base)) & ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(inside, F.substring(path, len(base) + 1, 1 << 20))


def parsed_replies(replies: DataFrame, root: str) -> DataFrame:
    """The table that ``from_locations`` takes, from a provider's JSON answers: a column ``reply`` beside the site.

    An answer is one location, a list of them, or null; a location has ``uri`` and ``range``, or as a link
    ``targetUri`` and ``targetSelectionRange``. Broken answers and null tell nothing.
    """
    one = F.startswith(F.ltrim("reply"), F.lit("{"))
    found = F.from_json(F.when(one, F.concat(F.lit("["), "reply", F.lit("]"))).otherwise(F.col("reply")), _REPLY)
    each = replies.select(*SITE, "predicate", F.explode(found).alias("at"))
    start = F.coalesce("at.range.start", "at.targetSelectionRange.start")
    return each.select(*SITE, "predicate", uri_path(F.coalesce("at.uri", "at.targetUri"), root).alias("uri_path"), start["line"].alias("line"), start["character"].alias("character"))


def from_locations(locations: DataFrame, symbols: DataFrame, provider: str, version: str, observed_at: str) -> DataFrame:
    """Relations from answers of a definition provider: a site and ``uri_path, line, character`` (from 0).

    Only sites with exactly one answer inside the repository count; it means the smallest symbol around
    the position.
    """
    key = [*SITE, "predicate"]
    one = locations.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("uri_path").alias("path"), F.first("line").alias("l"), F.first("character").alias("col")).where("n = 1 AND path IS NOT NULL")
    points = one.select("path", (F.col("l") + 1).alias("line"), "col").distinct()
    at = symbols_at_position(symbols, points)
    met = one.withColumn("line", F.col("l") + 1).join(at, ["path", "line", "col"])
    out = met.withColumn("target", F.col("id")).withColumn("confidence", F.lit("INFERRED"))
    return out.withColumns({"provenance_provider": F.lit(provider), "provenance_version": F.lit(version), "observed_at": F.lit(observed_at)}).select(*names(RELATIONS))
