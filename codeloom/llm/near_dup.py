"""Near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ready
from .graph import components
from .shingles import long_lists, mix, release, shingles, slices

BANDS, ROWS = 32, 6
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 4096, dtype=np.uint64)
_U32 = np.uint64(32)


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a nonempty set of 64-bit numbers.

    Round i throws every item into a random bin with the value i plus a random fraction; a bin keeps
    its least value, and rounds end once no bin is empty. Should ``size`` rounds leave one, round
    ``size + b`` puts all items into bin b, so every coordinate fills. A coordinate of two sets is
    equal with a chance of their Jaccard similarity, and the mean over the coordinates concentrates
    as for independent ones. Small sets do several rounds at once, which changes nothing.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full(size, empty, dtype=np.uint64)
    done, step = 0, max(1, 4 * size // len(items))
    while done < size:
        rounds = np.arange(done, min(size, done + step), dtype=np.uint64)
        x = mix(items[None, :] ^ _SEEDS[rounds][:, None])
        np.minimum.at(out, ((x >> _U32) * np.uint64(size) >> _U32).astype(np.int64).ravel(), (rounds[:, None] << _U32 | x & np.uint64(0xFFFFFFFF)).ravel())
        done += len(rounds)
        if out.max() != empty:
            return out
    for b in np.flatnonzero(out == empty).tolist():
        x = mix(items ^ _SEEDS[size + b])
        out[b] = np.uint64(size + b) << _U32 | x.min() & np.uint64(0xFFFFFFFF)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = _SEEDS[2048 : 2048 + rows] | np.uint64(1)
    return mix(np.sum(coordinates.reshape(bands, rows) * weights, axis=1, dtype=np.uint64) + _SEEDS[3000 : 3000 + bands])


def _sketched(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, prints, keys = [], [], []
        for s in shingles(batch.column(1)):
            sizes.append(len(s))
            prints.append((int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _SEEDS[4000]).sum(dtype=np.uint64))))
            keys.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else s)
        both = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), long_lists(keys)], names=["doc_id", "n", "fp", "fp2", "keys"])
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = list(shingles(batch.column(1)))
        prints = np.array([mix(s).sum(dtype=np.uint64) for s in found], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), long_lists(found)], names=["id", "fp", "items"])
    release()


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of five-word shingles have a Jaccard similarity of at least ``percent``
    are linked; ``component_id`` is the least id that links reach. Texts without words link with
    nothing. A row without an id is a component of its own: ``component_id`` null, ``kept`` true.
    Rows that share an id are one vertex. Only ``doc_id`` and ``text`` are read.

    Equal sets become one class first. Classes meet in buckets by band (two sets at the threshold
    miss each other in all bands with a chance of 3e-7); a bucket's members are verified against its
    least, not against each other, and linked classes are joined. Where a bucket then still holds
    several components, its members of different ones are compared as well, so no link is lost; of
    those pairs, only such as share one of their rarest shingles can reach the similarity. A bucket
    of near copies so costs its size, linked or not.
    """
    spark = docs.sparkSession
    ready(spark)
    schema = "doc_id long, n long, fp long, fp2 long, keys array<long>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(texts.mapInArrow(lambda b: _sketched(b, bands, rows), schema), "sketches")
    classes = known.where("doc_id IS NOT NULL AND n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = materialize(classes, "classes")
    keyed = classes.select("id", "fp", "n", F.explode("keys").alias("key"))

    buckets = keyed.groupBy("key").agg(F.min(F.struct("id", "fp", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = materialize(keyed.join(buckets, "key"), "crowded")
    star = crowded.where("fp <> least.fp OR id <> least.id").select(F.struct("id", "fp").alias("a"), F.struct("least.id", "least.fp").alias("b"), F.col("n").alias("na"), F.col("least.n").alias("nb"))
    star = materialize(_likely(star, percent), "star")
    sets = _shingle_sets(spark, texts, star, broadcast_ids)
    links = materialize(_verified(star, sets, percent), "links")
    of = components(links)

    told = materialize(crowded.join(of, "id", "left").select("key", "id", "fp", "n", F.coalesce("component", "id").alias("component")), "told")
    mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rest = materialize(told.join(mixed, "key").select("id", "fp", "n", "component").distinct(), "rest")
    untold = materialize(_prefix_pairs(rest, _shingle_sets(spark, texts, rest, broadcast_ids), percent).join(star, ["a", "b"], "left_anti"), "untold")
    more = _verified(untold, _shingle_sets(spark, texts, untold, broadcast_ids), percent)
    all_links = links.unionByName(more)
    final = components(materialize(all_links, "all-links"))

    many = classes.where("copies > 1").select("fp", "fp2", "id")
    first = known.join(many, ["fp", "fp2"], "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("id"))
    out = first.join(final, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity, each once, the lesser end first."""
    fits = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int, share: int = 128) -> DataFrame:
    """Pairs of different components that can reach the similarity, by their rarest shingles.

    With all sets in one order, two sets of the similarity share an item among the first
    ``n - ceil(n * percent / 100) + 1`` of each. Rare items come first, so what most sets hold is in
    few prefixes. The first item that two sets share also tells how many more they can share at most:
    what comes after it in either. That ends most pairs of near copies that are too far apart.

    A pair of different components shares no more than the second best component of the item can (``reach``) and
    is no smaller than the item's least set allows, so a set that falls short of that meets nobody there. Of what
    is left, no pair lies within the item's largest component: its sets are only the one end of pairs. A
    cloud of copies that are linked, with others around that are not, so costs those others times the cloud.

    An item that many sets hold is dealt to one task for each ``share`` of them: a set goes to one of those as
    the one end of its pairs, and, unless of the largest component, to all as the other.
    """
    held = rest.join(sets, ["id", "fp"]).select("id", "fp", "n", "component", F.explode("items").alias("item"))
    often = held.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("id", "fp").orderBy("often", "item"))
    prefix = held.join(often, "item").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = materialize(prefix.where("often > 1").select("item", "id", "fp", "n", "component", (1 + F.col("n") - F.col("place")).alias("most")), "prefix")
    # small tables are written, so a join shuffles both sides anew and can split a frequent item
    by = materialize(prefix.groupBy("item", "component").agg(F.max("most").alias("most"), F.min("n").alias("n")), "item-components")
    best = by.groupBy("item").agg(F.max(F.struct("most", "component")).alias("best"), F.min("n").alias("least"), F.count(F.lit(1)).alias("components"))
    best = materialize(best.where("components > 1").select("item", F.col("best.component").alias("first"), "least"), "mixed-items")
    others = materialize(by.join(best, "item").where("component <> first").select("item", "most", "least"), "item-others")
    bounds = materialize(others.groupBy("item").agg(F.max("most").alias("reach"), F.first("least").alias("least")), "item-bounds")
    shared, partner = F.least("most", "reach"), F.greatest(F.ceil(F.col("n") * percent / 100), "least")
    near = prefix.join(bounds, "item").where(100 * shared >= percent * (F.col("n") + partner - shared)).drop("reach", "least")
    near = materialize(near, "near")
    sizes = near.groupBy("item", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(
        F.max(F.struct("n", "component")).alias("top"), F.ceil(F.sum("n") / share).cast("int").alias("parts"), F.count(F.lit(1)).alias("components"))
    sizes = materialize(sizes.where("components > 1").select("item", "parts", F.col("top.component").alias("largest")), "item-sizes")
    met = materialize(near.join(sizes, "item"), "met")
    x = met.withColumn("part", F.pmod(F.xxhash64("id", "fp"), F.col("parts")).cast("int")).alias("x")
    y = met.where("component <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    most = F.least("x.most", "y.most")
    same = (F.col("x.item") == F.col("y.item")) & (F.col("x.part") == F.col("y.part"))
    once = (F.col("x.component") == F.col("x.largest")) | (F.col("x.component") < F.col("y.component"))  # y is of another than the largest
    pairs = x.join(y, same & once & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)))
    return _likely(pairs.select(F.struct("x.id", "x.fp").alias("a"), F.struct("y.id", "y.fp").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")), percent)


def _shingle_sets(spark: SparkSession, texts: DataFrame, of: DataFrame, broadcast_ids: int) -> DataFrame:
    """The full sets of the documents in ``of``, which has pairs (a, b) or ids: id, fp, items."""
    each = of.select(F.explode(F.array("a.id", "b.id")).alias("doc_id")) if "a" in of.columns else of.select(F.col("id").alias("doc_id"))
    ids = materialize(each.distinct(), "ids")
    few = ids.count() <= broadcast_ids  # a checked size of some 16 MB; else both sides are shuffled
    wanted = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return materialize(wanted.mapInArrow(_sets, "id long, fp long, items array<long>").dropDuplicates(["id", "fp"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.struct("id", "fp").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.struct("id", "fp").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
    return both.where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def oracle(percent: int = 85) -> str:
    """The same as DuckDB SQL over ``documents``: all pairs that share a shingle, in full."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


def keep_first(docs: DataFrame, broadcast_ids: int = 1_000_000, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; rows without an id all stay.

    Rows that share the least id are copies of one document too, so only one of them stays.
    Two sets of a similarity of 0.8 miss each other in all of the bands with a chance of 1.3e-7.
    """
    found = materialize(near_duplicates(docs, percent, bands, rows).where("doc_id IS NOT NULL").select("doc_id", "kept"), "verdicts")

    def but(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = ids.count() <= broadcast_ids  # a checked size of some 16 MB; else both sides are shuffled
        return rows.join(F.broadcast(ids) if few else ids, "doc_id", how).select(*docs.columns)

    out = but(docs, materialize(found.where("NOT kept").select("doc_id").distinct(), "dropped"), "left_anti")
    repeated = materialize(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    return but(out, repeated, "left_anti").unionByName(but(out, repeated, "left_semi").dropDuplicates(["doc_id"]))
