"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order four over UTF-16 code units, so an n-gram is exactly one 64-bit number: its
units from high to low. Its contexts and suffixes are shifts and masks of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parallelism, ready
from .shingles import release

ORDER = 4
UNITS = 1 << 16
BEGIN = 2  # the unit that stands before a text
CHUNK = 1 << 20  # units looked at at once
BINS = 1000  # of the logarithm of perplexity, by unit, for quantiles


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams that end at each unit of a text, a chunk at a time."""
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    for lo in range(0, len(raw), CHUNK):
        ahead = raw[max(0, lo - ORDER + 1) : lo]
        part = np.concatenate([np.full(ORDER - 1 - len(ahead), BEGIN, dtype=np.uint64), ahead.astype(np.uint64), raw[lo : lo + CHUNK].astype(np.uint64)])
        n = len(part) - ORDER + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(ORDER):
            out = out << np.uint64(16) | part[k : k + n]
        yield out.view(np.int64)


def _packed(texts: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    """All n-grams of many texts, gathered to chunks of some CHUNK."""
    held, size = [], 0
    for t in texts:
        for g in grams(t.as_py() or ""):
            held.append(g)
            size += len(g)
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Partial counts; what a task has gathered is passed on whenever it exceeds ``most``."""
    seen, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts)], names=["g", "c"])

    for batch in batches:
        for g in _packed(batch.column(0)):
            new, c = np.unique(g, return_counts=True)
            merged, inverse = np.unique(np.concatenate([seen, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, c]), minlength=len(merged)).astype(np.int64)
            seen = merged
            if len(seen) > most:
                yield out()
                seen, counts = seen[:0], counts[:0]
    yield out()


def _mask(units: int) -> Column:
    return F.lit((1 << 16 * units) - 1)


def _before(g: str) -> Column:
    """The context of an n-gram: all its units but the last."""
    return F.shiftrightunsigned(F.col(g), 16)


class Model:
    """The count tables by order, sharded by n-gram, and what interpolation needs of each context."""

    def __init__(self, counts: DataFrame):
        spark = counts.sparkSession
        self.counts = {ORDER: materialize(counts, "counts-4")}
        for n in range(ORDER - 1, 0, -1):  # how many different units stand before an n-gram
            longer = self.counts[n + 1].select(F.col("g").bitwiseAND(_mask(n)).alias("g"))
            self.counts[n] = materialize(longer.groupBy("g").agg(F.count(F.lit(1)).alias("c")), f"counts-{n}")
        self.contexts, self.discounts = {}, {}
        for n in range(1, ORDER + 1):
            found = {r["c"]: r["count"] for r in self.counts[n].where("c <= 4").groupBy("c").count().collect()}  # four numbers
            self.discounts[n] = _discounts(found)
            if n > 1:
                d = self.discounts[n]
                left = F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
                by = self.counts[n].groupBy(_before("g").alias("h")).agg(F.sum("c").alias("total"), left.alias("left"))
                self.contexts[n] = by
        top = self.counts[1].agg(F.sum("c").alias("total"), F.sum(F.least(F.col("c"), F.lit(3)).cast("double")).alias("capped")).collect()[0]
        kinds = {r["k"]: r["count"] for r in self.counts[1].groupBy(F.least("c", F.lit(3)).alias("k")).count().collect()}
        self.total = float(top["total"] or 0)
        self.left = sum(self.discounts[1][k - 1] * n for k, n in kinds.items())
        self.spark = spark

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """``g, p`` for distinct n-grams ``g``: joins with the tables of every order, from the lowest."""
        d = self.discounts
        first = self.counts[1].select(F.col("g").alias("_k"), F.col("c").alias("_c"))
        out = asked.withColumn("_k", F.col("g").bitwiseAND(_mask(1))).join(first, "_k", "left")
        uniform = F.lit(1.0 / UNITS)
        p = (_discounted(d[1]) + F.lit(self.left) * uniform) / F.lit(self.total) if self.total else uniform
        out = out.withColumn("p", p).drop("_k", "_c")
        for n in range(2, ORDER + 1):
            own = F.col("g") if n == ORDER else F.col("g").bitwiseAND(_mask(n))
            own_count = self.counts[n].select(F.col("g").alias("_k"), F.col("c").alias("_c"))
            context = self.contexts[n].select(F.col("h").alias("_h"), "total", "left")
            out = out.withColumn("_k", own).withColumn("_h", F.shiftrightunsigned("_k", 16)).join(own_count, "_k", "left").join(context, "_h", "left")
            joined = (_discounted(d[n]) + F.col("left") * F.col("p")) / F.col("total")
            out = out.withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise(joined)).drop("_k", "_h", "_c", "total", "left")
        return out


def _discounted(d: tuple[float, float, float]) -> Column:
    c = F.col("_c")
    return F.when(c.isNull(), 0.0).when(c == 1, 1 - d[0]).when(c == 2, 2 - d[1]).otherwise(c - d[2])


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of an order from how many n-grams occur once to four times."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Trusted are the documents of label quality 1; a fifth of them, by hash, sets the thresholds and
    is not counted, as a text that the model has counted is likelier than any other.
    """
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.withColumn("_trusted", F.when(F.pmod(F.xxhash64(F.lit("threshold"), "doc_id"), F.lit(5)) == 0, "threshold").otherwise("model"))


def scored(docs: DataFrame, labels: DataFrame, broadcast_ids: int = 1_000_000, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``_trusted``, ``_n`` (units) and ``_logp`` (of the text) for every document.

    Of the trusted documents (see ``trusted_ids``), all for the model are counted. Documents are dealt by
    hash into blocks of about ``block_bytes`` of text. A block asks for its distinct n-grams, those of all
    blocks are looked up once by joins with the sharded tables, and the answers meet the block's
    texts, so texts are shuffled twice and no task holds the model. Rows equal in id and text have
    one block: the asking task meets each such text once from each task before it, and to be scored a block of
    twice the size or more is cut into parts, each of which gets the block's answers.
    """
    spark = docs.sparkSession
    ready(spark)
    ids = materialize(trusted_ids(labels), "trusted")
    few = ids.count() <= broadcast_ids  # a checked size; else both sides are shuffled
    with_ids = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left").select(*[docs[c] for c in docs.columns], F.coalesce("_trusted", F.lit("no")).alias("_trusted"))
    counts = with_ids.where("_trusted = 'model' AND text IS NOT NULL").select("text").mapInArrow(_count, "g long, c long")
    model = Model(counts.groupBy("g").agg(F.sum("c").alias("c")))

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    blocks = max(parallelism(spark), -(-int(docs.agg(F.sum(size)).collect()[0][0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    sized = docs.select(block.alias("_block"), size.alias("_size")).groupBy("_block").agg(F.sum("_size").alias("_size"))
    large = materialize(sized.where(F.col("_size") >= 2 * block_bytes).select("_block", F.ceil(F.col("_size") / block_bytes).cast("int").alias("_parts")), "large-blocks")
    cut = not large.isEmpty()

    once = docs.select(block.alias("_block"), "text").where("text IS NOT NULL").mapInArrow(_once, "_block int, text string")
    asked = materialize(once.repartition(blocks, "_block").mapInArrow(_asked, "_block int, g long"), "asked")
    known = model.probabilities(asked.select("g").distinct())
    answers = asked.join(known, "g").select("_block", "g", F.log("p").alias("logp"))
    dealt, keys = with_ids.withColumn("_block", block), ["_block"]
    if cut:
        keys = ["_block", "_part"]
        parts = F.coalesce("_parts", F.lit(1))
        dealt = dealt.withColumn("_row", F.monotonically_increasing_id()).join(large, "_block", "left").withColumn("_part", F.pmod(F.xxhash64("_row"), parts).cast("int")).drop("_row", "_parts")
        answers = answers.join(large, "_block", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    names = [*docs.columns, "_trusted"]
    schema = T.StructType([*docs.schema.fields, T.StructField("_trusted", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_logp", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        g = right.column("g").to_numpy()
        order = np.argsort(g)
        g, logp = g[order], right.column("logp").to_numpy()[order]
        sums, sizes = [], []
        for t in left.column("text") if len(left) else ():
            n, total = 0, 0.0
            for part in grams(t.as_py() or ""):
                n += len(part)
                total += float(logp[np.searchsorted(g, part)].sum())
            sums.append(total)
            sizes.append(n)
        release()
        return left.select(names).append_column("_n", pa.array(sizes, pa.int64())).append_column("_logp", pa.array(sums, pa.float64()))

    return dealt.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(score, schema)


def _once(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows without those equal to one that this task has passed on (of the last ``most``, at least)."""
    seen: set[tuple[int, bytes]] = set()
    for batch in batches:
        keep = []
        for i, (block, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            key = block, blake2b(text.as_buffer(), digest_size=16).digest()
            if key not in seen:
                seen = {key} if len(seen) >= most else seen
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())) if len(keep) < len(batch) else batch


def _asked(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block of a partition, as far as ``most`` can be held; the same may come again."""
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for block, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block, dtype=np.int32)), pa.array(g)], names=["_block", "g"])
        held.clear()

    for batch in batches:
        of = batch.column(0).to_numpy()
        for block in np.unique(of).tolist():
            texts = batch.column(1).filter(pa.array(of == block))
            for g in _packed(texts):
                held[block] = np.union1d(held.get(block, g[:0]), g)
        if sum(map(len, held.values())) > most:
            yield from out()
    yield from out()
    release()


def judged(found: DataFrame, quantile: float = 0.99, slack: float = 0.05) -> DataFrame:
    """Add ``perplexity``, ``threshold`` and ``kept`` to a table of ``scored``.

    The threshold is, for each language, the least perplexity (to a thousandth) that ``quantile`` of
    its trusted documents outside the model do not exceed, and ``slack`` more; languages without
    any take that of all; with none at all nothing is rejected. A null or empty text has no perplexity
    and is rejected. The counts behind the quantiles are of all those documents.
    """
    log_ppl = -F.col("_logp") / F.col("_n")
    found = found.withColumn("_bin", F.when(F.col("_n") > 0, F.ceil(log_ppl * BINS)))
    trusted = found.where("_trusted = 'threshold' AND _bin IS NOT NULL")
    by_lang = trusted.groupBy(F.coalesce("lang", F.lit("")).alias("_lang"), "_bin").agg(F.count(F.lit(1)).alias("_c"))
    both = by_lang.unionByName(by_lang.groupBy("_bin").agg(F.sum("_c").alias("_c")).withColumn("_lang", F.lit(None).cast("string")))
    so_far = F.sum("_c").over(Window.partitionBy("_lang").orderBy("_bin"))
    all_ = F.sum("_c").over(Window.partitionBy("_lang"))
    cut = both.withColumn("_share", so_far / all_).where(F.col("_share") >= quantile).groupBy("_lang").agg(F.min("_bin").alias("_cut"))
    cut = materialize(cut, "thresholds")
    own, general = cut.where("_lang IS NOT NULL"), cut.where("_lang IS NULL").select(F.col("_cut").alias("_all"))
    out = found.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(own, "_lang", "left")
    rows = general.collect()  # one number
    limit = F.coalesce("_cut", F.lit(rows[0]["_all"] if rows else None).cast("long")) + int(np.ceil(np.log1p(slack) * BINS))
    return (
        out.withColumn("perplexity", F.when(F.col("_n") > 0, F.exp(log_ppl)))
        .withColumn("threshold", F.exp(limit / BINS))
        .withColumn("kept", F.when(F.col("_bin").isNull(), False).otherwise(F.coalesce(F.col("_bin") <= limit, F.lit(True))))
        .drop("_lang", "_cut", "_bin")
    )


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """One row per document: ``doc_id, lang, n_units, perplexity, threshold, kept``.

    Repeated rows are scored each by itself; rows without an id are scored, never trusted. Only
    ``doc_id``, ``text`` and ``lang`` are read.
    """
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), labels).select("doc_id", "lang", "_trusted", "_n", "_logp")
    out = judged(materialize(found, "perplexity"), quantile)
    return out.select("doc_id", "lang", F.col("_n").alias("n_units"), "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    named = own.withColumns({c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text", "lang")}).drop(*[f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang")])
    out = judged(materialize(scored(named, labels), "scored"), quantile).where("kept")
    return out.select(*[F.col(c if c in ("doc_id", "text", "lang") else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
