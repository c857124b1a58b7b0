"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, local_table, materialize

BINS = 1 << 16  # ranges of each leaf's seeded order: the highest 16 bits of a hash
COARSE = 1 << 8  # as many of those at a time are one coarse range

FEW_LEAVES = 10_000  # so many leaves, some 2 MB, are broadcast


@dataclass
class Node:
    """A domain, language or source. ``supply``: tokens of a leaf, with all epochs it may have."""

    name: tuple[str, ...]
    weight: float = 1.0
    supply: int = 0
    children: list[Node] = field(default_factory=list)

    def total(self) -> int:
        return sum(c.total() for c in self.children) if self.children else self.supply


def shares(weights: list[float], supplies: list[int], budget: int) -> list[int]:
    """Deal ``budget`` by weight, none above its supply; what one can't take, the others share by weight.

    Whole tokens; what rounding leaves goes to the largest fractions first, ties to the first. The sum
    is the budget, or all supplies where they are less. Weight 0 takes only what no other can.
    """
    out = [0] * len(weights)
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        left, open_ = min(budget - sum(out), sum(supplies[i] for i in group)), list(group)
        while open_:
            each = {i: weights[i] if weights[i] > 0 else 1.0 for i in open_}
            all_ = sum(each.values())
            full = [i for i in open_ if supplies[i] <= left * each[i] / all_]
            if not full:
                exact = {i: left * each[i] / all_ for i in open_}
                for i in open_:
                    out[i] = int(exact[i])
                rest = left - sum(out[i] for i in open_)
                for i in sorted(open_, key=lambda i: (int(exact[i]) - exact[i], i)):
                    if rest > 0 and out[i] < supplies[i]:
                        out[i] += 1
                        rest -= 1
                break
            for i in full:
                out[i] = supplies[i]
                left -= supplies[i]
                open_.remove(i)
    return out


def propagate(root: Node, budget: int) -> dict[tuple[str, ...], int]:
    """The budget of every leaf.

    Every node deals what it gets among its children by their weights. A child that can't fill its
    share gives the rest to its siblings; only what all siblings together can't take counts as a
    shortage of their parent, whose own siblings then share it, and so up to the root.
    """
    if not root.children:
        return {root.name: min(budget, root.supply)}
    parts = shares([c.weight for c in root.children], [c.total() for c in root.children], budget)
    out: dict[tuple[str, ...], int] = {}
    for child, part in zip(root.children, parts):
        out |= propagate(child, part)
    return out


def tree(leaves: list[tuple[tuple[str, ...], int]], weights: dict[tuple[str, ...], float]) -> Node:
    """Nodes of all paths; a path that ``weights`` does not name weighs 1."""
    root = Node(())
    nodes = {(): root}
    for path, supply in sorted(leaves):
        for n in range(1, len(path) + 1):
            key = path[:n]
            if key not in nodes:
                nodes[key] = Node(key, weights.get(key, 1.0))
                nodes[key[:-1]].children.append(nodes[key])
        nodes[path].supply += supply
    return root


def tokens(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")).cast("long")


def domain(source: str = "source") -> Column:
    """The domain of a source: its name without the closing digits, and of those the parity."""
    number = F.regexp_extract(F.col(source), r"(\d+)$", 1)
    parity = F.when(number == "", "").when(F.substring(number, -1, 1).isin("0", "2", "4", "6", "8"), "even").otherwise("odd")
    return F.concat(F.regexp_replace(F.col(source), r"\d+$", ""), parity)


def mix(
    docs: DataFrame, weights: dict[tuple[str, ...], float], fraction: float = 0.5, epochs: int = 1, seed: int = 11, levels: tuple[Column, ...] | None = None, size: Column | None = None, content: Column | None = None,
) -> DataFrame:
    """``docs`` as mixed: their columns, with ``mix_epoch`` and ``mix_tokens`` (replaced where present).

    The budget is ``fraction`` of all tokens (words, or ``size``), dealt through the tree of domain, language
    and source (or ``levels``). A leaf's documents follow each other in a seeded order, a new one in every
    epoch, and it takes the documents that begin within its budget: so at most the last one exceeds it,
    and none comes more than ``epochs`` times. The order is a hash of id and text (or ``content``), so rows
    without an id, or of one id, are spread over it. Null levels count as "". Repeated rows are taken each by
    itself. Documents without words take no budget and follow the same order.

    The driver gets one row for each leaf, whose number is that of the sources and languages. The
    order is cut into BINS fine ranges in COARSE coarse ones of a hash in each leaf and epoch. All ranges
    before the one where the budget ends are taken whole, first the coarse ones, then the fine ones of the last
    coarse one, and only in the last fine one are documents summed up one by one, so no leaf, be it a
    third of all rows, comes to one task, and texts are not shuffled. Texts are counted once for the
    ranges; later only where a row is returned with its count, or lies in a last range.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("mix_epoch", "mix_tokens")]
    levels, size, content = levels or (domain(), F.col("lang"), F.col("source")), tokens() if size is None else size, F.col("text") if content is None else content
    keys = [f"_l{k}" for k in range(len(levels))]
    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    leaf = [F.coalesce(level, F.lit("")).alias(k) for k, level in zip(keys, levels)]
    placed = docs.select(*inner, size.alias("_n"), F.xxhash64("doc_id", content).alias("_row"), *leaf)
    copies = placed.withColumn("_epoch", F.explode(F.array(*map(F.lit, range(epochs)))) if epochs > 1 else F.lit(0))
    copies = copies.withColumn("_order", F.xxhash64(F.lit(seed), "_epoch", "_row"))
    copies = copies.withColumn("_bin", F.shiftrightunsigned("_order", 48).cast("int"))

    sums = materialize(copies.groupBy(*keys, "_epoch", "_bin").agg(F.sum("_n").alias("_sum")), "mix-ranges")
    sums = sums.withColumn("_coarse", (F.col("_bin") / (BINS // COARSE)).cast("int"))
    supply = {tuple(r[k] for k in keys): r["s"] for r in sums.groupBy(*keys).agg(F.sum("_sum").alias("s")).collect()}
    budgets = propagate(tree(list(supply.items()), weights), int(fraction * sum(n // epochs for n in supply.values())))
    schema = ", ".join(f"{k} string" for k in keys)
    last, edge = {}, {}
    ranges, at = sums.groupBy(*keys, "_epoch", "_coarse").agg(F.sum("_sum").alias("_sum")), [(*path, budgets[path], 0) for path in supply]
    for place in ("_coarse", "_bin"):  # first the coarse range where each budget ends, then the fine one in it
        wanted = local_table(spark, at, f"{schema}, _budget long, _base long" + (", _epoch int, _coarse int" if place == "_bin" else ""))
        found = ranges.join(F.broadcast(wanted) if len(at) <= FEW_LEAVES else wanted, keys + ["_epoch", "_coarse"] * (place == "_bin"))
        before = Window.partitionBy(*keys).orderBy("_epoch", place).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        ends = found.where("_from < _budget AND _from + _sum > _budget").collect()  # one range of a leaf at most
        whole = found.where("_from + _sum <= _budget AND _budget > 0").groupBy(*keys).agg(F.max(F.struct("_epoch", place)).alias("_last")).collect()
        for r in whole:
            last[tuple(r[k] for k in keys)] = (r["_last"]["_epoch"], (r["_last"][place] + 1) * (BINS // COARSE) - 1 if place == "_coarse" else r["_last"][place])
        edge = {tuple(r[k] for k in keys): r for r in ends}
        ranges, at = sums, [(*path, budgets[path], r["_from"], r["_epoch"], r["_coarse"]) for path, r in edge.items()]
        if not at:
            break
    plan = [(*path, budgets[path], *last.get(path, (-1, -1)), *((edge[path]["_epoch"], edge[path]["_bin"], edge[path]["_from"]) if path in edge else (-1, -1, 0))) for path in supply]
    where = local_table(spark, plan, f"{schema}, _budget long, _last_epoch int, _last_bin int, _end_epoch int, _end_bin int, _from long")
    chosen = copies.drop("_n").join(F.broadcast(where) if len(plan) <= FEW_LEAVES else where, keys)  # a checked size, else both are shuffled
    whole = chosen.where("_epoch < _last_epoch OR (_epoch = _last_epoch AND _bin <= _last_bin)")
    part = chosen.where("_epoch = _end_epoch AND _bin = _end_bin")
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    p = "mix_"  # so that no name clashes where the own columns are back
    while any(c.startswith(p) for c in columns):
        p += "_"
    run = Window.partitionBy(*[p + k for k in keys]).orderBy(p + "_order", p + "_row").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*named, *[F.col(c).alias(p + c) for c in ("_epoch", *keys, "_order", "_row", "_from", "_budget")]).withColumn(p + "_n", size)
    part = part.withColumn(p + "_start", F.col(p + "_from") + F.coalesce(F.sum(p + "_n").over(run), F.lit(0))).where(F.col(p + "_start") < F.col(p + "_budget"))
    whole = whole.select(*named, F.col("_epoch").alias(p + "_epoch")).withColumn(p + "_n", size)
    out = [*columns, F.col(p + "_epoch").alias("mix_epoch"), F.col(p + "_n").alias("mix_tokens")]
    return whole.select(*out).unionByName(part.select(*out))


#: The target: English and the even domain come first; sources weigh alike but for the largest.
WEIGHTS = {("srceven",): 3.0, ("srcodd",): 2.0, **{(d, "en"): 2.0 for d in ("srceven", "srcodd")}, ("srceven", "en", "src0"): 2.0}


def mixed(docs: DataFrame) -> DataFrame:
    """The production mix: half of all tokens, by WEIGHTS, in two epochs at most. Texts are counted once, into a
    table of the other columns. Tokens are words here, and a source's domain a stand-in (see ``domain``).
    """
    rows = materialize(docs.select("doc_id", domain().alias("domain"), "lang", "source", tokens().alias("n_tokens"), F.xxhash64("text").alias("content")), "mix-rows")
    out = mix(rows, WEIGHTS, fraction=0.5, epochs=2, size=F.col("n_tokens"), content=F.col("content"))
    return out.select("doc_id", "domain", "lang", "source", F.col("mix_epoch").alias("epoch"), "n_tokens")
