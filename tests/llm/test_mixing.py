"""Budgets against their definition, and mixes against a plain run through the seeded order."""

import random
from collections import Counter, defaultdict

import pytest
from codeloom.llm import mixing
from codeloom.llm.mixing import Node, propagate, shares, tree
from pyspark.sql import functions as F


def test_shares_by_weight_and_shortage():
    assert shares([1, 1], [100, 100], 10) == [5, 5]
    assert shares([3, 1], [2, 100], 10) == [2, 8]
    assert shares([1, 1, 2], [1, 100, 3], 10) == [1, 6, 3]
    assert shares([1, 1], [3, 3], 10) == [3, 3]
    assert shares([1, 0], [4, 9], 6) == [4, 2]
    assert shares([1, 1, 1], [9, 9, 9], 10) == [4, 3, 3]
    assert shares([], [], 5) == []
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(1, 7)
        w, s, b = [rnd.choice([0, 1, 2.5]) for _ in range(n)], [rnd.randrange(20) for _ in range(n)], rnd.randrange(60)
        got = shares(w, s, b)
        assert sum(got) == min(b, sum(s)) and all(0 <= g <= x for g, x in zip(got, s))
        for i in range(n):  # whoever has room left got no less by weight than any other
            for j in range(n):
                if w[i] > 0 and w[j] > 0 and got[i] < s[i]:
                    assert got[i] / w[i] >= got[j] / w[j] - 1 / w[i] - 1 / w[j]


def test_siblings_share_shortages_before_ancestors():
    leaves = [(("a", "x"), 10), (("a", "y"), 100), (("b", "z"), 200)]
    got = propagate(tree(leaves, {}), 100)
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    got = propagate(tree([(("a", "x"), 10), (("a", "y"), 20), (("b", "z"), 200)], {}), 100)
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}
    assert propagate(Node(()), 5) == {(): 0}


@pytest.mark.parametrize(("fraction", "epochs"), [(0.0, 1), (0.3, 1), (1.0, 1), (0.7, 3)])
def test_prefixes_of_the_seeded_order(spark, docs_of, fraction, epochs):
    rnd = random.Random(7)
    texts = [None, ""] + [" ".join("w" * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 30))) for _ in range(400)]
    docs = docs_of(texts).withColumn("source", F.when(F.rand(3) < 0.6, F.lit("src0")).otherwise(F.col("source"))).cache()
    weights = {("srceven",): 1.0, ("srcodd",): 4.0}
    rows = docs.select("doc_id", "source", "lang", mixing.domain().alias("domain"), mixing.tokens().alias("n"), *[F.xxhash64(F.lit(11), F.lit(e), F.xxhash64("doc_id", "text")).alias(f"e{e}") for e in range(epochs)]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["domain"], r["lang"], r["source"]].append(r)
    supply = {k: epochs * sum(r["n"] for r in v) for k, v in by.items()}
    budgets = propagate(tree(list(supply.items()), weights), int(fraction * sum(supply.values()) / epochs))
    want = Counter()
    for k, v in by.items():
        at = 0
        for e in range(epochs):
            for r in sorted(v, key=lambda r: r[f"e{e}"] % 2**64):
                if at < budgets[k]:
                    want[r["doc_id"], e] += 1
                at += r["n"]
    got = Counter((r["doc_id"], r["mix_epoch"]) for r in mixing.mix(docs, weights, fraction, epochs).collect())
    words = {r["doc_id"]: r["n"] for r in rows}
    full = lambda c: Counter({k: n for k, n in c.items() if words[k[0]]})
    assert full(got) == full(want)
    assert all(n == 1 for n in got.values())


def test_rows_without_id_are_spread(spark, docs_of):
    """Rows of one id, or none, follow an order by their texts, and a part of them can be taken."""
    docs = docs_of([f"a b {i}" for i in range(300)]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit("src0"))
    got = mixing.mix(docs, {}, fraction=0.5).collect()
    assert len(got) == 150 and len({r["text"] for r in got}) == 150


def test_repeats_nulls_and_clashing_columns(spark, docs_of):
    assert mixing.mixed(docs_of([]).limit(0)).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "c d e"), (2, None)]
    df = spark.createDataFrame([(*r, None, None, 5, "k") for r in rows], "doc_id long, text string, lang string, source string, mix_epoch int, _n string")
    out = mixing.mix(df, {}, fraction=1.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "_n", "mix_epoch", "mix_tokens"]
    assert sorted((r["doc_id"] or 0, r["mix_tokens"]) for r in out.collect() if r["mix_tokens"]) == [(0, 3), (1, 2), (1, 2)]
