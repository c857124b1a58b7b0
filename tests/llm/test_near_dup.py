"""Shingles, sketches and near-duplicates against plain Python sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from codeloom.llm import near_dup, shingles
from codeloom.llm.graph import components


def sets_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, percent=85):
    sets = [sets_of(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    texts = [None, "", " \n", "One", "one", "one two three", "ONE  two\tthree", "É b", "é b"]
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(3, 160))]
        for _ in range(rnd.randrange(1, 25)):  # a cloud of copies around the threshold
            w = list(base)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = word()
            texts.append(rnd.choice([" ", "\n"]).join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(docs_of, seed):
    texts = corpus(seed)
    want = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs_of(texts)).collect()}
    assert got == want


def test_both_ways_to_fetch_sets_agree(docs_of):
    texts = corpus(3)[:60]
    a, b = ({tuple(r) for r in near_dup.near_duplicates(docs_of(texts), broadcast_ids=n).collect()} for n in (0, 10**6))
    assert a == b


def test_nulls_repeats_and_clashing_columns(spark, docs_of):
    assert near_dup.near_duplicates(docs_of([]).limit(0)).count() == 0
    text = "a b c d e f g h"
    rows = [(None, text), (None, text), (7, text), (7, text), (3, text), (4, None), (4, "x")]
    df = spark.createDataFrame([(*r, True, 1, "k") for r in rows], "doc_id long, text string, kept boolean, id int, key string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dup.near_duplicates(df).collect()))
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (4, 4, True), (4, 4, True), (7, 3, False), (7, 3, False)]


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_sketch_estimates_similarity_and_fills(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    b = np.concatenate([a[: -(-n * 2 // 3)], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)])
    x, y = near_dup.sketch(a, 1024), near_dup.sketch(b, 1024)
    assert x.max() < np.iinfo(np.uint64).max
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - similarity) < 0.08


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    rnd = random.Random(3)
    texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("ab \nÉC") for _ in range(rnd.randrange(60))) for _ in range(80)]
    whole = [s.tolist() for s in shingles.shingles(pa.array(texts, pa.string()))]
    monkeypatch.setattr(shingles, "CHUNK", 16)
    assert [s.tolist() for s in shingles.shingles(pa.array(texts, pa.string()))] == whole
    assert [len(s) for s in whole] == [len(sets_of(t)) for t in texts]


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("seed", [5, 6])
def test_pairs_around_a_cloud_of_linked_copies(spark, monkeypatch, seed):
    """Every pair of different components at the threshold is met, and rows are not copied by the square of the cloud."""
    rnd, new, made = random.Random(seed), iter(range(10**4, 10**6)), {}
    write = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    sets = []
    for i in range(240):
        lost = rnd.randrange(1, 4) if i < 200 else rnd.randrange(3, 12)
        kept = rnd.sample(range(60), 60 - lost)
        sets.append((i, i * 7, kept + [next(new) for _ in range(lost)], 1 if 5 < i < 200 else i))
    rest = spark.createDataFrame([(i, f, len(s), c) for i, f, s, c in sets], "id long, fp long, n long, component long")
    items = spark.createDataFrame([(i, f, s) for i, f, s, _ in sets], "id long, fp long, items array<long>")
    found = near_dup._prefix_pairs(rest, items, 80, share=8)
    met = {tuple(sorted((r["a"]["id"], r["b"]["id"]))) for r in found.collect()}
    want = set()
    for i, _, s, c in sets:
        for j, _, t, d in sets[:i]:
            k = len({*s} & {*t})
            if c != d and 100 * k >= 80 * (len(s) + len(t) - k):
                want.add((j, i))
    assert len(want) > 50 and want <= met
    rows = made["met"]
    copies = (rows.where("component <> largest") if "largest" in rows.columns else rows).groupBy().sum("parts").collect()[0][0]
    assert copies <= 4 * made["prefix"].count()
