"""Chains against all chains, alignment and planted passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from codeloom.llm import passages as P
from codeloom.llm.shingles import words


def brute_best(x, y):
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    f = {}
    for i in order:
        f[i] = P.SEED + max([0.0, *(f[j] - P.GAP * (x[i] - x[j] + y[i] - y[j]) for j in f if x[j] < x[i] and y[j] < y[i])])
    return max(f.values())


def test_best_chain_against_all():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randrange(2, 25)
        pts = list({(rnd.randrange(60), rnd.randrange(60)) for _ in range(n)})
        x, y = (np.array(c, dtype=np.int64) for c in zip(*pts))
        got = P.chains(x, y, 1)
        x0, x1, y0, y1, k = got[0]
        assert P.SEED * k - P.GAP * (x1 - x0 + y1 - y0) == pytest.approx(brute_best(x.tolist(), y.tolist()))
        assert sum(g[4] for g in got) == len(x)


def test_alignment_passes_differences():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([a[:30], [900, 901], a[31:60], a[64:]]).astype(np.uint64)
    assert P.align(a, b, 10, 10) == (0, 100, 0, len(b), 95, 6)
    none = np.arange(200, 210, dtype=np.uint64)
    assert P.align(a[:5], none, 0, 0)[4] == 0


def test_seeds_are_the_same_within_equal_passages():
    rnd = random.Random(5)
    common = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    sets = []
    for _ in range(2):
        text = " ".join(f"z{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 80))) + " " + common + " q q q"
        g, at = P.seeds(words(pa.array([text]))[0])
        assert (np.diff(at) <= P.WINDOW).all()
        sets.append(set(g.tolist()))
    assert len(sets[0] & sets[1]) >= 2


def test_planted_passages(spark, docs_of):
    rnd = random.Random(11)
    text = lambda n: [f"w{rnd.randrange(10**5)}" for _ in range(n)]
    passages = [text(60) for _ in range(4)]
    docs, want = [], {}
    for i in range(160):
        w = text(rnd.randrange(60, 300))
        if i % 4 == 0:
            p, k = list(passages[i // 4 % 4]), rnd.randrange(len(w))
            if i % 8 == 0:  # fuzzy
                p[20:21] = ["x", "y"]
                del p[40]
            w[k:k] = p
            want.setdefault(i // 4 % 4, []).append((i, k, k + len(p)))
        docs.append(" ".join(w))
    docs += [docs[1], docs[1].upper(), None, "", "a b"]
    found = {r["doc_id"]: r for r in P.repeated_passages(docs_of(docs)).collect()}
    planted = {i: (a, b, rows[0][0]) for rows in want.values() for i, a, b in rows[1:]}
    assert set(found) == set(planted) | {160, 161}
    for i, (a, b, other) in planted.items():
        r = found[i]
        assert r["other_id"] == other and abs(r["start"] - a) <= 6 and abs(r["end"] - b) <= 6 and r["n_equal"] >= 45
    n = len(docs[1].split())
    assert all((found[i]["other_id"], found[i]["start"], found[i]["end"], found[i]["n_equal"], found[i]["n_edits"]) == (1, 0, n, n, 0) for i in (160, 161))


def test_texts_that_repeat_themselves(docs_of):
    loop = " ".join(["la"] * 70 + ["di"] * 70)
    got = P.repeated_passages(docs_of([loop, "x y z", "a b " + loop])).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["end"], r["n_equal"]) for r in got] == [(2, 0, 2, 142, 140)]


def test_odd_tables(spark, docs_of):
    assert P.repeated_passages(docs_of([]).limit(0)).count() == 0
    text = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(None, text, 1), (4, text, 1), (4, text, 1), (9, text, 1)], "doc_id long, text string, seed int")
    assert {(r["doc_id"], r["other_id"]) for r in P.repeated_passages(df).collect()} == {(9, 4)}


def test_passages_of_frequent_lines(docs_of):
    rnd = random.Random(3)
    line = [" ".join(f"v{rnd.randrange(10**4)}" for _ in range(12)) for _ in range(60)]
    texts = [[rnd.choice(line) for _ in range(20)] for _ in range(600)]
    planted = {}
    for i in range(12):
        b, c = 300 + 2 * i, 500 + 2 * i
        p, k = [rnd.choice(line) for _ in range(5)], rnd.randrange(15)
        texts[b][3:3] = texts[c][k:k] = p
        planted[c] = (12 * k, 12 * k + 60)
    found = {}
    for r in P.repeated_passages(docs_of([" ".join(t) for t in texts])).collect():
        assert r["other_id"] < r["doc_id"] and r["n_equal"] >= 45
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert all(any(min(e, b) - max(s, a) >= 45 for s, e in found.get(c, [])) for c, (a, b) in planted.items())


def test_one_copy_here_and_two_there(docs_of):
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    p, fuzzy = text(60), text(80)
    other = " ".join("x" if i == 40 else w for i, w in enumerate(fuzzy.split()))
    docs = [" ".join([text(30), p, text(30), fuzzy]), " ".join([text(20), p, text(40), p, text(20), other, text(50), other])]
    got = sorted((r["start"], r["end"]) for r in P.repeated_passages(docs_of(docs)).collect())
    assert got == [(20, 80), (120, 180), (200, 280), (330, 410)]


def brute_passages(texts, least):
    """(document, first word, end) of every longest run of ``least`` words or more that a text shares with one before it."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w = t.lower().split()
        hit = [tuple(w[k : k + least]) in seen for k in range(len(w) - least + 1)]
        k = 0
        while k < len(hit):
            if hit[k]:
                end = k
                while end < len(hit) and hit[end]:
                    end += 1
                out.append((i, k, end - 1 + least))
                k = end
            else:
                k += 1
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), i)
    return out


def test_short_stretches_in_earlier_documents_hide_no_passage(docs_of):
    """Two texts share 60 words, ten earlier ones hold a stretch of 12 of them each: against all runs of all texts."""
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(20):
        p = text(60)
        docs += [" ".join([*text(20), *p[6 * k : 6 * k + 12], *text(20)]) for k in range(9)]
        docs += [" ".join([*text(10), *p, *text(30)]), " ".join([*text(25), *p, *text(5)])]
    want = brute_passages(docs, 51)
    assert len(want) == 20
    found = {}
    for r in P.repeated_passages(docs_of(docs)).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for i, a, b in want:
        assert any(s <= a + 6 and e >= b - 6 for s, e in found.get(i, []))
    assert set(found) == {i for i, _, _ in want}


def test_random_copies_against_all_runs(docs_of):
    """Texts pasted together from pieces of each other, some repeated: every shared run of 51 words or more is found."""
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    pool, docs = [text(rnd.randrange(90, 200)) for _ in range(12)], []
    for _ in range(80):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p) - 40)
            w += p[a : a + rnd.randrange(10, 160)] if rnd.random() < 0.7 else text(rnd.randrange(5, 40))
        docs.append(" ".join(w))
    found = {}
    for r in P.repeated_passages(docs_of(docs)).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    want = brute_passages(docs, 51)
    assert len(want) > 30
    for i, a, b in want:
        covered = set()
        for s, e in found.get(i, []):
            covered |= set(range(s, e))
        assert len(covered & set(range(a, b))) >= b - a - 12


def test_every_run_of_45_words_is_found_whatever_earlier_texts_hold(docs_of):
    """Two texts share 45 to 50 words, whose stretches of 12 to 20 earlier ones hold: against all runs of all texts."""
    rnd = random.Random(21)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    docs = []
    for i in range(60):
        n = 45 + i % 6
        p = text(n)
        docs += [" ".join([*text(20), *p[k : k + 12 + i % 9], *text(20)]) for k in range(0, n - 8, 4)]
        docs += [" ".join([*text(10), *p, *text(30)]), " ".join([*text(25), *p, *text(5)])]
    want = brute_passages(docs, 45)
    assert len(want) == 60
    found = {}
    for r in P.repeated_passages(docs_of(docs)).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for i, a, b in want:
        assert any(s <= a and e >= b for s, e in found.get(i, []))
    assert set(found) == {i for i, _, _ in want}
