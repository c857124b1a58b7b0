"""Toxicity: held-out accuracy, located sentences and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
from codeloom.llm import toxicity

BAD = "vile nasty rotten foul".split()


def corpus(n, seed=2):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        parts = [" ".join("".join(rnd.choice("abcdefg") for _ in range(3)) for _ in range(8)).capitalize() for _ in range(rnd.randrange(1, 12))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            k = rnd.randrange(len(parts))
            parts[k] = parts[k] + " " + rnd.choice(BAD) + " you " + rnd.choice(BAD)
        texts.append(". ".join(parts) + ".")
        labels.append((i, 1 - toxic, toxic))
    return texts, labels


def test_held_out_accuracy_and_places(spark, docs_of):
    texts, rows = corpus(1200)
    labels = spark.createDataFrame([*rows, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of([*texts, None, "", " . ! "])
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) + 3
    for i in got:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    unseen = [(t, got[i]["predicted"]) for i, _, t in rows if got[i]["held_out"]]
    assert sum(t == p for t, p in unseen) >= 0.97 * len(unseen)
    assert all(got[len(texts) + k]["score"] == 0 for k in range(3))
    for r in toxicity.locate(docs, model).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"]
        assert rows[r["doc_id"]][2] == 0 or any(b in r["sentence"] for b in BAD)


def test_labels_of_the_held_out_fold_change_nothing(spark, docs_of):
    texts, rows = corpus(300)
    docs = docs_of(texts)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    a, b = (toxicity.fit(docs, spark.createDataFrame(r, "doc_id long, quality int, toxic int")) for r in (rows, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_noisy_or_of_sentences(docs_of):
    word = toxicity.sentences(pa.array(["vile"]))[0][0]
    weights = np.zeros(1 << toxicity.BITS)
    weights[word] = 3.0
    model = toxicity.Model(weights, -2.0)
    docs = docs_of(["Vile.", "vile x! vile\nnone", "y"])
    p = 1 / (1 + np.exp(-1.0))
    q = 1 / (1 + np.exp(2.0))
    got = [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    # the words are told apart as they stand, so only the lower-case ones count
    upper = toxicity.sentences(pa.array(["Vile"]))[0][0] == word
    assert np.allclose(got, [p if upper else q, 1 - (1 - p) ** 2 * (1 - q), q])


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert max(r["score"] for r in toxicity.toxicity(docs_of(["a b", None]), none).collect()) < 1e-9
    assert toxicity.toxicity(docs_of([]).limit(0), none).count() == 0
    clash = docs_of(["a"]).selectExpr("*", "1 AS held_out", "2 AS score", "3 AS toxic")
    assert toxicity.toxicity(clash, none).count() == 1
