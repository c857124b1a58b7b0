"""The Kneser-Ney model against a plain implementation; the classifier on clean and broken text."""

import math
import random
from collections import Counter

import pytest
from codeloom.llm import quality_lm

L = "doc_id long, quality int, toxic int"


def units(text):
    raw = text.encode("utf-16-le", "surrogatepass")
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def brute(trusted, texts):
    """Log probability of each text, straight from the definition."""
    tables = {4: Counter()}
    for t in trusted:
        u = [2, 2, 2, *units(t)]
        tables[4].update(tuple(u[i : i + 4]) for i in range(len(u) - 3))
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    d = {n: quality_lm._discounts(Counter(c for c in tables[n].values() if c <= 4)) for n in tables}

    def p(g, n):
        if n == 0:
            return 1 / 65536
        g = g[-n:]
        followers = {x: c for x, c in tables[n].items() if x[:-1] == g[:-1]}
        if not followers:
            return p(g, n - 1)
        cut = lambda c: d[n][min(c, 3) - 1]
        c = followers.get(g, 0)
        return (max(0, c - cut(c)) if c else 0) / sum(followers.values()) + sum(map(cut, followers.values())) / sum(followers.values()) * p(g, n - 1)

    out = []
    for t in texts:
        u = [2, 2, 2, *units(t or "")]
        out.append(sum(math.log(p(tuple(u[i : i + 4]), 4)) for i in range(len(u) - 3)))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_log_probabilities(spark, docs_of, few):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc é🎉") for _ in range(rnd.randrange(40))) for _ in range(30)] + [None, "", "zzzz"]
    trusted = list(range(0, 30, 2))
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(30)] + [(None, 1, 0)], L)
    model = {r["doc_id"] for r in quality_lm.trusted_ids(labels).where("_trusted = 'model'").collect()}
    assert 5 < len(model) < len(trusted)
    want = brute([texts[i] for i in trusted if i in model], texts)
    got = {r["doc_id"]: r for r in quality_lm.scored(docs_of(texts), labels, broadcast_ids=10**6 if few else 0, block_bytes=100).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["_n"] == len(units(t or "")) and got[i]["_logp"] == pytest.approx(want[i], rel=1e-9)


def test_equal_rows_are_cut_into_parts(spark):
    """Rows equal in id and text share a block, which is scored in parts; null languages count as one."""
    rows = [(None, "the same text again", None)] * 500 + [(i, f"text {i}", "en") for i in range(40)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], L)
    whole = sorted((str(r["doc_id"]), str(r["text"]), r["_n"], round(r["_logp"], 9)) for r in quality_lm.scored(docs, labels).collect())
    parts = quality_lm.scored(docs, labels, block_bytes=1000)
    assert "_part" in parts._jdf.queryExecution().toString()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["_n"], round(r["_logp"], 9)) for r in parts.collect()) == whole and len(whole) == 541
    assert quality_lm.quality(docs, labels).where("doc_id IS NULL").count() == 500


def test_chunks_change_nothing(monkeypatch):
    text = "abcdefghijklmnop" * 3
    whole = [int(x) for g in quality_lm.grams(text) for x in g]
    monkeypatch.setattr(quality_lm, "CHUNK", 5)
    assert [int(x) for g in quality_lm.grams(text) for x in g] == whole and len(whole) == len(text)


def test_classifier_rejects_noise_and_keeps_clean(spark, docs_of):
    rnd = random.Random(9)
    parts = ["ba", "no", "ri", "tel", "sum", "ka"]
    clean = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(40)) for _ in range(300)]
    noise = ["".join(rnd.choice("#$%&*XQZ|0123") for _ in range(200)) for _ in range(40)]
    docs = docs_of(clean + noise + [None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(300, 320)], L)
    got = {r["doc_id"]: r for r in quality_lm.quality(docs, labels).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 290 and not any(got[i]["kept"] for i in range(300, 342))
    assert got[340]["perplexity"] is None
    kept = quality_lm.keep_good(docs.withColumn("kept", docs["lang"]).withColumn("_n", docs["lang"]), labels)
    assert kept.columns == [*docs.columns, "kept", "_n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["kept"])


def test_no_labels_no_rows(spark, docs_of):
    none = spark.createDataFrame([], L)
    assert [r["kept"] for r in quality_lm.quality(docs_of(["some text"]), none).collect()] == [True]
    assert quality_lm.quality(docs_of([]).limit(0), none).count() == 0
