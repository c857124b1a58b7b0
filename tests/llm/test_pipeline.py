"""The stages on a small table, each held against what it must do to its own input."""

import random

import corpus_pipeline
import pytest
from codeloom.llm import packing, quality_lm
from codeloom.llm.registry import tokenizer_path

from .test_near_dup import brute, sets_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["ba", "no", "ri", "tel"]) for _ in range(rnd.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randrange(20, 90))) for _ in range(150)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]] + ["".join(rnd.choice("#$%&*XQZ|0123") for _ in range(300)) for _ in range(10)]
    texts[5] = texts[5] + " password: hunter2hunter2 ok"
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, rnd.choice(["en", "de"]), f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns and {r["doc_id"] for r in after} <= set(before)
            assert len({r["doc_id"] for r in after}) == len(after)
        if name == "quality classifier":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            judged = {r["doc_id"]: r["kept"] for r in quality_lm.quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
            assert {r["doc_id"] for r in after} == {i for i, k in judged.items() if k}
            assert len(after) >= 170 and not any(r["doc_id"] >= 190 for r in after)
        if name == "near-duplicates":
            ids = sorted(before)
            want = brute([before[i]["text"] for i in ids])
            assert {r["doc_id"] for r in after} == {ids[k] for k, (_, c) in want.items() if k == c}
        if name == "secrets":
            assert len(after) == len(before)
            for r in after:
                assert "hunter2" not in r["text"]
                if r["doc_id"] != 5:
                    assert r.asDict() == before[r["doc_id"]]
        if name == "mixing":
            total = sum(len(b["text"].split()) for b in before.values())
            assert 0.75 * total < sum(len(r["text"].split()) for r in after) < total
        if name == "packing":
            encode = packing.encoder(tokenizer_path())
            assert {d: n for d, n in docs.groupBy("doc_id").sum("length").collect()} == {i: len(encode(b["text"])) + 1 for i, b in before.items()}
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_run_is_the_stages_in_turn(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    assert sets_of("a b") == {("a", "b")}


def test_near_copies_go_from_four_fifths(spark, docs_of):
    w = [f"w{i}" for i in range(104)]  # 100 shingles
    near = " ".join([*w[:94], *(f"x{i}" for i in range(10))])  # shares 90 of 110
    far = " ".join([*w[:84], *(f"y{i}" for i in range(20))])  # shares 80 of 120
    kept = corpus_pipeline.near_duplicates(spark, docs_of([" ".join(w), near, far]), "")
    assert {r["doc_id"] for r in kept.collect()} == {0, 2}


def test_odd_rows(spark, folder):
    """Null and empty texts go with the classifier; of repeated rows one stays; rows without id all stay; clashing names do no harm."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some, clash = docs.where("doc_id < 60"), ["kept", "_n", "_epoch", "_block", "rank", "spans", "c0", "_key", "mix_epoch", "length", "component"]
    odd = some.unionByName(some.where("doc_id < 5")).unionByName(some.where("doc_id IN (7, 8)").selectExpr("cast(NULL AS bigint) AS doc_id", "text", "cast(NULL AS string) AS lang", "cast(NULL AS string) AS source", "n_chars"))
    odd = odd.unionByName(spark.createDataFrame([(900, None, "en", "src0", None), (901, "", None, None, 0)], odd.schema))
    odd = odd.selectExpr("*", *[f"cast(doc_id AS string) AS {c}" for c in clash])
    now = odd
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, folder).cache()
        if name != "packing":
            assert now.columns == odd.columns
        if name == "quality classifier":
            assert not {900, 901} & {r["doc_id"] for r in now.collect()}
            assert now.count() >= odd.count() - 6
        if name == "near-duplicates":
            ids = [r["doc_id"] for r in now.collect()]
            assert ids.count(None) == before.where("doc_id IS NULL").count() and len({i for i in ids if i is not None}) == len([i for i in ids if i is not None])
        if name == "secrets":
            assert now.count() == before.count() and now.where("kept IS DISTINCT FROM cast(doc_id AS string)").count() == 0
    assert now.count() > 10


def test_empty_table(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.count() == 0
