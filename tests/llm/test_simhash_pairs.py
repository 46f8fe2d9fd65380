"""SimHash under the generalised pigeonhole principle in the pipeline's near-duplicate stage."""

import random

import corpus_pipeline

from simloom.llm import shingle_join, simhash_dedup
from simloom.llm.components import roots


def long_copies(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            copy[r.randrange(1500)] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts + ["", None, "one two", "one two", "ONE two"]


def test_pairs_are_those_of_all_fingerprints_within_two_bits(spark):
    texts = long_copies(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = shingle_join.marked_sets(df, "doc_id", "text", 5, 0.8, simhash_dedup.majority).cache()
    rows = {x["doc_id"]: x for x in marked.collect()}
    marks = [simhash_dedup.fingerprint((t or "").encode(), 5) for t in texts]
    assert [rows[k]["simhash"] for k in range(len(texts))] == [simhash_dedup.signed(m) for m in marks]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2 and top[a] != top[b]:
                top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    found = {x["u"]: x["v"] for x in roots(simhash_dedup.probable(marked, 2)).collect()}
    got = [found.get(rows[k]["fp"], rows[k]["fp"]) for k in range(len(texts))]
    assert len(set(top)) < len(set(marks)) and len(set(got)) == len(set(top)) == len(set(zip(got, top, strict=True)))


def test_the_stage_verifies_the_pairs_of_simhash_first(spark, monkeypatch, tmp_path):
    searched, checked = [], []
    links, check = simhash_dedup.links, shingle_join.verified

    def noted(nodes, threshold=2):
        searched.append(threshold)
        return links(nodes, threshold)

    def counted(pairs, *rest):
        out = check(pairs, *rest)
        checked.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "links", noted)
    monkeypatch.setattr(shingle_join, "verified", counted)
    df = spark.createDataFrame(list(enumerate(long_copies(5))), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path))
    assert sorted(x["doc_id"] for x in kept.collect()) == [*range(0, 48, 4), 48, 50]
    assert searched == [2] and checked[0] > 0
