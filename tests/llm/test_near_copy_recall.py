"""Pairs that the pipeline's near-duplicate stage finds, by their similarity."""

import random

import pytest

from simloom.llm import simhash_dedup


def true_set(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


@pytest.mark.parametrize("level", [0.80, 0.85, 0.90])
def test_every_pair_at_a_level_is_found(spark, level):
    r = random.Random(int(100 * level))
    texts, pairs, below = [], [], []
    while len(pairs) < 60 or len(below) < 20:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 400))]
        copy = list(words)
        for k in r.sample(range(len(copy)), max(1, round(len(copy) * (1 - level) / 9))):
            copy[k] = f"new{r.randrange(10**6)}"
        a, b = true_set(words), true_set(copy)
        j = len(a & b) / len(a | b)
        if level <= j < level + 0.03:
            pairs.append(len(texts))
        elif 0.70 < j < 0.80:
            below.append(len(texts))
        else:
            continue
        texts += [" ".join(words), " ".join(copy)]
        if level > 0.8 and len(pairs) >= 60:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_texts(df).collect()}
    assert all(group[k] == group[k + 1] for k in pairs) and all(group[k] != group[k + 1] for k in below)


def test_a_large_group_of_edited_copies_is_one(spark):
    r = random.Random(41)
    origin = [f"o{k}" for k in range(150)]
    texts = []
    for _ in range(600):
        copy = list(origin)
        for k in r.sample(range(150), r.randrange(1, 4)):
            copy[k] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["component_id"] for x in simhash_dedup.similar_texts(df).collect()} == {0}
