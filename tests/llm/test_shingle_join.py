"""Near duplicates against every pair's true similarity."""

import random

import pytest

from simloom.llm import shingle_join, simhash_dedup


def true_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def true_components(texts):
    sets, parent = [true_set(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(texts))]


def edited(r, words, edits):
    out = list(words)
    for k in r.sample(range(len(out)), edits):
        out[k] = f"new{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = ["", None, "one", "one two three four five"]
    for _ in range(60):  # pairs around the threshold
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 200))]
        out += [" ".join(words), " ".join(edited(r, words, max(1, round(len(words) * r.choice((0.015, 0.02, 0.025, 0.03))))))]
    hub = [f"h{k}" for k in range(150)]
    for _ in range(80):  # a large group; some members are similar only through others
        out.append(" ".join(hub))
        hub = edited(r, hub, 1) if r.random() < 0.5 else hub
        out.append(" ".join(edited(r, hub, r.randrange(1, 6))))
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 60))) for _ in range(60)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("partitions", "common"), [(1, 3), (7, 3), (3, 10**6)])
def test_near_duplicates_are_those_of_every_pair(spark, monkeypatch, texts, partitions, common):
    monkeypatch.setattr(shingle_join, "COMMON", common)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    rows = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_texts(df).collect()}
    assert [rows[k] for k in range(len(texts))] == true_components(texts)


def test_near_duplicates_without_sent_identifiers(spark, monkeypatch, texts):
    monkeypatch.setattr(shingle_join, "SENT", -1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_texts(df).collect()}
    assert [rows[k] for k in range(len(texts))] == true_components(texts)
