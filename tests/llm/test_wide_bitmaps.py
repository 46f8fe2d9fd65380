"""What the near-duplicate stage shuffles to verify pairs."""

import random

import numpy as np
import pytest

from simloom.llm import shingle_join, simhash_dedup


@pytest.fixture
def rows_written(monkeypatch):
    """Rows of the tables that the join writes, by name."""
    rows, write = {}, shingle_join.written

    def counted(df, name):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(shingle_join, "written", counted)
    return rows


@pytest.mark.parametrize("known", [200_000, 0])
def test_texts_that_share_a_passage_are_told_apart_without_their_texts(spark, monkeypatch, rows_written, known):
    monkeypatch.setattr(shingle_join, "COMMON", 10**6)  # as if the sample had missed the passage
    monkeypatch.setattr(shingle_join, "MOST_WORDS", known, raising=False)
    r = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(1000)) for _ in range(40)]
    texts.append(texts[7] + " end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_texts(df).collect()}
    assert group == {k: 7 if k == 40 else k for k in range(41)}
    assert sum(rows_written["texts"]) <= 2
    if known:  # words that all texts use come last in the order, so texts don't even meet there
        assert sum(rows_written["pairs"]) <= 1
    else:
        assert sum(rows_written["pairs"]) > 30


def test_wide_bitmaps_never_differ_in_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(11)
    for n in (0, 1, 100, 127, 129, 900, 1030, 5000):
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        for gone, new in ((0, 0), (n // 9, 0), (0, n // 5), (n // 20, n // 20)):
            b = np.unique(np.concatenate([a[gone:], r.integers(-(2**63), 2**63 - 1, new)]))
            apart = shingle_join.wide_apart(shingle_join.wide_bitmap(a), shingle_join.wide_bitmap(b))
            assert apart <= len(np.setxor1d(a, b)) and (apart > 0) == (gone + new > 0)
        narrow = np.bitwise_xor.reduce(np.frombuffer(shingle_join.wide_bitmap(a), np.int64).reshape(-1, 4), axis=0)
        assert (narrow == shingle_join.bitmap(a)).all()
    a, b = (np.unique(r.integers(-(2**63), 2**63 - 1, 3000)) for _ in range(2))
    assert shingle_join.wide_apart(shingle_join.wide_bitmap(a), shingle_join.wide_bitmap(b)) > 2 * 6000 / 9
