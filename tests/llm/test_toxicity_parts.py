"""What misspelled forms and context add to held-out scores, and groups of copies."""

import random

import numpy as np
import pytest

from simloom.llm import toxicity

TERMS = ["worthless", "idiotic", "disgusting", "pathetic", "grubscum", "loathsome"]


def misspelled(r, w):
    k = r.randrange(1, len(w) - 1)
    return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("xqz1") + w[k + 1 :], w[:k] + r.choice("xqz") + w[k:]])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    letters = "abcdefghilmnoprstuw"
    plain = ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(300)]
    plain += [w[:n] + "".join(r.choice(letters) for _ in range(6)) for w in TERMS for n in range(2, 7) for _ in range(6)]  # no stem tells
    out = []
    for k in range(2400):
        words = [r.choice(plain) for _ in range(r.randrange(15, 60))]
        y = int(k % 4 == 0)
        if y:  # abuse, half of it misspelled
            for _ in range(2):
                w = r.choice(TERMS)
                words[r.randrange(len(words))] = misspelled(r, w) if r.random() < 0.5 else w
        elif k % 4 == 1:  # reports of it
            w = r.choice(TERMS)
            words[r.randrange(len(words))] = r.choice([f'said "{w}" today', f'the word {w}', f"they wrote “such {w} things”"])
        out.append((k, " ".join(words), y))
    return out


def auc(spark, rows, **shares):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df, **shares)
    scorer = model.scorer()
    held = {x["doc_id"] for x in df.where(toxicity.held_out(df["doc_id"])).collect()}
    s = np.array([scorer.score(t) for k, t, _ in rows if k in held])
    y = np.array([v for k, _, v in rows if k in held])
    return (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2


def test_misspelled_forms_and_context_add_to_held_out_scores(spark, rows):
    whole = auc(spark, rows)
    assert whole > 0.9
    assert whole > auc(spark, rows, fuzzy=(0.0,)) + 0.02
    assert whole > auc(spark, rows, quoted=(1.0,)) + 0.02


def test_passages_of_copies_are_no_terms(spark):
    r = random.Random(32)
    plain = ["".join(r.choice("aeioulnrstm") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    text = lambda n: [r.choice(plain) for _ in range(n)]
    passage = [f"zz{k}{r.choice(plain)}" for k in range(60)]
    rows = []
    for k in range(900):
        words = text(40)
        if k % 3 == 0:
            words[r.randrange(40)] = "grubscum"
        if k % 9 == 0:  # near copies of one text, all toxic
            words = list(passage)
            words[r.randrange(60)] = "grubscum"
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = [t for t, _ in toxicity.learn(df, df).terms]
    assert any("grubscum".startswith(t) for t in terms) and not any(t.startswith("zz") for t in terms)


def test_quotations():
    found = lambda t: [t[a:b] for a, b in toxicity.quotations(t)]
    assert found('a "b c" d “e "f" g” «h» "i\nj" k') == ['"b c"', '“e "f" g”', "«h»"]
    assert found("„x“ „y” ‘z’ “open " + "w " * 1000 + "shut”")[-1].endswith("shut”")
    assert toxicity.quotations("“" * 1_000_000) == []
