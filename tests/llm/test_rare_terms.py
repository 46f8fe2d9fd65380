"""Toxic terms that are rare, or many."""

import random
import string

from pyspark.sql import functions as F

from simloom.llm import toxicity


def test_rare_terms_are_learned(spark):
    r = random.Random(3)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    terms = ["".join(r.sample(string.ascii_lowercase, 7)) for _ in range(120)]
    rows = []
    for k in range(6000):
        words = [r.choice(plain) for _ in range(30)]
        if k < 1200:  # each term in one of 120 toxic texts
            words[r.randrange(30)] = terms[k % 120]
        rows.append((k, " ".join(words), int(k < 1200)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df)
    scorer = model.scorer()
    known = [bool(scorer.matches(t)[1]) for t in terms]  # chance leaves a few with too little evidence
    assert len(model.terms) > 64 and sum(known) >= 100
    out = toxicity.report(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("held_out")
    caught = out.agg(F.avg(F.when(F.col("doc_id") < 1200, F.col("predicted"))), F.avg(F.when(F.col("doc_id") >= 1200, F.col("predicted")))).first()
    assert caught[0] > 0.8 and caught[1] < 0.05, caught
