"""The pipeline, stage by stage, against plain versions over all documents."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from test_llm_operators import brute_targets
from test_pseudonym_twin import DIGEST, SECRET, twin
from test_shingle_join import true_components

from simloom.llm import pii_pseudonyms, source_mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_toxicity(spark, docs, rows, sf):
    scorer = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    return Counter(r for r in rows if scorer.score(r[1] or "") < toxicity.THRESHOLD)


def kept_by_near_dedup(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    tops = true_components([r[1] for r in order])
    return Counter(order[k] for k in range(len(order)) if tops[k] == k)


def pseudonymised(rows):
    pattern = re.compile(pii_pseudonyms.PATTERN)
    return Counter((r[0], None if r[1] is None else pattern.sub(lambda m: twin(m[0]), r[1]), *r[2:]) for r in rows)


def mixed(rows, source=3):
    size = lambda r: len(WORD.findall(r[1] or ""))
    h = lambda r: int(hashlib.md5(f"{source_mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)
    sizes = Counter()
    for r in rows:
        sizes[r[source]] += size(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = brute_targets({s: sizes[s] for s in order})
    copies, done = [], Counter()
    for r in sorted(rows, key=lambda r: (h(r), r[0] is None, r[0] or 0, size(r))):
        done[r[source]] += size(r)
        if size(r) and target[r[source]] > 0:
            copies += [((e * sizes[r[source]] + done[r[source]]) / target[r[source]], r[source] is None, r[source] or "", h(r), r) for e in range(3)]
    out, spent = Counter(), 0
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        spent += size(r)
        if spent > sum(sizes.values()):
            break
        out[r] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The documents with odd ones: null, empty, very long, secret, and a large group of copies."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    first = base.first()
    long = "lorem ipsum dolor sit amet " * 10_000 + "card 4845168114407329"
    odd = [(None, "a text without a number", "en", "a", 23), (9001, None, "en", None, None), (9002, "", None, "a", 0), (9003, long, "en", "b", len(long)), (9004, "mail jane@example.org", "en", "b", 20)]
    odd += [(9100 + k, first["text"] + (" more" if k % 2 else ""), "en", "b", 5) for k in range(60)]
    return base.unionAll(spark.createDataFrame(odd, base.schema)).cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_every_stage_equals_its_plain_version(spark, sf, docs):
    spark.conf.set(pii_pseudonyms.KEY_SETTING, SECRET)
    try:
        assert pii_pseudonyms._Build(SECRET).key == f"'{DIGEST}'"
        stages = dict(corpus_pipeline.STAGES)
        assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "encoding"]
        given = list(rows_of(docs).elements())
        out = stages["toxicity"](spark, docs, sf).cache()
        got = rows_of(out)
        assert got == kept_by_toxicity(spark, docs, given, sf) and 0 < sum(got.values()) < len(given)
        given, out = list(got.elements()), stages["near_dedup"](spark, out, sf).cache()
        got = rows_of(out)
        assert got == kept_by_near_dedup(given) and sum(got.values()) < len(given) - 50
        given, out = list(got.elements()), stages["pii"](spark, out, sf).cache()
        got = rows_of(out)
        # a pseudonym may be as long as another; n_chars follows the text
        assert Counter(r[:2] for r in got.elements()) == Counter(r[:2] for r in pseudonymised(given).elements())
        assert all(r[4] == len(r[1]) for r in got if r[1] is not None)
        given, out = list(got.elements()), stages["mixing"](spark, out, sf).cache()
        got = rows_of(out)
        assert got == mixed(given)
        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        last = stages["encoding"](spark, out, sf).collect()
        texts = {r[0]: r[1] for r in got}
        assert Counter(r["doc_id"] for r in last) == Counter(r[0] for r in got.elements())
        assert all(library.decode(list(s["ids"])) == texts[r["doc_id"]] for r in last for s in r["samples"])
    finally:
        spark.conf.unset(pii_pseudonyms.KEY_SETTING)
