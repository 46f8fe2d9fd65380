"""What toxicity's counting of terms holds at a time."""

import random
from collections import Counter

import pyarrow as pa

from simloom.llm import toxicity


def test_terms_are_handed_on_before_they_fill_a_worker():
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefghij", k=8)) for _ in range(500)) for _ in range(300)]
    rows = pa.record_batch([pa.array(texts), pa.array([k % 2 for k in range(300)], pa.int32())], names=["text", "y"])
    sums, sizes = Counter(), []
    for b in toxicity._term_counts(iter([rows])):
        sizes.append(b.num_rows)
        for x in b.to_pylist():
            sums.update({(x["term"], c): x[c] for c in ("d1", "d0", "f1", "f0")})
    assert max(sizes) < 150_000 < sum(sizes)
    whole = Counter()
    for k, t in enumerate(texts):
        words = Counter(w + " " for w in t.split())
        whole.update({(w, f"f{k % 2}"): n for w, n in words.items()})
        whole.update((w, f"d{k % 2}") for w in words)
    assert {k: n for k, n in sums.items() if k[0].endswith(" ") and n} == whole
