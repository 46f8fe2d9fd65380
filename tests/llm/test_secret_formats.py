"""Credentials of learned formats, planted without a label among ordinary runs."""

import random
import string

from simloom.llm import secret_scan
from simloom.llm.automata import Automaton
from simloom.llm.secret_scan import SYMBOLS, plain

BASE62 = string.ascii_letters + string.digits


def of(r, letters, n):
    return "".join(r.choice(letters) for _ in range(n))


FORMATS = {
    "ghp": lambda r: "ghp_" + of(r, BASE62, 36),
    "live": lambda r: "sk_live_" + of(r, BASE62, 24),
    "uuid": lambda r: "-".join(of(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
    "pass": lambda r: of(r, string.ascii_uppercase, 4) + of(r, string.digits, 4) + of(r, string.ascii_uppercase, 6),
}


def ordinary(r):
    word = lambda: "".join(r.choice(["on", "ti", "er", "an", "the", "re", "st", "ly", "ou", "in"]) for _ in range(r.randrange(2, 6)))
    return r.choice(
        [
            word,
            word,
            word,
            lambda: word().capitalize() + ".",
            lambda: f"{word()}_{word()}_{word()}",
            lambda: word() + word().capitalize() + word().capitalize(),
            lambda: f"/usr/{word()}/{word()}.{r.choice(['py', 'txt', 'html'])}",
            lambda: f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
            lambda: str(r.randrange(10**15)),
            lambda: f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(99)}",
            lambda: word().upper() + word().upper(),
            lambda: "-".join(word() for _ in range(4)),
        ]
    )()


def text(r, value=None):
    words = [ordinary(r) for _ in range(60)]
    at = r.randrange(60)
    if value:
        words.insert(at, value)
    return " ".join(words)


def test_planted_credentials_are_found(spark):
    r = random.Random(11)
    texts = [text(r, f'token = "{make(r)}"') for make in FORMATS.values() for _ in range(60)]
    texts += [text(r) for _ in range(300)]
    planted = {len(texts) + k: make(r) for k, make in enumerate(m for m in FORMATS.values() for _ in range(40))}
    texts += [text(r, v) for v in planted.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = found = caught = 0
    for x in secret_scan.report(df).collect():
        t, value = texts[x["doc_id"]], planted.get(x["doc_id"])
        spans = [s.split(":") for s in x["spans"].split(",") if s.startswith("format")]
        values = [t[int(a) : int(b)] for _, a, b in spans]
        found += len(values)
        hits += sum(v == value for v in values)
        caught += value in values if value else 0
    assert caught >= 0.95 * len(planted) and hits >= 0.95 * found, (caught, hits, found)


def test_automata_keep_lengths_and_positions():
    r = random.Random(12)
    for make in FORMATS.values():
        values = [make(r) for _ in range(130)]
        a = Automaton(map(plain, values), SYMBOLS)
        assert len(a.steps) > 5
        same = [a.log_likelihood(plain(make(r))) / len(values[0]) for _ in range(50)]
        assert min(same) > a.log_likelihood(plain(values[0] + "a")) / len(values[0]) + 0.05


def test_states_of_free_lengths_merge():
    r = random.Random(13)
    a = Automaton((plain(of(r, "0123456789", r.randrange(6, 200))) for _ in range(500)), SYMBOLS)
    assert len(a.steps) < 60


def test_what_base_spans_leave_is_scored():
    assert secret_scan.left_over(0, 30, [("access", 5, 25)]) == [(0, 5), (25, 30)]
    assert secret_scan.left_over(0, 30, [("access", 0, 10), ("hex", 4, 12)]) == [(12, 30)]
