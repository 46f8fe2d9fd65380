"""Main text by what wrappers tell, without marks, and pages that are long, deep or broken."""

import random
import re
import time
from collections import Counter

import pytest

from simloom.llm import html_wrappers


def words(r, n):
    return " ".join("".join(r.choice("aeioulnrstdm") for _ in range(r.randrange(2, 9))) for _ in range(n))


def texts(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrappers.main_text(df).collect()}


def f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def template(r, host, notice="", body=None):
    """A page of plain containers and its article."""
    body = body or [words(r, r.randrange(20, 80)) for _ in range(r.randrange(1, 6))]
    title = words(r, 5)
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(r, 6).split())
    inner = f"<h2>{title}</h2>" + "".join(f"<p>{p}</p>" + notice * (k == 0) for k, p in enumerate(body))
    page = f"<html><body><div><ul>{menu}</ul></div><div>{words(r, 6)}</div><div>{inner}</div><div>&copy; {host} {words(r, 4)}</div></body></html>"
    return page, "\n\n".join([title, *body])


def test_pages_without_marks(spark):
    r = random.Random(21)
    made = [(f"http://h{k % 6}.example/{k}", *template(r, f"h{k % 6}")) for k in range(120)]
    got = texts(spark, [(u, h) for u, h, _ in made])
    scores = [f1(got[k], want) for k, (_, _, want) in enumerate(made)]
    assert sum(scores) / len(scores) > 0.97 and min(scores) > 0.8


def test_marks_taken_from_real_pages_change_nothing(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html").collect()

    def bare(h):
        h = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", h)
        return re.sub(r"<div[^>]*>", "<div>", h)

    marked = texts(spark, [(r["url"], r["html"]) for r in rows])
    # on hosts of their own, so that both forms don't share wrappers
    plain = texts(spark, [(r["url"], bare(r["html"] or "")) for r in rows])
    assert sum(f1(marked[k], plain[k]) for k in marked) / len(marked) > 0.95


def test_constant_notices_inside_an_article_go(spark):
    r = random.Random(22)
    notice = "<p>Subscribe now to read all of our stories every day of the week</p>"
    pages, wanted = [], []
    for k in range(30):
        page, want = template(r, "n", notice, [words(r, 30), words(r, 30)])
        page = page.replace("<div><h2>", "<article><h2>").replace("</p></div><div>&copy;", "</p></article><div>&copy;")
        pages.append((f"http://n.example/{k}", page))
        wanted.append(want)
    got = texts(spark, pages)
    # the notice follows the first paragraph; folded paragraphs make one slot unless the notice stands apart
    apart = [(u, h.replace("<p>Subscribe", "<h4>Subscribe").replace("week</p>", "week</h4>")) for u, h in pages]
    got = texts(spark, apart)
    assert [got[k] for k in range(30)] == wanted


def test_a_second_template_of_a_host_keeps_its_text(spark):
    r = random.Random(23)
    pages = [(f"http://s.example/{k}", f"<body><nav><a>m</a></nav><article><p>{words(r, 40)}</p><p>{words(r, 40)}</p></article></body>") for k in range(20)]
    other = [words(r, 60) for _ in range(10)]
    pages += [(f"http://s.example/b{k}", f"<body><div><ul><li><a>x</a></li><li><a>y</a></li></ul></div><div><h3>{t[:30]}</h3><div>{t}</div></div></body>") for k, t in enumerate(other)]
    got = texts(spark, pages)
    for k, t in enumerate(other):
        assert t in got[20 + k] and t[:30].strip() in got[20 + k]


def test_hosts_of_copies_keep_their_text(spark):
    page, want = template(random.Random(24), "c")
    got = texts(spark, [(f"http://c.example/{k}", page) for k in range(8)])
    assert all(f1(t, want) > 0.85 for t in got.values())


N = 1_000_000
BAD = {
    "deep": "<div>" * 10_000 + "<p>kept text</p>" + "</div>" * 10_000,
    "deep and unclosed": "<div><span><section>" * 20_000 + "kept text",
    "wrong ends": "<div>" * 50_000 + "</p></li>" * 50_000 + "kept text",
    "tags without an end": "<p>kept text</p>" + "<a " * (N // 3),
    "quotes without an end": "<p>kept text</p>" + '<a href="' * (N // 9),
    "quotes that don't pair": "<p>kept text</p>" + "<i x=\">" * (N // 7) + "<i x='>" * 1000,
    "blanks in tags": "<p>kept text</p><a" + " " * N,
    "equals signs": "<p>kept text</p>" + "<a =  " * (N // 6) + ">",
    "declarations": "<p>kept text</p>" + "<!x " * (N // 4),
    "comments": "<p>kept text</p>" + "<!--" * (N // 4),
    "scripts": "<p>kept text</p>" + "<script>" * (N // 8),
    "brackets": "<p>kept text</p>" + "<" * N,
    "siblings": "<p>kept text</p>" + "".join(f"<h{k % 6 + 1}>a{k}</h{k % 6 + 1}>" + "<p>b</p>" * (k * k % 7) + "<ul></ul>" * (k * k % 3) for k in range(20_000)),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_pages_are_read_in_seconds(name):
    start = time.perf_counter()
    page = html_wrappers.read(BAD[name])
    assert any("kept text" in t for _, t in page.blocks)
    a = html_wrappers.folded(page.root)
    b = html_wrappers.folded(html_wrappers.read(BAD[name] + "<table><tr><td>more</td></tr></table>" + "<h5>z</h5><ul><li>q</li></ul>" * 50).root)
    wrapper = html_wrappers.parse(html_wrappers.dump(html_wrappers._merge(b, html_wrappers.parse(html_wrappers.dump(a)))))
    stream = html_wrappers.parse(html_wrappers.dump(a))
    assert len(html_wrappers.decided(stream, wrapper, html_wrappers.roles(wrapper))) == sum(1 for _ in html_wrappers.slots(stream))
    html_wrappers.pattern(wrapper)
    assert time.perf_counter() - start < 10


def test_marked_parts_below_the_depth_are_left_out(spark):
    page = "<article>" + "<div>" * 200 + "<p>text of the article</p><nav><div>menu</div></nav><p>more of it</p>" + "</div>" * 200 + "</article>"
    assert texts(spark, [("http://d.example/", page)])[0] == "text of the article\n\nmore of it"
