"""Repeats of open pages, and the whole extraction against a brute-force version."""

import math
import random
from html.parser import HTMLParser

from corpus import words

from resonara.llm import html_extract


def test_repeat_on_two_pages_of_a_large_host_goes(spark):
    notice = "A notice that two pages of this host have"
    own = {k: " ".join(words(20, k, 100000)) for k in range(60)}
    rows = [(k, f"http://a.example/{k}", f"<p>{own[k]}</p>") for k in own]
    for n in range(0, 40, 2):
        for k in (n, n + 1):
            rows[k] = (k, rows[k][1], f"<p>{own[k]}</p><div>{notice} number{n}</div>")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r[0]: r[2] for r in html_extract.extract(pages).collect()}
    assert whole == own
    assert {r[0]: r[2] for r in html_extract.extract(pages, host_pages=2).collect()} == whole
    one = spark.createDataFrame(rows[:2] + rows[40:], "page_id long, url string, html string")
    for size in (1, 3, 20):
        assert {r[0]: r[2] for r in html_extract.extract(one, host_pages=size).collect()} == {k: own[k] for k in [0, 1, *range(40, 60)]}


def test_phrases_that_pages_share_stay_in_their_sentences():
    phrase = "at the end of the day".split()
    texts = [words(12, k, 100000) + phrase + words(12, 100 + k, 100000) for k in range(30)]
    pages = [[" ".join(t), "All rights reserved by the host"] for t in texts]
    assert html_extract.without_repeats(pages) == [[" ".join(t)] for t in texts]


def test_forms_and_ordinary_names():
    read = html_extract.read_page
    assert read('<form id="aspnetForm"><nav>menu</nav><article><p>one</p><form>name</form><p>two</p></article></form>') == ("one\n\ntwo", [])
    assert read("<form><p>a page that stands in a form as a whole</p></form><p>foot</p>") == (None, ["a page that stands in a form as a whole", "foot"])
    assert read("<p>an article of some words</p><form><p>your name</p></form>") == (None, ["an article of some words"])
    assert read('<article><p>a</p><div class="share-price">100</div><p class="related-work">b</p><div class="share-buttons">x</div><div class="notice">y</div><div class="menu">z</div></article>')[0] == "a\n\n100\n\nb"
    assert read("<aside><article>comment</article></aside><p>open</p>") == (None, ["open"])


def test_copies_among_open_pages_stay(spark):
    menu = "Home News Sport Weather Travel Shop Contact"
    own = [words(60, k, 100000) for k in range(12)]
    near = [*own[0][:30], "changed", *own[0][31:]]
    bodies = [*own, own[0], near, own[1][10:25]]
    rows = [(k, "http://a.example/", f"<div>{menu}</div><p>{' '.join(b)}</p>") for k, b in enumerate(bodies)]
    rows.append((99, "http://a.example/", f"<p>{' '.join(own[2][:20])}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 3):
        got = {r[0]: r[2] for r in html_extract.extract(pages, host_pages=size).collect()}
        assert all(got[k] == " ".join(b) for k, b in enumerate(bodies) if k not in (1, 2, 14))
        assert got[1] == " ".join(own[1]) and got[2] == " ".join(own[2])
        assert got[99] == " ".join(own[2][:20])


class Reader(HTMLParser):
    """Blocks of well-formed pages of known tags: (in an article, text)."""

    def __init__(self):
        super().__init__()
        self.path, self.out, self.held = [], [], ""

    def flush(self):
        if text := " ".join(self.held.split()):
            self.out.append(("article" in self.path, text))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a"):
            self.flush()
        self.path.append("nav" if dict(attrs).get("class") in ("ad", "newsletter") else tag)

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        self.path.pop()

    def handle_data(self, data):
        if not {"nav", "footer", "aside", "script", "title"} & set(self.path):
            self.held += data


def brute(rows, least=5, share=0.02):
    """page_id -> text, by comparing every page of a host with every other."""
    read = {}
    for key, url, page in rows:
        r = Reader()
        r.feed(page)
        r.flush()
        read[key] = (url.split("/")[2], r.out)
    grams = lambda t: {tuple(t[i : i + least]) for i in range(max(1, len(t) - least + 1))} if t else set()
    opened = {k: [b.split() for _, b in out] for k, (_, out) in read.items() if not any(a for a, _ in out)}
    whole = {k: [w for b in page for w in b] for k, page in opened.items()}
    group = {k: k for k in opened}
    for a in opened:
        for b in opened:
            x, y = grams([w.lower() for w in whole[a]]), grams([w.lower() for w in whole[b]])
            if 100 * len(x & y) >= 85 * len(x | y):
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    out = {}
    for key, (host, found) in read.items():
        if key not in opened:
            out[key] = "\n\n".join(t for a, t in found if a)
            continue
        grams_of = {}
        for k in opened:
            if read[k][0] == host:
                grams_of.setdefault(group[k], set()).update(tuple(whole[k][i : i + least]) for i in range(len(whole[k]) - least + 1))
        enough = max(2, math.ceil(len(grams_of) * share))
        hit = [False] * len(whole[key])
        for i in range(len(hit) - least + 1):
            if sum(tuple(whole[key][i : i + least]) in g for g in grams_of.values()) >= enough:
                hit[i : i + least] = [True] * least
        at, kept = 0, []
        for b in opened[key]:
            if 2 * sum(hit[at : at + len(b)]) <= len(b):
                kept.append(" ".join(b))
            at += len(b)
        out[key] = "\n\n".join(kept or [" ".join(b) for b in opened[key]])
    return out


def test_whole_extraction_equals_brute_force(spark):
    r = random.Random(9)
    pool = [" ".join(words(r.randrange(3, 14), 700 + k, 50)) for k in range(30)]
    rows = []
    for k in range(150):
        paragraphs = "".join(f"<p>{' '.join(words(r.randrange(4, 40), 1000 + k * 10 + j, 60 if k % 3 else 5000))} <b>x{k}</b></p>" for j in range(r.randrange(1, 4)))
        body = f"<nav><a>m{k}</a></nav><div>{r.choice(pool)}</div><div class=ad>ad {k}</div>"
        body += f"<article><h1>t{k}</h1>{paragraphs}<aside>no</aside></article>" if k % 4 == 0 else f"<h1>t{k}</h1>{paragraphs}"
        rows.append((k, f"http://h{k % 5 % 3}.example/{k}", f"<html><title>T</title><body>{body}<p>{r.choice(pool)}</p><footer>f{k}</footer></body></html>"))
    rows += [(200 + k, rows[k][1], rows[k][2].replace(f"x{k}", "x")) for k in range(0, 150, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for share in (0.02, 0.2):
        expected = brute(rows, share=share)
        for size in (256, 5):
            assert {x[0]: x[2] for x in html_extract.extract(pages, host_pages=size, host_share=share).collect()} == expected
    assert brute(rows) != brute(rows, share=0.2)


def test_very_long_page(spark):
    text = " ".join(words(200_000, 5))
    pages = spark.createDataFrame([(1, "http://a/", f"<article><p>{text}</p></article>"), (2, "http://a/", f"<p>{text}</p>"), (3, "http://a/", "<p>short</p>")], "page_id long, url string, html string")
    assert {r[0]: r[2] for r in html_extract.extract(pages).collect()} == {1: text, 2: text, 3: "short"}


def test_marked_articles_lose_what_the_site_puts_into_them(spark):
    notice, quoted = "Read more stories like this in our daily letter", "a line that a third of the articles quote"
    rows, expected = [], {}
    for k in range(60):
        own = [" ".join(words(25, 10 * k + j, 100000)) for j in range(2)] + [quoted] * (k % 3 == 0)
        rows.append((k, "http://a.example/", f"<nav>menu</nav><article><p>{own[0]}</p><p>{notice}</p>{''.join(f'<p>{t}</p>' for t in own[1:])}</article>"))
        expected[k] = "\n\n".join(own)
    # Copies and near copies of one article are one page, which keeps what it says; nor does a page vanish.
    for k in range(100, 180):
        rows.append((k, "http://a.example/", rows[1][2].replace("<nav>menu</nav>", "") if k % 2 else rows[1][2].replace(expected[1][-8:], f"{expected[1][-8:]} x{k}")))
        expected[k] = expected[1] if k % 2 else expected[1] + f" x{k}"
    rows.append((200, "http://a.example/", f"<article><p>{notice}</p></article>"))
    expected[200] = notice
    # Too few pages to tell.
    rows += [(300 + k, "http://b.example/", f"<article><p>{notice}</p><p>own{k}</p></article>") for k in range(19)]
    expected |= {300 + k: f"{notice}\n\nown{k}" for k in range(19)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 40, 7):
        assert {r[0]: r[2] for r in html_extract.extract(pages, host_pages=size).collect()} == expected


def test_windows_of_groups_meet_exactly():
    tokens = [[*range(100 * k, 100 * k + 9), *([7, 8, 9, 10, 11, 12] if k % 2 else [])] for k in range(1, 9)]
    marks = [1, 2, 3, 4, 5, 6, 7, 8]
    assert len(html_extract.repeated_windows(tokens, 5, marks, 4)) == 2
    assert not len(html_extract.repeated_windows(tokens, 5, marks, 5))
    assert not len(html_extract.repeated_windows(tokens, 5, [2, 1, 2, 3, 2, 5, 2, 7], 2))
    assert not len(html_extract.repeated_windows([[1, 2], [], [1, 2]], 5))
    assert len(html_extract.repeated_windows(tokens, 5, marks, 1)) == 5 * 4 + 11 * 4 - 2 * 3
