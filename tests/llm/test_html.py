"""HTML extraction: the method's steps by brute force, generated pages with known articles, hostile pages."""

import itertools
import math
import random
import time

import pytest

from ledgerline.llm import html_extract
from ledgerline.llm.html_extract import NAMED, PLAIN, READERS, Page, main_text, named, smooth, threshold

PARAS = "".join(f"<p>Paragraph {i} of the story, with enough words in it to be read as running text.</p>" for i in range(5))


def test_smoothing_by_brute_force():
    rng = random.Random(1)
    for n in (1, 2, 5, 30):
        values = [rng.random() * 9 for _ in range(n)]
        want = []
        for i in range(n):
            w = [math.exp(-((i - j) ** 2) / 4.5) if abs(i - j) <= 5 else 0.0 for j in range(n)]
            want.append(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w))
        assert smooth(values) == pytest.approx(want)


def test_threshold_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        values = [rng.choice([0.0, 1.0, 1.5, 4.0, rng.random() * 6]) for _ in range(rng.randint(1, 12))]
        best, cut = 0.0, -math.inf
        for c in sorted(set(values))[1:]:
            up, low = [v for v in values if v >= c], [v for v in values if v < c]
            gap = sum(up) / len(up) - sum(low) / len(low)
            if len(up) * len(low) * gap * gap > best + 1e-12:
                best, cut = len(up) * len(low) * gap * gap, c if gap >= math.log(2.5) else -math.inf
        assert threshold(values) == cut
    assert threshold([]) == -math.inf


def test_names_of_boxes():
    assert {named(t, False) for t in ("ad", "ad-slot", "cookieNotice", "site-header", "sidebar-left", "left_sidebar", "related-posts", "main-menu", "newsletter-signup", "pageFooter")} == {NAMED}
    assert {named(t, False) for t in ("comments", "user-comments", "comment-list", "respond", "CommentThread")} == {READERS}
    assert {named(t, False) for t in ("overflow-hidden", "has-sidebar", "related-work", "search-space", "alert-level", "entry-header", "article", "content", "load", "shadow", "leader", "", "--")} == {PLAIN}
    assert named("header", True) == PLAIN and named("header", False) == NAMED


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='card overflow-hidden'>{PARAS}</div>",
        f"<div class='layout has-sidebar'>{PARAS}<div class=sidebar><p>side text of one line</p></div></div>",
        f"<article><div class='prose overflow-hidden'>{PARAS}</div></article>",
        f"<div class=banner>{PARAS}</div>",
        f"<form id=f1>{PARAS}<div class=sidebar><p>side text</p></div></form>",
        f"<nav><ul><li><a href=/>Home</a><article>{PARAS}</article>",
        f"<article>{PARAS}</article><div class='user-reviews'>{'<p>I like it a lot, really, the best thing I ever bought.</p>' * 30}</div>",
        f"<body><aside><article><p>A teaser of some other story, that goes on for quite a while, in one line.</p></article></aside><article>{PARAS}</article>",
        f"<div>{PARAS}</div><section class=comments>{'<p>First! And a long comment it is, as they all are here.</p>' * 30}</section>",
        f"<article>{PARAS}<ul><li><a href=a>Facebook</a><li><a href=b>Twitter</a><li><a href=c>Mail</a></ul></article>",
    ],
)
def test_names_are_weighed(page):
    lines = main_text(page).split("\n")
    assert len(lines) == 5 and all(x.startswith(f"Paragraph {i} ") for i, x in enumerate(lines))


def test_parts_of_an_article_with_telling_names():
    page = f"<article>{PARAS}<section id='related-work'><p>Others did this.</p></section><p class='search-space'>Space.</p><p class='alert-level'>Three.</p><p><a href=x>one link</a></p></article>"
    assert main_text(page).split("\n")[5:] == ["Others did this.", "Space.", "Three.", "one link"]
    assert main_text("<p>text <span class=share>Share this</span> goes <b>on</b></p>") == "text goes on"
    assert main_text("<article><p>x<![foo[ y]> z<math>a=2</math></article>") == "x z" + "a=2"


def generated(rng):
    """A page and its article's lines."""
    words = lambda a, b: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    lines = [words(3, 8)]
    html = f"<h1>{lines[0]}</h1>"
    for _ in range(rng.randint(4, 14)):
        kind = rng.random()
        if kind < 0.1:
            lines.append(words(1, 4))
            html += f"<h2>{lines[-1]}</h2>"
        elif kind < 0.2:
            lines.append(words(3, 9))
            html += f"<p class='{rng.choice(['lead', 'related-work', 'alert-level', 'x'])}'>{lines[-1]}"
        elif kind < 0.3:
            items = [words(4, 15) for _ in range(rng.randint(2, 5))]
            lines += items
            html += "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        else:
            lines.append(words(25, 90))
            some = lines[-1].split(" ")
            some[2] = f"<a href=/x>{some[2]}</a>"
            some[4] = f"<b>{some[4]}</b>"
            html += f"<p>{' '.join(some)}</p>"
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{i}>{words(1, 3)}</a></li>" for i in range(rng.randint(3, 12))) + "</ul>"
    wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='post'>{}</div>", "<div id=content><div>{}</div></div>", "<div class='grid has-sidebar'>{}</div>"])
    before = [f"<nav>{menu()}</nav>", f"<header><p>{words(2, 5)}</p>{menu()}</header>", f"<div class='ad-slot'>{words(5, 20)}</div>", f"<div id='cookie-notice'><p>{words(8, 25)}</p></div>", f"<div class=topnav>{menu()}</div>", f"<form><label>{words(1, 2)}</label><input></form>"]
    after = [f"<footer><p>{words(5, 15)}</p></footer>", f"<aside>{words(5, 30)}</aside>", f"<section class='comments'><h3>{words(1, 2)}</h3>" + "".join(f"<p>{words(5, 40)}</p>" for _ in range(rng.randint(1, 20))) + "</section>", f"<div class='related-posts'>{menu()}</div>", f"<div class=newsletter><p>{words(5, 25)}</p></div>"]
    rng.shuffle(before)
    rng.shuffle(after)
    page = "<html><head><title>t</title><style>p{}</style></head><body><script>var x = '<p>no</p>';</script>"
    page += "".join(before[: rng.randint(1, 5)]) + wrap.format(html) + "".join(after[: rng.randint(1, 5)]) + "</body></html>"
    return page, lines


def test_generated_pages():
    rng = random.Random(11)
    wanted = right = given = whole = 0
    for _ in range(600):
        page, lines = generated(rng)
        got = main_text(page).split("\n")
        wanted, given = wanted + len(lines), given + len(got)
        right += len(set(lines) & set(got))
        whole += got == lines
    assert right / wanted >= 0.995 and right / given >= 0.995 and whole / 600 >= 0.95, (right / wanted, right / given, whole / 600)


def test_hostile_pages_take_linear_time():
    n = 60_000
    pages = ["<b>" * n + "<hr>" * n, "<b>" * n + "</i>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<div>" * n + "<dt></dt>" * n, "<article>" * n, "<!--" * n, "<a " * n, "</" * n, "<?" * n,
             "<![CDATA[" * n, "<![foo[" * n, "&#" * n, "<p class='a b ad'>x" * n, "<a x='" * n + ">", "<a" + " " * n + "x" + " " * n + ">", "<!--" * n + ">"]
    for page in pages:
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 5, page[:20]
    assert main_text("<div>" * n + PARAS).count("Paragraph") == 5
    assert main_text("<article><!-- open <p>" + PARAS + "</article>").count("Paragraph") == 5


def test_no_mix_of_broken_bits_fails():
    bits = ["<p>", "</p>", "<div", ">", "<!--", "-->", "<![CDATA[", "]]>", "<!x", "&#x41;", "t ", "<article>", "<nav>", "</nav>", "<form>", "<a href='x", "</", "<?", "/>", "<br/>", "<li>", "<td>", "<![if a]>"]
    rng = random.Random(4)
    for a, b, c in itertools.islice(itertools.product(bits, repeat=3), 0, None, 7):
        main_text(a + b + c)
    for _ in range(2000):
        text = main_text("".join(rng.choices(bits, k=30)))
        assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))
    assert main_text(None) == main_text("") == main_text("<p> </p>") == "" and Page("").lines == []
    assert html_extract.SCHEMA.startswith("page_id")
