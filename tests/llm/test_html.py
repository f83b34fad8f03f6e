import html
import math
import random
import re

import pyarrow.parquet as pq
import pytest

from lattiq.llm import html as H
from lattiq.llm.common import table
from lattiq.llm.html import main_text, main_texts

FRAME = "<html><head><title>T</title><style>p{margin:0}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>@@<footer>&copy; me</footer></body></html>"
P = "This is a paragraph of the article with quite a few words in it, number %d, and it goes on."
BODY = [P % i for i in range(4)]


def paras(items):
    return "".join(f"<p>{x}</p>" for x in items)


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>Head</h1>{paras(BODY)}</article>",
        f"<main><h1>Head</h1><div class=content>{paras(BODY)}</div></main><aside>{P % 9}</aside>",
        f"<div id=wrap><h1>Head</h1><div class='post-body'>{paras(BODY)}</div><div class='sidebar'><p>{P % 8}</p></div></div>",
        f"<div><h1>Head</h1>{paras(BODY)}</div><section class='comments'><p>{P % 7}</p><p>{P % 6}</p></section>",
        f"<div class='cookie-notice'>{P % 5}<button>OK</button></div><div><h1>Head</h1>" + "".join(f"<p>{x}" for x in BODY) + "</div>",
        f"<article><header><h1>Head</h1></header>{paras(BODY)}<form>Mail <input></form><script>var a='</p>';</script></article><div class=ad>{P % 4}</div>",
        f"<article><h1>Head</h1>{paras(BODY)}<div class='related'><a href=x>More</a><a href=y>More</a></div></article>",
    ],
)
def test_templates(page):
    assert main_text(FRAME.replace("@@", page)) == " ".join(["Head", *BODY])


def test_edges():
    assert [main_text(x) for x in ("", "<!DOC", "   ", "<script>x", "<div><p", "just words &amp; more")] == ["", "", "", "", "", "just words & more"]
    assert main_text("<article><p>a&nbsp; b&#233;<b>c</b>d<br>e\n\n f<p>g &lt;x&gt;") == "a bécd e f g <x>"
    deep = "<div><span>" * 20_000 + "deep text here" + "</span></div>" * 20_000
    assert main_text(deep) == "deep text here"


@pytest.mark.parametrize("tag", ['<p class="a"">', "<p class='a''>", "<p title='Tom's'>", '<p "a">', '<p title="unclosed>', "<p a = 'x>y' b=\"'\">", '<p a=b"c>', '<p title="a > b" class="c>'])
@pytest.mark.parametrize("rest", ["", " It isn't so, isn't it?"])
def test_stray_quotes(tag, rest):
    text = main_text(f"<article><h1>Head</h1>{tag}{BODY[0]}{rest}</p><p>{BODY[1]}</p></article>")
    assert text.endswith(f"{BODY[0]}{rest} {BODY[1]}")


THREAD = [f"Reader {i} says that this is {'very ' * 30} true and has a lot more to add to it." for i in range(12)]


@pytest.mark.parametrize(
    "thread",
    [
        f"<div id='comments'>{paras(THREAD)}</div>",
        "<ol class='commentlist'>" + "".join(f"<li><p>{x}</p></li>" for x in THREAD) + "</ol>",
        "<div id=comments><h2>12 replies</h2><ol class='commentlist'>" + "".join(f"<li><article><p>{x}</p></article></li>" for x in THREAD) + "</ol></div>",
        f"<div class='advert'>{paras(THREAD)}</div>",
        f"<div class=menu>{paras(THREAD)}</div>",
    ],
)
@pytest.mark.parametrize("page", ["<article><h1>Head</h1>@</article>#", "<div><h1>Head</h1><div>@</div></div>#", "<article><h1>Head</h1>@#</article>", "<div><h1>Head</h1>@#</div>", "<div class='page menu-open'><main><h1>Head</h1>@</main>#</div>", "<div class='wrap sidebar'><div><h1>Head</h1>@</div>#</div>"])
def test_noise_larger_than_the_article(page, thread):
    assert main_text(FRAME.replace("@@", page.replace("@", paras(BODY)).replace("#", thread))) == " ".join(["Head", *BODY])


def test_comments_beside_an_article_without_headline():
    assert main_text(FRAME.replace("@@", f"<div>{paras(BODY)}</div><div id=comments><h2>Replies</h2>{paras(THREAD)}</div>")) == " ".join(BODY)


CONTROLS = "<div><label>Your name</label><input name=a><select><option>One<option>Two</select><textarea>old</textarea><button>Send</button></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<form id='aspnetForm' action=x><input type=hidden><div><h1>Head</h1>{paras(BODY)}</div>{CONTROLS}</form>",
        f"<form id='aspnetForm'><fieldset><article><h1>Head</h1>{paras(BODY)}</article></fieldset>{CONTROLS}</form>",
        f"<form id='aspnetForm'><article><h1>Head</h1>{paras(BODY)}<div class=comments><p>{P % 7}</p></div></article></form>",
        f"<article><h1>Head</h1>{paras(BODY)}<form><p>Your address is not published.</p>{CONTROLS}</form></article>",
        f"<article><h1>Head</h1>{paras(BODY)}</article><form><fieldset><p>{P % 8}</p>{CONTROLS}</fieldset></form>",
    ],
)
def test_forms(page):
    assert main_text(FRAME.replace("@@", page)) == " ".join(["Head", *BODY])


def test_form_around_one_paragraph():
    assert main_text(f"<body><form id='aspnetForm'><p>{P % 1}</p>{CONTROLS}</form></body>") == P % 1


def test_whole_table_against_the_article_element(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    extra = spark.createDataFrame([(None, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    got = main_texts(pages.unionByName(extra).selectExpr("page_id", "url", "html", "html as text")).collect()
    want = []
    for r in pages.unionByName(extra).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        a = re.sub(r"<[^>]*$", "", m[1]) if m else {"<p>x</p>": "x"}.get(r.html, "")
        a = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", a))).split())
        want.append((str(r.page_id), a, len(a)))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(want)
    assert main_texts(extra.limit(0)).count() == 0


SECTIONS = f"<section class='notice-of-award'><h2>Award</h2><p>{P % 11}</p></section><div class='related-work'><p>Short.</p></div>"
TALK = "".join(f"<div class=talkback><span class=author>Reader {i}</span><p>{THREAD[i]}</p><a href=#>Reply</a></div>" for i in range(6))
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Another story of the day {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>Head</h1>{paras(BODY)}{SECTIONS}</article>",
        f"<div><h1>Head</h1>{paras(BODY)}{SECTIONS}</div>",
        f"<article><h1>Head</h1>{paras(BODY)}{SECTIONS}</article><div>{TALK}</div>",
        f"<article><h1>Head</h1>{paras(BODY)}{SECTIONS}<div>{TALK}</div></article>",
        f"<div><h1>Head</h1>{paras(BODY)}{LINKS}{SECTIONS}</div>{LINKS}",
        f"<div><p>Short text.</p></div><div><h1>Head</h1>{paras(BODY)}{SECTIONS}</div><div>Buy now, it is cheap.</div>",
    ],
)
def test_nothing_else_is_dropped(page):
    assert main_text(FRAME.replace("@@", page)) == " ".join(["Head", *BODY, "Award", P % 11, "Short."])


def test_words_of_names():
    assert [H._named(x) for x in ("ad", "ad-slot", "siteFooter", "page_sidebar", "commentlist", "notice-of-award", "related-work", "address", "header-text", "post", "")] == [True] * 5 + [False] * 6


def test_density_against_the_formula():
    """Characters, tags and link counts counted again by regular expressions from each element's source."""
    page = f"<body><div id=a><p>{P % 1}</p><p>{P % 2} <a href=x>a link of it</a></p></div><div id=b><ul>" + "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(5)) + "</ul></div></body>"
    root = H.parse(page)
    order = H._measure(root)
    sources = {"body": page[6:-7], "a": page[page.index("<div id=a>") + 10 : page.index("</div>")], "b": page[page.index("<div id=b>") + 10 : page.rindex("</div>")]}
    count = lambda s: len(re.sub(r"<[^>]*>|\s", "", s))
    whole = sources["body"]
    linked = sum(map(count, re.findall(r"<a .*?</a>", whole))) / count(whole)
    for x in order:
        x.weight = 1
        name = "body" if x.tag == "body" else x.attrs.strip()[3:] if x.tag == "div" else None
        if name:
            s = sources[name]
            c, t, lc, lt = count(s), len(re.findall(r"<[a-z]", s)), sum(map(count, re.findall(r"<a .*?</a>", s))), len(re.findall("<a ", s))
            want = c / t * math.log(c / lc * t / lt) / math.log(math.log(c / max(1, c - lc) * lc + linked * c + math.e) + math.e - 1)
            assert H._density(x, linked) == pytest.approx(want)


@pytest.mark.parametrize("constant", [True, False])
def test_density_decides(monkeypatch, constant):
    """Densities of any other kind give another text on most pages of a table."""
    rng = random.Random(1)
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    before = [main_text(x) for x in pages]
    monkeypatch.setattr(H, "_density", lambda *_: 1.0 if constant else rng.random())
    assert sum(main_text(x) != y for x, y in zip(pages, before)) > len(pages) * (0.9 if constant else 0.3)
