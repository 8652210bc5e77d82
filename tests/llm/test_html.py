"""HTML extraction on labelled pages whose layouts the classifier's training blocks don't have, held out by template."""

from __future__ import annotations

import numpy as np
import pytest

from motionloom.llm import html

PROSE = (
    "The council met on Monday and agreed, after three hours, to mend the lower bridge before the winter comes.",
    "We left at dawn and took the path along the stream, which was high after the rain, and cold.",
    "Nobody knows who built the tower, or why it has no door, and nobody in the town will tell you.",
)


class Page:
    """Writes a page and remembers which blocks are content."""

    def __init__(self, seed: int) -> None:
        self.rng, self.kept, self.gone = np.random.default_rng(seed), [], []
        self.words = ["".join(self.rng.choice(list("abdeghiklmnoprstuvw"), self.rng.integers(2, 9))) for _ in range(300)]

    def text(self, low: int, high: int, end: str = ".") -> str:
        x = " ".join(self.rng.choice(self.words, self.rng.integers(low, high)))
        return x[0].upper() + x[1:] + end

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return text

    def drop(self, text: str) -> str:
        self.gone.append(text)
        return text

    def paragraphs(self, tag: str = "p", low: int = 1, high: int = 7) -> str:
        return "".join(f"<{tag}>{self.keep(' '.join(self.text(4, 18) for _ in range(self.rng.integers(low, high))))}</{tag}>\n" for _ in range(self.rng.integers(3, 9)))

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{self.drop(self.text(1, 4, ""))}</a></{tag}>' for k in range(n))

    def title(self, tag: str = "h1") -> str:
        return f"<{tag}>{self.keep(self.text(3, 9, ''))}</{tag}>"


def blog(p: Page) -> str:
    return f"""<html><head><title>x</title></head><body class="home page-template"><div id="page"><div id="masthead"><p class="site-title">{p.drop(p.text(2, 3, ""))}</p></div>
<div id="site-navigation"><ul>{p.links(6)}</ul></div><div id="primary" class="content-area"><div class="hentry"><div class="entry-header">{p.title()}
<div class="entry-meta">{p.drop("Posted on 3 May")} </div></div><div class="entry-content">{p.paragraphs()}</div><div class="post-tags"><ul>{p.links(3)}</ul></div></div>
<div id="comments" class="comments-area"><h2>{p.drop("Two thoughts")}</h2><ol class="comment-list"><li><p>{p.drop(p.text(20, 40))}</p></li><li><p>{p.drop(p.text(20, 40))}</p></li></ol></div></div>
<div id="secondary" class="widget-area"><h3>{p.drop("Archives")}</h3><ul>{p.links(5)}</ul></div><div id="colophon" class="site-footer"><p>{p.drop("Proudly run by nobody")}</p></div></div></body></html>"""


def news(p: Page) -> str:
    return f"""<body><header role="banner"><a href="/">{p.drop("The Paper")}</a><form><label>{p.drop("Search here")}</label></form></header><nav>{p.links(8, "span")}</nav>
<div class="gdpr-banner"><p>{p.drop(p.text(15, 30))}</p><button>Yes</button></div><main><div class="story-body">{p.title()}<p class="byline">{p.drop("By A. Person")}</p>{p.paragraphs()}
<div class="ad-unit"><p>{p.drop(p.text(15, 25))}</p></div>{p.paragraphs()}<aside><h4>{p.drop("More on this")}</h4><ul>{p.links(4)}</ul></aside></div></main>
<div class="recommended-links"><ul>{p.links(6)}</ul></div><footer><p>{p.drop("© The Paper, all rights reserved.")}</p><ul>{p.links(5)}</ul></footer></body>"""


def plain_divs(p: Page) -> str:
    """No names at all."""
    return f"""<html><body><div><div><a href="/">{p.drop("Start")}</a></div><div><ul>{p.links(7)}</ul></div></div><div><div>{p.title()}{p.paragraphs("p", 2, 7)}</div></div>
<div><div>{p.links(4, "div")}</div></div></body></html>"""


def old_table(p: Page) -> str:
    return f"""<body><table><tr><td colspan=2><ul>{p.links(5)}</ul></td></tr><tr><td><ul>{p.links(9)}</ul></td><td>{p.title("h2")}{p.paragraphs("p", 2, 7)}</td></tr>
<tr><td colspan=2><p>{p.drop("Copyright 1999 by the owner")}</p></td></tr></table></body>"""


def guide(p: Page) -> str:
    steps = "".join(f"<li>{p.keep(p.text(8, 20))}</li>" for _ in range(5))
    return f"""<body><div class="navbar"><ul>{p.links(5)}</ul></div><div class="sidebar-left"><ul>{p.links(12)}</ul></div><div class="main-content" role="main">{p.title()}
{p.paragraphs()}<h2>{p.keep(p.text(2, 5, ""))}</h2><ol>{steps}</ol><pre>{p.keep("make all install clean")}</pre><blockquote>{p.keep(p.text(12, 25))}</blockquote></div>
<div class="pager"><a href="/p">{p.drop("Previous")}</a> </div><div class="page-footer"><p>{p.drop(p.text(4, 8))}</p></div></body>"""


def interleaved(p: Page) -> str:
    parts = "".join(f"<p>{p.keep(p.text(12, 30))}</p><div><a href='/s'>{p.drop('Share')}</a></div>" for _ in range(12))
    return f"<body><div class='header-text'>{p.title()}{parts}</div><div class='newsletter-signup'><p>{p.drop(p.text(10, 20))}</p></div></body>"


def nested_comments(p: Page) -> str:
    return f"""<body><main><article class="post author-interview">{p.title()}{p.paragraphs()}</article><section class="replies"><article class="comment"><p>{p.drop(p.text(20, 40))}</p></article>
<article class="comment"><p>{p.drop(p.text(20, 40))}</p></article></section></main><div class="site-notice"><p>{p.drop(p.text(12, 20))}</p></div></body>"""


def magazine(p: Page) -> str:
    return f"""<body><div class="wrap"><div id="top"><span>{p.drop(p.text(2, 4, ""))}</span></div><ul class="mainmenu">{p.links(6)}</ul>
<div class="two-columns"><div class="col-left"><div class="headline">{p.title()}<div class="dateline">{p.drop("12 June, 10:15")}</div></div><div class="lead">{p.keep(p.text(14, 30))}</div>{p.paragraphs("div", 2, 6)}
<div class="tags-list">{p.links(4, "span")}</div><div class="share-buttons">{p.links(3, "span")}</div><div id="user-comments"><h3>{p.drop("What readers say")}</h3>
<div class="comment"><div class="comment-author">{p.drop("somebody")}</div><div class="comment-text">{p.drop(p.text(18, 40))}</div></div></div></div>
<div class="col-right"><div class="teaser"><h4><a href="/t">{p.drop(p.text(4, 8, ""))}</a></h4></div><div class="ad-box">{p.drop(p.text(10, 20))}</div></div></div>
<div id="footer"><p>{p.drop(p.text(6, 12))}</p></div></div></body>"""


def manual(p: Page) -> str:
    rows = "".join(f"<tr><td>{p.keep(p.text(1, 3, ''))}</td><td>{p.keep(p.text(5, 14))}</td></tr>" for _ in range(6))
    return f"""<body><nav class="toc"><ul>{p.links(15)}</ul></nav><section>{p.title()}{p.paragraphs()}<table><tbody>{rows}</tbody></table><h3>{p.keep(p.text(2, 4, ""))}</h3>{p.paragraphs("p", 1, 3)}</section>
<div class="prev-next"><a href="/a">{p.drop("Earlier")}</a> </div><form><p>{p.drop(p.text(8, 14, "?"))}</p></form></body>"""


def bare(p: Page) -> str:
    return f"<html><head><title>{p.drop('A title')}</title></head><body>{p.title()}{p.paragraphs()}<hr><address>{p.drop('© somebody')}</address></body></html>"


TEMPLATES = (blog, news, plain_divs, old_table, guide, interleaved, nested_comments)
#: Written after the classifier was settled, and not used to change it.
UNSEEN = (magazine, manual, bare)


def scores(template, pages: int = 25) -> tuple[float, float]:
    """Precision and recall by characters."""
    right = found = wanted = 0
    for seed in range(pages):
        p = Page(seed)
        text = template(p)
        kept = [" ".join(x.split()) for x in p.kept]
        lines = html.extract(text).split("\n")
        right += sum(len(x) for x in lines if x in kept)
        found += sum(map(len, lines))
        wanted += sum(map(len, kept))
    return right / max(found, 1), right / wanted


@pytest.mark.parametrize("template", TEMPLATES + UNSEEN)
def test_held_out_templates(template):
    precision, recall = scores(template)
    assert precision > 0.97 and recall > 0.97, (precision, recall)


@pytest.mark.parametrize("name", ["author-interview", "header-text", "blog-post meta", "widget-page content"])
def test_names_around_prose_keep_it(name):
    page = f'<html><body><div class="{name}">' + "".join(f"<p>{x}</p>" for x in PROSE) + "</div></body></html>"
    assert html.extract(page) == "\n".join(PROSE)


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "ad-slot", "cookie-notice", "site-footer", "newsletter box"])
def test_names_of_boilerplate_drop_prose(name):
    page = f'<html><body><h1>On walking</h1><p>{PROSE[0]}</p><div class="{name}">' + "".join(f"<p>{x}</p>" for x in PROSE[1:]) + "</div></body></html>"
    assert html.extract(page) == f"On walking\n{PROSE[0]}"


@pytest.mark.parametrize(("wrap", "n"), [("body", 2000), ("body", 3), ("article", 3)])
def test_links_between_paragraphs(wrap, n):
    prose = [f"{PROSE[k % 3]} So it was for the {k}th time." for k in range(n)]
    page = f"<{wrap}>" + "".join(f"<p>{x}</p><div><a href='/'>Home</a></div>" for x in prose) + f"</{wrap}>"
    assert html.extract(page) == "\n".join(prose)


def test_very_long_page_and_many_pages_in_bounded_batches(spark):
    long = "<article>" + "".join(f"<p>{PROSE[k % 3]} {k}.</p>" for k in range(30_000)) + "</article>"
    rows = [(k, "u", f"<article><p>{PROSE[k % 3]}</p></article>", k) for k in range(50)] + [(99, None, long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    assert len(found) == 51 and all(found[k]["text"] == PROSE[k % 3] for k in range(50))
    assert found[99]["text"].count("\n") == 29_999 and found[99]["n_chars"] == len(found[99]["text"])


BRIDGE = [
    "The old bridge over the river was closed in spring, and the people of the lower town had to walk around by the mill for months.",
    "In the third week of June the council met in the school, because the hall was too small for all who wanted to hear what it would say.",
    "Nobody was surprised when the engineer read out the costs, but the silence afterwards lasted longer than anyone there could remember.",
]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BRIDGE)


@pytest.mark.parametrize("wrap", ["<form action='/'>{}</form>", "<form><main>{}</main></form>", "<form><div class='content'>{}</div></form>", "<header>{}</header>", "<aside>{}</aside>", "<form><div id='page'><article>{}</article></div></form>"])
def test_whole_pages_in_a_form_or_header(wrap):
    page = "<html><head><title>T</title></head><body>" + wrap.format("<h1>The bridge</h1>" + PARAGRAPHS) + "<form><p>Your name, please.</p></form><footer><p>All rights reserved.</p></footer></body></html>"
    assert html.extract(page) == "\n".join(["The bridge", *BRIDGE])


COMMENTS = ["I was there too, and it was not at all like this; it rained on all of the three days that we spent in the town.", "What a nice story, thank you very much for it, and please write more about the mill and those who lived in it."]


@pytest.mark.parametrize("wrap", [
    "<ul class='commentlist'>{}</ul>", "<div class='c-comments'><div class='c-comments__item'>{}</div></div>", "<div class='user-reviews'>{}</div>",
    "<section class='discussion'><h3>3 Comments</h3>{}</section>", "<h2>Comments</h2><div>{}</div>", "<div><h3>Comments (2)</h3>{}</div>",
])
@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
@pytest.mark.parametrize("inside", [True, False])
def test_comment_layouts(wrap, outer, inside):
    item = "<li>{}</li>" if "<ul" in wrap else "<p>{}</p>"
    comments = wrap.format("".join(item.format(x) for x in COMMENTS))
    page = outer.format("<h1>The bridge</h1>" + PARAGRAPHS + comments * inside) + comments * (not inside)
    assert html.extract(f"<html><body>{page}</body></html>") == "\n".join(["The bridge", *BRIDGE])


def test_an_article_about_comments_stays():
    page = f"<article><h1>Comments</h1><h2>Discussion</h2>{PARAGRAPHS}</article>"
    assert all(x in html.extract(page) for x in BRIDGE)
    page = f"<article><h1>The town</h1><p>{BRIDGE[0]}</p><h2>Comments on the plan</h2><p>{BRIDGE[1]}</p><h2>Costs</h2><p>{BRIDGE[2]}</p></article>"
    assert all(x in html.extract(page) for x in BRIDGE)
