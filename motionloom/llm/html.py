"""HTML extraction by minimum-cut labelling.

A page falls into blocks: runs of text between block-level tags. A logistic
classifier, trained here on a small set of labelled blocks (``TRAINING``), gives each block the log-odds
of being content. These become terminal capacities of a flow network: positive
log-odds tie a block to the content terminal, negative ones to the boilerplate
terminal. Smoothness edges join each block to the next one and to the next one within the same
container; they carry the more capacity the closer the two stand in the DOM and the more alike their shares of links
are, so that prose and menus that alternate don't pull at each other. The minimum cut (by
augmenting paths) is the labelling of least cost; content blocks are joined in page order.

Names (class, id and role) are read whole: "comment-list" names comments, since all its parts are words for boilerplate or for
boxes; "author-interview" names neither. Words such as "header" or "meta", which may stand around an article as well as beside it
(``WEAK_NAMES``), count as far as their element holds no prose.

Parsing is tolerant: comments, scripts, styles and other raw text (``RAW_TAGS``, among them noscript, button, select and svg) are skipped
whole, paragraphs and list items
close by themselves, unmatched end tags are ignored, and an open element ends with the page (a button or another element
that may hold markup is passed over if it has no end). Names of html and body aren't read. Character
references are decoded once; white space inside a block becomes one blank; <br> is white space.

Defined cases. A null or empty page, one without text, or one of boilerplate only gives the empty
string. A page without tags is one block. Rows that repeat a page_id get a row each. An empty
table gives no rows. Other columns of the table are not used.

Scale. One scan, no shuffle; a task holds one batch of pages and one page's blocks, and returns about OUT characters at a time.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

# Tag names by kind.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot"
    " th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no page text; the parser skips to their end tag.
RAW_TAGS = frozenset("script style textarea noscript template iframe object svg math canvas audio video select button".split())
#: Those of them that hold no markup, so that an unclosed one goes on to the end of the page; the others are passed over then.
TEXT_TAGS = frozenset("script style textarea noscript iframe".split())
#: Elements whose own names tell about the page as a whole.
WHOLE_TAGS = frozenset("html body".split())
#: Elements that aren't content, unless most of the page's prose is in them: so many characters and blocks of it at least.
HOLDERS, HELD, HELD_BLOCKS = ("form", "header", "aside"), 200, 2
#: Tags that close an open element of the same kind, up to the containers after it.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
#: Words of class, id and role names: of what is no article, however much prose it has.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commenter commenters commentlist commentary complementary consent contentinfo cookie cookies"
    " copyright discussion discussions disqus dialog feedback foot footer gdpr hidden login logo masthead menu menus modal nav navbar navigation newsletter notice notices notification"
    " notifications overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond responses reviews rss search share sharing"
    " sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar topbar trending warning".split()
)
#: Of what may also stand around an article.
WEAK_NAMES = frozenset(
    "alert author banner bio bottom byline byl categories category disclaimer form head header info legal links meta post-meta tags teaser toc tools top widget widgets".split()
)
#: Words that go with either and change nothing: boxes, places and parts.
BOX_NAMES = frozenset(
    "a area aside bar bars block blocks body bottom box boxes button buttons card cards col column columns container content footer global group head header holder icon icons inner item"
    " items label left line link links list lists main message mobile module outer page panel row right section sections site slot slots small sticky strip text the thread title top"
    " unit units user users view wrap wrapper zone".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text prose".split())
ENTRY_NAMES, HEAD_NAMES = frozenset("article entry post story".split()), frozenset("head header heading title".split())

FEATURES = (
    "bias", "in_content_tag", "in_page_nav", "in_page_header", "in_page_footer", "in_aside", "in_form", "in_head",
    "bad_name", "weak_name", "good_name", "link_share", "links_only", "paragraph", "heading", "list_item", "cell", "long", "prose", "very_short", "sentence", "copyright",
)

#: Labelled blocks: path of elements (tag, or tag.name), text, share of it in links, 1 for content.
TRAINING = (
    ("html head title", "A walk in the hills", 0.0, 0),
    ("html body nav ul li", "Home", 1.0, 0),
    ("html body nav ul li", "About us", 1.0, 0),
    ("html body nav", "Home | News | Contact", 0.9, 0),
    ("html body div.menu ul li", "Products", 1.0, 0),
    ("html body nav p", "Where do you want to go today? Choose a place, and read all that we have written about it.", 0.0, 0),
    ("html body div nav ul li", "Our story", 0.0, 0),
    ("html body nav h2", "Sections", 0.0, 0),
    ("html body article nav ul li", "Chapter two", 1.0, 0),
    ("html head title", "A walk in the hills, and what we found there after three days of rain. The Daily Page.", 0.0, 0),
    ("html body div.topbar p", "Call us any time.", 0.0, 0),
    ("html body header h1", "The Daily Page", 0.5, 0),
    ("html body header p", "News since the year of the flood.", 0.0, 0),
    ("html body header div.logo", "Daily", 1.0, 0),
    ("html body div.header h1", "My site", 0.0, 0),
    ("html body div.ad", "Buy now and save half of it. Offer ends soon, while stocks last.", 0.0, 0),
    ("html body div.ad", "Cheap trips to the sea.", 0.0, 0),
    ("html body article div.ad", "Try our shoes. They run by themselves and never wear out at all.", 0.0, 0),
    ("html body main div.sponsored p", "A word from our sponsor, who pays for all of this.", 0.2, 0),
    ("html body div.advert p", "Half price today.", 0.0, 0),
    ("html body div.cookie p", "We use cookies to make this page work better for you and for us.", 0.1, 0),
    ("html body div.consent", "By staying here you agree to our terms, which you can read.", 0.2, 0),
    ("html body div.notice p", "This site will be down on Sunday. We are sorry for that.", 0.0, 0),
    ("html body article div.notice", "Sign in to read the rest of the stories that we publish.", 0.1, 0),
    ("html body div.popup", "Subscribe to our letter.", 0.0, 0),
    ("html body aside h3", "Related", 0.0, 0),
    ("html body aside ul li", "Ten things about rivers that you did not know", 1.0, 0),
    ("html body aside p", "The writer lives by the sea and has two cats, one of them old.", 0.0, 0),
    ("html body main aside p", "In other news, the bridge is open again, and all may cross it.", 0.0, 0),
    ("html body article aside p", "Read more about the bridge in our long report from last week.", 0.3, 0),
    ("html body div.sidebar p", "Most read this week, in the order of our own choice.", 0.2, 0),
    ("html body div.sidebar ul li", "A short history of bread", 1.0, 0),
    ("html body form p", "Your name and your message, please.", 0.0, 0),
    ("html body form label", "Name", 0.0, 0),
    ("html body article form p", "Leave your address here, and we will write to you.", 0.0, 0),
    ("html body main form div", "Search", 0.0, 0),
    ("html body section.comments h2", "Three comments", 0.0, 0),
    ("html body section.comments div.comment p", "I was there too, and it was not at all like this. It rained.", 0.0, 0),
    ("html body article div.comments p", "Well said! I could not agree more with what you write here.", 0.0, 0),
    ("html body div.comments ul li p", "What a nice story. Thank you for it.", 0.0, 0),
    ("html body main ol.comment-list li.comment p", "No, that is wrong. The bridge is older than the town.", 0.0, 0),
    ("html body footer", "© The Daily Page. All rights reserved.", 0.0, 0),
    ("html body footer p", "Some words about us and what we do here every day of the year.", 0.0, 0),
    ("html body footer ul li", "Imprint", 1.0, 0),
    ("html body div.footer p", "Copyright by the writers.", 0.1, 0),
    ("html body article footer p", "Filed under hills, rain, walks.", 0.8, 0),
    ("html body article div.share", "Share this", 1.0, 0),
    ("html body main div.related ul li", "Another walk, in another place", 1.0, 0),
    ("html body div.breadcrumb", "Home > Walks > Hills", 0.9, 0),
    ("html body div.comment-list div.comment-body p", "I have read this twice now, and I still think that the bridge was built by the monks, not by the town.", 0.0, 0),
    ("html body div.content div.comments p", "My father told me the same story when I was young, and he had it from his father, who was there.", 0.0, 0),
    ("html body div.main div.sidebar p", "Our best stories of the week, sent to you every Sunday before you get up, and all of it for nothing.", 0.0, 0),
    ("html body div.cookie-banner p", "We and our partners store data on your device, so that we can show you what you may want to buy.", 0.0, 0),
    ("html body div.ad-slot p", "The new car is here. It drives by itself, it parks by itself, and it pays for itself in ten years.", 0.0, 0),
    ("html body div.newsletter p", "Get the best of the hills into your post box, once a week, with maps and with all the news on huts.", 0.0, 0),
    ("html body article.comment p", "This is the best text on bees that I have read so far, and I have read a lot of them over the years.", 0.0, 0),
    ("html body div.content div.promo p", "Members read all of our stories without a limit, and they get our yearly book of maps on top of it.", 0.0, 0),
    ("html body div.meta", "By A. Writer, 3 May", 0.2, 0),
    ("html body div.content div.meta span", "Filed on Monday", 0.0, 0),
    ("html body div.post div.author", "A. Writer", 1.0, 0),
    ("html body div.tags", "hills, rain, walks", 1.0, 0),
    ("html body div.header div", "News since the flood", 0.0, 0),
    ("html body div.header p", "Your paper for the hills", 0.0, 0),
    ("html body div.widget h3", "Archive", 0.0, 0),
    ("html body div.banner", "Now in a new shape", 0.0, 0),
    ("html body div", "Home", 1.0, 0),
    ("html body div", "Back to the list", 1.0, 0),
    ("html body div ul li", "Contact", 1.0, 0),
    ("html body p", "Home | News | About us", 0.9, 0),
    ("html body div p", "Terms Privacy Imprint", 0.9, 0),
    ("html body article div", "Home", 1.0, 0),
    ("html body article div", "Read next: the long way to the sea", 1.0, 0),
    ("html body article p", "Next page", 1.0, 0),
    ("html body main div", "All stories", 1.0, 0),
    ("html body div.content div", "Back to the top", 1.0, 0),
    ("html body div", "Loading", 0.0, 0),
    ("html body div", "Page 3 of 9", 0.5, 0),
    ("html body p", "© 2021 The Daily Page", 0.0, 0),
    ("html body div.meta p", "We asked the writer how she came to the hills, and she told us of a summer with her aunt, long ago.", 0.0, 1),
    ("html body div.header p", "The council met on Monday and agreed, after three hours, to mend the lower bridge before the winter.", 0.0, 1),
    ("html body div.author p", "When I was ten years old my father gave me a knife and told me to find my own way home by the river.", 0.0, 1),
    ("html body div.widget p", "To set the clock, hold both keys until the hand stops, then turn the wheel to the left by one step.", 0.1, 1),
    ("html body div.top div p", "The storm came in from the sea at four, and by five there was no light left in any of the houses.", 0.0, 1),
    ("html body div.banner div p", "In the old days the banner was carried through the town by six men, who were paid with beer and bread.", 0.0, 1),
    ("html body div.head div.body p", "All of them had come on foot, and nobody had thought of bringing more than a coat and a bit of bread.", 0.0, 1),
    ("html body article h1", "A walk in the hills", 1.0, 1),
    ("html body div.post h2", "The lower road", 1.0, 1),
    ("html body article h1", "A walk in the hills", 0.0, 1),
    ("html body article h2", "The way down", 0.0, 1),
    ("html body article header h1", "A walk in the hills", 0.0, 1),
    ("html body article p", "We left at dawn and took the path along the stream, which was high after the rain.", 0.0, 1),
    ("html body article p", "It was cold.", 0.0, 1),
    ("html body article p", "Oh.", 0.0, 1),
    ("html body article p", "See the map for the way, and the list of huts where you can sleep.", 0.3, 1),
    ("html body article p", "and then on, without a stop, to the top of it", 0.0, 1),
    ("html body article ul li", "Bread and cheese", 0.0, 1),
    ("html body article ul li", "A map of the hills that shows every path, however small.", 0.0, 1),
    ("html body article blockquote p", "The hills are not high, but they are long.", 0.0, 1),
    ("html body article table tr td", "Twelve miles", 0.0, 1),
    ("html body article div", "From the top we saw the sea, and the ships on it, far out and still.", 0.0, 1),
    ("html body article", "Down there the town lay in the sun, and we could hear its bells.", 0.0, 1),
    ("html body article section p", "At the pass we met a man with a dog. He asked us where we came from.", 0.0, 1),
    ("html body article section h3", "What to bring", 0.0, 1),
    ("html body article pre", "north 3 east 2 north 1", 0.0, 1),
    ("html body main h1", "Bread for a week", 0.0, 1),
    ("html body main p", "Mix the flour with the water and let it stand overnight in a cool room.", 0.0, 1),
    ("html body main p", "Then bake.", 0.0, 1),
    ("html body main div p", "The crust should be dark, and the loaf should sound hollow when you tap it.", 0.1, 1),
    ("html body main ul li", "Two pounds of flour", 0.0, 1),
    ("html body div.content p", "The river rose in the night, and by morning the lower road was gone.", 0.0, 1),
    ("html body div.content h2", "The lower road", 0.0, 1),
    ("html body div.post div.entry p", "I have kept bees for nine years, and they have kept me, in their way.", 0.0, 1),
    ("html body div.main div.text p", "Nobody knows who built the tower, or why it has no door.", 0.0, 1),
    ("html body p", "This page has no frame around it, only its text, which goes on for a while.", 0.0, 1),
    ("html body h1", "Notes", 0.0, 1),
    ("html body div p", "The second part tells how the tower fell, and who was blamed for it in the end.", 0.0, 1),
    ("html body div div p", "There are three ways over the hills, and all of them are closed in winter.", 0.0, 1),
    ("html body", "Plain words on a plain page, without any mark around them but the body.", 0.0, 1),
    ("html body div p", "It rained.", 0.0, 1),
    ("html body table tr td", "Twelve", 0.0, 1),
    ("html body table tr td", "7.5", 0.0, 1),
    ("html body div table tr th", "Place", 0.0, 1),
    ("html body div dl dd", "a kind of bread", 0.0, 1),
    ("html body table tr td", "Home", 1.0, 0),
    ("html body div.sidebar table tr td", "Twelve", 0.0, 0),
    ("html body div p", "Nobody answered.", 0.0, 1),
    ("html body p", "So it was.", 0.0, 1),
    ("html body div h2", "The second winter", 0.0, 1),
    ("html body div h1", "How the tower fell", 0.0, 1),
    ("html body div", "From here on the path is steep, and you should not walk it after rain, or with small children.", 0.0, 1),
    ("html body div div", "The house had nine rooms, and in each of them there was a clock that told another time of day.", 0.0, 1),
    ("html body table tr td", "The first of them came from the north, the others from places whose names we have not kept.", 0.0, 1),
    ("html body div ul li", "Take the salt out of the water before you put the bread in, and keep the lid on for an hour.", 0.0, 1),
    ("html body p", "See the first part of this story for how they met, and the notes for what is known of the ship.", 0.4, 1),
)

#: Capacity of the edge between two blocks that share their element; least share of it between blocks far apart.
SMOOTH, FAR = 1.0, 0.1
L2, STEPS = 0.02, 30
#: Characters of a block from which it is prose, if a sentence ends it and links are less than half of it.
PROSE = 60
#: Characters of text in a batch that a task returns.
OUT = 1 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_SPLIT = re.compile(r"[^a-z]+")
_LONG_REFERENCE = re.compile(r"&#0*([0-9]{8})[0-9]*")
#: A heading above readers' comments.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader|user)?\s*(?:comments?|replies|responses|discussion|reviews)\s*(?:\(?\d+\)?)?\s*:?", re.I)
_SENTENCE = re.compile(r"[.!?…。][\"'”’)]*$")


def _kind(name: str) -> str:
    """What a class, id or role stands for: bad, weak, good or nothing."""
    parts = {x for x in _SPLIT.split(name) if len(x) > 2 or x in ("ad", "to")} or {x for x in _SPLIT.split(name) if x}  # one or two letters are a prefix
    plain = BOX_NAMES | CONTENT_NAMES
    if parts <= ENTRY_NAMES | HEAD_NAMES and not parts.isdisjoint(ENTRY_NAMES):  # the head of an article, as in "entry-header"
        return "good"
    if name in WEAK_NAMES or parts <= WEAK_NAMES | plain and not parts.isdisjoint(WEAK_NAMES):
        return "weak"
    if parts <= BOILERPLATE_NAMES | WEAK_NAMES | plain and not parts.isdisjoint(BOILERPLATE_NAMES):
        return "bad"
    return "" if parts.isdisjoint(CONTENT_NAMES) else "good"


class Element:
    __slots__ = ("tag", "depth", "parent", "bad", "weak", "good", "hidden", "seen", "within", "holders")

    def __init__(self, tag: str, names: str, parent: Element | None) -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.bad, self.weak, self.good, self.hidden = (parent.bad, parent.weak, parent.good, parent.hidden) if parent else (False, None, False, False)
        self.seen = parent.seen if parent else frozenset()
        self.within = parent.within if parent else frozenset()
        self.holders = parent.holders if parent else {}  # the outermost of the elements that may hold a whole page after all
        if tag in HOLDERS and tag not in self.holders:
            self.holders = self.holders | {tag: self}
        if tag not in self.within:
            self.within = self.within | {tag}
        if tag in ("article", "main"):
            self.seen, self.weak = self.seen | {"content"}, None
        elif tag in ("nav", "header", "footer", "aside", "form", "head"):
            # The head of an article is content; of the page it is not.
            self.seen = self.seen | ({tag} if tag != "header" or "content" not in self.seen else set())
        if names and tag not in WHOLE_TAGS:
            kinds = {_kind(x) for x in names.split()}
            self.bad = self.bad or "bad" in kinds
            self.good = self.good or "good" in kinds
            if "weak" in kinds and not (tag in ("article", "main") or tag == "header" and "content" in self.seen):
                self.weak = self  # the nearest element so named
            elif "good" in kinds:
                self.weak = None


def _names(attributes: str) -> tuple[str, bool]:
    """Words of class, id and role; whether the element is hidden."""
    names, hidden = [], False
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        elif key in ("hidden", "aria-hidden"):
            hidden = hidden or key == "hidden" or value == "true"
        else:
            names.append(value)
    return " ".join(names), hidden


def blocks(page: str) -> list[tuple[Element, str, float]]:
    """(element, text, share of the text in links) of each block with text, in page order."""
    out: list[tuple[Element, str, float]] = []
    root = here = Element("", "", None)
    parts: list[str] = []
    linked, link = 0, False
    unclosed: set[str] = set()  # raw tags without an end tag from here on

    def flush() -> None:
        nonlocal linked
        if parts:
            # A number of eight digits is beyond all code points, however many more follow.
            text = " ".join(entities.unescape(_LONG_REFERENCE.sub(r"&#\1", "".join(parts))).split())
            if text and not here.hidden:
                out.append((here, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            parts.append(page[at:end])
            if link:
                linked += len(page[at:end].strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # end tag
            if tag == "a":
                link = False
            elif tag in BLOCK_TAGS:
                flush()
                if tag not in here.within:
                    continue
                x = here
                while x.parent and x.tag != tag:
                    x = x.parent
                if x.parent:
                    here = x.parent
            continue
        if tag == "a":
            link = True
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW_TAGS and not m[3].rstrip().endswith("/"):
            if tag not in unclosed:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if close or tag in TEXT_TAGS:
                    at = close.end() if close else size
                else:
                    unclosed.add(tag)
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        link = link and tag not in ("article", "main", "section", "p", "li")
        if here.tag == "p":  # a block ends an open paragraph
            here = here.parent
        if tag in CLOSES:
            own, stops = CLOSES[tag]
            x = here
            while not here.within.isdisjoint(own.split()) and x.parent and x.tag not in stops and x.tag not in own.split():
                x = x.parent
            while x.parent and x.tag in own.split():
                here = x = x.parent
        if tag in VOID_TAGS:
            continue
        if m[3]:
            names, hidden = _names(m[3])
            here = Element(tag, names, here)
            here.hidden = here.hidden or hidden
        else:
            here = Element(tag, "", here)
    flush()
    return out


def is_prose(text: str, share: float) -> bool:
    return len(text) >= PROSE and share < 0.5 and _SENTENCE.search(text) is not None


def describe(element: Element, text: str, share: float, weak: float, excused: frozenset = frozenset(), commented: bool = False) -> list[float]:
    """The values of FEATURES; weak: how much a weak name counts; excused: elements that don't count as what they are; commented: stands under a heading of comments."""
    seen, tag, n = element.seen, element.tag, len(text)
    if excused:
        seen = seen - {k for k, x in element.holders.items() if id(x) in excused}
    return [
        1.0, "content" in seen, "nav" in seen, "header" in seen, "footer" in seen, "aside" in seen, "form" in seen, "head" in seen,
        element.bad or commented, weak, element.good, share, share > 0.8 and not (tag[:1] == "h" and tag[1:].isdigit()), tag in ("p", "blockquote", "pre"), tag[:1] == "h" and tag[1:].isdigit(), tag == "li", tag in ("td", "th", "dd", "dt"),
        min(n, 400) / 200, is_prose(text, share), n < 25, _SENTENCE.search(text) is not None, "©" in text or "opyright" in text,
    ]


_trained: list[np.ndarray] = []


def weights() -> np.ndarray:
    """Weights of FEATURES, by logistic regression on TRAINING (Newton's steps)."""
    if not _trained:
        rows, labels = [], []
        for path, text, share, label in TRAINING:
            x = None
            for step in path.split():
                tag, _, names = step.partition(".")
                x = Element(tag, names, x)
            rows.append(describe(x, text, share, float(x.weak is not None and not is_prose(text, share))))
            labels.append(label)
        x, y, w = np.array(rows, float), np.array(labels, float), np.zeros(len(FEATURES))
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + L2 * np.eye(len(w)), x.T @ (p - y) + L2 * w)
        _trained.append(w)
    return _trained[0]


def _nearness(a: Element, b: Element, alike: float) -> float:
    """Capacity between two blocks: by the steps from one to the other in the DOM, and how alike they are."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return alike * SMOOTH * max(FAR, 1 / (1 + 0.5 * steps))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut of the network.

    odds: positive values are capacities from the content terminal, negative ones to the
    other. Terminal flow through a single node is cancelled at once; what is
    left moves along shortest augmenting paths between nodes.
    """
    n, left = len(odds), list(odds)
    if min(odds) > 0 or max(odds) <= 0:
        return [x > 0 for x in odds]
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        around[a][b] = around[a].get(b, 0.0) + capacity
        around[b][a] = around[b].get(a, 0.0) + capacity
    while True:
        before = {x: -1 for x in range(n) if left[x] > 1e-12}
        queue, ends = list(before), []
        for x in queue:  # breadth first; grows while it runs
            for y, capacity in around[x].items():
                if capacity > 1e-12 and y not in before:
                    before[y] = x
                    (ends if left[y] < -1e-12 else queue).append(y)
        if not ends:
            return [x in before for x in range(n)]
        for end in ends:  # all that the tree reaches, as far as what was pushed before leaves room
            path, x = [], end
            while before[x] >= 0:
                path.append((before[x], x))
                x = before[x]
            flow = min(left[x], -left[end], *(around[a][b] for a, b in path))
            if flow > 1e-12:
                left[x] -= flow
                left[end] += flow
                for a, b in path:
                    around[a][b] -= flow
                    around[b][a] += flow


def _excused(found: list[tuple[Element, str, float]]) -> frozenset:
    """Forms, headers and asides that hold more than half of the page's prose: whole pages stand in them on some sites."""
    total, inside = 0, {}
    for element, text, share in found:
        if is_prose(text, share) and not element.bad and element.seen.isdisjoint(("nav", "footer", "head")):
            total += len(text)
            for holder in element.holders.values():
                size = inside.setdefault(id(holder), [0, 0])
                size[0] += len(text)
                size[1] += 1
    return frozenset(k for k, (size, many) in inside.items() if size >= HELD and many >= HELD_BLOCKS and 2 * size > total)


def _commented(found: list[tuple[Element, str, float]]) -> list[bool]:
    """Which blocks stand under a heading of readers' comments, in its box, up to the next heading as high; prose must come before it."""
    out, box, level, prose = [], None, 0, False
    for element, text, share in found:
        tag = element.tag
        height = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
        if box is not None:
            x = element.parent
            while x is not None and x.depth > box.depth:
                x = x.parent
            if x is not box or height and height <= level:
                box = None
        if box is None and prose and height > 1 and _COMMENTS.fullmatch(text):
            box, level = element.parent, height
        out.append(box is not None)
        prose = prose or is_prose(text, share)
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    if not found:
        return ""
    w = weights()
    boxes: dict[int, list[int]] = {}  # characters, and those of prose, in each element with a weak name
    for element, text, share in found:
        if element.weak:
            size = boxes.setdefault(id(element.weak), [0, 0])
            size[0] += len(text)
            size[1] += len(text) * is_prose(text, share)
    weak = [0.0 if not x[0].weak else 1 - (box := boxes[id(x[0].weak)])[1] / box[0] for x in found]
    excused, commented = _excused(found), _commented(found)
    odds = (np.array([describe(*x, v, excused, z) for x, v, z in zip(found, weak, commented, strict=True)], float) @ w).tolist()
    edges, last = [], {}
    for k, (element, _, share) in enumerate(found):
        if k:
            edges.append((k - 1, k, _nearness(found[k - 1][0], element, 1 - abs(share - found[k - 1][2]))))
        j = last.get(id(element.parent))
        if j is not None and j < k - 1:
            edges.append((j, k, SMOOTH / 2 * (1 - abs(share - found[j][2]))))
        last[id(element.parent)] = k
    return "\n".join(x[1] for x, keep in zip(found, minimum_cut(odds, edges), strict=True) if keep)


def _extract(batches):
    def made(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
        columns = [ids, urls, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        first, size, texts = 0, 0, []
        for k, page in enumerate(batch.column(2)):
            texts.append(extract(page.as_py()))
            size += len(texts[-1])
            if size > OUT or k == batch.num_rows - 1:
                yield made(batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), texts)
                first, size, texts = k + 1, 0, []


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    kind = dict(pages.dtypes)["page_id"]
    return c.in_arrow(pages.select("page_id", "url", "html"), _extract, f"page_id {kind}, url string, text string, n_chars long")
