"""Pages made by hand in many layouts, each with the texts of its content blocks.

Layouts are written as a page would be; ``c`` marks a content text and ``b`` any other.
"""

import random

SYLLABLES = "ka lo mi ten dor vel ra su ni bre tal ost en qui mar fos li gan pe wo sta er hin duk".split()


class Layout:
    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.content = set()
        self.used = set()

    def words(self, n):
        return " ".join("".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 3))) for _ in range(n))

    def prose(self, low, high):
        """Sentences of that many words in all."""
        while True:
            left, out = self.rng.randint(low, high), []
            while left > 0:
                n = min(left, self.rng.randint(4, 14))
                s = self.words(n)
                if n > 7 and self.rng.random() < 0.6:
                    s = s.replace(" ", ", ", 1)
                out.append(s[0].upper() + s[1:] + self.rng.choice([".", ".", ".", ".", "!", "?"]))
                left -= n
            text = " ".join(out)
            if text not in self.used:
                self.used.add(text)
                return text

    def label(self, low, high):
        """Words without an end."""
        while True:
            text = self.words(self.rng.randint(low, high)).capitalize()
            if text not in self.used:
                self.used.add(text)
                return text

    def c(self, text):
        self.content.add(text)
        return text

    def para(self):
        return self.c(self.prose(15, 70))

    def short(self):
        """A paragraph of a word or a few."""
        return self.c(self.prose(1, 5))

    def head(self):
        return self.c(self.label(3, 8))

    def tag(self, name, inner):
        """A container by its element and class, or, as often, by neither."""
        element, _, kind = name.partition(".")
        if self.rng.random() < 0.5:
            return f'<div class="{self.words(1)}">{inner}</div>'
        return f'<{element} class="{kind}">{inner}</{element}>' if kind else f"<{element}>{inner}</{element}>"

    def links(self, n, tag="li"):
        return "".join(f'<{tag}><a href="/{i}">{self.label(1, 3)}</a></{tag}>' for i in range(n))

    def body(self, n=6):
        """Paragraphs, short ones among them."""
        return "".join(f"<p>{self.short() if self.rng.random() < 0.3 else self.para()}</p>" for _ in range(n))


def semantic(x):
    return f"<nav><ul>{x.links(6)}</ul></nav><article><h1>{x.head()}</h1>{x.body()}</article><aside><h3>{x.label(2, 4)}</h3><p>{x.prose(8, 25)}</p></aside><footer>&copy; {x.prose(4, 15)}</footer>"


def advert_first(x):
    return f'<nav><ul>{x.links(6)}</ul></nav><div class="ad">{x.prose(6, 20)}</div><article><h1>{x.head()}</h1>{x.body()}</article><footer>{x.prose(4, 12)}</footer>'


def one_short_paragraph(x):
    return f'<nav><ul>{x.links(5)}</ul></nav><div class="advert">{x.prose(5, 15)}</div><article><h1>{x.head()}</h1><p>{x.short()}</p></article><footer>{x.prose(4, 12)}</footer>'


def advert_inside(x):
    return f'<main><h1>{x.head()}</h1>{x.body(3)}<div class="sponsored box"><p>{x.prose(10, 30)}</p></div>{x.body(3)}</main>'


def class_soup(x):
    return f'<div id="top" class="site-header"><span>{x.label(2, 4)}</span></div><div class="menu">{x.links(5, "div")}</div><div class="post-content"><h2>{x.head()}</h2>{x.body()}</div><div class="sidebar"><p>{x.prose(10, 25)}</p></div><div class="footer">{x.prose(5, 12)}</div>'


def bare_soup(x):
    return f"<div>{x.links(7, 'span')}</div><div><div>{x.head()}</div>{x.body(7)}</div><div>{x.links(4, 'div')}</div><div>{x.label(2, 5)}</div>"


def bare_divs(x):
    parts = "".join(f"<div>{x.para() if x.rng.random() < 0.75 else x.short()}</div>" for _ in range(7))
    return f"<div><div>{x.links(6, 'div')}</div></div><div>{parts}</div><div><div>{x.links(5, 'div')}</div><div>{x.label(2, 5)}</div></div>"


def comments(x):
    said = "".join(f'<div class="comment"><b>{x.label(1, 2)}</b><p>{x.prose(5, 40)}</p></div>' for _ in range(3))
    return f'<article><h1>{x.head()}</h1>{x.body()}<section id="comments"><h2>{x.label(1, 3)}</h2>{said}</section></article>'


def comment_articles(x):
    said = "".join(f'<article class="comment"><p>{x.prose(5, 40)}</p></article>' for _ in range(3))
    return f"<main><article><h1>{x.head()}</h1>{x.body()}</article>{said}</main>"


def teaser_cards(x):
    cards = "".join(f'<article><h4><a href="/x">{x.label(3, 7)}</a></h4></article>' for _ in range(4))
    return f"<div><article><h1>{x.head()}</h1>{x.body()}</article></div><div>{cards}</div>"


def cookie_notice(x):
    return f'<div class="cookie-consent"><p>{x.prose(20, 50)}</p><p>{x.prose(8, 15)}</p></div><div id="content"><h1>{x.head()}</h1>{x.body()}</div><form><p>{x.prose(6, 12)}</p></form>'


def lists(x):
    items = "".join(f"<li>{x.c(x.prose(3, 14))}</li>" for _ in range(5))
    return f"<nav>{x.links(4, 'div')}</nav><article><h1>{x.head()}</h1><p>{x.para()}</p><ul>{items}</ul><p>{x.para()}</p></article><div class=\"related\"><ul>{x.links(5)}</ul></div>"


def tables(x):
    rows = "".join(f"<tr><td>{x.c(x.label(1, 2))}</td><td>{x.c(x.label(1, 3))}</td></tr>" for _ in range(4))
    return f"<article><h1>{x.head()}</h1><p>{x.para()}</p><table>{rows}</table><p>{x.para()}</p></article><footer><p>{x.prose(10, 30)}</p></footer>"


def link_paragraph(x):
    linked = x.label(4, 8)
    x.content.add(linked)
    return f'<div><ul>{x.links(6)}</ul></div><div class="entry"><p>{x.para()}</p><p><a href="/s">{linked}</a></p><p>{x.para()}</p><p>{x.short()}</p></div><div><ul>{x.links(6)}</ul></div>'


def quotation(x):
    return f'<header><p>{x.prose(3, 8)}</p></header><article><h2>{x.head()}</h2><p>{x.para()}</p><blockquote>{x.c(x.prose(3, 30))}</blockquote><p>{x.short()}</p><p>{x.para()}</p></article>'


def newsletter(x):
    return f'<article><h1>{x.head()}</h1>{x.body(3)}<div class="newsletter-signup"><h3>{x.label(2, 4)}</h3><p>{x.prose(8, 20)}</p></div>{x.body(2)}<div class="share">{x.links(3, "span")}</div></article>'


def cells_layout(x):
    return f"<table><tr><td>{x.links(5, 'div')}</td><td><p>{x.para()}</p><p>{x.para()}</p><p>{x.short()}</p><p>{x.para()}</p></td><td>{x.links(4, 'div')}</td></tr></table>"


def telling_or_not(x):
    """Containers that tell half the time what they are."""
    return x.tag("nav", x.links(6, "div")) + x.tag("article", f"<h1>{x.head()}</h1>{x.body(7)}") + x.tag("div.related", x.links(5, "div")) + x.tag("footer", f"<div>{x.label(2, 6)}</div><div>{x.links(3, 'span')}</div>")


def told_in_places(x):
    """An article whose parts lie in containers of their own."""
    parts = "".join(x.tag("section.text", x.body(3)) for _ in range(3))
    return x.tag("div.menu", x.links(8, "span")) + f"<div><h2>{x.head()}</h2>{parts}</div>" + x.tag("div.tagcloud", x.links(9, "span"))


def boxes_in_main(x):
    """Boxes without a telling name inside main: links, and captions of links."""
    return f"<main><h1>{x.head()}</h1>{x.body(4)}<div><div>{x.label(1, 3)}</div><ul>{x.links(5)}</ul></div>{x.body(3)}<div>{x.links(4, 'span')}</div></main>"


def bare_lines(x):
    """Short lines of an article between paragraphs, nothing told."""
    lines = "".join(f"<div>{x.para()}</div><div>{x.c(x.label(1, 4))}</div><div>{x.para()}</div>" for _ in range(3))
    return f"<div><div>{x.links(3, 'span')}</div><div>{x.label(1, 3)}</div></div><div>{lines}</div><div><div>{x.label(1, 4)}</div><div>{x.links(4, 'div')}</div><div>{x.label(1, 4)}</div></div>"


def sentences_among_links(x):
    """Short sentences above and below the article, between links and in no telling container."""
    top = f"<div><div>{x.links(3, 'span')}</div><p>{x.prose(1, 7)}</p><div>{x.links(3, 'span')}</div></div>"
    end = f"<div><ul>{x.links(3)}</ul><p>{x.prose(1, 9)}</p><p>{x.prose(1, 5)}</p><ul>{x.links(4)}</ul></div>"
    return f"<div>{top}<div><h1>{x.head()}</h1>{x.body(6)}</div>{end}</div>"


def sentences_in_main(x):
    """The same inside main, beside the article."""
    side = f"<section><p><a href=\"/a\">{x.label(2, 5)}</a></p><p>{x.prose(1, 6)}</p><p><a href=\"/b\">{x.label(2, 5)}</a></p></section>"
    return f"<main><section><h2>{x.head()}</h2>{x.body(5)}<p>{x.short()}</p></section>{side}{side.replace('/a', '/c')}</main>"


def few_words(x):
    """An article mostly of very short paragraphs."""
    short = "".join(f"<p>{x.short()}</p>" for _ in range(4))
    return f'<nav><ul>{x.links(5)}</ul></nav><div class="ad">{x.prose(4, 15)}</div><article><h1>{x.head()}</h1><p>{x.para()}</p>{short}</article><footer>{x.prose(3, 9)}</footer>'


STATES = "has-sidebar with-ads no-comments modal-open is-promo cookie-enabled hasSidebar without-widgets share-on".split()
ABOUT = "legal-analysis related-work advert-history cookie-baking social-science menu-planning sponsor-story comment-culture".split()
WRAPPERS = ["form", "div.modal", "div.overlay", "aside", "div.widget", "div.promo", "div.legal", "section.notice", "div.sidebar", "dialog", "div.subscription", "div.related", "div.popup-content", "fieldset", "div.login"]
BOILERPLATE = ["div.sidebar", "div.promo-box", "aside", "div.ad", "section.notice", "div.newsletter-signup", "div.related-posts", "div.widget", "div.site-footer", "div.cookie-notice"]


def state_names(x):
    """Names that tell a state of the page or what the article is about, on the article's own wrappers."""
    a, b, c = x.rng.choice(STATES), x.rng.choice(ABOUT), x.rng.choice(STATES)
    side = x.rng.choice(BOILERPLATE).partition(".")
    return f'<div class="page {a}"><nav><ul>{x.links(5)}</ul></nav><div id="{b}" class="content {c}"><h1>{x.head()}</h1>{x.body()}</div><{side[0]} class="{side[2]}"><p>{x.prose(8, 30)}</p></{side[0]}></div>'


def wrapped(x):
    """A whole page in an element that is named as boilerplate."""
    element, _, kind = x.rng.choice(WRAPPERS).partition(".")
    other = x.rng.choice(BOILERPLATE).partition(".")
    return f'<{element} class="{kind}"><nav><ul>{x.links(5)}</ul></nav><div><h1>{x.head()}</h1>{x.body(7)}</div><{other[0]} class="{other[2]}"><p>{x.prose(6, 20)}</p></{other[0]}><footer>{x.prose(3, 10)}</footer></{element}>'


def wrapped_article(x):
    """An article alone in an element that is named as boilerplate, beside other parts."""
    element, _, kind = x.rng.choice(WRAPPERS).partition(".")
    return f'<div><div>{x.links(6, "span")}</div></div><{element} class="{kind}"><h1>{x.head()}</h1>{x.body(8)}</{element}><footer><p>{x.prose(4, 12)}</p></footer>'


def many_comments(x):
    """More text of readers than of the article."""
    said = "".join(f'<li class="{x.rng.choice(["comment", "reply", "comment-item"])}"><p>{x.prose(15, 60)}</p></li>' for _ in range(8))
    return f'<article><h1>{x.head()}</h1>{x.body(4)}</article><div class="{x.rng.choice(["comments", "reader-feedback", "comment-list", "discussion"])}"><ol>{said}</ol></div>'


def unnamed_boxes(x):
    """Boilerplate outside the article's container, under names that tell nothing."""
    return f'<div class="{x.words(1)}">{x.links(5, "div")}</div><div class="{x.words(1)}"><div><h1>{x.head()}</h1>{x.body(7)}</div></div><div class="{x.words(1)}"><p>{x.prose(4, 15)}</p><div>{x.links(3, "span")}</div></div>'


def large_sidebar(x):
    """A sidebar with a good deal of prose."""
    return f'<main><h1>{x.head()}</h1>{x.body(7)}</main><div class="{x.rng.choice(["sidebar", "widget-area", "promo", "related"])}"><h3>{x.label(2, 4)}</h3><p>{x.prose(25, 60)}</p><p>{x.prose(20, 50)}</p></div>'


def scattered(x):
    """Parts of an article, boxes of links and a short remark, all side by side: no element is the core."""
    parts = [f"<div>{x.body(3)}</div>" for _ in range(4)]
    boxes = [f"<div>{x.links(4, 'span')}</div>" for _ in range(2)] + [f"<div><p>{x.prose(2, 9)}</p>{x.links(5, 'div')}</div>"]
    return f"<div>{x.links(5, 'span')}</div><h1>{x.head()}</h1>" + "".join(a + b for a, b in zip(parts, [*boxes, ""], strict=True)) + f"<div>{x.label(2, 5)}</div>"


def flat(x):
    """No containers at all: lines of links, then paragraphs and short ones, then links and remarks."""
    return f"{x.links(6, 'p')}<h1>{x.head()}</h1>{x.body(9)}<p>{x.c(x.label(1, 4))}</p>{x.body(3)}{x.links(3, 'p')}<p>{x.label(1, 3)}</p>{x.links(3, 'p')}<p>{x.prose(1, 6)}</p>{x.links(2, 'p')}"


def named_boxes_inside(x):
    """Long boxes between the paragraphs of a short article."""
    boxes = [x.rng.choice(BOILERPLATE).partition(".") for _ in range(2)]
    return f"<article><h1>{x.head()}</h1>" + "".join(f'<p>{x.para()}</p><{e} class="{k}"><p>{x.prose(12, 60)}</p></{e}>' for e, _, k in boxes) + f"<p>{x.para()}</p></article>"


def only_menus(x):
    return f'<nav><ul>{x.links(5)}</ul></nav><div class="banner">{x.prose(5, 15)}</div><footer>{x.prose(5, 15)}</footer>'


LAYOUTS = [semantic, advert_first, one_short_paragraph, advert_inside, class_soup, bare_soup, bare_divs, comments, comment_articles, teaser_cards, cookie_notice, lists, tables, link_paragraph, quotation, newsletter, cells_layout, telling_or_not, told_in_places, boxes_in_main, bare_lines, sentences_among_links, sentences_in_main, few_words, only_menus, state_names, wrapped, wrapped_article, many_comments, unnamed_boxes, large_sidebar, scattered, flat, named_boxes_inside, named_boxes_inside]


def pages(seeds):
    """(layout's name, page, texts of its content blocks) for each layout and seed."""
    out = []
    for seed in seeds:
        for make in LAYOUTS:
            x = Layout(f"{make.__name__}{seed}")
            made = make(x)
            out.append((make.__name__, f"<!DOCTYPE html><html><head><title>t</title></head><body>{made}</body></html>", x.content))
    return out
