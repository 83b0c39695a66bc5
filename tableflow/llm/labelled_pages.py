"""Labelled web pages to learn main text from: hand-written layouts, filled with invented words.

Which part of a layout is main text was decided by hand, in the layout. The words mean nothing, so that a model can
learn from markup, length, links and punctuation only.
"""

from __future__ import annotations

import random

#: Stands before every piece of main text in the labelled source.
MAIN = "\ue000"

# Elements that hold a kind of text on the web, as written in a start tag.
ELEMENTS = {
    "menu": ["nav", 'nav class="main-nav"', 'div class="menu"', 'div id="navigation"', 'div class="nav-bar"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="navbar"', 'div class="toc"', 'menu'],
    "header": ["header", 'header class="site-header"', 'div id="header"', 'div class="header"', 'div class="masthead"', 'div class="topbar"', 'div role="banner"', 'div class="branding"'],
    "footer": ["footer", 'footer class="site-footer"', 'div id="footer"', 'div class="footer"', 'div class="copyright"', 'div class="colophon"', 'div role="contentinfo"', 'div class="legal"'],
    "sidebar": ["aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div id="secondary"', 'div class="widget"', 'section class="related"', 'div class="related-posts"', 'div class="recommended"', 'div role="complementary"', 'div class="rail"'],
    "notice": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="cookies"', 'div class="notice"', 'div role="alert"', 'div class="alert"', 'div class="consent"', 'div class="gdpr"', 'div class="popup"', 'div class="modal"', "dialog", 'section class="paywall"', 'div class="disclaimer"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-top"', 'div class="ad-slot"', 'div class="sponsored"', 'div class="sponsor"', 'div class="promo"', 'aside class="ad"', 'ins class="ads"', 'div class="banner"', 'section class="promotion"'],
    "form": ["form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'div class="newsletter"', 'form id="login"', 'div class="signup"', "fieldset"],
    "comments": ['section id="comments"', 'section class="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div class="responses"', 'div class="discussion"', 'article class="comment"', 'div class="replies"', 'ul class="commentlist"'],
    "share": ['div class="share"', 'div class="social"', 'ul class="social-links"', 'div class="sharing"', 'div class="tags"'],
}
CONTAINERS = [
    ["article"], ["main"], ["main", "article"], ['div class="content"', "article"], ['div id="content"'], ['div class="content"'], ['div class="post"'],
    ['div class="entry-content"'], ['div class="article-body"'], ['section class="story"'], ['div id="main"'], ['div class="page"', 'div class="text"'],
    ["main", 'div class="body"'], ['article class="post"', 'div class="post-content"'], ['div role="main"'], ["table", "tr", "td"], ["div"], [],
    ['div class="container"', "article"], ['div class="wrapper"', 'main id="main"'], ['section', "article"], ['article itemprop="articleBody"'],
]
_SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va", "we", "xi", "yo", "zu", "ér", "ün", "os", "ing"]


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def chance(self, share: float) -> bool:
        return self.random.random() < share

    def words(self, least: int, most: int) -> str:
        pick = self.random.choice
        return " ".join("".join(pick(_SYLLABLES) for _ in range(self.random.randint(1, 4))) for _ in range(self.random.randint(least, most)))

    def sentence(self, least: int = 4, most: int = 25) -> str:
        text = self.words(least, most)
        return text[0].upper() + text[1:] + self.random.choice("....!?")

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(1, sentences)))

    def short(self) -> str:
        """A text of menus, buttons and captions."""
        made = self.words(1, 3)
        return self.random.choice([made, made.title(), made.upper(), f"{made} {self.random.randint(1, 2030)}"])

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.short()}</a>'

    def links(self) -> str:
        items = [f"<li>{self.link()}</li>" for _ in range(self.random.randint(2, 9))]
        return f"<ul>{''.join(items)}</ul>" if self.chance(0.7) else " ".join(self.link() for _ in items)

    def inside(self, opening: list[str], content: str) -> str:
        for tag in reversed(opening):
            content = f"<{tag}>{content}</{tag.split()[0]}>"
        return content

    def piece(self, kind: str) -> str:
        """Text that is not main text, in an element of its kind: often short or links, but as often like prose."""
        if kind == "menu":
            body = self.links()
        elif kind == "form":
            body = f"<label>{self.short()}</label><input name=x><button>{self.short()}</button>" + (f"<p>{self.prose(2)}</p>" if self.chance(0.5) else "")
        elif kind == "comments":
            said = [f"<p>{self.short()}</p><p>{self.prose(4)}</p>" if self.chance(0.5) else f"<div>{self.prose(4)}</div>" for _ in range(self.random.randint(1, 5))]
            body = (f"<h3>{self.short()}</h3>" if self.chance(0.6) else "") + "".join(said)
        elif kind == "footer":
            body = self.random.choice([f"&copy; {self.words(1, 2)} &middot; {self.prose(3)}", self.prose(2) + self.links(), f"<p>{self.prose(3)}</p>", f"<div>{self.short()}</div><p>{self.prose(2)}</p>"])
        elif kind == "header":
            body = self.random.choice([f"<h1>{self.short()}</h1>", f"<div>{self.short()}</div>"]) + self.random.choice([self.links(), f"<p>{self.words(2, 9)}</p>", f"<p>{self.prose(3)}</p>"])
        elif kind == "share":
            body = self.links()
        else:
            body = self.random.choice([self.prose(1), self.prose(4), f"<p>{self.prose(5)}</p>", f"<h3>{self.short()}</h3><p>{self.prose(3)}</p>", self.short(), self.links()])
        return self.inside([self.random.choice(ELEMENTS[kind])], body)

    def main(self) -> list[str]:
        """The pieces of an article."""
        said = [f"<h1>{MAIN}{self.words(2, 14)}</h1>"] if self.chance(0.85) else []
        if said and self.chance(0.25):
            said = [f"<header>{said[0]}</header>"]
        for _ in range(self.random.choice([1, 2, 3, 5, 8, 13])):
            kind = self.random.random()
            if kind < 0.62:
                said.append(f"<p>{MAIN}{self.prose(6)}" + ("</p>" if self.chance(0.85) else ""))
            elif kind < 0.70:
                said.append(f"<p>{MAIN}{self.words(1, 4)}{self.random.choice(['', '.', ' |'])}</p>")
            elif kind < 0.76:
                said.append(f"<p><b>{MAIN}{self.prose(2)}<br>{MAIN}{self.prose(2)}")
            elif kind < 0.81:
                said.append(f"<h2>{MAIN}{self.words(1, 7)}</h2>")
            elif kind < 0.87:
                items = [f"<li>{MAIN}{self.words(1, 12)}</li>" for _ in range(self.random.randint(2, 5))]
                said.append(f"<ul>{''.join(items)}</ul>")
            elif kind < 0.91:
                said.append(f"<blockquote><p>{MAIN}{self.prose(3)}</p></blockquote>")
            elif kind < 0.94:
                said.append(f"<div>{MAIN}{self.prose(5)}</div>")
            elif kind < 0.97:
                cells = [f"<tr><td>{MAIN}{self.words(1, 3)}<td>{MAIN}{self.random.randint(1, 999)}</tr>" for _ in range(self.random.randint(1, 4))]
                said.append(f"<table>{''.join(cells)}</table>")
            else:
                said.append(f'<p>{MAIN}{self.sentence()} <a href="/x">{self.words(1, 4)}</a> {self.sentence()}</p>')
        return said

    def page(self) -> str:
        said = self.main()
        for kind in ("advert", "share", "form", "comments", "notice", "sidebar"):
            if self.chance(0.14):
                said.insert(len(said) if kind in ("share", "comments") else self.random.randint(1, len(said)), self.piece(kind))
        article = self.inside(self.random.choice(CONTAINERS), "".join(said))
        before = [self.piece(kind) for kind in ("notice", "header", "menu", "advert", "form") if self.chance(0.45)]
        after = [self.piece(kind) for kind in ("share", "sidebar", "advert", "comments", "notice") if self.chance(0.35)]
        after += [self.piece("footer")] if self.chance(0.85) else []
        if self.chance(0.3):  # any piece in any place
            around = before + after
            self.random.shuffle(around)
            cut = self.random.randint(0, len(around))
            before, after = around[:cut], around[cut:]
        body = "".join(before) + article + "".join(after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def labelled_pages(count: int, seed: int = 0) -> list[str]:
    """``count`` pages in which each piece of main text begins with ``MAIN``."""
    return [_Writer(1_000_003 * seed + i).page() for i in range(count)]
