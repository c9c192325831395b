"""Labelled pages for the potentials: a text block that begins with § is content, any other is not.

A page is put together by rule from parts that a site may have: a head of the
page, menus, notices, side parts, comments and a foot around, between or
within the blocks of an article, in containers of several names, nested or
not.  Every choice comes from one seed, so the pages are the same at each run.
"""

from __future__ import annotations

import random

_SENTENCES = (
    "The committee met on Tuesday to discuss the plan for the new bridge, which has been delayed twice.",
    "Rain fell all night.",
    "He agreed.",
    "Nobody in the two towns had asked for it, and few of them were ready to pay for it.",
    "It costs more than was said at first, but less than the last one did when it was built in the spring of that year.",
    "What will become of the ferry is not known yet.",
    "She had lived by the river all her life and had seen it freeze only once.",
    "Why not wait?",
)
_PITCHES = (
    "Our new summer range is here and it is better than ever, with prices that will surprise you and a service that never sleeps.",
    "Buy two, get one free this week only.",
    "Try the new phone with a better camera and a longer life.",
    "Sign up to hear from us each week!",
    "We use cookies to improve your visit. By staying you accept them.",
    "Do not miss a story.",
    "Read what others liked this week",
)
_REPLIES = (
    "I have lived here for years and this was never needed by anyone.", "Great read, thank you for it!", "First",
    "The figures in the second part are wrong, see the report of the year before.",
)
_WORDS = ("Home", "News", "Sport", "Contact us", "About", "Archive", "Weather", "Jobs", "Ten roads to avoid this winter", "What the mayor said")
_RIGHTS = (
    "&copy; example.org &middot; All rights reserved by the owner.", "Copyright 2020. Terms apply.", "© The site. Made with care.",
    "Legal notice. Imprint.", "About us.",
)

#: Containers of the main text, and of parts that never belong to it, as element and attributes.
_CONTAINERS = (
    "article", "main", "section", "div", 'div class="content"', 'div id="main"', 'div class="article"', 'div class="post"',
    'div class="story body"', 'div class="entry-content"', 'div class="text"', 'div role="main"', 'div class="container"',
    'article class="story"', 'section class="content"',
)
_AROUND = (
    "aside", 'div class="ad"', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"',
    'section class="related"', 'div class="newsletter"', 'div class="promo sponsored"', 'div class="advert advertisement"',
    'div class="cookie banner"', 'div class="notice"', 'div class="alert notice"', 'div class="popup modal"', 'div role="complementary"',
    "form", 'div class="share social"', "noscript", "div hidden", 'div style="display:none"', 'aside class="sidebar"',
    'div class="ad banner"',
)
_COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comments"', 'section id="comments"', 'div class="discussion"')
_HEADS = ("header", 'div id="header"', 'div class="header"', 'header class="masthead"', 'div class="topbar"')
_MENUS = (
    "nav", 'nav class="navbar"', 'div class="menu bar"', 'div class="menu"', 'div class="nav"', 'div role="navigation"',
    'div class="breadcrumb"', 'ul class="menu"',
)
_FOOTS = ("footer", 'div id="footer"', 'div class="footer"', 'footer class="legal"', 'p class="copyright"', 'div role="contentinfo" class="footer"')


def _wrapped(tag: str, body: str) -> str:
    return f"<{tag}>{body}</{tag.split()[0]}>"


class _Maker:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.pick = self.rnd.choice
        self.bare = False

    def chance(self, share: float) -> bool:
        return self.rnd.random() < share

    def link(self, text: str) -> str:
        return f'<a href="/{self.rnd.randint(1, 99)}">{text}</a>'

    def prose(self, most: int = 6) -> str:
        said = [self.pick(_SENTENCES) for _ in range(self.rnd.randint(1, most))]
        if self.chance(0.3):
            said[0] = said[0].replace("the ", f"the {self.link('old')} ", 1)
        if self.bare or self.chance(0.1):  # verse, notes and the like end without a full stop
            said[-1] = said[-1].rstrip(".?") + self.pick(("", "", " |", " ***", ":"))
        return " ".join(said)

    def block(self) -> str:
        """One block of an article, marked as content."""
        kind = self.rnd.random()
        if kind < 0.03:  # signs that feet of pages begin with, too
            return f"<p>§{self.pick(('©', '&copy;', '®', '™'))} {self.pick(('', '2020 ', '1999: '))}{self.prose(3)}</p>"
        if kind < 0.62:
            return f"<p>§{self.prose()}</p>"
        if kind < 0.70:
            return _wrapped(f"h{self.pick('23')}", "§" + self.pick(("On foot", "Two towns", "What it costs", "A letter")))
        if kind < 0.78:
            tag = self.pick(("ul", "ol"))
            items = [self.pick((
                self.prose(1), self.prose(2), self.link(self.pick(_SENTENCES)), self.link("the plan") + " of the council", "First",
            )) for _ in range(self.rnd.randint(2, 5))]
            return f"<{tag}>" + "".join(f"<li>§{x}</li>" for x in items) + f"</{tag}>"
        if kind < 0.83:
            return f"<p>§{self.link(self.pick(_SENTENCES))}</p>"
        if kind < 0.87:
            return f"<blockquote><p>§{self.prose(2)}</p></blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>§{a}</td><td>§{b}</td></tr>" for a, b in (("Length", "420 m"), ("Height", "35 m"))) + "</table>"
        if kind < 0.94:
            return f"<figure><figcaption>§{self.prose(1)}</figcaption></figure>"
        if kind < 0.97:
            return "<dl><dt>§Span</dt><dd>§The distance between two supports of a bridge.</dd></dl>"
        return "<pre>§x = 1</pre>"

    def links(self) -> str:
        words = [self.link(self.pick(_WORDS)) for _ in range(self.rnd.randint(2, 7))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in words) + "</ul>" if self.chance(0.6) else self.pick((" ", " | ", " / ")).join(words)

    def around(self) -> str:
        """A part that is no main text, whatever it holds."""
        if self.chance(0.2):
            replies = "".join(self.pick((
                f'<div class="comment"><p>{x}</p></div>', f"<li><p>{x}</p></li>", f"<p>{x}</p>",
            )) for x in self.rnd.sample(_REPLIES, 2))
            return _wrapped(self.pick(_COMMENTS), "<h3>2 comments</h3>" + replies + self.pick(("", "<form><label>Leave a reply</label></form>")))
        body = self.pick((
            f"<p>{self.pick(_PITCHES)}</p>", self.pick(_PITCHES),
            f"<p>{self.pick(_PITCHES)}</p><p>{self.pick(_PITCHES)} {self.pick(_PITCHES)}</p>", "<h3>Related</h3>" + self.links(),
            f"<h4>Popular</h4><p>{self.link(self.pick(_SENTENCES))}</p>", f"<p>{self.pick(_PITCHES)}</p><button>Accept</button>",
        ))
        return _wrapped(self.pick(_AROUND), body)

    def plain(self) -> str:
        """Main text with hardly any element around it, or none at all."""
        if self.chance(0.4):
            return "§" + self.prose()
        body = "".join(self.block() for _ in range(self.rnd.randint(1, 5)))
        if self.chance(0.5):
            body = _wrapped(self.pick(_CONTAINERS), body)
        return self.pick((body, f"<body>{body}</body>", f"<html><body>{body}</body></html>", f"<body>§{self.prose()}{body}</body>"))

    def page(self) -> str:
        self.bare = self.chance(0.2)
        if self.chance(0.05):
            return self.plain()
        title = _wrapped(f"h{self.pick('12')}", "§" + self.pick(("A new bridge", "Night rain", "The river", "On foot")))
        if self.chance(0.2):
            title = f"<header>{title}</header>"
        blocks = [title, *[self.block() for _ in range(self.rnd.randint(2, 9))]]
        if self.chance(0.15):
            blocks.insert(1, '<div class="byline">By A. Writer</div>')
        if self.chance(0.4):  # a part within the article
            blocks.insert(self.rnd.randint(1, len(blocks)), self.around())
        if self.chance(0.1):
            blocks.append('<div class="tags">' + self.links() + "</div>")
        main = "".join(blocks)
        for _ in range(self.rnd.randint(0, 2)):
            main = _wrapped(self.pick(_CONTAINERS), main)
        parts = [main]
        if self.chance(0.03):  # a page without main text
            parts = [self.around(), self.around()]
        for _ in range(self.rnd.randint(0, 3)):
            parts.insert(self.pick((0, len(parts))), self.around())
        if self.chance(0.3):
            parts = [_wrapped(self.pick(('div class="wrapper"', "div", 'div class="main"')), "".join(parts))]
        if self.chance(0.8):
            menu = self.pick(_MENUS)
            parts.insert(
                0,
                _wrapped(menu, self.links()) if not menu.startswith("ul") else f"<{menu}><li>{self.link('Home')}</li><li>{self.link('News')}</li></ul>",
            )
        if self.chance(0.5):
            brand = _wrapped(f"h{self.pick('123')}", self.link("The Daily")) + self.pick(("", _wrapped(self.pick(_MENUS[:5]), self.links())))
            parts.insert(
                0,
                _wrapped(
                    self.pick(_HEADS),
                    self.pick((
                        brand, brand, self.link("The Daily"), f"{self.link('The Daily')}<p>News since 1901.</p>",
                        f"<p>{self.pick(_PITCHES)}</p>", self.links(),
                    )),
                ),
            )
        if self.chance(0.85):
            foot = self.pick(_RIGHTS)
            parts.append(_wrapped(self.pick(_FOOTS), self.pick((foot, f"{self.links()} {foot}", f"{foot} {self.pick(_PITCHES)}"))))
        if self.chance(0.1):  # as a browser would mend it
            return "".join(parts)
        return f"<html><head><meta charset=utf-8><title>Bridge</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}</body></html>"


def made(n: int, seed: int) -> list[str]:
    """``n`` labelled pages."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


PAGES = made(1000, 20240611)
