"""Synthetic pages with known main texts, and the fit of the block classifier's weights on them.

A page has an article (in an article or main element, a named or an unnamed container, or in none) of a heading,
paragraphs of one to eighty words, some with links, and now and then a list, a quotation, a table or subheadings; around
and inside it stand menus, headers, footers, sidebars, notices, adverts, related links, forms, reader comments and hidden
texts, in elements that say so, in named containers, or, one time in five, in containers that say nothing.  A block's
label is where its text comes from.
"""

from __future__ import annotations

import random

import numpy as np

from .pages import FEATURES, features, read
from .toxicity import logistic

_CONTENT = (("article", ""), ("main", ""), ("div", "post-content"), ("div", "entry-content"), ("div", "article"), ("section", "story"))
_BOILER = {
    "menu": (("nav", ""), ("div", "menu"), ("ul", "navbar"), ("div", "topbar")), "header": (("header", ""), ("div", "header"), ("div", "masthead")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "copyright")), "side": (("aside", ""), ("div", "sidebar"), ("div", "widget")),
    "notice": (("div", "cookie-notice"), ("div", "banner"), ("dialog", "")), "ad": (("div", "ad"), ("div", "sponsored"), ("div", "promo")),
    "related": (("aside", ""), ("div", "related"), ("ul", "recommended")), "form": (("form", ""), ("div", "newsletter"), ("div", "search")),
    "comments": (("section", "comments"), ("div", "comment-list"), ("ol", "replies")), "share": (("div", "social"), ("div", "share"), ("ul", "breadcrumbs")),
}


def synthetic_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    main: set[str] = set()

    def words(low: int, high: int, closed: float) -> str:
        w = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        w = [x + "," if rng.random() < 0.05 * closed else x for x in w]
        return (" ".join(w) + ("." if rng.random() < closed else "")).capitalize()

    def own(low: int, high: int, closed: float) -> str:
        text = words(low, high, closed)
        main.add(text)
        return text

    def box(inside: str, choices) -> str:
        tag, name = rng.choice(choices)
        if rng.random() < 1 / 5:
            tag, name = "div", f"c{rng.randint(1, 99)}"
        at = rng.choice(("class", "id"))
        return f'<{tag} {at}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{words(1, 6, 0.2)}</li>" if rng.random() < 0.25 else f"<li><a href=x>{words(1, 4, 0)}</a></li>" for _ in range(n)) + "</ul>"

    def linked(text: str) -> str:
        """Some of the words in a link."""
        w = text.split(" ")
        k = rng.randint(1, max(1, len(w) // 2))
        return f"<a href=x>{' '.join(w[:k])}</a> {' '.join(w[k:])}"

    def boiler(kind: str) -> str:
        if kind in ("menu", "related", "share"):
            inside = links(rng.randint(2, 9)) if rng.random() < 0.8 else "".join(f"<a href=x>{words(1, 3, 0)}</a> " for _ in range(4))
        elif kind == "form":
            inside = f"<label>{words(1, 4, 0)}</label><input><p>{words(3, 14, 0.7)}</p><button>go</button>"
        elif kind == "comments":
            inside = f"<h3>{words(1, 3, 0)}</h3>" + "".join(f"<p>{words(3, 35, 0.9)}</p>" for _ in range(rng.randint(1, 4)))
        elif kind in ("ad", "notice"):
            inside = rng.choice(("<p>{}</p>", "{}", "<b>{}</b>")).format(words(3, 18, 0.8))
        elif kind == "side":
            inside = f"<h4>{words(1, 3, 0)}</h4>" + rng.choice((links(4), f"<p>{words(6, 30, 0.8)}</p>"))
        elif kind == "hidden":
            how = rng.choice(('hidden', 'aria-hidden="true"', 'style="display:none"'))
            return f"<div {how}><p>{words(3, 40, 0.9)}</p></div>"
        else:
            inside = rng.choice((f"<p>{words(2, 16, 0.5)}</p>", words(2, 12, 0.5), links(3), f"<h1>{words(1, 3, 0)}</h1>"))
        return box(inside, _BOILER[kind])

    def article() -> str:
        out = [f"<h1>{own(2, 12, 0.1)}</h1>"]
        for _ in range(rng.randint(2, 9)):
            roll = rng.random()
            if roll < 0.08:
                out.append(f"<h2>{own(1, 8, 0)}</h2>")
            elif roll < 0.14:
                out.append("<ul>" + "".join(f"<li>{own(2, 20, 0.6)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.18:
                out.append(f"<blockquote>{own(5, 40, 0.9)}</blockquote>")
            elif roll < 0.2:
                out.append("<table><tr>" + "".join(f"<td>{own(1, 5, 0)}</td>" for _ in range(3)) + "</tr></table>")
            elif roll < 0.24:
                out.append(boiler(rng.choice(("ad", "related", "share", "hidden"))))
            else:
                text = own(1, 8, 0.8) if rng.random() < 0.2 else own(8, 80, 0.97)
                tag = "p" if rng.random() < 0.75 else "div"
                out.append(f"<{tag}>{linked(text) if rng.random() < 0.2 else text}</{tag}>")
        return "".join(out)

    before = [boiler(k) for k in ("notice", "header", "menu", "share", "ad") if rng.random() < 0.6]
    after = [boiler(k) for k in ("side", "related", "ad", "form", "comments", "footer") if rng.random() < 0.6]
    body = article()
    return "<html><body>" + "".join(before) + (box(body, _CONTENT) if rng.random() < 0.9 else body) + "".join(after) + "</body></html>", main


def synthetic_blocks(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of so many pages."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page, main = synthetic_page(rng)
        for b in read(page)[0]:
            x.append(features(b))
            y.append(b.text in main)
    return np.array(x), np.array(y, float)


def fit(pages: int = 1500, seed: int = 20) -> tuple[float, ...]:
    """Weights in the order of FEATURES."""
    x, y = synthetic_blocks(pages, seed)
    w, b = logistic(x[:, 1:], y, np.ones(len(y)), ridge=20.0)
    assert len(w) + 1 == len(FEATURES)
    return tuple(round(float(v), 2) for v in (b, *w))
