"""Labelled pages for the extraction model, composed from sections whose role is known.

Every section is drawn with its usual elements and names, so that the model learns from markup,
names, text lengths and links, not from the words of any language. ``data-keep`` carries the label.
"""

from __future__ import annotations

import random

# Names that sites commonly give to the parts of a page, in classes, ids and roles.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc sitemap skip".split(),
    "head": "header masthead topbar banner logo branding site-header hero-bar toolbar".split(),
    "foot": "footer copyright colophon site-footer legal imprint bottom credits".split(),
    "side": "sidebar aside related widget rail recommended recommendations teaser more-stories popular trending tags read-more".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay newsletter subscribe signup paywall message warning disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adslot adsense commercial doubleclick ad-container".split(),
    "form": "form search login contact-form survey poll input feedback".split(),
    "reader": "comment comments commentlist disqus reply replies discussion respond responses reviews guestbook thread".split(),
    "share": "share social sharing follow buttons byline-tools print".split(),
    "content": "content article post entry main story text body page-content post-body entry-content article-body maintext prose".split(),
}
NEUTRAL = "wrap wrapper container row col col-8 inner block box section-1 x12 grid page site outer left right".split()


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiouäé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    return _words(r, low, high).capitalize() + r.choice(["."] * 8 + ["!", "?", ".”", ""])


def _paragraph(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    if r.random() < 0.25:
        text = text.replace(" ", ' <a href="/x">link word</a> ', 1)
    return r.choice(["{}"] * 5 + ["<b>{}</b>", "<em>{}</em> x", "{}<br>{}"]).replace("{}", text)


def _name(r: random.Random, role: str) -> str:
    name = r.choice(NAMES[role])
    name = r.choice([name, name, f"{name}-{r.choice(['box', 'area', 'wrap', 'list', '1'])}", f"{r.choice(['main', 'site', 'top', 'js'])}-{name}" if role != "side" else name])
    return r.choice([f' class="{name}"', f' class="{r.choice(NEUTRAL)} {name}"', f' id="{name}"', f' class="{name}" id="s{r.randint(1, 99)}"'])


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, 1, 4)}</a></li>' for i in range(n)) + "</ul>"


def _noise(r: random.Random, role: str) -> str:
    element = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(role)
    semantic = element is not None and r.random() < 0.6
    tag = element if semantic else r.choice(["div", "div", "section", "ul" if role == "menu" else "div"])
    attrs = "" if semantic and r.random() < 0.6 else _name(r, role)
    texts = {
        "menu": lambda: _links(r, r.randint(2, 9)) if tag != "ul" else _links(r, 4)[4:-5],
        "head": lambda: r.choice([f'<a href="/">{_words(r, 1, 3)}</a>', f"<div>{_words(r, 1, 5)}</div>", f"<p>{_sentence(r)}</p>" + _links(r, 3), f"<span>{_words(r, 2, 6)}</span>"]),
        "foot": lambda: r.choice([f"© {_words(r, 1, 3)} · {_paragraph(r)}", f"<p>© 2020 {_words(r, 1, 4)}</p>" + _links(r, 3), f"<p>{_paragraph(r)}</p>", f"&copy; {_words(r, 1, 3)}"]),
        "side": lambda: r.choice([f"<h3>{_words(r, 1, 3)}</h3>" + _links(r, r.randint(2, 6)), f"<p>{_paragraph(r)}</p>", f"<h2>{_words(r, 1, 4)}</h2><p>{_paragraph(r)}</p>", _paragraph(r)]),
        "notice": lambda: r.choice([f"<p>{_paragraph(r)}</p><button>{_words(r, 1, 2)}</button>", _paragraph(r), f"<p>{_paragraph(r)}</p>"]),
        "advert": lambda: r.choice([_paragraph(r), f"<p>{_paragraph(r)}</p>", f'<a href="/ad">{_words(r, 2, 8)}</a>', f"<h4>{_words(r, 1, 4)}</h4><p>{_paragraph(r)}</p>"]),
        "form": lambda: f"<label>{_words(r, 1, 3)}</label><input><textarea>{_words(r, 0, 3)}</textarea><button>{_words(r, 1, 2)}</button>" + r.choice(["", f"<p>{_sentence(r)}</p>"]),
        "reader": lambda: f"<h3>{_words(r, 1, 3)}</h3>" + "".join(r.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<div><b>nn</b><p>{}</p></div>", "<article{0}><p>{}</p></article>".replace("{0}", ' class="comment"')]).format(_paragraph(r)) for _ in range(r.randint(1, 5))),
        "share": lambda: r.choice([_links(r, 3), f'<a href="#">{_words(r, 1, 1)}</a> <a href="#">{_words(r, 1, 1)}</a>', f"<span>{_words(r, 1, 3)}</span>"]),
    }
    return f'<{tag}{attrs} data-keep="0">{texts[role]()}</{tag}>'


def _article(r: random.Random) -> str:
    blocks = [f"<h1>{_words(r, 2, 9)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([0, 1, 2, 3, 5, 9, 15])):
        blocks.append(r.choice([
            lambda: f"<p>{_paragraph(r)}</p>", lambda: f"<p>{_paragraph(r)}</p>", lambda: f"<p>{_paragraph(r)}</p>", lambda: f"<p>{_sentence(r, 1, 3)}</p>",
            lambda: f"<h{r.randint(2, 4)}>{_words(r, 1, 7)}</h2>".replace("/h2", "/h2"),
            lambda: "<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(3)) + "</ul>",
            lambda: "<ol>" + "".join(f"<li><p>{_paragraph(r)}</p></li>" for _ in range(2)) + "</ol>",
            lambda: f"<blockquote><p>{_paragraph(r)}</p></blockquote>", lambda: f"<pre>{_words(r, 3, 20)}</pre>",
            lambda: f"<table><tr><th>{_words(r, 1, 2)}</th><td>{_words(r, 1, 3)}</td></tr><tr><td>{_words(r, 1, 3)}</td><td>7</td></tr></table>",
            lambda: f"<figure><img src=x><figcaption>{_sentence(r)}</figcaption></figure>", lambda: f"<div>{_paragraph(r)}</div>", lambda: f"<section><h2>{_words(r, 1, 4)}</h2><p>{_paragraph(r)}</p></section>",
        ])())
    for role in ("advert", "share", "side", "notice", "reader", "menu", "form", "foot"):
        if r.random() < 0.12:
            blocks.insert(r.randint(len(blocks) // 2, len(blocks)) if role != "reader" else len(blocks), _noise(r, role))
    return "".join(blocks)


def labelled_page(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.4:
        main = f"<article data-keep=\"1\"{r.choice(['', _name(r, 'content')])}>{_article(r)}</article>"
    elif kind < 0.55:
        main = f'<main data-keep="1"{r.choice(["", _name(r, "content")])}>{_article(r)}</main>'
    elif kind < 0.65:
        main = f'<main><article data-keep="1">{_article(r)}</article>{_noise(r, "side")}</main>'
    elif kind < 0.9:
        main = f'<div{_name(r, "content")} data-keep="1">{_article(r)}</div>'
    else:
        main = f'<div class="{r.choice(NEUTRAL)}" data-keep="1"><h1>{_words(r, 2, 6)}</h1>' + "".join(f"<p>{_paragraph(r)}</p>" for _ in range(r.randint(3, 9))) + "</div>"
    before = "".join(_noise(r, role) for role in ("head", "menu", "notice", "advert", "form") if r.random() < 0.45)
    after = "".join(_noise(r, role) for role in ("share", "side", "reader", "form", "advert", "side", "foot", "notice") if r.random() < 0.4)
    inside = before + main + after
    if r.random() < 0.4:
        inside = f'<div class="{r.choice(NEUTRAL)}">{inside}</div>'
    return f"<html><head><title>t</title></head><body>{inside}</body></html>"


def labelled_pages(count: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(count)]
