"""Labelled pages to learn from: made-up pages whose blocks are known to be article text or not."""

from __future__ import annotations

import random
from html import escape


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "er", "an", "in", "on", "st", "ou", "re", "é", "ch", "ü", "a", "e", "i", "o", "ti", "ng")) for _ in range(r.randint(1, 4)))


def _sentences(r: random.Random, words: int) -> str:
    out: list[str] = []
    while len(out) < words:
        part = [_word(r) for _ in range(min(words - len(out), r.randint(1, 18)))]
        style = r.random()
        part[0] = part[0].capitalize()
        part[-1] += "." if style < 0.93 else r.choice(("!", "?", ""))
        out += part
    text = " ".join(out)
    return text.upper() if r.random() < 0.03 else text.replace(" ", " | ") if r.random() < 0.03 else text


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """HTML, and the texts of the article's blocks in order. Every other text of the page is none of the article."""
    r = random.Random(seed)
    kept: list[str] = []

    odd = r.choice((None,) * 6 + (str.upper, lambda t: t.replace(" ", " | "), lambda t: t.replace(".", "").lower()))

    def body_text(tag: str, words: int) -> str:
        text = _sentences(r, words)
        text = odd(text) if odd else text
        kept.append(text)
        inner = escape(text, quote=False)
        if r.random() < 0.15:
            inner = f"<b>{inner}" + r.choice(("", "<br>", "</b>"))
        elif r.random() < 0.15:
            first, _, rest = inner.partition(" ")
            inner = f'<a href="/{_word(r)}">{first}</a> {rest}'.strip()
        return f"<{tag}>{inner}" + r.choice((f"</{tag}>", f"</{tag}>", f"</{tag}>", "" if tag in ("p", "li") else f"</{tag}>"))

    def links(n: int) -> str:
        items = [f'<a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.randint(1, 4)))}</a>' for _ in range(n)]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def plain(words: int, tag: str = "p") -> str:
        text = escape(_sentences(r, words))
        return text if r.random() < 0.4 else f"<{tag}>{text}</{tag}>"

    def name(*options: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(options)}{r.choice(("", "", "-1", " wide"))}"'

    def aside() -> str:
        kind = r.choice(("nav", "ad", "side", "notice", "form", "share", "related", "ad", "banner"))
        if kind == "nav":
            return f"<nav>{links(r.randint(3, 9))}</nav>" if r.random() < 0.6 else f"<div{name('menu', 'navbar', 'breadcrumbs', 'top-nav', 'pagination', 'toc')}>{links(r.randint(3, 9))}</div>"
        if kind == "ad":
            return f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'banner-ad', 'advertisement')}>{plain(r.randint(2, 40))}</div>"
        if kind == "side":
            inner = f"<h3>{escape(_sentences(r, 3))}</h3>" + r.choice((links(4), plain(r.randint(5, 40))))
            return f"<aside{r.choice(('', name('sidebar')))}>{inner}</aside>" if r.random() < 0.6 else f"<div{name('sidebar', 'side-bar', 'widget', 'rail')}>{inner}</div>"
        if kind == "notice":
            return f"<div{name('cookie', 'notice', 'consent', 'cookie-banner', 'alert', 'gdpr', 'popup', 'newsletter', 'subscribe', 'paywall')}>{plain(r.randint(4, 40))}{r.choice(('', '<button>Ok</button>'))}</div>"
        if kind == "form":
            return f'<form action="/{_word(r)}"><label>{_word(r)}</label><input name="q"><p>{_sentences(r, r.randint(1, 15))}</p><button>{_word(r)}</button></form>'
        if kind == "share":
            return f"<div{name('share', 'social', 'tags', 'byline-share', 'follow-us')}>{links(3)}</div>"
        if kind == "related":
            return f"<section{name('related', 'recommended', 'more-stories', 'read-more', 'popular')}><h2>{_sentences(r, 2)}</h2>{links(4)}</section>"
        return f"<div{name('banner', 'skyscraper-ad', 'breaking-banner')}>{plain(r.randint(3, 20))}</div>"

    def comments() -> str:
        items = "".join(r.choice((f"<div{name('comment', 'reply', 'comment-body')}>{plain(r.randint(2, 60))}</div>", f"<li>{plain(r.randint(2, 60))}</li>", f"<article{name('comment', 'reply')}>{plain(r.randint(2, 60))}</article>")) for _ in range(r.randint(1, 5)))
        return f"<{(tag := r.choice(('div', 'section')))}{name('comments', 'discussion', 'comment-list', 'replies', 'disqus', 'reader-comments')}><h3>{_sentences(r, 2)}</h3>{items}</{tag}>"

    def content() -> str:
        parts = [body_text("h1", r.randint(2, 12))] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.72:
                parts.append(body_text("p", r.choice((1, 2, 3, 8, 12, 20, 40, 80, 120))))
            elif x < 0.80:
                parts.append(body_text(r.choice(("h2", "h3")), r.randint(1, 6)))
            elif x < 0.86:
                parts.append("<ul>" + "".join(body_text("li", r.randint(1, 20)) for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.89:
                parts.append("<blockquote>" + body_text("p", r.randint(5, 40)) + "</blockquote>")
            elif x < 0.91:
                parts.append("<table><tr>" + "".join(body_text("td", r.randint(1, 4)) for _ in range(3)) + "</tr></table>")
            elif x < 0.92:
                parts.append(body_text("pre", r.randint(3, 20)))
            else:
                parts.append(r.choice((aside, comments))())
        return "".join(parts)

    def main() -> str:
        x = r.random()
        if x < 0.6:
            return f"<article{r.choice(('', '', name('post', 'story')))}>{content()}</article>"
        if x < 0.7:
            return f"<main>{content()}</main>"
        if x < 0.8:
            return f"<main><article>{content()}</article></main>"
        return f"<div{name('content', 'post', 'entry', 'article-body', 'story', 'main-content', 'text', 'post-content')}>{content()}</div>"

    before = [aside() for _ in range(r.randint(0, 3))]
    if r.random() < 0.4:
        before.insert(0, r.choice((f"<header><h1>{_sentences(r, 2)}</h1>{links(3)}</header>", f"<div{name('header', 'masthead', 'top', 'logo')}>{plain(3)}</div>", f"<header><p>{_sentences(r, 5)}</p></header>")))
    middle = main()
    after = ([comments()] if r.random() < 0.35 else []) + [aside() for _ in range(r.randint(0, 3))]
    if r.random() < 0.8:
        text = escape(_sentences(r, r.randint(1, 25)))
        after.append(r.choice((f"<footer>&copy; {_word(r)}.example &middot; {text}</footer>", f"<footer><p>{text}</p>{links(3)}</footer>", f"<div{name('footer', 'copyright', 'legal', 'site-footer')}>{text}</div>")))
    x = r.random()
    inner = "".join([*before, middle, *after])
    if x < 0.15:
        inner = "".join([*before, f"<div{name('wrap', 'container', 'page', 'row')}>{middle}{''.join(after[:1])}</div>", *after[1:]])
    elif x < 0.3:
        inner = f"<div{name('wrap', 'container', 'page', 'layout')}>{inner}</div>"
    head = f'<head><meta charset="utf-8"><title>{_sentences(r, 4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    return f"<!DOCTYPE html><html>{head}<body>{inner}" + r.choice(("", "</body></html>")), [" ".join(k.split()) for k in kept]
