"""Labelled training pages, written by a seeded generator.

Each page puts an article into a random frame of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, in several mark-up habits, with some tags left open. Every
block's label is known because the generator wrote it.
"""

from __future__ import annotations

import random

from leadmill.llm.html_blocks import Block, leaf_blocks

_SYLLABLES = "ba ce di fo gu la me ni or pa qu re si to un ver wa xe yo zu en er an th in on st al ou ie ß é ñ ö".split()
_MENU_WORDS = "Home News About Contact Products Login Shop Blog Archive Help Search Menu Sport Start Team".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _sentence(rng: random.Random, low: int = 1, high: int = 18) -> str:
    words = [_word(rng) for _ in range(rng.randint(low, high))]
    return rng.choice((words[0].capitalize(), words[0])) + "".join(f"{rng.choice((' ', ' ', ' ', ', ', ' | ', ' &amp; '))}{w}" for w in words[1:]) + rng.choice((".", ".", ".", "!", "?", "", " |"))


def _text(rng: random.Random) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))


def _name(rng: random.Random, names: tuple[str, ...]) -> str:
    name = rng.choice(names)
    return rng.choice((f' class="{name}"', f' id="{name}"', f' class="{_word(rng)} {name}"', f' class="{name}-{rng.choice(("box", "wrap", "inner", "list", "area"))}"', f" class='{name}'"))


def _links(rng: random.Random, n: int, item: str = "li") -> str:
    words = [rng.choice((rng.choice(_MENU_WORDS), _word(rng), _sentence(rng, 1, 3))) for _ in range(n)]
    links = [f'<a href="/{_word(rng)}">{w}</a>' for w in words]
    return "".join(f"<{item}>{x}</{item}>" for x in links) if item else rng.choice((" | ", " ", " &middot; ")).join(links)


def _menu(rng: random.Random) -> str:
    body = rng.choice((f"<ul>{_links(rng, rng.randint(3, 9))}</ul>", _links(rng, rng.randint(3, 8), ""), f"<ol>{_links(rng, rng.randint(2, 5))}</ol>"))
    return rng.choice((f"<nav>{body}</nav>", f"<nav{_name(rng, ('menu', 'nav', 'breadcrumb', 'pagination'))}>{body}</nav>", f"<div{_name(rng, ('menu', 'nav', 'navbar', 'navigation', 'breadcrumbs', 'pagination', 'topbar'))}>{body}</div>"))


def _header(rng: random.Random) -> str:
    body = rng.choice((f"<h1><a href='/'>{_sentence(rng, 1, 3)}</a></h1>", f"<p>{_sentence(rng, 1, 6)}</p>", f"<div>{_sentence(rng, 1, 5)}</div>", f"<h2>{_sentence(rng, 1, 3)}</h2><p>{_sentence(rng, 2, 8)}</p>")) + (_menu(rng) if rng.random() < 0.4 else "")
    return rng.choice((f"<header>{body}</header>", f"<header{_name(rng, ('site-header', 'header', 'masthead'))}>{body}</header>", f"<div{_name(rng, ('header', 'masthead', 'banner', 'site-title', 'branding'))}>{body}</div>"))


def _footer(rng: random.Random) -> str:
    body = rng.choice((f"&copy; {_word(rng)}.example.com &middot; {_text(rng)}", f"<p>&copy; {rng.randint(1999, 2030)} {_sentence(rng, 1, 4)} All rights reserved.</p>", f"<ul>{_links(rng, 4)}</ul>", _text(rng), f"<p>{_text(rng)}</p><p>{_sentence(rng)}</p>"))
    return rng.choice((f"<footer>{body}</footer>", f"<footer{_name(rng, ('footer', 'site-footer'))}>{body}</footer>", f"<div{_name(rng, ('footer', 'copyright', 'colophon', 'legal', 'bottom'))}>{body}</div>"))


def _aside(rng: random.Random) -> str:
    body = "".join(rng.choice((f"<h3>{_sentence(rng, 1, 4)}</h3>", f"<p>{_text(rng)}</p>", f"<ul>{_links(rng, rng.randint(2, 6))}</ul>", f"<div>{_sentence(rng)}</div>")) for _ in range(rng.randint(1, 4)))
    return rng.choice((f"<aside>{body}</aside>", f"<aside{_name(rng, ('sidebar', 'related', 'widget'))}>{body}</aside>", f"<div{_name(rng, ('sidebar', 'widget', 'related', 'recommended', 'popular', 'share', 'social', 'tags', 'promo', 'author-bio', 'rail'))}>{body}</div>"))


def _notice(rng: random.Random) -> str:
    body = rng.choice((_text(rng), f"<p>{_text(rng)}</p>", f"<p>{_sentence(rng)} <a href='/p'>{_word(rng)}</a></p><button>{_word(rng)}</button>", f"<p>We use cookies. {_sentence(rng)}</p><button>Accept</button>"))
    return f"<{(tag := rng.choice(('div', 'div', 'section', 'aside', 'dialog')))}{_name(rng, ('cookie', 'cookies', 'consent', 'notice', 'alert', 'gdpr', 'banner', 'popup', 'modal', 'overlay', 'warning', 'paywall', 'message'))}>{body}</{tag}>"


def _advert(rng: random.Random) -> str:
    body = rng.choice((_text(rng), f"<p>{_text(rng)}</p>", f'<a href="/x">{_sentence(rng)}</a>', f"<h4>{_sentence(rng, 1, 4)}</h4><p>{_sentence(rng)}</p>"))
    return f"<{(tag := rng.choice(('div', 'div', 'section', 'aside', 'figure')))}{_name(rng, ('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'adsbox', 'banner'))}>{body}</{tag}>"


def _form(rng: random.Random) -> str:
    body = f"<label>{_sentence(rng, 1, 4)}</label><input name='q'><button>{_word(rng)}</button>" + rng.choice(("", f"<p>{_sentence(rng)}</p>", f"<select><option>{_word(rng)}</option></select>"))
    return rng.choice((f"<form>{body}</form>", f"<form{_name(rng, ('search', 'subscribe', 'newsletter', 'login', 'contact'))}>{body}</form>", f"<div{_name(rng, ('newsletter', 'subscribe', 'signup', 'search'))}><p>{_text(rng)}</p><form>{body}</form></div>"))


def _comments(rng: random.Random) -> str:
    one = lambda: rng.choice((f"<li><p>{_text(rng)}</p></li>", f"<div{_name(rng, ('comment', 'reply', 'response'))}><p>{_word(rng)}</p><p>{_text(rng)}</p></div>", f"<div>{_text(rng)}</div>", f"<article><p>{_text(rng)}</p></article>", f"<p>{_text(rng)}</p>"))
    body = rng.choice(("", f"<h3>{rng.randint(1, 9)} Comments</h3>", f"<h2>{_sentence(rng, 1, 3)}</h2>")) + "".join(one() for _ in range(rng.randint(1, 5)))
    return f"<{(tag := rng.choice(('section', 'div', 'div', 'ol', 'ul', 'aside')))}{_name(rng, ('comments', 'comment', 'commentlist', 'discussion', 'replies', 'disqus', 'responses', 'reactions'))}>{body}</{tag}>"


_EXTRAS = (_menu, _aside, _notice, _advert, _form, _comments)


def _article(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of mark-up with their labels."""
    heading = rng.choice(("h1", "h1", "h2"))
    out = [(f"<{heading}>{_sentence(rng, 1, 10)}</{heading}>", 1)] if rng.random() < 0.85 else []
    if rng.random() < 0.2:
        out = [(f"<header>{out[0][0]}</header>" if out else f"<header><h1>{_sentence(rng, 2, 9)}</h1></header>", 1)]
    for _ in range(rng.choice((1, 1, 2, 4, 8, 15))):
        bold = rng.choice(("", "", "<b>", "<i>"))
        out.append((rng.choice((f"<p>{_text(rng)}</p>", f"<p>{_text(rng)}", f"<p>{bold}{_text(rng)}<br>{_text(rng)}</p>", f"<p>{bold}{_text(rng)}<br>", f"<p>{_text(rng)} <a href='/y'>{_word(rng)}</a> {_sentence(rng)}</p>", f"<h2>{_sentence(rng, 1, 6)}</h2>", f"<h3>{_sentence(rng, 1, 6)}</h3>", f"<ul><li>{_sentence(rng)}</li><li>{_sentence(rng)}</li></ul>", f"<blockquote>{_text(rng)}</blockquote>", f"<pre>{_text(rng)}</pre>", f"<table><tr><td>{_sentence(rng, 1, 4)}</td><td>{_sentence(rng, 1, 4)}</td></tr></table>", f"<div>{_text(rng)}</div>", f"<figure><figcaption>{_sentence(rng)}</figcaption></figure>", f"<section><p>{_text(rng)}</p></section>")), 1))
    if rng.random() < 0.35:
        out.insert(rng.randint(1 if len(out) > 1 else 0, len(out)), (rng.choice(_EXTRAS)(rng), 0))
    return out


def page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as (mark-up, label) pieces; joined they are its source."""
    head = f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{_sentence(rng, 1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    out = [(head, 0)]
    for part in rng.sample((_menu, _header, _notice, _advert, _form, _aside), rng.randint(0, 4)):
        out.append((part(rng), 0))
    depth = rng.random() < 0.3
    opened, closed = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{_name(rng, ('content', 'article', 'post', 'entry', 'story', 'main', 'text', 'body'))}>", "</div>"), (f"<article{_name(rng, ('post', 'entry', 'article', 'story'))}>", "</article>"), (f"<section{_name(rng, ('content', 'article', 'main'))}>", "</section>")))
    if depth:
        opened, closed = f"<div{_name(rng, ('wrap', 'container', 'page', 'row', 'layout'))}>{opened}", f"{closed}</div>"
    out += [(opened, 0), *_article(rng), (closed, 0)]
    for part in rng.sample((_comments, _aside, _advert, _form, _menu, _notice), rng.randint(0, 4)):
        out.append((part(rng), 0))
    if rng.random() < 0.85:
        out.append((_footer(rng), 0))
    out.append((rng.choice(("</body></html>", "")), 0))
    return out


def labelled(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """n pages as blocks and labels. A block belongs to the piece in whose mark-up it ends."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        pieces = page(rng)
        labels: list[int] = []
        source = ""
        for mark_up, label in pieces:
            source += mark_up
            # A closed probe makes the number of blocks up to here plain.
            labels += [label] * (len(leaf_blocks(source)) - len(labels))
        blocks = leaf_blocks(source)
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out
