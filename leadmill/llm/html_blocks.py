"""Leaf blocks of a page: stretches of text between block-level tags, with their open elements.

Tag soup is read as it comes: an unclosed paragraph ends at the next block, an end tag with no
open element is ignored, a page may stop anywhere. Scripts, styles, comments and other elements
without text of their own are dropped with all they hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|object|noscript|math|canvas|textarea|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)",
    re.S | re.I,
)
_UNQUOTED = re.compile(_TOKEN.pattern.replace(r"""((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)""", "([^>]*)"), re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z]")
_REST = re.compile(r"()()()()((?:[^<]|<(?![!?]|(?:script|style|template|svg|iframe|object|noscript|math|canvas|textarea|select)\b))*)", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
_PART = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset(("hr",))
_PARAGRAPH = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "body": ("head", "title")}
_HOLDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot")}


class Block(NamedTuple):
    path: tuple[str, ...]  # open elements from the outside in: "tag" or "tag word word"
    text: str  # character references decoded, white space single, trimmed
    linked: int  # characters of it inside links


def _element(tag: str, attributes: str) -> str:
    if not attributes.strip():
        return tag
    words = [w for found in _NAMES.findall(attributes) for w in _PART.findall("".join(found).lower())]
    if _HIDDEN.search(attributes):
        words.append("hidden")
    return " ".join((tag, *dict.fromkeys(words)))


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens in one pass: what follows the last ">" is no tag (a comment or script begun there is dropped), and once a quote never closes,
    tags are read without quotes, so no stretch is scanned again and again."""
    at, pattern, last = 0, _TOKEN, page.rfind(">")
    while at < len(page):
        if at > last:
            yield _REST.match(page, at)
            return
        token = pattern.match(page, at)
        if pattern is _TOKEN and token.group(5) == "<" and _TAG.match(page, at):
            pattern = _UNQUOTED
            continue
        yield token
        at = token.end()


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks that hold text, in page order."""
    blocks: list[Block] = []
    stack: list[str] = []
    tags: list[str] = []
    held: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(tuple(stack), text, linked))
            held.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        del stack[depth:], tags[depth:]

    for token in _tokens(page or ""):
        text = token.group(5)
        if text is not None:
            held.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not token.group(2)
        elif tag == "br":
            held.append("\n")
        elif tag in BLOCKS:
            close()
            in_link = False
            if token.group(2):
                for depth in range(len(tags) - 1, -1, -1):
                    if tags[depth] == tag:
                        pop_to(depth)
                        break
                continue
            if tags and tags[-1] in _PARAGRAPH:
                pop_to(len(tags) - 1)
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] in _HOLDS.get(tag, ()):
                    break
                if tags[depth] in _ENDS.get(tag, ()):
                    pop_to(depth)
            if tag not in _VOID:
                tags.append(tag)
                stack.append(_element(tag, token.group(4)))
    close()
    return blocks
