"""Main text of HTML pages by two passes over its blocks.

A page is cut into blocks at block-level tags.  What stands in navigation, forms, scripts and the
like, or in elements whose class, id or role says so, is left out by its place.  The first pass
decides every other block by the share of its characters in links, its length and the share of
stop words; blocks that are short, or whose words say little, stay open.  The second pass gives an
open block the label of its nearest decided neighbours, in the same article where there is one; text
without links is never decided against by its words alone.  So pages without an article element, or
without telling names, go by words, lengths and links.

Reading a page takes time in proportion to its length, whatever stands in it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Frequent words of the languages that pages are in.
STOP_WORDS = frozenset(
    # English
    "the of and to in is that for it with as was on be by this are at from or an have not but had his they she he which you we were been has their will would there what if can all her my one so no said who when them some out up into about than then its a i"
    # German
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich"
    # French
    " de la le et les des en un du une que est pour qui dans au par avec sur pas plus il ce ne se aux sont mais ou ses elle on comme nous vous leur son cette je tout être a été fait deux si sans même ces d l"
    # Spanish
    " de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está"
    .split()
)
#: Elements by what they do.
RAW = frozenset("script style noscript template svg iframe object textarea select title math".split())
OUTSIDE = frozenset("head nav footer aside form button dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark other things than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar topbar masthead copyright complementary contentinfo search alert rail sidenav leftbar rightbar".split()
)
MARK_STARTS = ("advert", "banner", "breadcrumb", "comment", "cookie", "disqus", "footer", "newsletter", "pagination", "popup", "sidebar", "social", "sponsor")
HEADS = frozenset("header banner masthead".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Rules:
    """Lengths are in characters, densities are shares."""

    link_density: float = 0.33
    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.25


@dataclass
class Block:
    article: int  # which article or main element, 0 for none
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""


@dataclass
class _Open:
    name: str
    outside: bool
    article: int


def _marked(attributes: str, article: int) -> bool:
    for found in ATTRIBUTE.findall(attributes):
        names = [name.lower() for name in NAME.findall("".join(found))]
        for before, name in zip([""] + names, names, strict=False):
            marked = name in MARKS or name.startswith(MARK_STARTS) or name == "header" and not article
            if marked and before not in ("with", "has", "no") and not (article and name in HEADS):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of text, in page order, that their place does not rule out."""
    out, stack = [], [_Open("", False, 0)]
    block, articles, link, at = Block(0), 0, 0, 0
    names: dict[str, int] = {}  # how many of the open elements have a name
    last = page.rfind(">") + 1  # no tag ends after it

    def text(piece: str) -> None:
        if piece and not stack[-1].outside:
            block.parts.append(piece)
            if link:
                block.linked += len(" ".join(html.unescape(piece).split()))

    def finish() -> None:
        nonlocal block
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
        block = Block(stack[-1].article)

    def close(depth: int) -> None:
        for gone in stack[depth:]:
            names[gone.name] -= 1
        del stack[depth:]

    while found := TOKEN.search(page, at, last):
        text(page[at : found.start()])
        at = found.end()
        if found[0].startswith("<!--") and not found[0].endswith("-->"):
            at = len(page)
            break
        name = (found[2] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1]), found[3] or ""
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            link = not closing
        elif name == "br":
            text(" ")
        elif name in BLOCKS:
            if closing:
                finish()
                if names.get(name):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            else:
                finish()
                if stack[-1].name == "p":
                    close(len(stack) - 1)
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
                    close(len(stack) - 1)
                if name not in VOID:
                    above, own = stack[-1], name in ("article", "main")
                    articles += own
                    article = articles if own else above.article
                    outside = False if own else above.outside or name in OUTSIDE or (name == "header" and not article)
                    if name not in ("html", "body", "article", "main") and attributes and not outside:
                        outside = _marked(attributes, article)
                    stack.append(_Open(name, outside, article))
                    names[name] = names.get(name, 0) + 1
            block.article, block.heading = stack[-1].article, not closing and name in HEADINGS
            link = 0
    rest = page[at:]
    text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    finish()
    return out


def first_pass(block: Block, rules: Rules) -> str:
    """good, bad or open."""
    size = len(block.text)
    if block.linked / size > rules.link_density:
        return "bad"
    if not block.article and ("©" in block.text or "\xa9" in block.text):
        return "bad"
    if size < rules.short:
        return "bad" if block.linked and not block.article else "open"
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= rules.stop_high or block.article and density >= rules.stop_low:
        return "good"
    if size >= rules.long and density >= rules.stop_low and not block.linked:
        return "good"
    return "bad" if block.linked and density < rules.stop_low and not block.article else "open"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of the nearest decided block, headings that of the next one.

    Of two as near, good wins, but for blocks with links outside articles.
    """
    n, out = len(found), [label == "good" for label in labels]
    before, last = [None] * n, None
    after, following = [None] * n, None
    for i in range(n):
        if labels[i] != "open":
            last = i
        before[i] = last
    for i in range(n - 1, -1, -1):
        if labels[i] != "open":
            following = i
        after[i] = following
    for i in range(n):
        if labels[i] != "open":
            continue
        inside = found[i].article
        near = [(abs(i - j), labels[j] == "good") for j in (before[i], after[i]) if j is not None and (not inside or found[j].article == inside)]
        if not near:
            out[i] = bool(inside)
            continue
        if found[i].heading and after[i] is not None and found[after[i]].article == inside:
            out[i] = labels[after[i]] == "good"
            continue
        least = min(d for d, _ in near)
        said = {good for d, good in near if d == least}
        out[i] = said == {True} or len(said) == 2 and (bool(inside) or not found[i].linked)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The article's blocks joined by line feeds; empty for null, empty and text-free pages."""
    found = blocks(page or "")
    labels = [first_pass(b, rules) for b in found]
    if "good" not in labels:  # perhaps a language without stop words here
        labels = ["good" if label == "open" and len(b.text) >= rules.short else label for b, label in zip(found, labels, strict=True)]
    kept = second_pass(found, labels)
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extracted(page: Column, rules: Rules = Rules()) -> Column:
    """main_text of each whole page.

    Null, empty and text-free pages have the empty text; very long ones are read whole; repeated rows have equal
    results.  Only this column is read, so other columns may have any names.
    """

    @F.arrow_udf(T.StringType())
    def run(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p.as_py(), rules) for p in pages), type=pa.string())

    return run(page)
