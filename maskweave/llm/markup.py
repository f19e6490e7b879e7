"""Web pages as tags and blocks of text, in one pass forward over the page, whatever it holds.

Tags are read by the rules of HTML: quotes count only where an attribute's value begins, a tag that the page's end cuts
off is dropped, scripts and the like go on to their end tag. Elements without a text of their own (frames, players,
drawings, forms' controls) are left out with all they hold if they are closed; one that is not closed holds nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import xxhash

# The forms of names, of the rest of a tag, and of comments.
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)""")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements by what they do to text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
TO_THE_END = frozenset("script style".split())
LEFT_OUT = frozenset("template noscript object svg math canvas select option button audio video".split())
NESTED = frozenset("object svg math template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
ENDS_P = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS, SCOPES = frozenset("ul ol dl table".split()), frozenset("article body td div section".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer masthead menu modal nav navbar"
    " navigation newsletter notice notices pagination popup promo promoted recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Names of readers' comments, or of parts of an article.
TALK_NAMES = frozenset("discussion discussions replies responses".split())
#: Words that say nothing of what an element holds.
PLAIN_NAMES = frozenset(
    "area bar block body bottom box button buttons container content form group header inner item items large left link links list main outer posts primary right row secondary section slot small text title top unit"
    " wide wrapper wrap".split()
)

Token = tuple[str, str, str]


def tokens(page: str) -> Iterator[Token]:
    """(kind, name, attributes or text): kind is "text", "start", "end" or "closed" (an element that is closed at once)."""
    at, n, endless = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", "", page[at : lt if lt >= 0 else n]
        if lt < 0:
            return
        c = page[lt + 1 : lt + 2]
        end = c == "/"
        name = NAME.match(page, lt + 1 + end)
        if name:
            rest = REST.match(page, name.end())
            at = rest.end()
            if page[at - 1] != ">":
                return
            low, attributes = name[0].lower(), page[name.end() : at - 1]
            if not end and low in RAW and low not in endless:
                close = re.compile(rf"</{re.escape(low)}(?=[\s/>])", re.I).search(page, at)
                if close:
                    at = REST.match(page, close.end()).end()
                    continue
                if low in TO_THE_END:
                    return
                endless.add(low)
            yield "end" if end else "closed" if attributes.endswith("/") else "start", low, attributes
        elif page.startswith("<!--", lt):
            at = COMMENT.match(page, lt).end()
        elif c and c in "!?/":
            gt = page.find(">", lt)
            at = gt + 1 if gt >= 0 else n
        else:
            yield "text", "", "<"
            at = lt + 1


def left_out(read: list[Token]) -> dict[int, int]:
    """For each start of a closed element that is left out, the place of its end."""
    opened: dict[str, list[int]] = defaultdict(list)
    until: dict[int, int] = {}
    for i, (kind, name, _) in enumerate(read):
        if name in LEFT_OUT:
            if kind == "start":
                if name not in NESTED:
                    opened[name].clear()
                opened[name].append(i)
            elif kind == "end" and opened[name]:
                until[opened[name].pop()] = i
    return until


def aside_name(attributes: str) -> tuple[bool, bool, bool]:
    """Of an element's names: whether some word is one of ASIDE_NAMES; whether one's head is; whether one's head is one of TALK_NAMES.

    A name's head is its last word that isn't plain: a cookie-notice-box is a notice, a cookie-recipe a recipe.
    """
    some = whole = talk = False
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", name) if w and w not in PLAIN_NAMES and w.isalpha()]
                some = some or not ASIDE_NAMES.isdisjoint(words)
                whole = whole or bool(words) and words[-1] in ASIDE_NAMES
                talk = talk or bool(words) and words[-1] in TALK_NAMES
    return some, whole, talk


def _segment(name: str, attributes: str) -> str:
    m = NAMES.search(attributes) if "=" in attributes else None
    return f"{name}.{m[1] or m[2] or m[3] or ''}" if m else name


def _hash(path: int, part: str) -> int:
    """A token of 64 bits with a sign: the path above it and what it adds."""
    return xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), seed=path & ((1 << 64) - 1)) - (1 << 63)


def blocks(page: str, known: frozenset[int] = frozenset()) -> tuple[list[int], list[tuple[int, str, bool, bool]]]:
    """The tokens in page order, and the blocks of text: (token, text, in an article, aside from the main text).

    A token is a hash of a tag or block of text with the path of tags above it; a path is carried as one hash, however
    deep it is. Inline tags stay within a block, all others end it. References are decoded, white space becomes one space.
    Inside an article an element whose name says less than clearly that it is aside is so only if ``known``, the host's
    template, has it; so are those outside of articles whose names have an aside's word, but not as their head.
    """
    read = list(tokens(page))
    until = left_out(read)
    out_tokens: list[int] = []
    out: list[tuple[int, str, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, path, main, aside
    opened: Counter[str] = Counter()
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, path, main, aside = stack[-1]
            token = _hash(path, " " + text)
            out.append((token, text, main, aside))
            out_tokens.append(token)

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                opened.subtract(s[0] for s in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    i = -1
    while (i := i + 1) < len(read):
        kind, name, rest = read[i]
        if kind == "text":
            held.append(rest)
        elif name in LEFT_OUT or name in RAW:
            i = until.get(i, i)
        elif name in INLINE:
            if name == "br":
                held.append(" ")
        elif kind == "end":
            flush()
            close((name,), frozenset())
        else:
            flush()
            if name in ENDS_P:
                close(("p",), SCOPES)
            if name in CLOSES:
                close(CLOSES[name], LISTS)
            _, path, main, aside = stack[-1]
            path = _hash(path, "/" + _segment(name, rest))
            out_tokens.append(path)
            if name in VOID:
                continue
            if not aside and name not in ("html", "body", "main") and (name != "article" or main):
                some, whole, talk = aside_name(rest)
                aside = whole or (talk and not main) or ((some or talk) and path in known)
            aside = aside or name in ASIDE or (name == "header" and not main)
            main = main or name in MAIN
            if kind == "start":
                stack.append((name, path, main, aside))
                opened[name] += 1
    flush()
    return out_tokens, out
