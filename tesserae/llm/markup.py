"""HTML as leaf blocks: the text between two boundaries of block elements, with the path of elements around it.

A forgiving reader in one pass: elements that were never closed end with what closes them, stray end tags count nothing,
an unclosed comment, script or style ends with the page. Elements that show no text are skipped, to their end tag if any.
"""

from __future__ import annotations

import html
import re
import zlib

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that end a block where they begin and end (fixed values of the HTML standard, and the parts of forms).
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in "script style title noscript template iframe object svg math canvas audio video textarea noembed noframes xmp".split()}
FOREIGN = ("svg", "math")
#: What a start tag closes, and what shields from it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: An open paragraph ends at any block but not beyond these; other start and end tags look no further than so many open elements.
SHIELDS, REACH = frozenset("td th caption button object table body html div section article aside main".split()), 256
ROWS = 4096


def token(name: str) -> int:
    """Row of a path token in the table of vectors."""
    return zlib.crc32(name.encode()) % ROWS


class Paths:
    """Paths by number: each has a parent and the tokens that its last element adds; equal paths share a number."""

    def __init__(self):
        self.number, self.parent, self.added, self.have, self.name = {}, [0], [()], [0], [""]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes)
        at = self.number.get(key)
        if at is None:
            words = {"t:" + tag}
            for name, *value in ATTRIBUTE.findall(attributes) if attributes else ():
                if name.lower() != "data-main":
                    words |= {"c:" + w.lower() for w in PART.findall("".join(value))}
            have, added = self.have[parent], []
            for k in sorted(map(token, words)):
                if not have >> k & 1:
                    have |= 1 << k
                    added.append(k)
            at = self.number[key] = len(self.parent)
            self.parent.append(parent), self.added.append(tuple(added)), self.have.append(have), self.name.append(tag)
        return at


def blocks(page: str, paths: Paths) -> list[tuple[str, int, int, bool]]:
    """(text, path, characters within links, mark) of each block that has text, in page order.

    White space (as ``str.split`` sees it, references decoded) is one blank; ``br`` is white space. ``mark`` is the nearest
    ``data-main`` of the path, of use where pages are made to learn from.
    """
    out, pieces, linked, endless = [], [], 0, set()
    stack, links = [("", 0, False)], 0  # open elements: name, path, mark; how many of them are links
    end = 0

    def close(n: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[n:])
        del stack[n:]

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.append((text, stack[-1][1], linked, stack[-1][2]))
            pieces.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        pieces.append(piece)
        if links:
            linked += len(piece)

    find = TAG.search
    while m := find(page, end):
        if m.start() > end:
            add(page[end : m.start()])
        end = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3].strip()
        if m[1]:
            if tag in BLOCK:
                flush()
            for n in range(len(stack) - 1, max(0, len(stack) - REACH), -1):
                if stack[n][0] == tag:
                    close(n)
                    break
            continue
        if tag in SKIPPED:
            pieces.append(" ")
            if tag in endless or attributes.endswith("/") and tag in FOREIGN:
                continue
            if skipped := SKIPPED[tag].search(page, end):
                end = skipped.end()
            elif tag in ("script", "style"):
                end = len(page)
            else:
                endless.add(tag)
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            ends, shields = CLOSES.get(tag, (("p",), SHIELDS))
            for n in range(len(stack) - 1, max(0, len(stack) - REACH), -1):
                if stack[n][0] in ends:
                    close(n)
                    break
                if stack[n][0] in shields:
                    break
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        _, path, mark = stack[-1]
        if tag in BLOCK:
            path = paths.child(path, tag, attributes)
            if "data-main" in attributes and (given := ATTRIBUTE.search(attributes[attributes.index("data-main") :])):
                mark = "1" in given.groups()
        stack.append((tag, path, mark))
    if end < len(page):
        add(page[end:])
    flush()
    return out
