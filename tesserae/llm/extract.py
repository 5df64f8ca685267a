"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``markup.blocks``). A block's input is the sum of the vectors of its path's tokens
(elements, and the words of class, id and role), the mean of the vectors of its hashed words, and a few measures. A
bidirectional LSTM in numpy reads the whole sequence, so that every block is classified by what stands before and after it
in the page. Blocks of the main text are joined in page order.

Learning: at most SAMPLE pages of at most PAGE_CHARS (a hash of the id chooses them) teach themselves. Their own semantic
elements give the labels (``article`` or ``main``, less what is a menu, form, footer and so on in it); besides, each page's
blocks are set into made layouts: other names for the same parts, with menus, sidebars, notices, adverts, forms and
comments that hold text of other pages. So structure and context decide, not the words of this corpus. All pages are
then labelled whole; pages of equal length run together, in batches of bounded size, and a very long page alone.

Nulls: null html is an empty text; a null id or url stays null. Repeated rows give equal rows. Without any page to
learn from, the layouts are filled with phrases. White space is what ``str.split`` takes for it, references decoded.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, slices
from .markup import ROWS, Paths, blocks

#: Bounds of what is learned from: pages, characters of a page, blocks of a sequence, made layouts for each page.
SAMPLE, PAGE_CHARS, LEARN_BLOCKS, LAYOUTS = 256, 1 << 16, 256, 3
PATH, WORD, UNITS, EPOCHS, BATCH, RATE = 24, 12, 24, 20, 32, 0.015
#: Blocks of a batch of pages while labelling.
AT_ONCE = 16_384
MEASURES = 8
_powers = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)
_space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words of the texts of blocks, and where each text's words begin; such a text begins with a word."""
    data = np.frombuffer("\n".join(texts).lower().encode() + b"\n", np.uint8)
    space = _space[data]
    start = np.flatnonzero(np.diff(np.concatenate([[1], space.astype(np.int8)])) == -1)
    begin = np.zeros(len(data), np.int64)
    begin[start] = start
    inside = np.minimum(np.arange(len(data)) - np.maximum.accumulate(begin), 63)
    hashed = np.add.reduceat(np.where(space, 0, data * _powers[inside]), start, dtype=np.uint32)
    line = np.cumsum(data == 10)[start]
    return ((hashed ^ hashed >> np.uint32(15)) % ROWS).astype(np.int64), np.searchsorted(line, np.arange(len(texts)))


def measures(found: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Length, words, share within links, marks, digits, an end as of a sentence, and the place in the page of each block."""
    out, n = np.empty((len(found), MEASURES), np.float32), len(found)
    for i, (text, _, linked, _) in enumerate(found):
        size = len(text)
        words = text.count(" ") + 1
        digits = sum(map(text.count, "0123456789"))
        out[i] = np.log1p(size) / 5, np.log1p(words) / 4, min(1, linked / size), min(1, 4 * (text.count(",") + text.count(".")) / words), digits / size, text[-1] in ".!?…:;\"»”", i / n, 1 / (1 + i)
    return out


class Sequence:
    """A page as input: tokens of each block's path, words, measures; and (while learning) the wanted labels."""

    def __init__(self, page: str, most: int | None = None, wanted: bool = False, short: np.random.Generator | None = None):
        paths = Paths()
        found = blocks(page, paths)[:most]
        if short is not None:  # main text has short blocks too, few or many
            share = short.choice([0.2, 0.5, 1.0])
            found = [(" ".join(t.split()[: short.integers(1, 4)]), *rest) if rest[2] and short.random() < share else (t, *rest) for t, *rest in found]
        self.tokens = [_tokens(paths, path) for _, path, _, _ in found]
        self.words, self.begins = word_rows([b[0] for b in found]) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.measures = measures(found)
        if wanted:
            self.wanted = np.array([b[3] for b in found], np.float32)


def _tokens(paths: Paths, path: int) -> list[int]:
    out = []
    while path:
        out += paths.added[path]
        path = paths.parent[path]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Vectors of tokens and words, an LSTM in each direction, and a logistic output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        wide = PATH + WORD + MEASURES
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"path": np.zeros((ROWS, PATH), np.float32), "word": np.zeros((ROWS, WORD), np.float32), "out": draw(2 * UNITS + wide, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"in_{d}": draw(wide, 4 * UNITS), f"re_{d}": draw(UNITS, 4 * UNITS), f"b_{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), UNITS)}

    def lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction over (time, page, input); masked places have none. ``keep`` takes what learning needs."""
        w, u = self.w[f"re_{d}"], UNITS
        z_in = x @ self.w[f"in_{d}"] + self.w[f"b_{d}"]
        h = c = np.zeros((x.shape[1], u), np.float32)
        out = np.empty((*x.shape[:2], u), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ w
            gates, new = _sigmoid(z[:, : 3 * u]), np.tanh(z[:, 3 * u :])
            before, h_before = c, h
            c = (gates[:, u : 2 * u] * c + gates[:, :u] * new) * mask[t]
            squashed = np.tanh(c)
            h = gates[:, 2 * u :] * squashed * mask[t]
            out[t] = h
            if keep is not None:
                keep.append((t, gates, new, before, h_before, squashed))
        return out

    def backward(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        """Gradients of one direction by the chain rule back through time; returns that of ``x``."""
        w, u = self.w[f"re_{d}"], UNITS
        dz_all = np.empty((*x.shape[:2], 4 * u), np.float32)
        dh = dc = np.zeros((x.shape[1], u), np.float32)
        grad[f"re_{d}"] = np.zeros_like(w)
        for t, gates, new, before, h_before, squashed in reversed(kept):
            i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
            dh = (dh + dout[t]) * mask[t]
            dc = (dc + dh * o * (1 - squashed**2)) * mask[t]
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
            dz_all[t] = dz
            grad[f"re_{d}"] += h_before.T @ dz
            dh, dc = dz @ w.T, dc * f
        flat = dz_all.reshape(-1, 4 * u)
        grad[f"in_{d}"], grad[f"b_{d}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return dz_all @ self.w[f"in_{d}"].T

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.lstm(x, mask, "f"), self.lstm(x, mask, "b"), x], 2)
        return both @ self.w["out"] + self.w["bias"]

    def learn(self, pages: list[Sequence], epochs: int = EPOCHS, seed: int = 1) -> Labeller:
        """Adam over batches of pages; the weights are the mean of those in the last half of the epochs."""
        rng, step, taken = np.random.default_rng(seed), 0, 0
        pages = [p for p in pages if len(p.tokens)]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        mean = {k: np.zeros(v.shape) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[i].tokens) // 16 for i in order], kind="stable")]  # similar lengths together
            for at in rng.permutation(np.arange(0, len(order), BATCH)):
                grad, step = self.gradients([pages[i] for i in order[at : at + BATCH]])[1], step + 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first, second = moments[k]
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    self.w[k] -= (rate * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
                if 2 * epoch >= epochs:
                    taken += 1
                    for k, v in self.w.items():
                        mean[k] += (v - mean[k]) / taken
        if taken:
            self.w = {k: v.astype(np.float32) for k, v in mean.items()}
        return self

    def gradients(self, batch: list[Sequence]) -> tuple[float, dict]:
        """Mean log loss over the blocks of a batch, and its gradient by each weight."""
        long_, n = max(len(p.tokens) for p in batch), len(batch)
        mask, wanted = np.zeros((long_, n, 1), np.float32), np.zeros((long_, n), np.float32)
        x = np.zeros((long_, n, PATH + WORD + MEASURES), np.float32)
        row, tok, words, word_at, word_share = [], [], [], [], []
        for j, p in enumerate(batch):
            m = len(p.tokens)
            mask[:m, j], wanted[:m, j], x[:m, j, PATH + WORD :] = 1, p.wanted, p.measures
            at = np.arange(m) * n + j
            sizes = np.array([len(t) for t in p.tokens])
            row.append(np.repeat(at, sizes)), tok.append(np.concatenate(p.tokens).astype(np.int64))
            each = np.diff(np.append(p.begins, len(p.words)))
            words.append(p.words), word_at.append(np.repeat(at, each)), word_share.append(np.repeat(1 / each, each))
        row, tok, words, word_at = map(np.concatenate, (row, tok, words, word_at))
        share = np.concatenate(word_share).astype(np.float32)[:, None]
        flat = x.reshape(-1, x.shape[2])
        flat[:, :PATH] = _gathered(self.w["path"][tok], row, len(flat))
        flat[:, PATH : PATH + WORD] = _gathered(self.w["word"][words] * share, word_at, len(flat))
        kept = {"f": [], "b": []}
        both = np.concatenate([self.lstm(x, mask, "f", kept["f"]), self.lstm(x, mask, "b", kept["b"]), x], 2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        loss = -float((mask[..., 0] * np.log(np.where(wanted > 0, p, 1 - p) + 1e-9)).sum() / mask.sum())
        dlogit = (p - wanted) * mask[..., 0] / mask.sum()
        grad = {"out": np.einsum("tbk,tb->k", both, dlogit), "bias": dlogit.sum(keepdims=True)[0]}
        dboth = dlogit[..., None] * self.w["out"]
        dx = dboth[..., 2 * UNITS :].copy()
        for k, d in enumerate("fb"):
            dx += self.backward(x, mask, d, kept[d], dboth[..., k * UNITS : (k + 1) * UNITS], grad)
        dflat = dx.reshape(-1, x.shape[2])
        grad["path"] = _gathered(dflat[row, :PATH], tok, ROWS)
        grad["word"] = _gathered(dflat[word_at, PATH : PATH + WORD] * share, words, ROWS)
        return loss, grad

    def inputs(self, found: list[tuple[str, int, int, bool]], paths: Paths, known: list[np.ndarray]) -> np.ndarray:
        """Input rows of a page's blocks; ``known`` has the vectors of paths so far and grows with ``paths``."""
        for k in range(len(known), len(paths.parent)):
            known.append(known[paths.parent[k]] + self.w["path"][list(paths.added[k])].sum(0))
        x = np.empty((len(found), PATH + WORD + MEASURES), np.float32)
        x[:, :PATH] = [known[b[1]] for b in found]
        for at in range(0, len(found), 4096):  # word vectors of a very long page are not all in memory at once
            part = found[at : at + 4096]
            words, begins = word_rows([b[0] for b in part])
            x[at : at + 4096, PATH : PATH + WORD] = np.add.reduceat(self.w["word"][words], begins) / np.diff(np.append(begins, len(words)))[:, None]
        x[:, PATH + WORD :] = measures(found)
        return x

    def main_text(self, pages: list[str]) -> list[str]:
        """The main text of each page: all its blocks in one sequence, pages of similar length together."""
        paths, known, out, waiting = Paths(), [np.zeros(PATH, np.float32)], [""] * len(pages), []
        for i, page in enumerate(pages):
            if found := blocks(page, paths):
                waiting.append((i, [b[0] for b in found], self.inputs(found, paths, known)))
        waiting.sort(key=lambda r: len(r[1]))
        while waiting:
            long_ = len(waiting[-1][1])
            group = waiting[-max(1, AT_ONCE // long_) :]
            del waiting[-len(group) :]
            x, mask = np.zeros((long_, len(group), PATH + WORD + MEASURES), np.float32), np.zeros((long_, len(group), 1), np.float32)
            for j, (_, texts, rows) in enumerate(group):
                x[: len(texts), j], mask[: len(texts), j] = rows, 1
            chosen = self.logits(x, mask) > 0
            for j, (i, texts, _) in enumerate(group):
                out[i] = "\n".join(t for t, main in zip(texts, chosen[:, j].tolist(), strict=False) if main)
        return out


def _gathered(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by place, of n places."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        places = at[order]
        first = np.flatnonzero(np.diff(places, prepend=-1))
        out[places[first]] = np.add.reduceat(rows[order], first)
    return out


# Names by which pages call their parts (words of class and id, and elements).
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc tabs pagination pager categories links",
    "header": "header masthead top topbar banner branding logo headline-bar site-header tagline",
    "footer": "footer bottom copyright colophon legal imprint credits site-footer",
    "sidebar": "sidebar aside side right left rail widget related recommended popular trending teaser latest archive tags share social follow more",
    "notice": "notice cookie cookies consent gdpr privacy alert warning modal popup overlay message paywall disclaimer announcement",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted commercial affiliate partner",
    "form": "form search login signup newsletter subscribe subscription contact register survey poll feedback",
    "comments": "comment comments commentlist reply replies discussion responses respond thread reviews guestbook reader-comments disqus",
}
MAIN = "content main article post entry story text body article-body post-content entry-content main-content page-content article-text articleBody hentry prose richtext".split()
NEUTRAL = "row col container wrapper wrap inner outer box block section page site grid clearfix layout panel group module card item".split()
ELEMENTS = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol")}
NOT_MAIN = frozenset("nav footer aside form header menu dialog search button select option label".split())
PHRASES = [
    "We use cookies to make this site better.", "Accept all cookies", "Subscribe to our newsletter", "Sign in", "Log in", "Read more", "Share this page", "All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "Advertisement", "Sponsored", "Reply", "3 comments", "Leave a comment", "Your email address", "Search", "Home", "About", "Related articles", "Most read", "Follow us", "Please enable JavaScript.", "© 2024", "Posted by a reader", "I agree with this.", "Thank you for the article!",
]


class Layouts:
    """Pages made of the blocks of given pages: the main text keeps its place, everything else is filled from other pages."""

    def __init__(self, prose: list[str], seed: int = 0):
        self.rng, self.prose = np.random.default_rng(seed), prose or PHRASES

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def phrase(self) -> str:
        """A short text, a sentence or a whole block."""
        if self.chance(0.3):
            return html.escape(self.pick(PHRASES))
        text = self.pick(self.prose)
        if self.chance(0.5):
            words = text.split()
            at = int(self.rng.integers(len(words)))
            text = " ".join(words[at : at + int(self.rng.integers(1, 12))])
        return html.escape(text)

    def named(self, names: list[str]) -> str:
        """Attributes with such a name, at times beside others."""
        words = [self.pick(names)]
        if self.chance(0.3):
            words.append(self.pick(NEUTRAL))
        if self.chance(0.15):
            words[0] = f"{self.pick(MAIN)}-{words[0]}" if self.chance(0.5) else f"{self.pick(NEUTRAL)}-{words[0]}"
        return f' {self.pick(["class", "class", "id"])}="{" ".join(words)}"'

    def neutral(self) -> str:
        return f' class="{self.pick(NEUTRAL)}"' if self.chance(0.5) else ""

    def part(self, kind: str) -> str:
        """A part that is not main text."""
        tag = self.pick(ELEMENTS[kind])
        attributes = self.named(PARTS[kind].split()) if tag in ("div", "section", "ul", "ol") or kind == "advert" or self.chance(0.5) else self.neutral()
        long_ = kind in ("comments", "sidebar", "notice", "advert")
        n = int(self.rng.integers(1, 9 if kind in ("menu", "comments") else 4))
        inside = []
        for _ in range(n):
            text = self.phrase() if long_ or self.chance(0.3) else " ".join(self.phrase().split()[:3])
            if kind in ("menu", "sidebar", "footer", "header") and self.chance(0.7):
                text = f'<a href="/x">{text}</a>'
            leaf = "li" if tag in ("ul", "ol") else self.pick(["li", "div", "span", "p"] if kind == "menu" else ["label", "button", "div", "p", "option"] if kind == "form" else ["p", "div", "p", "li", "h3", ""])
            if kind == "comments" and self.chance(0.5):
                inside.append(f"<div{self.named(PARTS[kind].split())}><h4>{' '.join(self.phrase().split()[:2])}</h4><p>{text}</p></div>")
            else:
                inside.append(f"<{leaf}{self.neutral() if self.chance(0.2) else ''}>{text}</{leaf}>" if leaf else text + "<br>")
        body = "".join(inside)
        if tag == "nav" and self.chance(0.6):
            body = f"<ul>{body}</ul>"
        if self.chance(0.2):
            body = f"<div{self.neutral()}>{body}</div>"
        return f"<{tag}{attributes} data-main=0>{body}</{tag}>"

    def main(self, texts: list[str]) -> str:
        """The main text in one of many forms, parts that do not belong to it at times between."""
        inside, tag = [], self.pick(["article", "main", "div", "div", "div", "section", "td"])
        if self.chance(0.15):  # and runs of alike ones
            at = int(self.rng.integers(len(texts)))
            texts = texts[:at] + [" ".join(texts[at].split()[: int(self.rng.integers(1, 12))])] * int(self.rng.integers(2, 60)) + texts[at:]
        listed, share = self.chance(0.1), self.pick([0.1, 0.2, 0.2, 0.9])
        leaf = self.pick(["p", "p", "p", "p", "p", "div", "dd"])
        for i, text in enumerate(texts):
            if self.chance(share):  # main text has short blocks too
                text = " ".join(text.split()[: int(self.rng.integers(1, 4))])
            text = html.escape(text)
            if self.chance(0.1):
                words = text.split(" ")
                at = int(self.rng.integers(len(words)))
                inline = self.pick(["b", "em", 'a href="/y"', "code"])
                words[at] = f"<{inline}>{words[at]}</{inline.split()[0]}>"
                text = " ".join(words)
            kind = self.pick(["h1", "h1", "h2"]) if i == 0 and self.chance(0.8) else self.pick(["h2", "h3", "blockquote", "li", "pre", "dd", "figcaption", "td", "div"]) if self.chance(0.12) else "li" if listed else leaf
            whole = "<table><tr><td>{}</td></tr></table>" if kind == "td" else "<p>{}" if kind == "p" and self.chance(0.2) else f"<{kind}{self.neutral() if self.chance(0.1) else ''}>{{}}</{kind}>"
            inside.append(whole.format(text))
            if self.chance(0.05):
                inside.append(self.part(self.pick(["advert", "sidebar", "form", "notice"])))
        if self.chance(0.2):
            inside.append(self.part(self.pick(["comments", "sidebar", "form"])))
        names = self.named(MAIN) if tag in ("div", "section", "td") and self.chance(0.85) or self.chance(0.2) else self.neutral()
        out = f"<{tag}{names} data-main=1>{''.join(inside)}</{tag}>"
        if tag == "td":
            out = f"<table><tr>{out}</tr></table>"
        for _ in range(int(self.rng.integers(3))):
            outer = self.pick(["div", "div", "main", "section"])
            out = f"<{outer}{self.named(MAIN) if self.chance(0.3) else self.neutral()}>{out}{self.part(self.pick(['sidebar', 'comments', 'advert'])) if self.chance(0.3) else ''}</{outer}>"
        return out

    def page(self, texts: list[str]) -> str:
        parts = []
        for kind, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("form", 0.2), ("sidebar", 0.3)):
            if self.chance(p):
                parts.append(self.part(kind))
        if self.chance(0.3):
            self.rng.shuffle(parts)
        if texts:
            parts.append(self.main(texts))
        for kind, p in (("comments", 0.4), ("sidebar", 0.4), ("advert", 0.3), ("form", 0.3), ("footer", 0.8), ("notice", 0.2)):
            if self.chance(p):
                parts.append(self.part(kind))
        return f"<html><body>{''.join(parts)}</body></html>"


def _marked(page: str) -> str:
    """The page with ``data-main`` where its own semantic elements tell what is main text."""
    from .markup import TAG

    def mark(m) -> str:
        tag = (m[2] or "").lower()
        if m[1] or tag not in NOT_MAIN and tag not in ("article", "main"):
            return m[0]
        return f"<{m[2]} data-main={int(tag not in NOT_MAIN)} {m[3].rstrip('/')}>"

    return TAG.sub(mark, page)


def lessons(pages: list[str], seed: int = 0) -> list[Sequence]:
    """The pages as they are and with blocks cut short (where they have semantic elements), and in made layouts."""
    own, found, prose = [], [], []
    for page in pages:
        marked = blocks(page := _marked(page), Paths())
        main = [b[0] for b in marked if b[3]]
        if main:
            own.append(page)
        else:
            main = [b[0] for b in marked if len(b[0]) >= 80]
        if main:
            found.append(main)
            prose += main
    made = Layouts(prose, seed)
    texts = found or [made.prose]
    pages = own + [made.page(t[: LEARN_BLOCKS // 2] if made.chance(0.95) else []) for t in texts for _ in range(LAYOUTS)]
    if len(texts) < SAMPLE:  # few pages: more layouts of each
        pages += [made.page(made.pick(texts)[: LEARN_BLOCKS // 2]) for _ in range((SAMPLE - len(texts)) * LAYOUTS)]
    return [Sequence(p, LEARN_BLOCKS, True) for p in pages] + [Sequence(p, LEARN_BLOCKS, True, made.rng) for p in own]


def train(pages: DataFrame, key: str = "page_id") -> Labeller:
    """Learn from at most SAMPLE pages: those of the smallest hashes of id and html.

    Hashes beyond a bound below which a few times as many are due do not take part, so what reaches the driver does not
    grow with the partitions; only if too few are below (few different pages) do all take part.
    """
    known = pages.where((F.length("html") <= PAGE_CHARS) & (F.length("html") > 0)).select("html", F.shiftrightunsigned(F.xxhash64(key, "html"), 1).alias("hash"))
    first = lambda some: [r.html for r in some.orderBy("hash", "html").limit(SAMPLE).collect()]
    bound = (1 << 63) * 4 * SAMPLE // max(1, pages.count())
    chosen = first(known.where(F.col("hash") < bound)) if bound < 1 << 63 else []
    return Labeller().learn(lessons(chosen if len(chosen) == SAMPLE else first(known)))


def extract(pages: DataFrame, model: Labeller, key: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, the columns ``keep``, text, n_chars) of every page: one pass, no shuffle."""
    arrow_limits(pages.sparkSession)
    names = [key, *(c for c in keep if c != key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            texts = model.main_text([h or "" for h in b.column("_html").to_pylist()])
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.select(*names, F.col("html").alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op13_block_labeller(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")
