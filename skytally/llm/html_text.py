"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in one linear pass: the text between the boundaries of block elements, character references
decoded in each piece of text and white space made single. Each block is a vector of its tag path (hashed element names and class, id and role tokens of all
ancestors), its hashed words, and a few measures (length, links, punctuation, place). A bidirectional LSTM in numpy reads
the blocks of the whole page in both directions and labels each as main text or not; main blocks joined by blank lines
are the result. Scripts, styles, comments and markup never are text.

The labeller is trained here, on synthetic pages of many layouts whose blocks have known labels (``layouts``), from a fixed
seed, when the operator is applied; its size doesn't depend on the data. Extraction is a map over rows: no shuffle.

Null html gives an empty text, as do pages without main blocks; unclosed or stray tags and truncated pages are read as
browsers do, roughly. Repeated rows give repeated results. Other columns are kept.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skytally.llm import columnar as C
from skytally.session import ship_package

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 256, 64, 9, 16
TRAIN_PAGES, EPOCHS, RATE, SEED = 1000, 12, 0.01, 11
#: Pages and blocks that one numpy step labels; a page of more blocks goes through the network piece by piece.
GROUP, STEP = 128, 8192

NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var img wbr".split())
#: Start tags that end an open element of these names, up to the nearest container.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
COMMENT_END = re.compile("--!?>")
#: The end of a tag lies in an unquoted value, so that a slash there is part of it.
IN_VALUE = re.compile(r"=\s*[^\s\"'>]+$")


@dataclass
class Block:
    text: str
    path: int  # a bit for each bucket of the path's tokens
    leaf: str
    linked: int
    marked: bool | None = None


class Buckets(dict):
    """Hash buckets of tokens, remembered up to a bound."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "replace")) % self.size
        return b


PATH_BUCKETS, WORD_BUCKETS = Buckets(PATH_DIM), Buckets(WORD_DIM)


def _path_bits(name: str, attributes: str) -> tuple[int, bool | None]:
    bits, marked = 1 << PATH_BUCKETS[f"<{name}"], None
    for groups in ATTRIBUTE.findall(attributes) if attributes else ():
        for part in PART.findall(" ".join(groups)):
            bits |= 1 << PATH_BUCKETS[part.lower()]
    if "data-main=" in attributes:  # only in the synthetic pages: the label of what is below
        marked = 'data-main="1"' in attributes
    return bits, marked


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Text pieces ("", text, ""), start tags ("<", name, attributes) and end tags ("/", name, ""), in one pass.

    A tag ends at the first > outside quotes, and quotes count only after =, so that stray ones change nothing. A < that no
    such end follows before the next < is text. Comments and declarations are left out; so is what raw elements hold.
    """
    n, done, at = len(page), 0, 0  # text from ``done`` on is not yet given out
    last = {q: page.rfind(q) for q in "\"'>"}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            # <!--> and <!---> are whole comments; one that never ends takes the rest.
            end = None if page.startswith((">", "->"), at + 4) else COMMENT_END.search(page, at + 4)
            stop = page.find(">", at) + 1 if page.startswith((">", "->"), at + 4) else end.end() if end else n
            found = None
        elif page.startswith(("<!", "<?"), at):
            if last[">"] < at:
                break
            stop, found = page.find(">", at) + 1, None
        else:
            found = NAME.match(page, at + 1)
            stop = found.end() if found else -1
            while found:
                m = STOP.search(page, stop)
                if m is None or m[0] == "<":
                    found, stop = None, -1
                elif m[0] == ">":
                    stop = m.end()
                    break
                else:
                    stop = m.end()
                    if page[m.start() - 1] == "=" or page[max(0, m.start() - 20) : m.start()].rstrip().endswith("="):
                        if last[m[0]] < stop:
                            # The quote is never closed: the tag ends at the next >, if there is one.
                            stop = page.find(">", stop) + 1 if last[">"] >= stop else -1
                            found = found if stop > 0 else None
                            break
                        stop = page.find(m[0], stop) + 1
            if stop < 0:
                at += 1
                continue
        if done < at:
            yield "", page[done:at], ""
        at = done = stop
        if found:
            name, attributes = found[2].lower(), page[found.end() : stop - 1]
            yield ("/" if found[1] else "<"), name, "" if found[1] else attributes
            # Only a foreign element can end itself.
            if name in RAW and not found[1] and not (name == "svg" and attributes.endswith("/") and not IN_VALUE.search(attributes)):
                end = RAW_END[name].search(page, at)
                at = done = end.end() if end else n
    if done < n:
        yield "", page[done:], ""


@dataclass(slots=True)
class Open:
    """An open element, with what holds for all that is in it."""

    name: str
    bits: int = 0
    marked: bool | None = None
    leaf: str = ""
    link: bool = False


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack = [Open("")]
    open_names: Counter[str] = Counter()
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, top.bits, top.leaf, linked, top.marked))
        linked = 0

    def pop(until: int) -> None:
        for gone in stack[until:]:
            open_names[gone.name] -= 1
        del stack[until:]

    for kind, name, attributes in tokens(page or ""):
        if not kind:
            text = html.unescape(name) if "&" in name else name
            words.append(text)
            if stack[-1].link:
                linked += len(text)
            continue
        if kind == "/":
            if name not in INLINE:
                flush()
            if open_names[name] > 0:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in RAW:
            continue
        if name == "br":
            words.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in IMPLIED:
                if any(open_names[x] > 0 for x in IMPLIED[name]):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name in IMPLIED[name]:
                            pop(i)
                            break
                        if stack[i].name in SCOPE:
                            break
            elif open_names["p"] > 0:
                # A block ends an open paragraph, and formatting left open in it.
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        pop(i)
                        break
                    if stack[i].name not in INLINE:
                        break
        if name not in VOID:  # a slash at its end means nothing to an html element
            bits, marked = _path_bits(name, attributes)
            top = stack[-1]
            stack.append(Open(name, top.bits | bits, top.marked if marked is None else marked, top.leaf if name in INLINE else name, top.link or name == "a"))
            open_names[name] += 1
    flush()
    return out


def vectors(page: list[Block], start: int = 0, stop: int | None = None, done: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block from start to stop; done and total: characters before them, and of the page."""
    total = total or sum(len(b.text) for b in page) or 1
    page = page[start:stop]
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    paths = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in page), np.uint8)
    x[:, :PATH_DIM] = np.unpackbits(paths, bitorder="little").reshape(len(page), PATH_DIM)
    for i, b in enumerate(page):
        words = b.text.lower().split()
        if words:
            x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(list(map(WORD_BUCKETS.__getitem__, words)), minlength=WORD_DIM) / len(words) ** 0.5
        t, k = b.text, PATH_DIM + WORD_DIM
        size = len(t)
        x[i, k:] = (
            min(np.log1p(size) / 6, 1.5),
            min(1.0, b.linked / size),
            t[-1] in ".!?\"'”)",
            (t.count(",") + t.count(".")) / size * 10,
            done / total,
            size / total,
            b.leaf == "p",
            b.leaf in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.leaf in ("li", "td", "a", "button", "label", "option"),
        )
        done += size
    return x


# The network: one LSTM in each direction, and a logistic unit over both states of each block.


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """x: (steps, pages, inputs); mask: (steps, pages). States (steps, pages, hidden); padded steps keep the state.

    state: the state to begin with, which becomes the one at the end.
    """
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out, z_in = np.empty((steps, pages, HIDDEN), np.float32), x @ wx + b
    for t in range(steps):
        z = z_in[t] + h @ wh
        i, f, o = _sig(z[:, :HIDDEN]), _sig(z[:, HIDDEN : 2 * HIDDEN] + 1), _sig(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(new_c)
        new_h = m * (o * tc) + (1 - m) * h
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, m))
        h, c = new_h, new_c
        out[t] = h
    if state is not None:
        state[:] = [h, c]
    return out


def _lstm_back(x: np.ndarray, wh: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh and b."""
    steps, pages, _ = x.shape
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + d_out[t]
        live_h, dh_pass = dh * m, dh * (1 - m)
        d_c = dc * m + live_h * o * (1 - tc**2)
        z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), live_h * tc * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
        dz[t] = z
        dwh += h.T @ z
        dh = z @ wh.T + dh_pass
        dc = d_c * f + dc * (1 - m)
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _long(model: Model, page: list[Block]) -> np.ndarray:
    """The same for one page of any length: only a piece of its vectors is held at a time."""
    w, starts = model.weights, range(0, len(page), STEP)
    sizes = np.array([len(b.text) for b in page])
    done = np.concatenate(([0], np.cumsum(sizes)))
    states = np.empty((len(page), 2 * HIDDEN), np.float32)
    for side, d, pieces in ((0, "f", starts), (1, "b", reversed(starts))):
        state: list = []
        for a in pieces:
            x = vectors(page, a, a + STEP, int(done[a]), int(done[-1]))[:, None]
            x = x[::-1] if side else x
            state = state or [np.zeros((1, HIDDEN), np.float32)] * 2
            out = _lstm(x, w[d + "x"], w[d + "h"], w[d + "b"], np.ones((len(x), 1), np.float32), state=state)[:, 0]
            states[a : a + STEP, side * HIDDEN : (side + 1) * HIDDEN] = out[::-1] if side else out
    return _sig(states @ w["out"] + w["bias"])[:, 0]


def predict(model: Model, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of main text for each block of each page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    w = model.weights
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > STEP:
            out[order[at]] = _long(model, pages[order[at]])
            at += 1
            continue
        # Fewer pages at a time where they are long.
        take = max(1, min(GROUP, STEP // len(pages[order[min(at + GROUP, len(order)) - 1]])))
        group = [i for i in order[at : at + take] if len(pages[i]) <= STEP]
        at += len(group)
        x, mask = _padded([vectors(pages[i]) for i in group])
        forward = _lstm(x, w["fx"], w["fh"], w["fb"], mask)
        backward = _lstm(x[::-1], w["bx"], w["bh"], w["bb"], mask[::-1])[::-1]
        p = _sig(np.concatenate([forward, backward], axis=2) @ w["out"] + w["bias"])[:, :, 0]
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k]
    return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam over batches of pages of similar length."""
    rng = np.random.default_rng(seed)
    inputs = pages[0].shape[1]
    w = {}
    for d in "fb":
        w[d + "x"] = rng.normal(0, 0.1, (inputs, 4 * HIDDEN)).astype(np.float32)
        w[d + "h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[d + "b"] = np.zeros(4 * HIDDEN, np.float32)
    w["out"], w["bias"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)
    m1, m2, count = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    batches = [order[i : i + 32] for i in range(0, len(order), 32)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = _padded([pages[i] for i in batches[k]])
            # Path tokens are left out at random, so that no single one decides alone.
            drop = rng.random((1, x.shape[1], PATH_DIM)) < 0.03
            x[:, :, :PATH_DIM] *= ~drop
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(labels[i]), j] = labels[i]
            kf, kb = [], []
            f = _lstm(x, w["fx"], w["fh"], w["fb"], mask, kf)
            xb = np.ascontiguousarray(x[::-1])
            b = _lstm(xb, w["bx"], w["bh"], w["bb"], mask[::-1], kb)[::-1]
            both = np.concatenate([f, b], axis=2)
            p = _sig(both @ w["out"] + w["bias"])[:, :, 0]
            d = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            g = {"out": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "bias": d.sum(axis=(0, 1))}
            d_both = d @ w["out"].T
            g["fx"], g["fh"], g["fb"] = _lstm_back(x, w["fh"], kf, d_both[:, :, :HIDDEN])
            g["bx"], g["bh"], g["bb"] = _lstm_back(xb, w["bh"], kb, d_both[::-1, :, HIDDEN:])
            count += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for name in w:
                m1[name] = 0.9 * m1[name] + 0.1 * g[name]
                m2[name] = 0.999 * m2[name] + 0.001 * g[name] ** 2
                w[name] = (w[name] - rate * (m1[name] / (1 - 0.9**count)) / (np.sqrt(m2[name] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
    return Model(w)


def layouts(n: int, seed: int = SEED) -> list[str]:
    """Synthetic pages; data-main attributes carry the labels and are no input."""
    r = random.Random(seed)
    syllables = ["the", "an", "ou", "re", "ti", "en", "er", "st", "on", "la", "de", "ch", "in", "ge", "mi", "so", "que", "au", "ver", "lo", "ta", "zu", "é", "ß", "ó", "ka", "pro", "qu", "ness", "ing"]
    notes = {
        "nav": ["home", "about us", "contact", "products", "news", "login", "menu", "search", "sign in"],
        "ad": ["advertisement", "sponsored", "buy now", "special offer", "ad"],
        "cookie": ["we use cookies to improve your experience", "accept all cookies", "this site uses cookies", "your privacy", "subscribe to continue"],
        "side": ["related articles", "popular posts", "most read", "tags", "recommended", "follow us", "archives"],
        "foot": ["all rights reserved", "© 2024", "privacy policy", "terms of use", "imprint", "powered by"],
        "comment": ["reply", "posted by", "3 comments", "leave a comment", "says:", "2 days ago"],
        "form": ["subscribe", "email address", "your name", "submit", "search", "password", "newsletter"],
        "share": ["share", "tweet", "like", "print this page", "email this"],
    }

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(lo: int = 3, hi: int = 22) -> str:
        s = " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(lo, hi)))
        return s[:1].upper() + s[1:] + r.choice([".", ".", ".", ".", "!", "?", ""])

    def para(hi: int = 6) -> str:
        t = " ".join(sentence() for _ in range(r.randint(1, hi)))
        if r.random() < 0.15:
            t = " ".join(w + r.choice(["%%%", "***", "&amp;&amp;", "!!", " |"]) for w in t.split())
        if r.random() < 0.1:
            t = t.upper()
        if r.random() < 0.25:
            a, b = sorted(r.sample(range(len(t) + 1), 2))
            tag = r.choice(["b", "i", "em", "strong", "a href='/x'", "span"])
            t = f"{t[:a]}<{tag}>{t[a:b]}" + (f"</{tag.split()[0]}>" if r.random() < 0.85 else "") + t[b:]
        return t

    def noise() -> str:
        return "" if r.random() < 0.6 else f' {r.choice(["class", "id"])}="{word()}{r.randint(0, 99)}"'

    def box(kind: str, inner: str) -> str:
        names = {
            "nav": (["nav"], ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "navigation", "breadcrumb", "toc"]),
            "ad": (["aside", "section"], ["ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot", "advertisement", "promoted"]),
            "cookie": (["dialog", "section"], ["cookie-banner", "cookies", "consent", "gdpr", "notice", "alert", "paywall", "popup", "modal", "overlay", "banner"]),
            "side": (["aside"], ["sidebar", "side-bar", "widget", "related", "recommended", "popular", "rail", "more-stories", "aside"]),
            "foot": (["footer"], ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"]),
            "head": (["header"], ["header", "site-header", "masthead", "top", "branding", "logo"]),
            "comment": (["section"], ["comments", "comment-list", "discussion", "replies", "comment", "disqus", "responses"]),
            "form": (["form"], ["search", "newsletter", "signup", "login", "subscribe", "contact-form"]),
            "share": (["section"], ["share", "social", "share-buttons", "tools", "sharing"]),
        }[kind]
        if r.random() < 0.5:
            tag, attr = r.choice(names[0]), noise() if r.random() < 0.5 else f' class="{r.choice(names[1])}"'
        else:
            tag, attr = r.choice(["div", "div", "div", "section", "ul" if kind in ("nav", "side") else "div", "td" if kind in ("nav", "side", "ad") else "div"]), f' {r.choice(["class", "class", "id"])}="{r.choice(names[1])}"'
        if tag in ("section", "aside") and "=" not in attr:
            attr = f' class="{r.choice(names[1])}"'
        return f'<{tag}{attr} data-main="0">{inner}</{tag}>'

    def links(lo: int, hi: int) -> str:
        items = [f"<a href='/{word()}'>{r.choice(notes['nav']) if r.random() < 0.3 else ' '.join(word() for _ in range(r.randint(1, 3)))}</a>" for _ in range(r.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.65 else r.choice([" ", " | ", "<br>"]).join(items)

    def boiler(kind: str) -> str:
        hint = r.choice(notes.get(kind, [""])) if r.random() < 0.6 else ""
        if kind == "nav":
            return box(kind, links(2, 9))
        if kind in ("side", "foot"):
            body = r.choice([lambda: links(1, 6), lambda: f"<p>{sentence()}</p>", lambda: sentence() + " " + hint, lambda: f"<h3>{hint or sentence(1, 4)}</h3>" + links(1, 5), lambda: f"<h3>{hint}</h3><p>{para(3)}</p><p>{para(2)}</p>", lambda: f"&copy; {word()} &middot; {sentence()} {sentence()}", lambda: para(3)])()
            return box(kind, body)
        if kind == "head":
            return box(kind, f"<{r.choice(['h1', 'div', 'p', 'span'])}>{sentence(1, 5)}" + (links(1, 6) if r.random() < 0.5 else "") + (f"<p>{sentence()}</p>" if r.random() < 0.4 else ""))
        if kind == "comment":
            each = "".join(f"<{t}>{r.choice(['', '<b>' + word() + '</b> ' + r.choice(notes['comment'])])}<p>{para(3)}</p></{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6)))
            return box(kind, f"<h3>{hint or 'comments'}</h3>" + each)
        if kind == "form":
            return box(kind, f"<label>{r.choice(notes['form'])}</label><input name=q>" + (f"<p>{sentence()}</p>" if r.random() < 0.5 else "") + f"<select><option>{word()}<option>{word()}</select><button>{r.choice(notes['form'])}</button>")
        if kind == "share":
            return box(kind, " ".join(f"<a href='#'>{s}</a>" for s in r.sample(notes["share"], 3)))
        return box(kind, r.choice([f"<p>{hint} {para(2)}</p>", f"{hint} {sentence()}", f"<p>{sentence()}</p><button>{r.choice(['ok', 'accept', 'close', hint])}</button>"]))

    def content() -> str:
        parts = []
        if r.random() < 0.8:
            parts.append(f"<h1{noise()}>{sentence(1, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.72:
                parts.append(f"<p{noise()}>{para()}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.8:
                parts.append(f"<h2>{sentence(1, 8)}</h2>")
            elif x < 0.86:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote>{para(2)}</blockquote>")
            elif x < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.95:
                parts.append(f"<pre>{sentence()}</pre>")
            else:
                parts.append(f"<div{noise()}>{para()}</div>")
            if r.random() < 0.09:
                parts.append(boiler(r.choice(["ad", "share", "side", "form", "ad", "cookie", "nav"])))
        tag, attr = r.choice([("article", ""), ("article", ""), ("article", noise()), ("main", ""), ("div", ' id="content"'), ("div", ' class="post"'), ("div", ' class="entry-content"'), ("div", ' class="article-body"'), ("section", ' class="story"'), ("div", noise()), ("td", "")])
        out = f'<{tag}{attr} data-main="1">{"".join(parts)}</{tag}>'
        if r.random() < 0.3:
            out = f"<main>{out}</main>"
        elif r.random() < 0.3:
            out = f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">{out}</div>'
        return out

    pages = []
    for _ in range(n):
        before = [k for k in ("head", "nav", "cookie", "ad", "form", "side", "nav") if r.random() < 0.4]
        after = [k for k in ("share", "ad", "comment", "side", "nav", "form", "foot", "cookie") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(map(boiler, before)) + (f"<!-- {word()} -->" if r.random() < 0.5 else "") + content() + "".join(map(boiler, after))
        pages.append(f"<!DOCTYPE html><html lang='{r.choice(['en', 'de', 'fr'])}'><head><title>{sentence(1, 8)}</title><style>p{{}}</style></head><body{noise()}>{body}" + ("</body></html>" if r.random() < 0.8 else ""))
    return pages


@lru_cache(maxsize=2)
def fit(pages: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """The labeller, trained on synthetic pages; the same from every call."""
    cut = [blocks(p) for p in layouts(pages, seed)]
    return train([vectors(p) for p in cut], [np.array([bool(b.marked) for b in p], np.float32) for p in cut])


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, q in zip(page, p, strict=True) if q >= 0.5) for page, p in zip(cut, predict(model, cut), strict=True)]


def extract(spark: SparkSession, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns, and main_text (empty if there is none); a column of that name becomes _in_main_text (see C.renamed)."""
    ship_package(spark)
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "html"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(main_texts(model, part.column("html").to_pylist()), pa.string())], [*part.schema.names, "main_text"])

    pages = C.renamed(pages, "main_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "main_text string"])
    return pages.mapInArrow(run, schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op1_html": op1_html}

ORACLE_SQL: dict[str, str] = {}
