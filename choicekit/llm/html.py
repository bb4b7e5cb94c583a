r"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, white space turned into single spaces, character
references decoded, with the path of open elements. A bidirectional LSTM (numpy) reads the page's blocks in
order, each as a hashed vector of its tag path (tags, and class and id words, of all open elements), a hashed
vector of all its words and a few ratios, and labels every block as main text or not with the context of
the whole document. The main blocks are joined by \n.

The labeller is trained here, on `pages` pages made by page_sample() (a bounded, seeded sample whose labels are
known since it is made with them); training takes seconds and happens once per driver process. Weights of about
100 kB go to the tasks with the function.

Scale: no shuffle; pages are handled in batches of at most `batch_chars` characters or one page. Null and empty html give
an empty text. Scripts, styles and other elements that hold no text are left out before labelling; nothing
else is dropped or cut. Repeated rows give repeated results. An empty table gives no rows. Extra columns are
dropped.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

PATH_DIM, WORD_DIM, STATS, HIDDEN = 256, 64, 6, 16
PAGES, EPOCHS, SEED, BATCH_CHARS = 2400, 7, 5, 1 << 20

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, up to its end: a quote counts after an equals sign, and only if it is closed.
_TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>""")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CLOSING = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in RAW}
#: Elements whose text is never shown as text.
HIDDEN_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript template svg math object canvas audio video select datalist xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title noframes".split())
#: Open elements of a path, counted from the innermost one, that a block's vector looks at.
PATH_DEPTH = 256
_NO_P = frozenset("button caption td th".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"})}


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each block that has text; path: one `tag class-and-id-words` string per open element.

    One pass. Omitted end tags are those of HTML: what can't be in a head ends it, also where its tag is left out.
    `<!...>`, `<?...>` and CDATA sections are comments. A quote that is never closed is no quote; where quotes leave a tag without an
    end, it and all tags after it are read without quotes. A comment that the page ends in is dropped, a tag that it ends in is text.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = hidden = linked = at = 0
    quotes, last = True, html.rfind(">")

    def flush() -> None:
        nonlocal linked
        if text:
            if whole := " ".join(unescape("".join(text)).split()):
                out.append((tuple(x for _, x in stack[-PATH_DEPTH:]), whole, linked))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        while len(stack) > k:
            name = stack.pop()[0]
            hidden -= name in HIDDEN_TEXT
            opened[name] -= 1

    def innermost(names: set[str], walls: frozenset | set) -> None:
        """Close the innermost open element of names, unless one of walls is nearer."""
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in walls:
                return
            if stack[k][0] in names:
                return pop_to(k)

    end = len(html)
    while at < end:
        start = html.find("<", at)
        m = None
        while start >= 0:
            two = html[start + 1 : start + 2]
            if two in ("!", "?") or (m := _TAG_NAME.match(html, start + 1 + (two == "/"))):
                break
            start = html.find("<", start + 1)
        stop = end if start < 0 else start
        if stop > at:
            if stack and stack[-1][0] == "head" and not html[at:stop].isspace():
                pop_to(len(stack) - 1)
            if not hidden:
                text.append(html[at:stop])
                if links:
                    linked += stop - at
        if start < 0:
            break
        if m is None:
            if html.startswith("<!--", start):
                close = start + 4 if html.startswith((">", "->"), start + 4) else html.find("-->", start + 4)
            else:
                close = start
            at = html.find(">", close) + 1 if close >= 0 and start < last else 0
            if not at:
                break
            continue
        if start > last:  # a tag that never ends is text
            if not hidden:
                text.append(html[start:])
            break
        name, attributes = m[0].lower(), ""
        if two == "/":
            at = html.find(">", m.end()) + 1
        else:
            rest = _TAG_REST.match(html, m.end()) if quotes else None
            quotes = rest is not None
            at = rest.end() if rest else html.find(">", m.end()) + 1
            attributes = html[m.end() : at - 1]
        if not at:
            break
        if two == "/":
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                text.append(" ")
            elif name in BLOCK or name in HIDDEN_TEXT:
                flush()
                innermost({name}, frozenset())
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            flush()
            pop_to(len(stack) - 1)
        if name in BLOCK or name in HIDDEN_TEXT:
            flush()
            links = 0
            if name in _CLOSES:
                innermost(*_CLOSES[name])
            if name in BLOCK and name not in ("option", "optgroup"):
                innermost({"p"}, _NO_P)
            if name in VOID:
                continue
            if name in RAW and not attributes.rstrip().endswith("/"):
                close = _CLOSING[name].search(html, at)
                at = html.find(">", close.start()) + 1 or end if close else end
                continue
            if name in ("svg", "math", "object", "canvas", "audio", "video") and attributes.rstrip().endswith("/"):
                continue
            hidden += name in HIDDEN_TEXT
            words = ""
            if attributes:
                found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
                words = " ".join(_NAME_WORD.findall(_CAMEL.sub("-", found).lower()))
            stack.append((name, f"{name} {words}" if words else name))
            opened[name] += 1
        elif name == "a":
            links += 1
        elif name == "br":
            text.append(" ")
    flush()
    return out


# --- vectors -------------------------------------------------------------------------------------------


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@lru_cache(1 << 14)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Tags and class words of all open elements; those of the innermost one also by themselves; the depth."""
    v = np.zeros(PATH_DIM, np.float32)
    for k, element in enumerate(path):
        tag, *names = element.split()
        if tag in ("html", "body"):
            continue
        for x in [f"<{tag}>", *names]:
            v[_bucket(x, PATH_DIM - 1)] = 1
            if k == len(path) - 1:
                v[_bucket(f"last {x}", PATH_DIM - 1)] = 1
    v[-1] = len(path) / 8
    return v


def word_vector(text: str, linked: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    v = np.empty(WORD_DIM + STATS, np.float32)
    crc = zlib.crc32
    v[:WORD_DIM] = np.bincount([crc(w) & (WORD_DIM - 1) for w in words], minlength=WORD_DIM) / len(words) ** 0.5
    n = len(text)
    v[WORD_DIM:] = (np.log1p(len(words)) / 5, min(1.0, linked / n), text.count(".") / len(words), n / len(words) / 10, text[-1] in ".!?:;\"", "©" in text)
    return v


# --- the labeller --------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over a sequence, one from each end, and a logistic output on both states."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        width, h = PATH_DIM + WORD_DIM + STATS, HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.1, (width, 4 * h))
            self.w["h" + d] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.w["c" + d] = np.concatenate([np.ones(h), np.zeros(3 * h)])
        self.w["o"] = rng.normal(0, 0.3, (2 * h, 1))
        self.w["p"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (n, T, h) of one direction over projected inputs x (n, T, 4h); padding passes the state on."""
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((n, t, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[:, k] + h @ self.w["h" + d]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                saved.append((k, h, c, f, i, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, k] = h
        return out, saved

    def scores(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(xf, mask, "f", False)
        b, _ = self._run(xb, mask, "b", False)
        return (np.concatenate([f, b], axis=2) @ self.w["o"])[..., 0] + self.w["p"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for a batch x (n, T, width), mask and labels y (n, T)."""
        run = {d: self._run(x @ self.w["x" + d] + self.w["c" + d], mask, d, True) for d in "fb"}
        states = np.concatenate([run["f"][0], run["b"][0]], axis=2)
        p = _sigmoid((states @ self.w["o"])[..., 0] + self.w["p"])
        total = mask.sum()
        loss = float(-(mask * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / total)
        dp = (p - y) * mask / total
        g = {"o": np.einsum("nth,nt->h", states, dp)[:, None], "p": dp.sum(keepdims=True)[0]}
        ds = dp[..., None] * self.w["o"][:, 0]
        for d, part in (("f", ds[..., :HIDDEN]), ("b", ds[..., HIDDEN:])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dz_all, g_h = np.zeros((*part.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w["h" + d])
            for k, h, c, f, i, o, gg, tc, m in reversed(run[d][1]):
                dh = dh + part[:, k]
                own, dcn = m * dh, m * dc
                dcn = dcn + own * o * (1 - tc**2)
                dz = np.concatenate([dcn * c * f * (1 - f), dcn * gg * i * (1 - i), own * tc * o * (1 - o), dcn * i * (1 - gg**2)], axis=1)
                dz_all[:, k] = dz
                g_h += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ self.w["h" + d].T, (1 - m) * dc + dcn * f
            g["x" + d] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * HIDDEN)
            g["h" + d], g["c" + d] = g_h, dz_all.sum(axis=(0, 1))
        return loss, g

    def label(self, pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        result: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            t = len(pages[some[-1]])
            xf, xb = (np.zeros((len(some), t, 4 * HIDDEN), np.float32) for _ in range(2))
            mask = np.zeros((len(some), t), np.float32)
            for row, k in enumerate(some):
                page = pages[k]
                words = np.stack([word_vector(text, linked) for _, text, linked in page])
                for d, x in (("f", xf), ("b", xb)):
                    x[row, : len(page)] = words @ self.w["x" + d][PATH_DIM:] + self.w["c" + d] + np.stack([self._path(path, d) for path, _, _ in page])
                mask[row, : len(page)] = 1
            s = self.scores(xf, xb, mask)
            for row, k in enumerate(some):
                result[k] = s[row, : len(pages[k])] > 0
        return result

    def _path(self, path: tuple[str, ...], d: str) -> np.ndarray:
        cache = self.__dict__.setdefault("cache", {})
        if (v := cache.get((path, d))) is None:
            if len(cache) > 1 << 14:
                cache.clear()
            v = cache[path, d] = path_vector(path) @ self.w["x" + d][:PATH_DIM]
        return v


def train(pages: list[tuple[str, set[str]]], *, epochs: int = EPOCHS, seed: int = SEED, batch: int = 32) -> BiLstm:
    """A labeller from (html, texts of the main blocks) pairs, by Adam."""
    net, rng = BiLstm(seed), np.random.default_rng(seed)
    data = []
    for html, main in pages:
        if own := blocks(html):
            x = np.stack([np.concatenate([path_vector(p), word_vector(t, n)]) for p, t, n in own])
            data.append((x, np.array([t in main for _, t, _ in own], np.float32)))
    m, v, step = {k: np.zeros_like(w) for k, w in net.w.items()}, {k: np.zeros_like(w) for k, w in net.w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            some = [data[k] for k in order[at : at + batch]]
            t = max(len(y) for _, y in some)
            x, y, mask = np.zeros((len(some), t, some[0][0].shape[1]), np.float32), np.zeros((len(some), t), np.float32), np.zeros((len(some), t), np.float32)
            for k, (a, b) in enumerate(some):
                x[k, : len(b)], y[k, : len(b)], mask[k, : len(b)] = a, b, 1
            # words and single names are dropped at times, so that nothing hangs on one of them
            x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= rng.random((len(some), t, 1)) < 0.7
            x[:, :, PATH_DIM + WORD_DIM :] *= rng.random((len(some), t, 1)) < 0.6
            _, g = net.gradient(x, mask, y)
            step += 1
            norm = sum(float((d**2).sum()) for d in g.values()) ** 0.5
            for k, d in g.items():
                d = d * min(1.0, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d**2
                net.w[k] = (net.w[k] - (0.01 if epoch < epochs - 3 else 0.003 if epoch < epochs - 1 else 0.001) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# --- pages with known labels ---------------------------------------------------------------------------

_MAIN = ["article", "main", "div class=content", "div id=content", "div class=post-body", "div class=entry-content", "section class=story", "div id=article-body", "div class=article", "div class=post", "div class=text", "main id=main", "div role=main"]
_WRAP = ["div", "div id=page", "div class=wrapper", "div class=container", "div id=root", "section", "div class=row", "div class=layout"]
_BOILER: dict[str, list[str]] = {
    "menu": ["nav", "nav class=menu", "div class=menu", "div id=nav", "div class=navbar", "div class=navigation", "ul class=nav", "div class=breadcrumbs", "div class=topbar", "div role=navigation"],
    "header": ["header", "div class=header", "div id=header", "header class=site-header", "div class=masthead", "div class=banner", "div role=banner"],
    "footer": ["footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class=copyright", "div class=bottom", "div class=legal"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=related", "div class=widget", "div class=recommended", "section class=related-posts", "div class=trending", "div class=more"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id=ad-1", "ins class=ad", "div class=sponsored", "div class=promo", "aside class=ad", "section class=promo-box", "div class=banner-ad", "p class=ad"],
    "notice": ["div class=cookie", "div id=cookie-banner", "div class=consent", "div class=notice", "div class=alert", "div role=alert", "section class=gdpr", "div class=cookie-notice", "div class=popup", "div class=modal", "dialog", "div class=paywall", "aside class=notice"],
    "form": ["form", "form class=newsletter", "div class=subscribe", "form class=search", "div class=signup", "div class=login", "form id=contact"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=discussion", "div class=comment", "section id=disqus", "div class=replies", "section class=reader-comments"],
    "share": ["div class=share", "div class=social", "ul class=tags", "div class=pagination", "div class=pager", "div class=share-buttons"],
}
_SAID = {
    "menu": "home about contact news blog products services login archive topics", "header": "the daily site welcome your source of news", "footer": "copyright all rights reserved privacy policy terms of use imprint",
    "side": "related articles most read popular posts recommended for you trending", "ad": "advertisement sponsored buy now limited offer sale discount shop", "notice": "we use cookies accept all reject settings consent this site important notice",
    "form": "email name subscribe sign up search submit send password", "comments": "reply says posted comment ago like great post thanks for sharing i agree", "share": "share tweet facebook next previous tags print",
}


def page_sample(n: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """n made-up pages, each with the texts of its main blocks: containers with telling and untelling names, boilerplate before, after and inside the article, and pages without any container."""
    rng = random.Random(seed)
    pick, between = rng.choice, rng.randrange
    syllables = [a + b + c for a in "bcdfglmnprstvw" for b in "aeiouéöü" for c in ("", "n", "r", "st")]

    def words(k: int, said: str = "", stop: bool = True) -> str:
        own = ["".join(rng.choices(syllables, k=between(1, 4))) for _ in range(max(1, k))]
        for w in said.split():
            if rng.random() < 0.4:
                own[between(len(own))] = w
        noise = rng.random()
        text = (" | " if noise < 0.05 else "%%% " if noise < 0.08 else " ").join(own if noise < 0.95 else own[:1] * len(own))
        return text[0].upper() + text[1:] + ("." if stop else "")

    def tag(spec: str, inner: str) -> str:
        name, _, rest = spec.partition(" ")
        if rest:
            key, _, value = rest.partition("=")
            rest = f' {key}="{value}"'
        return f"<{name}{rest}>{inner}</{name}>"

    out = []
    for _ in range(n):
        main: set[str] = set()

        def body(k: int) -> str:
            """Article blocks."""
            parts = []
            for _ in range(k):
                text = words(between(1, 12) if rng.random() < 0.25 else between(8, 90))
                kind = rng.random()
                if kind < 0.7:
                    if rng.random() < 0.15:
                        parts.append(f"<p><b>{text}<br>")
                    elif rng.random() < 0.15:
                        parts.append(f'<p><a href="/x">{text}</a></p>')
                    else:
                        parts.append(f"<p>{text}</p>")
                elif kind < 0.8:
                    text = words(between(1, 9), stop=False)
                    parts.append(tag(pick(["h2", "h3", "h4"]), text))
                elif kind < 0.9:
                    items = [words(between(1, 15), stop=rng.random() < 0.5) for _ in range(between(1, 5))]
                    main.update(items)
                    parts.append(tag(pick(["ul", "ol"]), "".join(f"<li>{x}</li>" for x in items)))
                    continue
                elif kind < 0.95:
                    parts.append(f"<blockquote><p>{text}</p></blockquote>" if rng.random() < 0.5 else f"<pre>{text}</pre>")
                else:
                    cells = [words(between(1, 5), stop=False) for _ in range(4)]
                    main.update(cells)
                    parts.append("<table><tr><td>" + "</td><td>".join(cells[:2]) + "</td></tr><tr><td>" + "</td><td>".join(cells[2:]) + "</td></tr></table>")
                    continue
                main.add(text)
            return "".join(parts)

        def boiler(kind: str) -> str:
            said = _SAID[kind] if rng.random() < 0.4 else ""
            spec = pick(_BOILER[kind])
            if kind in ("menu", "share") or kind in ("footer", "side", "header") and rng.random() < 0.4:
                items = [f'<a href="/{k}">{words(between(1, 4), said, False)}</a>' for k in range(between(2, 8))]
                inner = "".join(f"<li>{x}</li>" for x in items) if spec.startswith("ul") else "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)
                if rng.random() < 0.3:
                    inner = f"<h3>{words(3, said, False)}</h3>{inner}" if not spec.startswith("ul") else inner
                return tag(spec, inner)
            if kind == "comments":
                own = [f"<p>{words(between(3, 60), said)}</p>" for _ in range(between(1, 5))]
                return tag(spec, ("<h3>Comments</h3>" if rng.random() < 0.5 else "") + "".join(tag(pick(["div class=comment", "li", "div class=reply", "article class=comment", "div"]), x) for x in own))
            if kind == "form":
                return tag(spec, f"<label>{words(2, said, False)}</label><input name=q><button>{words(1, said, False)}</button>" + (f"<p>{words(9, said)}</p>" if rng.random() < 0.4 else ""))
            text = words(between(2, 40), said, rng.random() < 0.7)
            if kind == "footer" and rng.random() < 0.6:
                text = f"&copy; {text}"
            if kind == "header" and rng.random() < 0.5:
                return tag(spec, f"<h1>{words(3, said, False)}</h1>" + (f"<p>{text}</p>" if rng.random() < 0.5 else ""))
            how = rng.random()
            return tag(spec, text if how < 0.5 or spec.startswith("p") else f"<p>{text}</p>" if how < 0.8 else f"<h3>{words(3, said, False)}</h3><p>{text}</p>")

        title = words(between(2, 12), stop=False)
        main.add(title)
        head = f"<h1>{title}</h1>"
        if rng.random() < 0.15:
            head = f"<header>{head}</header>"
        k = between(0, 5) if rng.random() < 0.3 else between(3, 16)
        inside = head
        while k > 0:
            step = between(1, 8)
            inside += body(min(step, k))
            k -= step
            if k > 0 and rng.random() < 0.3:
                inside += boiler(pick(["ad", "share", "side", "form", "notice", "ad"]))
        if rng.random() < 0.2:
            inside += boiler(pick(["comments", "share", "side"]))
        bare = rng.random() < 0.08
        page = inside if bare else tag(pick(_MAIN[:1]) if rng.random() < 0.4 else pick(_MAIN), inside)
        before = "".join(boiler(x) for x in ("menu", "header", "notice", "ad", "form", "menu") if rng.random() < (0.15 if bare else 0.45))
        after = "".join(boiler(x) for x in ("share", "comments", "side", "ad", "form", "notice", "footer") if rng.random() < (0.15 if bare else 0.4))
        page = before + page + after
        for _ in range(between(0, 3)):
            page = tag(pick(_WRAP), page)
        out.append((f"<html><head><title>{title}</title></head><body>{page}</body></html>", main))
    return out


@lru_cache(1)
def labeller(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    return train(page_sample(pages, seed), epochs=epochs, seed=seed)


def extract(pages: DataFrame, net: BiLstm | None = None, *, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    ship(pages.sparkSession)
    weights = (net or labeller()).w
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLstm(0)
        net.w = weights
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                cut, stop, size = [], at, 0
                while stop < batch.num_rows and (stop == at or size < batch_chars):
                    html = batch.column(2)[stop].as_py() or ""
                    size += len(html)
                    cut.append(blocks(html))
                    stop += 1
                texts = ["\n".join(t for (_, t, _), main in zip(page, labels) if main) for page, labels in zip(cut, net.label(cut))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = stop

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
