"""Main-text extraction: a recurrent labeller over a page's leaf blocks.

A page is cut to leaf blocks: runs of text between block-level tags, each with its path of open
elements. A numpy bidirectional LSTM reads, block by block, a vector of hashed path parts (tag names,
class and id words), hashed words and a few counts, in both directions, so each block is judged in the
context of the whole page. Blocks judged as main text are joined in page order.

The labeller is trained here, once a process, on generated pages whose blocks are known (seeded; the
same weights each time), and is sent to the tasks. Pages are batched by length inside a task; every
page goes through whole.

Text of script, style, textarea and iframe elements and comments is never a block; formulas, drawings and
the like are text as any other. Character references are decoded, white space inside a block becomes one space, blocks are joined by one line break.

Defined cases: null, empty or tag-free html works like any other (no blocks give an empty text); repeated
rows are handled one by one; null url and page_id pass through; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that part blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W_]+")
_TERM = re.compile(r"[^\W_]+|©")
_ENDS = re.compile(r"[.!?…][^\w.!?…]{0,12}\Z")
PATHS, WORDS, EXTRA, HIDDEN = 128, 32, 8, 16
#: No block below this is main text, whatever else the page has.
SECOND_LOOK = 0.15
INPUTS = PATHS + WORDS + EXTRA


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def leaf_blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = pos = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that what is not open is not looked for
    last = page.rfind(">")  # no tag ends after it, so nothing is searched there

    def drop(k: int) -> None:
        opened.subtract(t for t, _ in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                path = tuple(x for tag, names in stack for x in (tag, *names))
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    size = len(page)
    while pos < size:
        m = _TAG.search(page, pos) if pos <= last else None
        raw = page[pos : m.start()] if m else page[pos:]
        if raw:
            parts.append(raw)
            if opened["a"]:
                linked += len(raw)
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if closing:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    drop(k)
                    break
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if opened["svg"] or opened["math"]:  # a block ends an open drawing or formula
                drop(next(k for k, (t, _) in enumerate(stack) if t in ("svg", "math")))
            for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[k][0] == "p":  # a block ends an open paragraph
                    drop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            for k in range(len(stack) - 1, -1, -1) if tag in _CLOSES else ():
                if stack[k][0] in _CLOSES[tag]:
                    drop(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        elif tag in ("br", "img"):
            parts.append(" ")
        if tag not in VOID:
            names = tuple("." + w.lower() for n in _NAMES.findall(attrs) for w in _WORD.findall(n[0] or n[1] or n[2])) if attrs else ()
            stack.append((tag, names))
            opened[tag] += 1
    flush()
    return out


@lru_cache(maxsize=200_000)
def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words (share of the block), counts."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    for k, b in enumerate(blocks):
        for part in b.path:
            x[k, _bucket(part, PATHS)] = 1
        words = _TERM.findall(b.text) or [""]  # signs between words say nothing, but for the one below
        places = [_bucket(w, WORDS) for w in words]
        x[k, PATHS : PATHS + WORDS] = np.bincount(places, minlength=WORDS) / len(words)
        e = x[k, PATHS + WORDS :]
        size = len(b.text)
        e[0] = math.log1p(len(words)) / 4
        e[1] = min(b.linked / size, 1)
        e[2] = _ENDS.search(b.text) is not None
        e[3] = len(b.path) / 10
        e[4] = k / len(blocks)
        e[5] = b.path[-1:] == ("p",)
        e[6] = sum(map(str.isdigit, b.text)) / size
        e[7] = 1
    return x


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w["x" + d] = (r.normal(size=(INPUTS, 4 * HIDDEN)) / np.sqrt(40)).astype(np.float32)
            self.w["h" + d] = (r.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.w["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        self.w["o"] = (r.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        pre = x.reshape(n * steps, -1) @ self.w["x" + d] + self.w["c" + d]
        pre = pre.reshape(n, steps, -1)
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            th = np.tanh(new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        both = [self._direction(x, mask, d, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"]
        hidden = np.concatenate(both, 2)
        if tapes is not None:
            tapes["hidden"] = hidden
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w["o"] + self.w["p"], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes: dict = {}
        p = self.forward(x, mask, tapes)
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", dz, tapes["hidden"]), "p": np.array([dz.sum()], np.float32)}
        for k, d in enumerate("fb"):
            up = dz[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            pre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc, gh = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32), np.zeros_like(self.w["h" + d])
            for t, h, c, i, f, o, cand, th, m in reversed(tapes[d]):
                dh_all = dh + up[:, t]
                dnew = m * (dc + dh_all * o * (1 - th * th))
                do = m * dh_all * th
                z = np.concatenate([dnew * cand * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - cand * cand)], 1)
                pre[:, t] = z
                gh += h.T @ z
                dh = z @ self.w["h" + d].T + (1 - m) * dh_all
                dc = dnew * f + (1 - m) * dc
            flat = pre.reshape(-1, 4 * HIDDEN)
            g["x" + d], g["h" + d], g["c" + d] = x.reshape(-1, INPUTS).T @ flat, gh, flat.sum(0)
        return g


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((len(rows), steps, INPUTS), np.float32), np.zeros((len(rows), steps), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


MARK = ""


def training_page(r: random.Random) -> str:
    """A generated page; MARK stands in every block of its article."""
    sounds = "an be cor de el fin gra ho in jo ka lun me no op pra qui re so ti un ver wo xi yen zo".split()
    word = lambda: "".join(r.choices(sounds, k=r.randint(1, 4)))

    def phrase(lo: int, hi: int) -> str:
        text = " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(min(lo, hi), hi)))
        return text

    def signed(text: str) -> str:
        """Some texts carry a sign after each word, one sign or several."""
        if r.random() < 0.07:
            signs = r.choice((("***", "$$$", "%%%", "&amp;&amp;&amp;", "###"), (" |",), (" /", " -"), ("*", "+")))
            return " ".join(w + r.choice(signs) for w in text.split())
        return text

    sentence = lambda lo, hi: phrase(lo, hi).capitalize() + r.choice((".", ".", ".", "!", "?"))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    attr = lambda *names: f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-1", " wide", "-box"))}"' if r.random() < 0.85 else ""
    named = lambda *names: f' {r.choice(("class", "id"))}="{r.choice(names)}{r.choice(("", "", "-1", " wide", "-box"))}"'
    made = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=r.randint(4, 10)))
    machine = lambda: r.choice(("", f' class="{made()}"', f' class="{made()} {made()}-{made()}"', f' id="{made()}"'))
    often = lambda *names: named(*names) if r.random() < 0.8 else machine()
    states = ("comments-open", "has-sidebar", "social-share", "with-menu", "cookie-bar", "no-ads", "nav-open", "widget-area", "footer-fixed", "related-posts-on", "banner-top", "newsletter-on")
    state = lambda: f' class="{" ".join(r.sample(("post", "page", "entry", "hentry", "single", "wrap", *states), r.randint(1, 4)))}"'

    def menu() -> str:
        items = [link() for _ in range(r.randint(2, 9))]
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)
        return f"<nav{attr('menu', 'nav', 'navbar')}>{body}</nav>" if r.random() < 0.7 else f"<div{often('menu', 'nav', 'navigation', 'breadcrumb', 'topbar')}>{body}</div>"

    def advert() -> str:
        t = r.choice(("div", "div", "aside", "p", "section"))
        return f"<!-- ad --><{t}{named('ad', 'ads', 'advert', 'banner', 'sponsor', 'promo')}>{r.choice((sentence(3, 14), phrase(2, 8), '<p>' + sentence(4, 30) + '</p>'))}</{t}>"

    def notice() -> str:
        return f"<div{named('cookie', 'notice', 'consent', 'alert', 'newsletter', 'popup', 'modal')}>{r.choice(('', '<p>'))}{sentence(5, 25)} {r.choice(('', '<button>' + phrase(1, 2) + '</button>'))}</div>"

    def sidebar() -> str:
        inner = "".join(r.choice((f"<h3>{phrase(1, 4)}</h3>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{sentence(4, 25)}</p>")) for _ in range(r.randint(1, 5)))
        return f"<aside{attr('sidebar', 'related', 'widget')}>{inner}</aside>" if r.random() < 0.5 else f"<div{named('sidebar', 'related', 'widget', 'recommended', 'share', 'social', 'tags')}>{inner}</div>"

    def form() -> str:
        return f"<form{attr('search', 'login', 'subscribe')}><label>{phrase(1, 4)}</label><input type=text> <button>{phrase(1, 2)}</button><select><option>{word()}<option>{word()}</select>{r.choice(('', '<p>' + sentence(4, 16) + '</p>'))}</form>"

    def comments() -> str:
        each = lambda: f"<{t}{attr('comment', 'reply')}>{r.choice(('', '<h4>' + phrase(1, 2) + '</h4>'))}<p>{sentence(3, 60)}</p></{t}>"
        t = r.choice(("div", "li", "article"))
        return f"<{s}{named('comments', 'comment-list', 'responses', 'discussion', 'disqus')}><h3>{phrase(1, 3)}</h3>{''.join(each() for _ in range(r.randint(1, 6)))}</{s}>" if (s := r.choice(("section", "div", "ol"))) else ""

    in_divs = r.random() < 0.1

    def paragraph() -> str:
        text = " ".join(sentence(1 if r.random() < 0.15 else 4, r.choice((3, 8, 25, 40))) for _ in range(r.choice((1, 1, 2, 4, 8))))
        text, k = signed(text), r.random()
        if in_divs and k < 0.8:
            return f"<div>{MARK}{text}</div>"
        if k < 0.1:
            return f"<p><b>{MARK}{text}<br>"
        if k < 0.18:
            return f"<p>{MARK}{text}"
        if k < 0.3:
            return f"<p>{MARK}{text} {link()} {phrase(2, 9)}.</p>"
        if k < 0.33:
            return f'<p><a href="/{word()}">{MARK}{text}</a></p>'
        if k < 0.36:
            return f"<{(q := r.choice(('blockquote', 'pre', 'figcaption', 'h2', 'h3')))}>{MARK}{phrase(2, 14)}</{q}>"
        if k < 0.42:
            return f"<{(q := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{MARK}{phrase(2, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{q}>"
        if k < 0.45:
            return "<table>" + "".join(f"<tr><td>{MARK}{phrase(1, 4)}<td>{MARK}{r.randint(1, 9999)}" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<p>{MARK}{text}</p>"

    title = phrase(2, 9)
    body = [f"<h1>{MARK}{title}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20))):
        body.append(paragraph())
        if r.random() < 0.06:
            body.append(r.choice((advert, notice, sidebar, form))())
    if r.random() < 0.1:
        body.append(comments())
    inner = "".join(body)
    if r.random() < 0.1:  # paragraphs parted by line breaks only
        lines = [MARK + " ".join(sentence(4, 30) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 6))]
        inner = (f"<h1>{MARK}{title}</h1>" if r.random() < 0.5 else "") + r.choice(("<br><br>", "<br/>\n<br/>", "<br>")).join(lines)
    k = r.random()
    if k < 0.3:
        main = f"<article{attr('post', 'entry', 'story')}>{inner}</article>"
    elif k < 0.4:
        main = f"<main{attr('content', 'main')}>{inner}</main>"
    elif k < 0.57:
        main = f"<div{named('content', 'article', 'post', 'entry', 'story', 'main', 'text')}>{inner}</div>"
    elif k < 0.66:
        main = f"<section{r.choice((machine(), attr('content', 'story', 'body')))}>{inner}</section>"
    elif k < 0.76:
        main = f"<div>{inner}</div>"
    elif k < 0.84:
        main = f"<div{machine()}>{inner}</div>"
    elif k < 0.92:
        main = f"<{(q := r.choice(('div', 'article', 'section', 'main')))}{state()}>{inner}</{q}>"
    elif k < 0.97:
        main = inner
    else:
        main = f"<table{machine()}><tr><td{machine()}>{inner}</td></tr></table>"
    if r.random() < 0.25:
        main = f"<main><div{attr('wrapper', 'container', 'row')}>{main}</div></main>"
    for _ in range(r.choice((0, 0, 1, 2, 3))):
        main = f"<div{r.choice((machine, machine, state))()}>{main}</div>"
    before = [f() for f in (menu, advert, notice, sidebar, form) for _ in range(r.randint(0, 1))]
    if r.random() < 0.4:
        before.append(f"<header{attr('header', 'masthead')}>{r.choice((menu(), phrase(1, 5), '<h2>' + phrase(1, 4) + '</h2>' + menu()))}</header>")
    after = [f() for f in (comments, sidebar, advert, notice, menu, form) if r.random() < 0.3]
    foot = r.choice(("&copy; ", "Copyright ", "")) + phrase(1, 3) + r.choice((".example.com", ".org", " Ltd", "")) + r.choice((" &middot; ", " | ", " - ", " ")) + sentence(3, 14)
    if r.random() < 0.85:
        after.append(f"<footer{attr('footer')}>{r.choice((foot, '<p>' + foot + '</p>'))}</footer>" if r.random() < 0.75 else f"<div{often('footer', 'copyright', 'legal')}>{foot}</div>")
    if r.random() < 0.7:
        r.shuffle(before)
        r.shuffle(after[:-1])
    if r.random() < 0.06:  # hardly any page around the text
        return r.choice((main, f"<body>{main}", f"<html><body>{main}</body></html>", f"{MARK}{' '.join(sentence(4, 30) for _ in range(r.randint(1, 6)))}", f"{before[0] if before else ''}{main}"))
    end = "</body></html>" if r.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{state() if r.random() < 0.25 else ''}>{''.join(before)}{main}{''.join(after)}{end}"


@lru_cache(maxsize=1)
def trained(pages: int = 2600, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Labeller:
    r, model = random.Random(seed), Labeller()
    made = []
    for _ in range(pages):
        blocks = leaf_blocks(training_page(r))
        y = np.array([MARK in b.text for b in blocks], np.float32)
        # an article must be known without its containers' names too
        gone = {x for b in blocks for x in b.path if x[0] == "." and r.random() < 0.4} if r.random() < 0.3 else set()
        clean = [Block(tuple(x for x in b.path if not y[k] or x not in gone), b.text.replace(MARK, "") or "-", b.linked) for k, b in enumerate(blocks)]
        made.append((vectors(clean), y))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, total = 0, epochs * -(-pages // batch)
    for _ in range(epochs):
        order = sorted(range(pages), key=lambda k: (len(made[k][1]) // 4, r.random()))
        groups = [order[k : k + batch] for k in range(0, pages, batch)]
        r.shuffle(groups)
        for group in groups:
            x, mask = _padded([made[k][0] for k in group])
            y = np.zeros_like(mask)
            for row, k in enumerate(group):
                y[row, : len(made[k][1])] = made[k][1]
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] -= (rate * (1 - 0.9 * step / total) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def main_text(pages: list[str], model: Labeller, group: int = 64) -> list[str]:
    """The main text of each page."""
    blocks = [leaf_blocks(p) for p in pages]
    texts = [""] * len(pages)
    order = sorted((k for k, b in enumerate(blocks) if b), key=lambda k: len(blocks[k]))
    for at in range(0, len(order), group):
        own = order[at : at + group]
        while own:
            take = own  # bounded work for very long pages: fewer of them at once
            while len(take) > 1 and len(take) * len(blocks[take[-1]]) > 200_000:
                take = take[: len(take) // 2]
            p = model.forward(*_padded([vectors(blocks[k]) for k in take]))
            for row, k in enumerate(take):
                own_p = p[row, : len(blocks[k])]
                # a page without any block at one half gets a second look, at half of what its best block has
                least = 0.5 if own_p.max() >= 0.5 else max(own_p.max() / 2, SECOND_LOOK)
                texts[k] = "\n".join(b.text for b, q in zip(blocks[k], own_p, strict=True) if q >= least)
            own = own[len(take) :]
    return texts


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_text([h or "" for h in part.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
