"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks (runs of text between block-level tags, with
their open ancestors).  Each block is described by its ancestors' tags, the
words of their class and id attributes, and its own text (length, links,
punctuation, place).  A two-label CRF, trained by conditional likelihood on
labelled pages, marks the main text; Viterbi finds the best labelling.

The labelled pages are made here (``labelled_pages``): layouts with articles in
several kinds of container among menus, headers, sidebars, notices, adverts,
forms, comments and footers, labelled by construction.  Any other labelled
pages can be given to ``train``.

Defined cases: a null page is empty and has an empty text; unclosed and
truncated markup is read as far as it goes; very long or deeply nested pages take
time in proportion to their length, whatever tags they invent; repeated rows are read each; ties between
labellings go to "other"; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm import _shared

# Elements by their role in the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea xmp".split())
CLOSES_P = BLOCKS - frozenset("body head html option title caption td th tr tbody thead tfoot legend".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div nav aside main body menu form select".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=|\"|')*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")


#: Names of classes and ids are read from so many nearest ancestors, and so many words of each (features only; no text is left out).
NEAREST, NAMES = 32, 16


class Block:
    __slots__ = ("text", "leaf", "tags", "marks", "linked", "raw")

    def __init__(self, text: str, leaf: str, tags: frozenset, marks: frozenset, linked: int, raw: int) -> None:
        self.text, self.leaf, self.tags, self.marks, self.linked, self.raw = text, leaf, tags, marks, linked, raw


class _Open:
    """The open elements.  Each knows the tags above it, so that a block costs no walk up the stack."""

    def __init__(self, known: frozenset | None = None) -> None:
        self.known = known  # tags that a model has weights for; others say nothing to it, and are not carried along
        self.stack: list[tuple[str, frozenset, frozenset, str]] = []  # name, own marks, tags so far, nearest block tag
        self.count: Counter = Counter()

    def push(self, name: str, marks: frozenset) -> None:
        tags, leaf = self.stack[-1][2:] if self.stack else (frozenset(), "")
        carried = name not in tags and (self.known is None or name in self.known)
        self.stack.append((name, marks, tags | {name} if carried else tags, name if name in BLOCKS else leaf))
        self.count[name] += 1

    def cut(self, k: int) -> None:
        for name, *_ in self.stack[k:]:
            self.count[name] -= 1
        del self.stack[k:]

    def close(self, names: tuple[str, ...], within: frozenset = frozenset()) -> None:
        """Close the innermost element of one of the names, unless one of ``within`` lies in between."""
        if any(self.count[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in names:
                    self.cut(k)
                    return
                if self.stack[k][0] in within:
                    return

    def tags(self) -> frozenset:
        return self.stack[-1][2] if self.stack else frozenset()

    def leaf(self) -> str:
        return self.stack[-1][3] if self.stack else ""

    def marks(self) -> frozenset:
        return frozenset().union(*(e[1] for e in self.stack[-NEAREST:]))


def blocks_of(page: str | None, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order, with decoded text whose white space is single spaces.

    ``known``: the tags to note of a block's ancestors; all, where it is None.
    """
    page = page or ""
    up = _Open(known)
    out: list[Block] = []
    held: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, up.leaf(), up.tags(), up.marks(), linked, sum(map(len, held))))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if up.count["a"]:
                linked += len(text)

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        token = m.group()
        got = _NAME.match(token)
        if not got:
            continue
        if not token.endswith(">"):
            break  # the page ends inside a tag
        name = got.group(1).lower()
        if name in BLOCKS:
            flush()
        if name == "br":
            held.append(" ")
        if token[1] == "/":
            up.close((name,))
            continue
        if name in CLOSES_P:
            up.close(("p",))
        if name in SIBLINGS:
            up.close(SIBLINGS[name], SCOPE)
        if name in VOID or (token.endswith("/>") and name not in BLOCKS):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = (_PART.findall((a.group(1) or a.group(2) or a.group(3) or "").lower())[:NAMES] for a in _ATTR.finditer(token))
        up.push(name, frozenset(w for ws in words for w in ws))
    flush()
    return out


def describe(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for b in blocks:
        size = len(b.text)
        words = b.text.count(" ") + 1
        names = ["bias", f"leaf:{b.leaf}"]
        names += [f"in:{t}" for t in b.tags] + [f"mark:{w}" for w in b.marks]
        names.append(f"len:{min(size.bit_length(), 10)}")
        names.append(f"links:{min(int(4 * b.linked / max(b.raw, 1)), 4)}")
        names.append(f"stops:{min(sum(b.text.count(c) for c in '.!?'), 4)}")
        names.append(f"commas:{min(b.text.count(','), 3)}")
        if words < 4:
            names.append("few-words")
        if "©" in b.text:
            names.append("copyright")
        out.append(names)
    return out


class Crf:
    """Weights of a two-label (0 other, 1 main) linear-chain CRF."""

    def __init__(self, state: dict[str, tuple[float, float]], move: list[list[float]], start: list[float]) -> None:
        self.state, self.move, self.start = state, move, start
        self.tags = frozenset(f.removeprefix("in:") for f in state if f.startswith("in:"))

    def viterbi(self, features: list[list[str]]) -> list[int]:
        state, (m00, m01), (m10, m11) = self.state, *self.move
        back: list[tuple[int, int]] = []
        a = b = 0.0
        zero = (0.0, 0.0)
        for i, names in enumerate(features):
            e0 = e1 = 0.0
            for f in names:
                w = state.get(f, zero)
                e0 += w[0]
                e1 += w[1]
            if i == 0:
                a, b = self.start[0] + e0, self.start[1] + e1
                continue
            from0 = (a + m00 >= b + m10, a + m01 >= b + m11)
            back.append((0 if from0[0] else 1, 0 if from0[1] else 1))
            a, b = (a + m00 if from0[0] else b + m10) + e0, (a + m01 if from0[1] else b + m11) + e1
        if not features:
            return []
        label = 0 if a >= b else 1
        path = [label]
        for pair in reversed(back):
            label = pair[label]
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.1, l2: float = 0.02) -> Crf:
    """Maximise the conditional likelihood of labelled block sequences (full batch, forward-backward, Adam)."""
    names = sorted({f for feats, _ in pages for b in feats for f in b})
    index = {f: i for i, f in enumerate(names)}
    B, T = len(pages), max(len(y) for _, y in pages)
    mask = np.zeros((B, T))
    gold = np.zeros((B, T), dtype=int)
    rows, cols = [], []
    for p, (feats, y) in enumerate(pages):
        mask[p, : len(y)] = 1
        gold[p, : len(y)] = y
        for t, b in enumerate(feats):
            rows += [p * T + t] * len(b)
            cols += [index[f] for f in b]
    rows, cols = np.array(rows), np.array(cols)
    par = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
    onehot = np.eye(2)[gold] * mask[:, :, None]
    for step in range(1, steps + 1):
        w, move, start = par
        e = np.stack([np.bincount(rows, weights=w[cols, k], minlength=B * T) for k in (0, 1)], 1).reshape(B, T, 2)
        alpha, beta = np.zeros((B, T, 2)), np.zeros((B, T, 2))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, T):
            new = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            nxt = beta[:, t + 1] + e[:, t + 1]
            new = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        logz = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        node = np.exp(alpha + beta - logz) * mask[:, :, None]
        pair = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :]
        pair = np.exp(pair - logz[..., None]) * mask[:, 1:, None, None]
        true = onehot[:, :-1, :, None] * onehot[:, 1:, None, :]
        diff = (node - onehot).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(cols, weights=diff[rows, k], minlength=len(names)) for k in (0, 1)], 1) + l2 * w,
            (pair - true).sum((0, 1)) + l2 * move,
            (node[:, 0] - onehot[:, 0]).sum(0) + l2 * start,
        ]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            par[k] = par[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w, move, start = par
    return Crf({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, move.tolist(), start.tolist())


# Names that page parts go by in the labelled layouts.
MAIN_NAMES = ("article", "content", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "main-content", "story-body")
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toc"),
    "header": ("header", "masthead", "top", "banner", "site-header", "branding", "logo"),
    "footer": ("footer", "bottom", "site-footer", "copyright", "legal", "colophon"),
    "sidebar": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "more"),
    "notice": ("notice", "cookie", "consent", "alert", "cookie-banner", "gdpr", "modal", "popup", "overlay", "paywall", "message"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact"),
    "comments": ("comments", "comment", "comment-list", "replies", "reply", "disqus", "discussion", "responses"),
    "hatnote": ("hatnote", "dablink", "disambiguation", "note", "rellink", "navbox"),
    "share": ("share", "social", "tags", "meta", "byline", "author", "pagination"),
}
TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "p", "dialog"),
        "advert": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul", "p"), "hatnote": ("div", "p")}


def _words(rng: random.Random, n: int) -> str:
    bits = "an er in on re th ti en at ou es st al ar le de la ro mi ka so be lu po".split()
    return " ".join("".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random, most: int = 8) -> str:
    return " ".join(_words(rng, rng.randint(1, 18)).capitalize() + rng.choice((".", ".", ",", "?", "!", " %%%.", "")) for _ in range(rng.randint(1, most)))


def labelled_pages(n: int = 700, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(page, texts of its main blocks), the layouts drawn by rule."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        main: set[str] = set()
        unique = iter(range(10**6))

        def other(kind: str) -> str:
            tag, name = rng.choice(TAGS[kind]), rng.choice(OTHER_NAMES[kind])
            attr = rng.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}"', f' class="site-{name}"')) if tag in ("div", "section", "p", "ul", "ol", "dialog") or rng.random() < 0.5 else ""
            link = lambda: f'<a href="/{_words(rng, 1)}">{_words(rng, rng.randint(1, 3))} {next(unique)}</a>'
            text = f"{_sentences(rng, 3)} {next(unique)}"
            if kind == "menu" or (kind in ("sidebar", "share", "footer") and rng.random() < 0.5):
                items = [link() for _ in range(rng.randint(2, 8))]
                inner = "".join(f"<li>{x}</li>" for x in items) if tag in ("ul", "ol") else "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            elif kind == "hatnote":
                inner = f"{_words(rng, 3).capitalize()}, {link()}."
            elif kind == "form":
                inner = f"<label>{text}</label><input name=q><button>{_words(rng, 2)}</button>"
            elif kind == "comments":
                inner = f"<h3>{_words(rng, 2)} {next(unique)}</h3>" * (rng.random() < 0.6) + "".join(
                    rng.choice(('<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p>{}</p>", "<article><p>{}</p></article>")).format(f"{_sentences(rng, 4)} {next(unique)}") for _ in range(rng.randint(1, 5)))
            elif kind == "footer":
                inner = f"{rng.choice(('&copy; ', '© ', ''))}{text}"
            else:
                inner = text if tag == "p" or rng.random() < 0.5 else f"<p>{text}</p>"
            return f"<{tag}{attr}>{inner}</{tag}>"

        def say(tag: str) -> str:
            if tag in ("td", "th", "dt"):  # cells are short, and many are numbers
                text = str(next(unique)) if rng.random() < 0.5 else f"{_words(rng, rng.randint(1, 3)).capitalize()} {next(unique)}"
            else:
                text = f"{_sentences(rng) if tag in ('p', 'li', 'blockquote', 'dd') else _words(rng, rng.randint(2, 9)).capitalize()} {next(unique)}"
            main.add(" ".join(text.split()))
            return f"<{tag}>{text}</{tag}>" if tag != "p" or rng.random() < 0.8 else f"<p><b>{text}<br>"

        def table() -> str:
            wide = rng.randint(2, 5)
            head = "<tr>" + "".join(say("th") for _ in range(wide)) + "</tr>" if rng.random() < 0.7 else ""
            rows = "".join("<tr>" + "".join(say("td") for _ in range(wide)) + "</tr>" for _ in range(rng.randint(1, 6)))
            return f"<table>{say('caption') if rng.random() < 0.2 else ''}{head}{rows}</table>"

        def bold() -> str:
            text = f"{_words(rng, rng.randint(1, 6)).capitalize()} {next(unique)}"
            main.add(text)
            return rng.choice((f"<b>{text}</b><br>", f"<font size=5>{text}</font><br>")) if rng.random() < 0.5 else f"<div><b>{text}</b></div>"

        def plain() -> str:
            """Paragraphs without a container of their own: under body, in a nameless div, or in the cell of a layout table."""
            inside = [rng.choice((say("h1"), say("h2"), bold() + "<p>"))] if rng.random() < 0.6 else []
            inside += [say("p") for _ in range(rng.randint(1, 6))]
            if rng.random() < 0.2:
                inside.append(table())
            body = "".join(inside)
            x = rng.random()
            return body if x < 0.4 else f"<div>{body}</div>" if x < 0.6 else f"<table><tr><td>{body}</td></tr></table>" if x < 0.8 else f"<center>{body}</center>"

        def article() -> str:
            inside = [say("h1")] if rng.random() < 0.8 else []
            if rng.random() < 0.2:
                inside.insert(rng.randint(0, len(inside)), other("hatnote"))
            for _ in range(rng.randint(1, 9)):
                x = rng.random()
                inside.append(table() if x < 0.06 else "<dl>" + say("dt") + say("dd") + "</dl>" if x < 0.09 else "<pre>" + say("code") + "</pre>" if x < 0.11 else say("p") if x < 0.7 else say("h2") if x < 0.8 else "<ul>" + say("li") + say("li") + "</ul>" if x < 0.88 else say("blockquote") if x < 0.94 else f"<div>{say('p')}</div>")
                if rng.random() < 0.06:
                    inside.append(other(rng.choice(("advert", "share", "sidebar", "form", "notice"))))
            if rng.random() < 0.15:
                inside.append(other("comments"))
            tag = rng.choice(("article", "article", "main", "div", "div", "section"))
            name = rng.choice(MAIN_NAMES)
            attr = rng.choice((f' class="{name}"', f' id="{name}"')) if tag in ("div", "section") or rng.random() < 0.3 else ""
            body = f"<{tag}{attr}>{''.join(inside)}</{tag}>"
            return f"<main>{body}</main>" if tag == "article" and rng.random() < 0.2 else f'<div class="{rng.choice(("container", "wrapper", "page", "row", "col"))}">{body}</div>' if rng.random() < 0.3 else body

        before = [other(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.55]
        after = [other(k) for k in ("share", "comments", "sidebar", "form", "advert", "menu", "notice", "footer") if rng.random() < 0.45]
        if rng.random() < 0.3:
            before.append(other("sidebar"))
        if rng.random() < 0.15:  # nothing but the text
            before, after = [], []
        title = f"<head><title>{_words(rng, 4)} {next(unique)}</title></head>" if rng.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html>{title}<body>{''.join(before)}{plain() if rng.random() < 0.2 else article()}{''.join(after)}</body></html>"
        out.append((page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.1 else page, main))
    return out


def sequences(pages: list[tuple[str, set[str]]]) -> list[tuple[list[list[str]], list[int]]]:
    out = []
    for page, main in pages:
        blocks = blocks_of(page)
        if blocks:
            # the last block of a cut page may be the beginning of a main one
            out.append((describe(blocks), [int(b.text in main or (b is blocks[-1] and any(x.startswith(b.text) for x in main))) for b in blocks]))
    return out


_MODEL: dict[tuple, Crf] = {}


def default_model(n: int = 700, seed: int = 11) -> Crf:
    if (n, seed) not in _MODEL:
        _MODEL[n, seed] = train(sequences(labelled_pages(n, seed)))
    return _MODEL[n, seed]


def extract(page: str | None, model: Crf) -> str:
    blocks = blocks_of(page, model.tags)
    labels = model.viterbi(describe(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def main_text(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""
    spark = pages.sparkSession
    _shared.ship(spark)
    known = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = known.value
        for batch in batches:
            texts = [extract(x.as_py(), crf) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return main_text(_shared.table(spark, sf_dir, "pages"))
