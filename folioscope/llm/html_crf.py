"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into blocks: runs of text between boundaries of block-level elements, each with the elements around it.
Features of a block are its ancestors' tags and the words of their class and id, and properties of its text. A chain of
two labels (main, other) over the page's blocks, with weights for features and for neighbouring labels, is trained by
maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages mark main text by the attribute data-label="main", which features don't see. `training_pages` writes a
fixed set of them from a seed: many layouts, invented words.

White space inside a block becomes one blank (a line break element counts as white space); character references are
decoded; main blocks are joined by one line end in page order. Scripts, styles, comments and the like are no text.
Nulls: null or empty html gives an empty text. Broken markup (elements not closed, stray end tags, a page cut off inside
a tag; a head, noscript, svg, object, iframe or template without its end tag or closed in itself; a quote that isn't closed) is read as far as it
goes. Repeated rows are extracted each. Of labellings that are equally likely, the one with fewer main blocks at the end is taken. A very
long page is read as a whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    # a quote that isn't closed before white space or the tag's end is an attribute's character: the tag ends at the next >
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*(?=>|\Z)|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that are no text if they are closed; without an end tag only the tag itself is left out.
_WHOLE = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("noscript", "template", "svg", "iframe", "object")}
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=\"'-])(hidden)(?![\w=-])")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their own kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_WORDS = re.compile(r"[a-z]+|\d+")
HINTS = ("cookie", "subscribe", "advert", "sponsor", "comment", "repl", "sign up", "log in", "privacy", "share", "copyright", "©", "newsletter", "all rights", "terms", "follow us", "read more", "related", "menu", "search", "consent", "accept")


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # tag and class words of each element around it
    linked: int  # characters inside links
    main: bool  # by data-label


def _names(attrs: str) -> tuple[tuple[str, ...], bool]:
    words: list[str] = []
    main = False
    for name, a, b, c, hidden in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if hidden or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            words.append("hidden")
        elif name in ("class", "id", "role"):
            words += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        elif name == "data-label":
            main = value == "main"
    return tuple(dict.fromkeys(words)), main


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, tuple((t, n) for t, n, _ in stack), min(linked, len(text)), any(m for _, _, m in stack)))
            parts.clear()
        linked = 0

    def close(tags: tuple[str, ...]) -> None:
        nonlocal in_link
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                in_link -= sum(t == "a" for t, _, _ in stack[k:])
                del stack[k:]
                return

    at = 0
    html = html or ""
    open_ended: set[str] = set()  # elements of _WHOLE that have no end tag from here on
    while m := _MARKUP.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "head":  # both of its tags may be missing; what it holds is no text of its own
            continue
        if tag in _WHOLE:
            if not m["end"] and not m["attrs"].rstrip().endswith("/") and tag not in open_ended:
                if end := _WHOLE[tag].search(html, at):
                    at = end.end()
                else:
                    open_ended.add(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            close((tag,))
        elif tag not in VOID:
            if tag in SIBLINGS:
                inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("ul", "ol", "dl", "table", "select", "article", "section", "div", "td", "main", "body")), -1)
                if any(t in SIBLINGS[tag] for t, _, _ in stack[inner + 1 :]):
                    close(SIBLINGS[tag])
            elif tag in BLOCKS and any(t == "p" for t, _, _ in stack):
                close(("p",))
            if not m["attrs"].rstrip().endswith("/") or tag in BLOCKS:
                names, main = _names(m["attrs"]) if "=" in m["attrs"] or "hidden" in m["attrs"] else ((), False)
                stack.append((tag, names, main))
                in_link += tag == "a"
    parts.append(html[at:])
    flush()
    return found


#: Tags and name words that mark what isn't main text; a block inside one gets a shared feature besides its own.
ASIDE_TAGS = frozenset("nav footer aside form button select label menu dialog option textarea search".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar banner logo breadcrumb breadcrumbs crumbs footer foot copyright legal colophon sidebar side rail widget aside related recommended recommendations more promo promotion sponsor sponsored sponsors ad ads adv advert adverts advertisement adsense dfp cookie cookies consent notice notices gdpr alert popup modal overlay banner newsletter subscribe subscription signup login signin search form share sharing social comment comments commentlist respond reply replies discussion disqus thread tags tag pagination pager paging byline author bio meta tools toolbar hidden skip contentinfo complementary navigation dialog".split()
)
#: Beginnings by which longer names count as the names above.
STEMS = ("cookie", "comment", "advert", "sidebar", "footer", "navig", "newsletter", "related", "recommend", "subscri", "sponsor", "breadcrumb", "promo", "popup", "banner", "disqus", "pagination", "social", "consent", "masthead")
MAIN_WORDS = frozenset("article content contents post entry main story body text maincontent page".split())

_OFF_WORDS = ASIDE_WORDS | frozenset(STEMS)


@lru_cache(maxsize=100_000)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    tags = {t for t, _ in path}
    words = {next((x for x in STEMS if w.startswith(x)), w) for t, names in path for w in names if t not in ("html", "body")}
    inside = "article" in tags or "main" in tags or bool(words & MAIN_WORDS)
    outer_header = "header" in tags and not any(t in ("article", "main") for t, _ in path[: next((k for k, (t, _) in enumerate(path) if t == "header"), 0)])
    off = bool(tags & ASIDE_TAGS) or bool(words & _OFF_WORDS) or outer_header
    last = next((t for t, _ in reversed(path) if t in BLOCKS), "")
    out = [f"tag {t}" for t in sorted(tags)] + [f"word {w}" for w in sorted(words & (_OFF_WORDS | MAIN_WORDS))] + [f"leaf {last}", f"off {off}", f"inside {inside} {off}"]
    return tuple(out + ["outer header"] * outer_header)


def features(block: Block, before: Block | None) -> list[str]:
    text, low = block.text, block.text.lower()
    n = text.count(" ") + 1
    size = min(n.bit_length(), 7)
    density = block.linked / max(1, len(text))
    out = list(_path_features(block.path))
    out += [f"words {size}", f"links {int(density * 3.99)}", f"stop {text[-1] in '.!?'}", "bias"]
    out += [f"hint {h} {'short' if n < 60 else 'long'}" for h in HINTS if h in low]
    out.append(f"same {before is not None and before.path[:-1] == block.path[:-1]}")
    return out


@dataclass(frozen=True)
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # feature x label (0 other, 1 main)
    steps: np.ndarray  # label x next label
    first: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for k, b in enumerate(blocks):
            at = [self.index[f] for f in features(b, blocks[k - 1] if k else None) if f in self.index]
            out[k] = self.weights[at].sum(axis=0)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        emit, s = self.scores(blocks).tolist(), self.steps.tolist()
        a, b = emit[0][0] + self.first[0], emit[0][1] + self.first[1]
        back = []
        for e0, e1 in emit[1:]:
            from_a0, from_b0, from_a1, from_b1 = a + s[0][0], b + s[1][0], a + s[0][1], b + s[1][1]
            back.append((int(from_b0 > from_a0), int(from_b1 > from_a1)))
            a, b = max(from_a0, from_b0) + e0, max(from_a1, from_b1) + e1
        labels = [int(b > a)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def train(pages: list[str], rounds: int = 90, rate: float = 0.2, ridge: float = 2e-4) -> Crf:
    """Maximum likelihood by Adam; forward-backward runs over all pages at once, step by step."""
    docs = [b for b in map(blocks_of, pages) if b]
    names = [[features(b, d[k - 1] if k else None) for k, b in enumerate(d)] for d in docs]
    index = {f: i for i, f in enumerate(sorted({f for d in names for x in d for f in x}))}
    n, longest = len(docs), max(map(len, docs))
    x = np.zeros((n * longest, len(index)), np.float32)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, d in enumerate(docs):
        for k, b in enumerate(d):
            x[i * longest + k, [index[f] for f in names[i][k]]] = 1
            y[i, k], mask[i, k] = b.main, True
    w, steps, first = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    gold = np.eye(2)[y] * mask[:, :, None]
    pairs = mask[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    params, m, v = [w, steps, first], [0, 0, 0], [0, 0, 0]
    lse = lambda z, axis: np.log(np.exp(z - z.max(axis=axis, keepdims=True)).sum(axis=axis)) + z.max(axis=axis)
    for t in range(1, rounds + 1):
        emit = (x @ w).reshape(n, longest, 2)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + first
        for k in range(1, longest):
            new = lse(alpha[:, k - 1, :, None] + steps, 1) + emit[:, k]
            alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = lse(steps + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + steps + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [x.T @ (gold - node).reshape(-1, 2) / n - ridge * w, (pairs - edge).sum(axis=(0, 1)) / n - ridge * steps, (gold[:, 0] - node[:, 0]).sum(axis=0) / n]
        for j, g in enumerate(grads):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            params[j] += rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Crf(index, w, steps, first)


def training_pages(n: int = 260, seed: int = 5) -> list[str]:
    """Labelled pages of many layouts, always the same for a seed."""
    r = np.random.default_rng(seed)
    syllables = "ba co du el fi ga hu in jo ka lu me no or pa qui ra si to un ve wa xo yu za".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.integers(1, 4)))
    pick = lambda *x: x[r.integers(len(x))]

    def words(lo: int, hi: int) -> str:
        out = " ".join(word() for _ in range(r.integers(lo, hi + 1)))
        return out.capitalize() + pick(".", ".", "", "!", "?", "***", "%%%", "&amp;", " &copy;") if r.random() < 0.8 else out.upper()

    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.integers(2, 7))) + "</ul>"
    junk = lambda: pick(words(1, 4), words(5, 20), words(10, 60), f"<p>{words(3, 40)}</p>" * int(r.integers(1, 3)), menu(), f"<h3>{words(1, 4)}</h3><p>{words(2, 30)}</p>")

    def main_part() -> str:
        out = []
        for _ in range(int(r.integers(1, 9))):
            t = pick(words(1, 2), words(3, 15), words(10, 80), words(10, 80))
            if r.random() < 0.15:
                t += f" {link()} {words(1, 10)}"
            out.append(pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<div>{t}</div>", f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</li><li>{words(1, 9)}</li></ul>", f"<h2>{words(1, 6)}</h2><p>{t}</p>", f"<table><tr><td>{t}</td><td>{words(1, 3)}</td></tr></table>", f"<section><p>{t}</p></section>", f"<pre>{t}</pre>", f"<figure><figcaption>{words(2, 9)}</figcaption></figure>"))
        return "".join(out)

    def off_block(where: str) -> str:
        names = {
            "top": ("nav", "navbar", "menu", "header", "masthead", "banner", "breadcrumb", "topbar", "logo", "navigation"),
            "side": ("sidebar", "widget", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended", "newsletter", "subscribe", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "social", "share", "login", "search", "alert"),
            "end": ("footer", "copyright", "legal", "comments", "comment", "commentlist", "respond", "reply", "disqus", "related", "more", "tags", "pagination", "author-bio", "share"),
        }[where]
        name = pick(*names)
        attr = pick(f'class="{name}"', f'id="{name}"', f'class="{name}-{word()}"', f'class="{word()} {name}"', f'class="site-{name}"')
        tags = {"top": (f"<nav>{menu()}</nav>", f"<header><h1>{words(1, 4)}</h1>{menu()}</header>", f"<header><p>{words(2, 12)}</p></header>"), "side": (f"<aside><h3>{words(1, 3)}</h3><p>{words(3, 40)}</p></aside>", f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>", f"<aside>{menu()}</aside>", f"<dialog><p>{words(4, 30)}</p></dialog>"), "end": (f"<footer>&copy; {words(2, 9)} &middot; {words(2, 12)}", f"<footer><p>{words(3, 30)}</p>{menu()}</footer>", f'<section id="comments"><h2>{words(1, 3)}</h2><article class="comment"><p>{words(3, 40)}</p></article></section>', f'<ol class="commentlist"><li class="comment"><p>{words(3, 40)}</p></li></ol>')}[where]
        return pick(f"<div {attr}>{junk()}</div>", f"<section {attr}>{junk()}</section>", pick(*tags), pick(*tags), f'<div hidden>{words(2, 20)}</div>' if where == "side" else pick(*tags))

    pages = []
    for _ in range(n):
        title = f'<h1 data-label="main">{words(2, 10)}</h1>' if r.random() < 0.8 else ""
        body = main_part().replace("<p", '<p data-label="main"').replace("<pre", "<pre").replace('<p data-label="main"re', '<pre data-label="main"')
        for t in ("div", "blockquote", "h2", "td", "li", "figcaption"):
            body = body.replace(f"<{t}>", f'<{t} data-label="main">')
        if r.random() < 0.35:  # something that isn't main text amid the article
            at = body.find("<p data-label", int(r.integers(len(body) + 1)))
            body = body[:at] + off_block("side") + body[at:] if at > 0 else body + off_block(pick("side", "end"))
        if r.random() < 0.3:
            body += off_block("end")
        whole = pick(f"<article>{title}{body}</article>", f"<article>{title}{body}</article>", f"<main>{title}{body}</main>", f"<main><article>{title}{body}</article></main>", f'<div class="{pick("content", "post", "entry-content", "article-body", "story", "main-content", "post-content")}">{title}{body}</div>', f'<div id="{pick("content", "main", "article")}"><div class="{word()}">{title}{body}</div></div>', f'<article><header>{title}<p class="byline">{words(2, 5)}</p></header>{body}</article>', f"{title}{body}", f"<div>{title}{body}</div>")
        top = "".join(off_block("top") for _ in range(r.integers(0, 3))) + "".join(off_block("side") for _ in range(r.integers(0, 3)))
        low = "".join(off_block("side") for _ in range(r.integers(0, 2))) + "".join(off_block("end") for _ in range(r.integers(0, 3)))
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{top}{whole}{low}" + pick("</body></html>", ""))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(training_pages())


def main_text(model: Crf, html: str | None) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                texts = [main_text(model, h) for h in own.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("page_id").cast(pa.int64()), own.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # its size is that of the features of the training pages
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
