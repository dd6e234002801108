"""HTML main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text without a block-level tag between them. Each block has features of its
open ancestors (tags, words of class, id and role) and of its text (length, link share, marks). The field labels the
sequence main text or not; weights come from stochastic gradient ascent on the conditional likelihood of labelled
pages, decoding is Viterbi. A caller passes pages labelled block by block; `sample_pages` makes a varied set of
layouts by rule, whose words carry no meaning, so that the field learns structure.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Container, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Elements whose content is no text of the page. The first two run to the end of the page if not closed, the others
#: only lose their tag then.
TO_END = frozenset("script style".split())
RAW = TO_END | frozenset("template noscript iframe svg annotation annotation-xml textarea title select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr"
    " math mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable"
    " mtd mtext mtr munder munderover semantics object".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these names (up to the nearest container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """Text as shown, the code points of it inside links, and what its open elements say: features, the innermost block."""

    text: str
    linked: int
    inside: frozenset[str]
    leaf: str


def _marks(attributes: str) -> tuple[str, ...]:
    words: list[str] = []
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() in ("class", "id", "role"):
            words += _WORD.findall(value)
        elif name.lower() != "style":
            words += ["hidden"] if value != "false" else []
        elif re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.append("hidden")
    return tuple(words)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each tag, and of what is no text with an empty name.

    A tag ends at the next > outside of quotes, or at the next > at all where its quotes don't close. Linear: places after a
    quote from which no end was found are remembered, so that a later scan that comes there gives up at once.
    """
    at, last, unclosed = 0, page.rfind(">"), set()
    last_quote, dead = {q: page.rfind(q) for q in "\"'"}, set()
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(mark, at + (4 if mark == "-->" else 9))
            at = end + 3 if end >= 0 else len(page)
            yield begin, at, "", False, ""
            continue
        if at > last:  # no tag ends from here on
            return
        if page[at + 1] in "!?":
            at = page.find(">", at) + 1
            yield begin, at, "", False, ""
            continue
        slash = page[at + 1] == "/"
        m = _NAME.match(page, at + 1 + slash)
        if not m:
            at += 1
            continue
        i, end, trail = m.end(), -1, []
        while stop := _STOP.search(page, i):
            if stop[0] == ">":
                end = stop.start()
                break
            if stop.start() == last_quote[stop[0]]:
                break
            i = page.find(stop[0], stop.end()) + 1
            if i in dead:
                break
            trail.append(i)
        if end < 0:
            dead.update(trail)
            end = page.find(">", m.end())
        name, at = m[0].lower(), end + 1
        attributes = page[m.end() : end]
        if name in RAW and not slash and not (name == "svg" and attributes.endswith("/")):
            close = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:  # nor will a later one be closed
                unclosed.add(name)
                if name in TO_END:
                    at = len(page)
            name = ""
        elif name in RAW:
            name = ""
        yield begin, at, name, slash, attributes


class _Open(NamedTuple):
    """An open element: its name, and what it and those around it say of a block inside."""

    name: str
    inside: frozenset[str]
    leaf: str


def leaf_blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The blocks of a page in order, without those of white space only.

    Only features in `known` are noted, if that is given: with a fixed set of them an element of any depth holds a bounded
    set, shared with its parent where it adds nothing, and the work is linear in the page's size.
    """
    blocks: list[Block] = []
    noted = lambda x: known is None or x in known
    root = _Open("", frozenset(["outside"]), "")
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name
    containers: list[int] = []
    parts: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else root
            blocks.append(Block(text, min(linked, len(text)), top.inside, top.leaf))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())

    def close(i: int) -> None:
        for x in stack[i:]:
            places[x.name].pop()
            if x.name in CONTAINERS:
                containers.pop()
        del stack[i:]

    at = 0
    for begin, end, name, slash, attributes in _tags(page):
        add(page[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
        if slash:
            if places.get(name):
                close(places[name][-1])
            continue
        closes = CLOSES.get(name) or ({"p"} if name not in INLINE else ())
        nearest = max((places[x][-1] for x in closes if places.get(x)), default=-1)
        if nearest > (containers[-1] if containers else -1):
            close(nearest)
        if name not in VOID and not attributes.endswith("/"):
            top = stack[-1] if stack else root
            inside = top.inside
            if name in ("article", "main") and "outside" in inside:
                inside = inside - {"outside"}
            if (own := f"in {name}") not in inside and noted(own):
                inside = inside | {own}
            if attributes and (marks := {m for w in _marks(attributes) if noted(m := f"mark {w}") and m not in inside}):
                inside = inside | marks
            places.setdefault(name, []).append(len(stack))
            if name in CONTAINERS:
                containers.append(len(stack))
            stack.append(_Open(name, inside, top.leaf if name in INLINE else name))
    add(page[at:])
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for i, b in enumerate(blocks):
        f = {"bias", f"n{min(12, int(math.log2(len(b.text) + 1)))}", f"link{round(4 * b.linked / len(b.text))}"}
        f |= {f"leaf {b.leaf}", f"end {b.text[-1] if not b.text[-1].isalnum() else 'word'}"} | b.inside
        if "©" in b.text or "(c)" in b.text:
            f.add("copyright")
        f.add(f"place {min(2, 3 * i // len(blocks))}")
        out.append(sorted(f))
    return out


class Field(NamedTuple):
    """Weight for main text of each feature (the other label has the negative) and of each step between labels."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]


def _scores(weights: dict[str, float], features: list[list[str]]) -> list[float]:
    get = weights.get
    return [sum(get(x, 0.0) for x in f) for f in features]


def viterbi(field: Field, features: list[list[str]]) -> list[int]:
    """The best label sequence; a tie goes to not main text."""
    (aa, ab), (ba, bb) = field.steps
    back: list[tuple[int, int]] = []
    off = on = 0.0
    for i, s in enumerate(_scores(field.weights, features)):
        if i:
            to_off = (off + aa, 0) if off + aa >= on + ba else (on + ba, 1)
            to_on = (off + ab, 0) if off + ab >= on + bb else (on + bb, 1)
            back.append((to_off[1], to_on[1]))
            off, on = to_off[0], to_on[0]
        off, on = off - s, on + s
    if not features:
        return []
    labels = [int(on > off)]
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Ascend the conditional likelihood of labelled pages, page by page, with AdaGrad steps and an L2 penalty."""
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    steps, s2 = [[0.0, 0.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 1.0]]
    order = random.Random(1)
    for _ in range(epochs):
        order.shuffle(pages)
        for features, labels in pages:
            n = len(labels)
            if not n:
                continue
            s = _scores(w, features)
            fore, rear = [(-s[0], s[0])], [(0.0, 0.0)] * n
            for i in range(1, n):
                a, b = fore[-1]
                fore.append((_log_add(a + steps[0][0], b + steps[1][0]) - s[i], _log_add(a + steps[0][1], b + steps[1][1]) + s[i]))
            for i in range(n - 2, -1, -1):
                a, b = rear[i + 1][0] - s[i + 1], rear[i + 1][1] + s[i + 1]
                rear[i] = (_log_add(steps[0][0] + a, steps[0][1] + b), _log_add(steps[1][0] + a, steps[1][1] + b))
            z = _log_add(*fore[-1])
            for i in range(n):
                grad = labels[i] - math.exp(min(0.0, fore[i][1] + rear[i][1] - z))
                for x in features[i]:
                    g = 2 * grad - l2 * w.get(x, 0.0)
                    g2[x] = g2.get(x, 1.0) + g * g
                    w[x] = w.get(x, 0.0) + rate * g / math.sqrt(g2[x])
            moves = [[0.0, 0.0], [0.0, 0.0]]
            for i in range(1, n):
                for a in (0, 1):
                    for b in (0, 1):
                        p = math.exp(min(0.0, fore[i - 1][a] + steps[a][b] + (s[i] if b else -s[i]) + rear[i][b] - z))
                        moves[a][b] += (labels[i - 1] == a and labels[i] == b) - p
            for a in (0, 1):
                for b in (0, 1):
                    s2[a][b] += moves[a][b] ** 2
                    steps[a][b] += rate * moves[a][b] / math.sqrt(s2[a][b])
    return Field(w, (tuple(steps[0]), tuple(steps[1])))


# --- labelled pages by rule -------------------------------------------------------------------------------------

_MAIN = ("<article>|</article>", "<main>|</main>", '<div id="content">|</div>', '<div class="post">|</div>', '<div class="entry-content">|</div>',
         '<main><article class="story">|</article></main>', '<div class="article-body">|</div>', "<table><tr><td>|</td></tr></table>", "|",
         "<section class='text'>|</section>", '<div role="main">|</div>', "<article><div><div>|</div></div></article>", "<article><section>|</section></article>")
#: What the class, id or role of a part that is not main text may say.
_SIDE_WORDS = {
    "nav": "nav navigation menu menubar navbar breadcrumb breadcrumbs pagination pager toc skip topbar tabs", "header": "header masthead site-header banner branding logo",
    "footer": "footer site-footer copyright bottom legal contentinfo", "aside": "sidebar side widget related recommended popular tags share social complementary rail",
    "ad": "ad ads advert advertisement banner promo promotion sponsored sponsor", "notice": "notice cookie cookies cookie-notice cookie-consent consent popup modal alert gdpr dialog overlay",
    "form": "form search login signup newsletter subscribe subscription contact-form",
    "comments": "comments comment commentlist comment-list comment-thread replies respond discussion disqus", "hidden": "x",
}
#: Elements of each kind; the marked ones always say their kind in an attribute.
_SIDE_TAGS = {
    "nav": "nav nav ul div div*", "header": "header div*", "footer": "footer footer div*", "aside": "aside aside div* section*", "ad": "div* section* p*",
    "notice": "div* section* dialog p*", "form": "form form div*", "comments": "section* section* div* ol* ul*", "hidden": "div* section* p*",
}


def _words(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioubdfklmnprstv") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", ".", "!", "?", "", ","])


def _prose(rng: random.Random, most: int) -> str:
    """One or more paragraphs of any length, as an article has them."""
    tag = rng.choice(["p", "p", "p", "div", "div", "section", "span", "li"])
    return "".join(f"<{tag}>{_words(rng, rng.choice([1, 3, 8, 20, 50, 90]))}</{tag}>" for _ in range(rng.randint(1, most)))


def _side(rng: random.Random, kind: str) -> str:
    tag = rng.choice(_SIDE_TAGS[kind].split())
    marked, tag = tag.endswith("*") or (tag in ("div", "ul", "section")), tag.rstrip("*")
    mark = f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice(_SIDE_WORDS[kind].split())}"' if marked or rng.random() < 0.4 else ""
    if kind == "hidden":
        mark = rng.choice([" hidden", " style='display:none'", ' aria-hidden="true"'])
    short = lambda: _words(rng, rng.randint(1, 5)).rstrip(".,!?")
    if tag == "p":
        body = _words(rng, rng.randint(2, 40))
    elif tag in ("ol", "ul") and kind == "comments":
        body = "".join(f"<li>{_prose(rng, 2)}</li>" for _ in range(rng.randint(1, 4)))
    elif rng.random() < 0.4:
        body = (f"<h3>{short()}</h3>" if rng.random() < 0.3 else "") + _prose(rng, 3)
    elif kind == "nav" or tag == "ul":
        linked = rng.random() < 0.7
        items = "".join(f'<li><a href="/x">{short()}</a></li>' if linked else f"<li>{short()}" for _ in range(rng.randint(2, 8)))
        body = items if tag == "ul" else f"<ul>{items}</ul>"
    elif kind == "footer":
        body = f"&copy; {short()} &middot; {_words(rng, rng.randint(1, 14))}" + ('<p><a href="/y">' + short() + "</a></p>") * rng.randint(0, 1)
    elif kind == "form":
        body = f"<label>{short()}</label><input name=q><button>{short()}</button>" + f"<p>{_words(rng, rng.randint(3, 12))}</p>" * rng.randint(0, 1)
    elif kind == "comments":
        own = rng.choice(['div class="comment"', "div", "article class=comment", "p"])
        body = f"<h3>{short()}</h3>" + "".join(f"<{own}><b>{short()}</b>{_prose(rng, 1) if own != 'p' else _words(rng, 9)}</{own.split()[0]}>" for _ in range(rng.randint(1, 4)))
    elif kind in ("aside", "header"):
        body = f"<h3>{short()}</h3>" + "".join(f'<p><a href="/z">{short()}</a></p>' if rng.random() < 0.6 else f"<p>{_words(rng, rng.randint(2, 25))}</p>" for _ in range(rng.randint(0, 4)))
    else:
        body = _words(rng, rng.randint(2, 25)) if rng.random() < 0.6 else f"<p>{_words(rng, rng.randint(2, 25))}</p><button>{short()}</button>"
    return f"<{tag}{mark}>{body}</{tag}>"


def _body(rng: random.Random) -> list[str]:
    """The parts of an article. Its paragraphs have one tag for the most part, with or without a class that says nothing."""
    out = [f"<h1>{_words(rng, rng.randint(2, 10))}</h1>"] if rng.random() < 0.8 else []
    usual = rng.choice(["p", "p", "p", "div", "div", "section", "dd"])
    for _ in range(rng.randint(1, 12)):
        p = rng.random()
        n = rng.choice([1, 2, 6, 20, 50, 90])
        tag = usual if rng.random() < 0.8 else rng.choice(["p", "div", "div", "section", "figure", "details"])
        said = f" class='{rng.choice(['note', 'text', 'lead', 'intro', 'wide', 'box', 'caption', 'quote', 'para', 'section', 'body', 'first', 'author'])}'" if rng.random() < 0.2 else ""
        if p < 0.62:
            link = f" <a href='/w'>{_words(rng, 2)}</a> {_words(rng, n)}" if rng.random() < 0.2 else ""
            out.append(f"<{tag}{said}>{_words(rng, n)}{link}</{tag}>")
        elif p < 0.7:
            out.append(f"<p><b>{_words(rng, n)}<br>")
        elif p < 0.78:
            out.append(f"<h{rng.choice('234')}>{_words(rng, 4)}</h2>")
        elif p < 0.86:
            kind = rng.choice(["ul", "ul", "ol"])
            out.append(f"<{kind}>" + "".join(f"<li>{_words(rng, rng.randint(1, 15))}</li>" for _ in range(rng.randint(2, 5))) + f"</{kind}>")
        elif p < 0.93:
            out.append(f"<blockquote>{_words(rng, n)}</blockquote>")
        else:
            out.append(f"<pre>{_words(rng, n)}</pre>" if rng.random() < 0.5 else f"<table><tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr></table>")
    return out


def sample_pages(count: int = 1000, seed: int = 4) -> Iterator[tuple[str, list[int]]]:
    """Pages with a label for each leaf block, 1 for main text."""
    rng = random.Random(seed)
    for _ in range(count):
        sides = lambda kinds, p: [(_side(rng, k), 0) for k in kinds if rng.random() < p]
        main = [(x, 1) for x in _body(rng)]
        for kind in ("ad", "aside", "form", "notice", "nav", "comments", "hidden"):  # some stand inside the article
            if rng.random() < 0.2:
                main.insert(rng.randint(0, len(main)), (_side(rng, kind), 0))
        inside = sides(["comments"], 0.2)
        opening, closing = rng.choice(_MAIN).split("|")
        top = sides(["notice", "header", "nav", "ad"], 0.6)
        end = sides(["comments", "aside", "form", "ad", "footer"], 0.5)
        parts = [*top, (opening, None), *main, *inside, (closing, None), *end]
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(x for x, _ in parts) + "</body></html>"
        labels = [label for x, label in parts if label is not None for _ in leaf_blocks(x)]
        if len(labels) == len(leaf_blocks(page)):
            yield page, labels


def train(pages: Iterable[tuple[str, list[int]]]) -> Field:
    """Fit on (html, labels of its leaf blocks)."""
    return fit([(block_features(leaf_blocks(page)), labels) for page, labels in pages])


def main_text(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page, field.weights)
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(field, block_features(blocks)), strict=True) if y)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(shared.value, page) for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract_main_text(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, which needs page_id, url and html.

    Character references are decoded, white space inside a block becomes one space, blocks join by two \\n in page
    order. Null or empty html, and a page without a main block, give an empty text. Repeated rows stay. Elements may be
    nested to any depth. A tag whose quotes don't close ends at its next >.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)
    return pages.select("page_id", "url", "html").mapInArrow(common.releasing(_extract(shared)), "page_id long, url string, text string, n_chars long")
