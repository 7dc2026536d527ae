"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut to leaf blocks: runs of text between the starts and ends of block elements, with the chain of their
ancestors. Each block's label (main text or not) depends on features of its ancestors' tags, classes, ids and roles,
on its text, and on its neighbours' labels. Weights are learned on pages with known labels, which a seeded generator
lays out in many ways (`TRAINING_PAGES` of them); pages are decoded by Viterbi's algorithm. Scripts, styles, titles,
text areas, frames, templates and the head, which ends before the first text or tag that can't stand in it, hold no
blocks. Text in embedded elements (`EMBEDDED`) makes blocks of its own after the paragraph it stands in, which goes on
behind them.

Open elements are nodes that know their parent and the features that they add to it, so time and memory grow with the
page and not with its depth.

Defined cases: null and empty pages have no text; pages of any length and depth are read whole; unclosed elements close
as browsers close them, at the next block or at the end; embedded elements without an end tag hold nothing; character
references are decoded once; white space inside a block, breaks included, becomes one space; empty blocks go; a block
whose labels score alike is no main text; repeated rows have equal results; an empty table has none; extra columns stay
out of the result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_columns

TRAINING_PAGES, SEED = 700, 11
RAW = "script style textarea title iframe noembed noframes".split()
EMBEDDED = frozenset("svg select datalist object audio video canvas noscript template".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.S,
)
_ENDS = {tag: re.compile(rf"</({tag})(?=[\s/>])[^>]*+>", re.I) for tag in (*RAW, "xmp")}
#: The same inside of SVG, where none of these elements reaches beyond its picture.
_SVG_ENDS = {tag: re.compile(rf"</({tag})(?=[\s/>])[^>]*+>|</?svg(?=[\s/>])", re.I) for tag in _ENDS}
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Start tags that leave the head open.
_HEAD = frozenset("html head title meta link base basefont bgsound style script noscript template noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_P_FENCE = frozenset("table td th button".split()) | EMBEDDED
#: Elements that close earlier ones of their kind: (those, what stands between).
_SIBLINGS = {
    tag: (tuple(own.split()), frozenset(fence.split()) | EMBEDDED)
    for tag, own, fence in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))
}
_SECTIONS = frozenset("article main nav header footer aside form section body div table figure blockquote dialog menu".split())
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An open element: its tag, its parent, and what it tells about the blocks in it."""

    __slots__ = ("leaf", "main", "near", "new", "tag", "tokens", "up")

    def __init__(self, tag: str, tokens: tuple[str, ...], up: Node | None, new: list[str]):
        self.tag, self.tokens, self.up, self.new = tag, tokens, up, new
        self.near = (tag, tokens) if tag in _SECTIONS else up.near if up else ("body", ())
        self.leaf = tag if tag not in _INLINE else up.leaf if up else "body"
        self.main = tag in ("article", "main") or up is not None and up.main


class Stack:
    """Open elements, and where those of each tag stand."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.tokens: Counter[str] = Counter()

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        new = [] if self.at[tag] else [f"in:{tag}"]
        for w in tokens:
            if not self.tokens[w]:
                new.append(f"token:{w}")
            self.tokens[w] += 1
        self.at[tag].append(len(self.nodes))
        self.nodes.append(Node(tag, tokens, self.nodes[-1] if self.nodes else None, new))

    def cut(self, size: int) -> None:
        """Close all but the outermost elements."""
        while len(self.nodes) > size:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for w in node.tokens:
                self.tokens[w] -= 1

    def last(self, tags) -> int:
        """Where the innermost open element of any of the tags stands; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, tags, fence) -> None:
        """Close the innermost element of the tags, with all in it, unless a fence stands in between."""
        if (k := self.last(tags)) > self.last(fence):
            self.cut(k)


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost element that it began in
    link_chars: int


def _tags(page: str) -> list[tuple[int, int, str, bool, str, tuple[int, int] | None]]:
    """Tags of a page: start, end, name, whether it is an end tag, attributes, and from where to where its content goes.

    Contents are known of raw text, whose tag ends with it, and of embedded elements. What isn't an element has no name,
    as have embedded elements without an end tag.
    """
    out: list = []
    open_at: dict[str, list[int]] = {tag: [] for tag in EMBEDDED}
    unended, at = set(), 0
    while m := _TOKEN.search(page, at):
        start, at = m.span()
        if not m["tag"]:
            out.append((start, at, "", False, "", None))
            continue
        tag, end, attrs, inner = m["tag"].lower(), bool(m["end"]), m["attrs"], None
        closed, drawn = attrs.endswith("/"), bool(open_at["svg"])
        if tag in _ENDS and not end:
            stop = None if tag in unended or closed and drawn else (_SVG_ENDS if drawn else _ENDS)[tag].search(page, at)
            if stop and stop[1]:
                inner, at = (at, stop.start()), stop.end()
            elif drawn or tag == "xmp":
                tag = ""
                if not stop and not closed:
                    unended.add(m["tag"].lower())
            else:
                inner, at = (at, len(page)), len(page)
        elif tag in EMBEDDED and end:
            if open_at[tag]:
                k = open_at[tag].pop()
                out[k] = (*out[k][:2], tag, *out[k][3:5], (out[k][1], start))
            else:
                tag = ""
        elif tag in EMBEDDED:
            if not (closed and tag == "svg"):
                open_at[tag].append(len(out))
            tag = ""
        out.append((start, at, tag, end, attrs, inner))
    return out


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack = Stack()
    buffer: list[str] = []
    linked, at, in_head, begun = 0, 0, False, False
    node: Node | None = None
    after: list[Block] = []  # blocks of embedded elements that come behind the block in the buffer
    outer: list[tuple] = []  # by open embedded element: what was being read around it

    def flush():
        nonlocal linked, node, begun
        text = " ".join("".join(buffer).split())
        if text:
            out.append(Block(text, node, linked))
        out.extend(after)
        buffer.clear()
        after.clear()
        linked, node, begun = 0, None, False

    def enter():
        nonlocal out, buffer, linked, node, begun, after
        outer.append((len(stack.nodes), out, buffer, linked, node, begun, after))
        out, buffer, linked, node, begun, after = [], [], 0, None, False, []

    def leave():
        """Go on with what stands around embedded elements that are no longer open."""
        nonlocal out, buffer, linked, node, begun, after
        while outer and len(stack.nodes) <= outer[-1][0]:
            flush()
            inner = out
            _, out, buffer, linked, node, begun, after = outer.pop()
            after += inner

    def say(raw: str, decode: bool = True):
        nonlocal linked, node, begun, in_head
        if raw and in_head and not outer and raw.strip():
            in_head = False
        if raw and not in_head:
            text = entities.unescape(raw) if decode and "&" in raw else raw
            if not begun and text.strip():
                node, begun = stack.nodes[-1] if stack.nodes else None, True
            buffer.append(text)
            if stack.at["a"]:
                linked += len(text.strip())

    for start, stop, tag, end, attrs, inner in _tags(page):
        if start < at:  # in a template
            continue
        say(page[at:start])
        at = stop
        if in_head and tag and not end and not outer and tag not in _HEAD:
            in_head = False
        if not tag or tag in RAW:
            continue
        if tag == "template" and not end and "shadowroot" not in attrs.lower():
            at = inner[1]
            continue
        if tag == "head":
            in_head = not end
            continue
        if tag == "br":
            say(" ")
            continue
        if tag == "xmp" and inner:
            flush()
            stack.push("pre", _tokens(attrs))
            say(page[slice(*inner)], decode=False)
            flush()
            stack.cut(len(stack.nodes) - 1)
            continue
        inline = tag in _INLINE or tag in _MATH or tag in EMBEDDED
        if not inline:
            flush()
        if end:
            if stack.at.get(tag):
                stack.cut(stack.at[tag][-1])
                leave()
                if not inline:
                    flush()
            continue
        if tag in _VOID or tag in ("option", "optgroup") and stack.last(EMBEDDED) < 0:
            continue
        if tag in _MATH:
            say(" ")
        if tag in _P_CLOSERS:
            stack.close(("p",), _P_FENCE)
        if tag in _SIBLINGS:
            stack.close(*_SIBLINGS[tag])
        if attrs.rstrip().endswith("/") and (tag in ("path", "g", "math") or stack.last(("svg", "math")) >= 0):
            continue
        if tag in EMBEDDED:
            enter()
        stack.push(tag, _tokens(attrs))
    say(page[at:])
    stack.cut(0)
    leave()
    flush()
    return out


@lru_cache(4096)
def _tokens(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs and "hidden" not in attrs.lower():
        return ()
    found = []
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found += [t for t in _SPLIT.split(value) if t]
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            found.append("~hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs, re.I):
        found.append("~hidden")
    return tuple(dict.fromkeys(found))


def own_features(b: Block, k: int, n: int) -> list[str]:
    """Feature names of the k-th of n blocks, without those of its ancestors."""
    section, tokens = b.node.near if b.node else ("body", ())
    f = ["bias", f"near:{section}", *[f"near-token:{w}" for w in tokens], f"leaf:{b.node.leaf if b.node else 'body'}"]
    if b.node and b.node.main:
        f.append("within-main")
    words, size = b.text.count(" ") + 1, len(b.text)
    f.append(f"words:{min(6, words.bit_length())}")
    density = b.link_chars / size
    f.append("links:" + ("none" if density == 0 else "some" if density < 0.5 else "most"))
    if b.text[-1] in ".!?…:;\"":
        f.append("ends")
    if "©" in b.text:
        f.append("copyright")
    f.append(f"place:{min(3, 4 * k // n)}")
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for k, b in enumerate(blocks):
        f, node = own_features(b, k, len(blocks)), b.node
        while node is not None:
            f += node.new
            node = node.up
        out.append(f)
    return out


@dataclass
class Field:
    """Feature weights for the label main (against other), and the score of each pair of neighbouring labels."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's best labels."""
        if not blocks:
            return []
        get, pairs = self.weights.get, self.pairs.tolist()
        told: dict[Node | None, float] = {None: 0.0}

        def ancestors(node: Node | None) -> float:
            """The sum of the weights of a node and all above it, each of which is summed once a page."""
            path = []
            while node not in told:
                path.append(node)
                node = node.up
            total = told[node]
            for x in reversed(path):
                total += sum(get(f, 0.0) for f in x.new)
                told[x] = total
            return total

        scores = [ancestors(b.node) + sum(get(x, 0.0) for x in own_features(b, k, len(blocks))) for k, b in enumerate(blocks)]
        other, main, back = 0.0, scores[0], []
        for s in scores[1:]:
            o = (other + pairs[0][0], main + pairs[1][0])
            m = (other + pairs[0][1], main + pairs[1][1])
            back.append((o[1] > o[0], m[1] > m[0]))
            other, main = max(o), max(m) + s
        label = main > other
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        return "\n\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def learn(pages: list[tuple[list[Block], list[bool]]], steps: int = 150, l2: float = 2e-4, rate: float = 0.15) -> Field:
    """Maximum conditional likelihood by Adam; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, cols = [], []
    longest, n = max(len(b) for b, _ in pages), len(pages)
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        for k, f in enumerate(features(blocks)):
            cols += [names.setdefault(x, len(names)) for x in f]
            rows += [i * longest + k] * len(f)
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    rows, cols = np.array(rows), np.array(cols)
    theta, m, v = (np.zeros(len(names) + 4) for _ in range(3))
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for t in range(1, steps + 1):
        pairs = theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(rows, weights=theta[cols], minlength=n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(ahead[:, k - 1, 0, None] + pairs[0], ahead[:, k - 1, 1, None] + pairs[1]) + emit[:, k]
            ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            nxt = behind[:, k + 1] + emit[:, k + 1]
            step = np.logaddexp(pairs[:, 0][None, :] + nxt[:, 0, None], pairs[:, 1][None, :] + nxt[:, 1, None])
            behind[:, k] = np.where(mask[:, k + 1, None], step, 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - z[:, None, None])[:, :, 1] * mask
        joint = np.exp(ahead[:, :-1, :, None] + pairs[None, None] + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate([np.bincount(cols, weights=(p - y * mask).ravel()[rows], minlength=len(names)), (joint.sum(axis=(0, 1)) - seen).ravel()]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({x: float(theta[k]) for x, k in names.items()}, theta[-4:].reshape(2, 2))


# --- labelled pages -------------------------------------------------------------------------------------------------

_GOOD = "content post entry story body article text main page".split()
_BAD = {
    "aside": "sidebar related recommended widget aside rail trending popular".split(),
    "div": "ad ads advert advertisement banner sponsor promo sponsored cookie consent notice alert popup modal overlay newsletter subscribe signup social share sharing breadcrumb breadcrumbs menu toolbar comments comment replies disqus related tags meta pagination pager legal disclaimer login search skip hidden".split(),
    "section": "comments comment replies discussion respond related newsletter promo sponsored cookie".split(),
    "nav": "nav menu navigation topnav breadcrumb toc".split(),
    "header": "header masthead site top banner".split(),
    "footer": "footer bottom copyright site".split(),
    "form": "form search login newsletter comment contact".split(),
}


class _Maker:
    """Pages with known labels; marked text is \x01 for main text and \x02 for the rest."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        out = " ".join("".join(self.pick("abdeghilmnoprstuv") + self.pick("aeiou") for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n))
        return out.capitalize() + (self.pick([".", ".", "!", "?"]) if self.chance(0.7) else "")

    def attrs(self, tokens: list[str], p: float = 0.8) -> str:
        if not self.chance(p):
            return ""
        name = self.pick(["class", "class", "id"])
        value = self.pick(tokens)
        return f' {name}="{value}{self.pick(["", "", "-wrap", " box", "-1", "_inner"])}"'

    def inline(self, mark: str, lo: int, hi: int, link: float = 0.1) -> str:
        text = mark + self.words(lo, hi)
        if self.chance(link):
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 5)}'
        return f"<{t}>{text}</{t}>" if (t := self.pick(["b", "em", "span", "", "", "", "", ""])) else text

    def bad(self, where: str = "page") -> str:
        tag = self.pick(["nav", "header", "footer", "aside", "form", "div", "div", "div", "section"] if where == "page" else ["aside", "div", "div", "form", "section", "footer", "nav"])
        attrs = self.attrs(_BAD[tag], 0.6 if tag not in ("div", "section") else 1.0)
        kind = self.pick(["links", "text", "both"])
        body = ""
        if kind != "text" or tag == "nav":
            items = "".join(f"<li><a href='/'>\x02{self.words(1, 3)}</a></li>" for _ in range(int(self.rng.integers(2, 7))))
            body += f"<ul>{items}</ul>"
        if kind != "links":
            for _ in range(int(self.rng.integers(1, 4))):
                t = self.pick(["p", "p", "div", "h2", "h3", "span", ""])
                text = self.inline("\x02", 2, 40)
                body += f"<{t}>{text}</{t}>" if t else text
        if tag == "form" or self.chance(0.05):
            body += "<label>\x02Mail</label><input name=q><button>\x02Send</button>"
        if tag == "footer" and self.chance(0.7):
            body = f"\x02&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}" + (body if self.chance(0.3) else "")
        return f"<{tag}{attrs}>{body}</{tag}>"

    def good(self) -> str:
        kind = self.rng.random()
        if kind < 0.68:
            return f"<p>{self.inline(chr(1), 1, 70)}" + ("</p>" if self.chance(0.8) else "")
        if kind < 0.78:
            h = self.pick(["h2", "h3", "h4"])
            return f"<{h}>\x01{self.words(1, 9)}</{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.inline(chr(1), 1, 15, 0.3)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>\x01{self.words(3, 30)}</p></blockquote>"
        if kind < 0.93:
            return f"<pre><code>\x01{self.words(2, 12)}</code></pre>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>\x01{self.words(2, 12)}</figcaption></figure>"
        if kind < 0.98:
            return "<table>" + "".join(f"<tr><td>\x01{self.words(1, 3)}</td><td>\x01{self.words(1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        return f"<div>\x01{self.words(2, 40)}</div>"

    def page(self) -> str:
        rng = self.rng
        inner = [f"<h1>\x01{self.words(1, 12)}</h1>"] if self.chance(0.85) else []
        if inner and self.chance(0.15):
            inner = [f"<header>{inner[0]}</header>"]
        inner += [self.good() for _ in range(int(rng.integers(0 if self.chance(0.1) else 1, 12)))]
        for _ in range(int(rng.integers(1, 4)) if self.chance(0.6) else 0):
            inner.insert(int(rng.integers(len(inner) + 1)), self.bad("article"))
        if self.chance(0.2):
            inner[:] = [x.replace("<p>", "<p><b>", 1) if x.startswith("<p>") and k == 1 else x for k, x in enumerate(inner)]
        tag = self.pick(["article", "article", "article", "main", "div", "div", "section"])
        attrs = self.attrs(_GOOD, 0.3 if tag in ("article", "main") else 1.0)
        body = f"<{tag}{attrs}>" + "".join(inner) + f"</{tag}>"
        if self.chance(0.3):
            body = f"<main{self.attrs(_GOOD, 0.4)}>{body}{self.bad() if self.chance(0.4) else ''}</main>"
        if self.chance(0.3):
            body = f"<div{self.attrs(['wrapper', 'container', 'layout', 'page', 'site', 'root'], 0.8)}>{self.bad() if self.chance(0.5) else ''}{body}{self.bad() if self.chance(0.6) else ''}</div>"
        before = "".join(self.bad() for _ in range(int(rng.integers(0, 4))))
        after = "".join(self.bad() for _ in range(int(rng.integers(0, 4))))
        if self.chance(0.6):
            before = "<nav><ul>" + "".join(f'<li><a href="/">\x02{self.words(1, 2)}</a></li>' for _ in range(int(rng.integers(2, 7)))) + "</ul></nav>" + before
        if self.chance(0.7):
            after += f"<footer>\x02&copy; {self.words(1, 2)} &middot; {self.words(2, 14)}</footer>"
        end = "</body></html>" if self.chance(0.85) else ""
        return f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{before}{body}{after}{end}'


    def embedded(self) -> str:
        tag = self.pick(["svg", "select", "datalist", "object", "audio", "video", "canvas", "noscript"])
        if tag in ("select", "datalist"):
            body = "".join(f"<option>\x02{self.words(1, 3)}</option>" for _ in range(int(self.rng.integers(1, 5))))
        elif tag == "svg":
            body = "".join(f"<text>\x02{self.words(1, 3)}</text>" for _ in range(int(self.rng.integers(1, 4))))
        else:
            body = self.inline("\x02", 2, 14, 0.3)
            body = f"<p>{body}</p>" if self.chance(0.5) else body
        return f"<{tag}{self.attrs(['box', 'icon', 'media'], 0.3)}>{body}</{tag}>"

    def with_embedded(self, page: str) -> str:
        """The page with embedded elements before or in some of its paragraphs."""
        places = [m.end() for m in re.finditer(r"(?=<(?:p|h[1-4]|ul|blockquote)\b)|<p>\x01", page)]
        for at in sorted({self.pick(places) for _ in range(int(self.rng.integers(0, 4)))} if places else (), reverse=True):
            page = page[:at] + self.embedded() + page[at:]
        return page


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of generated pages; embedded elements are drawn by a generator of their own."""
    maker, embedder, out = _Maker(seed), _Maker(seed + 1000), []
    for _ in range(n):
        blocks = blocks_of(embedder.with_embedded(maker.page()))
        labels = ["\x01" in b.text for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace("\x01", "").replace("\x02", "").split()) or "-"
        out.append((blocks, labels))
    return out


@lru_cache(1)
def trained() -> Field:
    return learn(labelled_pages())


_ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", field: Field | None = None) -> DataFrame:
    """One row per page: its id, url, text and n_chars (its code points); a map without a shuffle."""
    held = pages.sparkSession.sparkContext.broadcast(field or trained())

    def make():
        def f(part: pa.RecordBatch) -> dict:
            texts = [held.value.text(p) for p in part.column(part.schema.get_field_index(html)).to_pylist()]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return f

    return map_columns(pages.select(page_id, url, html), make, _ADDED, [html], [page_id, url])
