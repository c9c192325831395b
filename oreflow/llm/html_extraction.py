"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of block elements with its text runs as leaves.  Every
node is content, boilerplate or (elements only) a mixture; the joint probability is
P(root) * prod P(child and its element | parent and its element) * prod
P(feature | node): parent-child potentials and one for each observed feature.  Sum-product messages,
upward and then downward, give each node's exact content marginal; the text of
the leaves above one half is the main text.

All potentials, that of the page itself included, are counted with additive
smoothing from labelled pages: those of :mod:`oreflow.llm.labelled_pages`.
The counts have a fixed size and go to every task; the pages are mapped, with
no shuffle.  Only what is never text (scripts, styles, templates, frames, the
title of the head, form values) is left out by rule; whether hidden blocks,
notices or any other text belong to the main text is for the model to say.

Null html is the empty page (empty text); text outside any tag is judged like
other text; repeated rows are extracted each; an empty table gives no rows;
very long pages and deep nesting need no recursion; columns beside the three
used are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from oreflow.llm import common

#: Fixed values of HTML: elements that break the line, that have no end, and whose content is no text.
BLOCKS = frozenset((
    "address article aside audio blockquote body button canvas caption center col colgroup dd details dialog dir "
    "div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li "
    "main menu nav noscript object ol option p pre search section select summary svg table tbody td tfoot th thead "
    "tr ul video"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style title textarea iframe template noframes noembed".split())
#: A start tag of the key ends an open element of the value, up to the named container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!-)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_STYLE = re.compile(r"style\s*=\s*[\"'][^\"']*")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

class Node:
    __slots__ = ("children", "hints", "length", "linked", "name", "parent", "text")

    def __init__(self, name: str, parent: int, hints: tuple[str, ...] = ()):
        self.name, self.parent, self.hints = name, parent, hints
        self.text, self.length, self.linked = "", 0, 0


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents before children; leaves named ``#text`` hold a block's text."""
    nodes = [Node("#page", -1)]
    stack = [0]
    run: list[tuple[str, bool]] = []
    links, at, n = 0, 0, len(page)

    def flush() -> None:
        if run:
            whole = "".join(x for x, _ in run)
            whole = _SPACE.sub(" ", html.unescape(whole) if "&" in whole else whole).strip()
            if whole:
                leaf = Node("#text", stack[-1])
                leaf.text, leaf.length = whole, len(whole)
                leaf.linked = min(leaf.length, sum(len(x.strip()) for x, inside in run if inside))
                nodes.append(leaf)
            run.clear()

    def close(k: int) -> None:
        flush()
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            run.append((page[at:], links > 0))
            break
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].name == name:
                        close(k)
                        break
                else:
                    flush()
            continue
        if name in OPAQUE:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
            run.append((" ", False))
            continue
        if name == "br":
            run.append((" ", False))
            continue
        if name == "a":
            links = 1
            continue
        if name not in BLOCKS:
            continue
        flush()
        links = 0
        if name in CLOSES:
            ends, limit = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if (own := nodes[stack[k]].name) in limit:
                    break
                if own in ends:
                    close(k)
        for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            own = nodes[stack[k]].name
            if own == "p":
                close(k)
                break
            if own in BLOCKS and own not in ("label", "button"):
                break
        if name in VOID:
            continue
        found = [w for a in _ATTRIBUTE.finditer(m[3]) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())]
        if _hidden(m[3]):
            found.append("hidden")
        stack.append(len(nodes))
        nodes.append(Node(name, stack[-2], tuple(dict.fromkeys(found))))
    flush()
    for x in reversed(nodes):  # lengths of whole subtrees
        if x.parent >= 0:
            nodes[x.parent].length += x.length
            nodes[x.parent].linked += x.linked
    return nodes


def _hidden(attributes: str) -> bool:
    """Whether the attributes hide the element: ``hidden``, ``aria-hidden`` or a style without display."""
    if "aria-hidden" in attributes and _HIDDEN.search(attributes):
        return True
    return bool(_HIDDEN.search(_QUOTED.sub("", attributes) + " ".join(_STYLE.findall(attributes))))


def _share(part: int, whole: int) -> str:
    return "none" if not part else "some" if 3 * part < whole else "much" if 4 * part < 3 * whole else "all"


def features(node: Node, parent: Node | None) -> list[tuple[tuple[str, str], ...]]:
    """What is seen of a node: its named parts, or a text's links, length, end and first sign.

    The words of class, id and role that tell something are those that the
    labelled pages have often enough.  Each is a feature and the group of nodes that it is a share of; where a
    first form, given the parent's element, was hardly met in the labelled
    pages, the second stands for it.
    """
    if node.name != "#text":
        return [((f"hint={h}", "element"),) for h in node.hints]
    up = parent.name if parent else ""
    end = "stop" if node.text[-1] in ".!?…。”\"'" else "open"
    form = f"{_share(node.linked, node.length)},{min(6, int(math.log2(1 + node.length / 12)))},{end}"
    mark = "legal" if node.text[0] in "©®™" else "none"
    return [((f"text={up}:{form}", f"text under={up}"), (f"text={form}", "text")), ((f"mark={mark}", "text"),)]


#: States of a node: all of its text is boilerplate, both kinds, all of it content.
BOILERPLATE, MIXED, CONTENT = range(3)


LEAST = 5
#: Nodes that the wider potential counts for.
WIDER = 2.0
#: The texts of a page are much alike in form, so that of each counts for a share of an independent observation.
ALIKE = 0.25


class Model:
    """Potentials counted from labelled pages."""

    def __init__(self, labelled: list[tuple[list[Node], list[int]]], smoothing: float = 1.0):
        pair, seen, roots = Counter(), [Counter(), Counter(), Counter()], Counter()
        group_of: dict[str, str] = {}
        for nodes, labels in labelled:
            roots[labels[0]] += 1
            for x, y in zip(nodes, labels, strict=True):
                parent = nodes[x.parent] if x.parent >= 0 else None
                if parent:
                    for names in ("", x.name, f"{parent.name}>{x.name}"):
                        pair[names, labels[x.parent], y] += 1
                seen[y]["element" if x.name != "#text" else "text"] += 1
                if x.name == "#text":
                    seen[y][f"text under={parent.name}"] += 1
                forms = {f for forms in features(x, parent) for f in forms}
                seen[y].update(name for name, _ in forms)
                group_of.update(forms)
        # P(child | parent, elements), smoothed towards that of the child's element, and that towards all.
        self.pair: dict[str, list[list[float]]] = {"": [[1 / 3] * 3] * 3}
        for names in sorted({n for n, _, _ in pair}, key=lambda n: ((">" in n) + bool(n), n)):
            wider = self.pair[""] if ">" not in names else self.pair[names.split(">")[1]]
            counts = [[pair[names, p, c] for c in range(3)] for p in range(3)]
            self.pair[names] = [[(n + WIDER * w) / (sum(row) + WIDER) for n, w in zip(row, wide, strict=True)] for row, wide in zip(counts, wider, strict=True)]
        # times P(the child's element | its parent's element and state), smoothed towards that in all states
        inside: Counter = Counter()
        for (names, p, _), n in pair.items():
            if ">" in names:
                for key in ((names, p), (names.split(">")[0], p)):
                    inside[key] += n
                    inside[key[0]] += n
        for names in [n for n in self.pair if ">" in n]:
            up = names.split(">")[0]
            overall = inside[names] / inside[up]
            shares = [(inside[names, p] + WIDER * overall) / (inside[up, p] + WIDER) for p in range(3)]
            self.pair[names] = [[x * share for x in row] for row, share in zip(self.pair[names], shares, strict=True)]
        self.root = [math.log((roots[y] + smoothing) / (len(labelled) + 3 * smoothing)) for y in range(3)]
        # A leaf is never mixed; what was met fewer than LEAST times says nothing.
        self.log: dict[str, tuple[float, ...]] = {}
        for f, group in group_of.items():
            if sum(c[f] for c in seen) >= LEAST:
                weight = ALIKE if f.startswith("text=") else 1.0
                self.log[f] = tuple(weight * math.log((c[f] + smoothing) / (c[group] + 10 * smoothing)) for c in seen)

    def between(self, node: Node, parent: Node) -> list[list[float]]:
        """P(state and element of the node | state and element of its parent), by the two states."""
        return self.pair.get(f"{parent.name}>{node.name}") or self.pair.get(node.name) or self.pair[""]

    def evidence(self, node: Node, parent: Node | None) -> Iterator[tuple[float, ...]]:
        """log P(feature | state) of each of a node's features that the model knows."""
        for forms in features(node, parent):
            for f, _ in forms:
                if (v := self.log.get(f)) is not None:
                    yield v
                    break

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node given the whole page."""
        pairs = [self.pair[""], *(self.between(x, nodes[x.parent]) for x in nodes[1:])]
        up: list[list[float]] = []
        told: set[str] = set()
        for x in nodes:
            own = list(self.root) if x.parent < 0 else [0.0, -30.0 if x.name == "#text" else 0.0, 0.0]
            if x.name != "#text" or x.text not in told:  # a repeated line tells nothing new
                for v in self.evidence(x, nodes[x.parent] if x.parent >= 0 else None):
                    own = [o + w for o, w in zip(own, v, strict=True)]
                told.add(x.text)
            top = max(own)
            up.append([math.exp(max(-60.0, o - top)) for o in own])
        sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            a, b, c = up[k]
            total = a + b + c
            a, b, c = up[k] = [a / total, b / total, c / total]
            if k:
                (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = pairs[k]
                sent[k] = x, y, z = aa * a + ab * b + ac * c, ba * a + bb * b + bc * c, ca * a + cb * b + cc * c
                own = up[nodes[k].parent]
                own[0] *= x
                own[1] *= y
                own[2] *= z
                if (top := max(own)) < 1e-100:
                    own[:] = [o / top for o in own]
        belief: list[list[float]] = [up[0]]
        for k in range(1, len(nodes)):
            # The parent's belief without this child's own message.
            (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = pairs[k]
            a, b, c = (q / max(s, 1e-300) for q, s in zip(belief[nodes[k].parent], sent[k], strict=True))
            x, y, z = up[k]
            x, y, z = x * (a * aa + b * ba + c * ca), y * (a * ab + b * bb + c * cb), z * (a * ac + b * bc + c * cc)
            total = x + y + z
            belief.append([x / total, y / total, z / total])
        return [x[CONTENT] for x in belief]


def label(nodes: list[Node], mark: str = "§") -> list[int]:
    """States of a page whose content blocks begin with ``mark`` (removed here); a node without text is boilerplate."""
    own, rest = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        if x.name == "#text":
            good = x.text.startswith(mark)
            own[k], rest[k] = int(good), int(not good)
            x.text = x.text.removeprefix(mark)
        if x.parent >= 0:
            own[x.parent] += own[k]
            rest[x.parent] += rest[k]
    return [BOILERPLATE if not a else MIXED if b else CONTENT for a, b in zip(own, rest, strict=True)]


@lru_cache(maxsize=1)
def default_model() -> Model:
    from oreflow.llm.labelled_pages import PAGES

    return Model([(nodes, label(nodes)) for nodes in map(parse, PAGES)])


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    return "\n\n".join(x.text for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.name == "#text" and p > 0.5)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [main_text(x or "", m) for x in b.column(2).to_pylist()]
                yield {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return common.map_rows(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.dealt(common.table(spark, sf_dir, "pages")))
