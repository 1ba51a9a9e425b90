"""Main text of web pages by a tree-structured graphical model.

A page's nodes (block elements and runs of text) each have a hidden label, content
or not. A potential on every parent and child says how the label passes down, by
the child's kind: its element and what its names tell, or for a run the element
around it. A potential on every run says how well its length, links and ending
fit the label.
Sum-product messages go up from the leaves and down from the root once, which on a
tree gives each node's exact marginal; runs with a marginal above one half are the
text, in page order, joined by single spaces.

The potentials are smoothed shares counted over labelled pages (page_samples).
The number of training pages is a parameter; pages to extract are all read whole.

Null and empty pages have no text. Repeated rows are extracted one by one. An
empty table gives an empty result. Other columns pass through; columns named like
a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.html_tree import Node, parse
from tidemark.llm.page_samples import sample_pages

TRAINING_PAGES = 1500
TRAINING_SEED = 7
#: A kind seen less often in training is replaced by a coarser one, at last by ANY.
LEAST_SEEN = 10
ANY = "any"

#: What names of classes, ids and roles tell about a part of a page.
NAMES = {
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promoted promotion dfp",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav pager pagination tabs toolbar",
    "head": "header masthead topbar logo branding",
    "foot": "footer copyright colophon legal",
    "side": "sidebar aside widget related recommended popular recent share social tags archive complementary",
    "comment": "comment comments discussion responses reply replies disqus thread reader",
    "notice": "cookie cookies consent notice alert popup modal gdpr overlay warning privacy paywall",
    "form": "form search newsletter subscribe signup login contact",
    "main": "article content main post entry story body text blog page",
}
_NAME_KINDS = {word: kind for kind, words in NAMES.items() for word in words.split()}
_KINDS = {"main": 0, "side": 1, "head": 2, "nav": 3, "foot": 4, "form": 5, "notice": 6, "comment": 7, "ad": 8}
_split = re.compile(r"[^a-z]+")
#: Elements that pass labels in a way of their own; all others count as one kind.
TAGS = frozenset("#page html head body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption form fieldset button details dialog address center".split())


def name_kind(names: str) -> str:
    """The strongest hint among an element's names: what marks boilerplate goes first."""
    found = [_NAME_KINDS[w] for w in _split.split(names) if w in _NAME_KINDS]
    return max(found, key=_KINDS.__getitem__, default="none") if found else "none" if not names else "other"


def features(node: Node) -> tuple[tuple[str, object], ...]:
    """What is seen of a run of text; elements speak through their kind."""
    if node.tag:
        return ()
    n = len(node.text)
    link = 0 if not node.linked else 1 if 3 * node.linked < n else 2 if 5 * node.linked < 4 * n else 3
    return (("run", (min(n.bit_length(), 9), link)), ("end", (node.text[-1] in ".!?\"»”", "©" in node.text)))


def kinds_of(node: Node, parent: Node | None) -> tuple[str, ...]:
    """A node's kind, then the coarser kinds that stand in for one too rarely seen."""
    if not node.tag:
        around = parent.tag if parent and parent.tag in TAGS else "other"
        return f"run in {around}", "run"
    tag = node.tag if node.tag in TAGS else "other"
    name = "hidden" if node.hidden else name_kind(node.names)
    where = " in body" if parent and parent.tag in ("body", "#page") else ""
    by_name = (f"* {name}",) if name not in ("none", "other") else ()
    return (f"{tag} {name}{where}", *by_name, f"{tag}{where}")


@dataclass(frozen=True)
class Model:
    """Logarithms: pass_down[kind][parent label][label] and fit[feature][label]."""

    pass_down: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    fit: dict[tuple[str, object], tuple[float, float]]


def train(pages: list[tuple[str, list[tuple[int, int]]]], smoothing: float = 0.5) -> Model:
    """Potentials from pages with the spans that are content."""
    down: Counter = Counter()
    seen: Counter = Counter()
    labels: Counter = Counter()
    values: dict[str, set] = {}
    for page, spans in pages:
        nodes = parse(page)
        of = [int(any(a <= x.at < b for a, b in spans)) for x in nodes]
        for x, y in zip(nodes, of, strict=True):
            for kind in kinds_of(x, nodes[x.parent] if x.parent >= 0 else None):
                down[kind, of[x.parent] if x.parent >= 0 else 0, y] += 1
            for f in features(x):
                seen[f, y] += 1
                labels[f[0], y] += 1
                values.setdefault(f[0], set()).add(f[1])

    def share(kind: str, parent: int) -> tuple[float, float]:
        # Where a parent label is little seen, the kind's own share stands in.
        own = [down[kind, 0, y] + down[kind, 1, y] + smoothing for y in (0, 1)]
        a, b = (down[kind, parent, y] + 2 * own[y] / sum(own) for y in (0, 1))
        return math.log(a / (a + b)), math.log(b / (a + b))

    total: Counter = Counter()
    for (kind, _, _), count in down.items():
        total[kind] += count
    kinds = {k for k, count in total.items() if count >= LEAST_SEEN} | {ANY}
    fit = {(name, v): tuple(math.log((seen[(name, v), y] + smoothing) / (labels[name, y] + smoothing * (len(vs) + 1))) for y in (0, 1)) for name, vs in values.items() for v in vs}
    return Model({k: (share(k, 0), share(k, 1)) for k in kinds}, fit)


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """The probability that each node is content, by one pass up and one down."""
    n = len(nodes)
    own0, own1 = [0.0] * n, [0.0] * n
    up0, up1 = [0.0] * n, [0.0] * n
    edges = []
    fit, down = model.fit, model.pass_down
    for i, x in enumerate(nodes):
        kinds = kinds_of(x, nodes[x.parent] if x.parent >= 0 else None)
        edges.append(down[next((k for k in kinds if k in down), ANY)])
        for f in features(x):
            found = fit.get(f)
            if found:
                own0[i] += found[0]
                own1[i] += found[1]
    exp, log = math.exp, math.log
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        (a00, a01), (a10, a11) = edges[i]
        b0, b1 = own0[i], own1[i]
        top = b0 if b0 > b1 else b1
        e0, e1 = exp(b0 - top), exp(b1 - top)
        up0[i] = m0 = top + log(exp(a00) * e0 + exp(a01) * e1)
        up1[i] = m1 = top + log(exp(a10) * e0 + exp(a11) * e1)
        p = nodes[i].parent
        own0[p] += m0
        own1[p] += m1
    out = [0.0] * n
    (r0, r1), _ = edges[0]
    belief0, belief1 = [0.0] * n, [0.0] * n
    belief0[0], belief1[0] = own0[0] + r0, own1[0] + r1
    for i in range(n):
        if i:
            p = nodes[i].parent
            (a00, a01), (a10, a11) = edges[i]
            c0, c1 = belief0[p] - up0[i], belief1[p] - up1[i]  # what the parent knows without this child
            top = c0 if c0 > c1 else c1
            e0, e1 = exp(c0 - top), exp(c1 - top)
            belief0[i] = own0[i] + top + log(exp(a00) * e0 + exp(a10) * e1)
            belief1[i] = own1[i] + top + log(exp(a01) * e0 + exp(a11) * e1)
        d = belief0[i] - belief1[i]
        out[i] = 1 / (1 + exp(d)) if d < 700 else 0.0
    return out


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    return " ".join(x.text for x, p in zip(nodes, marginals(nodes, model), strict=True) if not x.tag and p > 0.5)


def extract_text(df: DataFrame, html: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """df without its html, with text and n_chars."""
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    model = train(sample_pages(training_pages, TRAINING_SEED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(x, model) if x else "" for x in part[html].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + [pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=schema.names)

    return df.select(*[f"`{c}`" for c in kept], f"`{html}`").mapInArrow(run, schema)
