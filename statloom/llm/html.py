"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text. A linear classifier turns what is known of a
block (the nearest telling ancestor by tag, class, id or role, the share of its
text in links, its length, its tag, its punctuation) into a cost for either
label; the costs are the capacities to the two terminals. Neighbours in the page
are joined by edges whose capacity falls with the length of the way between them
in the document tree, and successive blocks of one parent by another edge. The
cut of least capacity labels the blocks.

Blocks whose own cost outweighs all their edges keep their label in every
minimum cut. They are taken out first, again and again, their edges turning into
costs of their neighbours; only what is left is sent to maximum flow, and that
part alone decides ties, towards boilerplate. Pages are labelled one by one
where they lie, so nothing is shuffled.

Defined results: NULL and empty pages, and pages without a content block, give
the empty text. White space of a block becomes one space, blocks are joined in
page order by one space; nothing else is dropped. Repeated rows are treated
alike; extra columns are kept, and a taken result name is refused.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statloom.llm.common import long_texts

#: What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot tr div section article main body html nav aside header footer form".split())

#: Telling tags, and telling words in a class, id or role.
PLAIN_TAGS = frozenset("nav footer aside form menu button select textarea dialog fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
PLAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments contentinfo cookie "
    "cookies consent dialog disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe tags toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
NOT_ABOUT_ITSELF = frozenset(("has", "with", "no", "without", "is"))
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Costs of the classifier.
REGION, LINKS, TEXT_TAG, LIST_TAG, SENTENCE, SIGN = 6.0, 5.0, 1.0, -1.0, 0.5, -2.0
#: Capacities of the edges.
NEXT, SIBLING = 1.5, 0.5
SENTENCE_END = frozenset(".!?…。！？:;\"'»”")


def _words(name: str) -> set[str]:
    parts = [w.lower() for w in WORD.findall(name)]
    return set() if not parts or parts[0] in NOT_ABOUT_ITSELF else {parts[0], parts[-1], "".join(parts)}


def region(tag: str, attributes: list[tuple[str, str | None]], around: float, in_main: bool) -> float:
    """What an element says of all it holds, given what its surroundings said."""
    said = {k: v or "" for k, v in attributes}
    if "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", ""):
        return -REGION
    if tag in PLAIN_TAGS or tag == "header" and not in_main:
        return -REGION
    names = set().union(*[_words(x) for k in ("class", "id", "role") for x in said.get(k, "").split()])
    if in_main:
        names.discard("header")
    if tag not in ("body", "html", "main") and names & PLAIN_WORDS:
        return -REGION
    if around >= 0 and (tag in MAIN_TAGS or names & MAIN_WORDS):
        return REGION if tag in MAIN_TAGS else max(around, REGION / 2)
    return around


class Page(HTMLParser):
    """Blocks of a page: (text, words, share in links, region, tag, path of element numbers)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, float, float, str, tuple[int, ...]]] = []
        self.open: list[tuple[str, float, bool, bool, int]] = [("", 0.0, False, False, 0)]
        self.count: dict[str, int] = {}
        self.made = 0
        self.text: list[str] = []
        self.linked = self.unseen = self.links = 0

    def _flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            text = " ".join(words)
            tag, said = next(((e[0], e[1]) for e in reversed(self.open) if e[0] not in INLINE), ("", 0.0))
            path = tuple(e[4] for e in self.open if e[0] not in INLINE)
            self.blocks.append((text, min(1.0, self.linked / max(1, len(text))), min(said, self.open[-1][1]), tag, path))
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            if tag == "br" or tag == "hr":
                self.text.append(" ")
                if tag == "br":
                    return
            self._flush()
            if self.count.get("p") and (tag == "p" or tag in CONTAINERS or tag[0] == "h" and tag[1:].isdigit()):
                self._close("p", CONTAINERS - {"tr"})
            for other in ENDS_ITSELF.get(tag, ()):
                if self.count.get(other):
                    self._close(other, {"ul", "ol", "dl", "table"})
        if tag in VOID:
            return
        _, said, in_main, _, _ = self.open[-1]
        self.made += 1
        self.open.append((tag, region(tag, attrs, said, in_main), in_main or tag in MAIN_TAGS, tag in UNSEEN, self.made))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.count.get(tag):
            self._close(tag, ())

    def _close(self, tag: str, stop) -> None:
        """Close the innermost open element of a name, and what it holds, unless one of `stop` lies between."""
        at = len(self.open) - 1
        while at and self.open[at][0] != tag:
            if self.open[at][0] in stop:
                return
            at -= 1
        for name, _, _, unseen, _ in self.open[at:] if at else ():
            self.count[name] -= 1
            self.unseen -= unseen
            self.links -= name == "a"
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of unknown or malformed names are comments up to the next `>`, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def close(self) -> None:
        super().close()
        self._flush()


def cost(text: str, linked: float, said: float, tag: str) -> float:
    """How much rather content than boilerplate."""
    words = text.count(" ") + 1
    value = said + min(3.0, 0.75 * words.bit_length() - 2.0) - LINKS * linked
    if tag in ("p", "blockquote", "pre", "figcaption") or tag[:1] == "h" and tag[1:].isdigit():
        value += TEXT_TAG
    elif tag in ("li", "td", "th", "dt", "dd"):
        value += LIST_TAG
    if text[-1] in SENTENCE_END:
        value += SENTENCE
    if "©" in text or "®" in text:
        value += SIGN
    return value


def edges(paths: list[tuple[int, ...]]) -> dict[tuple[int, int], float]:
    """Neighbours in the page, and successive blocks of a parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, path in enumerate(paths):
        if i:
            other, shared = paths[i - 1], 0
            for a, b in zip(path, other):
                if a != b:
                    break
                shared += 1
            out[i - 1, i] = NEXT / (1 + len(path) + len(other) - 2 * shared)
        parent = path[-2] if len(path) > 1 else path[-1]
        if parent in last:
            out[last[parent], i] = out.get((last[parent], i), 0.0) + SIBLING
        last[parent] = i
    return out


def cut(costs: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of the minimum cut: True on the content side."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in links.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    costs = list(costs)
    pull = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = [i for i in range(n) if abs(costs[i]) > pull[i]]
    while queue:
        i = queue.pop()
        if label[i] is not None:
            continue
        label[i] = costs[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                costs[j] += c if label[i] else -c
                pull[j] -= c
                if abs(costs[j]) > pull[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, kept in zip(rest, _flow(rest, costs, near, label)):
            label[i] = kept
    return [bool(x) for x in label]


def _flow(rest: list[int], costs: list[float], near: list[dict[int, float]], label: list[bool | None]) -> list[bool]:
    """Maximum flow by shortest augmenting paths in layers; the source's side of the cut."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    left: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i, k in place.items():
        if costs[i] > 0:
            left[source][k], left[k][source] = costs[i], 0.0
        elif costs[i] < 0:
            left[k][sink], left[sink][k] = -costs[i], 0.0
        for j, c in near[i].items():
            if label[j] is None:
                left[k][place[j]] = c
    least = 1e-9
    while True:
        layer = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c in left[a].items():
                if c > least and b not in layer:
                    layer[b] = layer[a] + 1
                    queue.append(b)
        if sink not in layer:
            return [k in layer for k in range(len(rest))]
        order, tried = [list(x) for x in left], [0] * len(left)
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                amount = min(left[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    left[x][y] -= amount
                    left[y][x] = left[y].get(x, 0.0) + amount
                path = [source]
                continue
            while tried[a] < len(order[a]):
                b = order[a][tried[a]]
                if left[a][b] > least and layer.get(b) == layer[a] + 1:
                    path.append(b)
                    break
                tried[a] += 1
            else:
                layer.pop(a, None)
                path.pop()


def label_blocks(html: str | None) -> list[tuple[str, bool]]:
    """The blocks of a page in order, and whether each is content."""
    if not html:
        return []
    page = Page()
    page.feed(html)
    page.close()
    blocks = page.blocks
    kept = cut([cost(*b[:4]) for b in blocks], edges([b[4] for b in blocks]))
    return [(b[0], k) for b, k in zip(blocks, kept)]


def main_text(html: str | None) -> str:
    return " ".join(text for text, kept in label_blocks(html) if kept)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each page."""
    if text.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {text!r} is there already; choose another result name")
    place = df.columns.index(html)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py()) for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return long_texts(df).mapInArrow(run, schema)
