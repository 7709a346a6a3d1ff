"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A block is a run of text without a block-level tag in it. Its features are the tags and the words of the class and id
names of all elements around it, and the shape of its text. Two labels, main and rest, follow one another with learned
weights; Viterbi finds the best labelling of the whole page. The field is trained here on labelled pages
(``labelled_pages``); its weights are as many as there are features in those, so they are small enough to send to all tasks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.labelled_pages import labelled_pages

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DARK = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title head".split())
RAW = frozenset("script style textarea title".split())
#: An opening tag of the first kind ends an open element of the second, inside the nearest element of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("html",)),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int
    around: tuple[str, ...]
    tag: str


@dataclass
class _Walk:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    around: Counter = field(default_factory=Counter)
    open: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    begun: tuple[tuple[str, ...], str] | None = None

    def push(self, tag: str, attributes: str) -> None:
        names = [x for m in _NAMES.findall(attributes) for x in _PART.findall("".join(m).lower())] if attributes else ()
        marks = tuple({"in=" + tag, *("name=" + x for x in names)})
        self.stack.append((tag, marks))
        self.around.update(marks)
        self.open[tag] += 1

    def pop(self) -> None:
        tag, marks = self.stack.pop()
        self.open[tag] -= 1
        for m in marks:
            self.around[m] -= 1
            if not self.around[m]:
                del self.around[m]

    def end(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            around, tag = self.begun
            self.blocks.append(Block(text, min(self.linked, len(text)), around, tag))
        self.pieces, self.linked, self.begun = [], 0, None

    def say(self, text: str) -> None:
        if self.begun is None and text.strip():
            tag = next((t for t, _ in reversed(self.stack) if t not in INLINE), "")
            self.begun = (tuple(self.around), tag)
        self.pieces.append(text)
        if self.open["a"]:
            self.linked += len(text)


def leaf_blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in their order; character references decoded, white space one space. Null and empty: none."""
    html, walk, at = html or "", _Walk(), 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        raw = m.group()
        if m.group(2) is None:
            if raw[0] != "<" or raw == "<":
                walk.say(entities.unescape(raw))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag not in INLINE:
                walk.flush()
            walk.end(tag)
            continue
        if tag in DARK:
            # Raw elements end at their own closing tag alone; others may nest.
            if tag not in INLINE:
                walk.flush()
            if m.group(3).endswith("/") and tag not in RAW:
                continue
            at = _after(html, at, tag)
            continue
        if tag not in INLINE:
            walk.flush()
            if walk.open["p"] and tag not in ("html", "body"):
                walk.end("p")
            closes, limit = ENDS.get(tag, ((), ()))
            for i in range(len(walk.stack) - 1, -1, -1) if closes and any(walk.open[t] for t in closes) else ():
                if walk.stack[i][0] in limit:
                    break
                if walk.stack[i][0] in closes:
                    while len(walk.stack) > i:
                        walk.pop()
        if tag == "br":
            walk.say(" ") if walk.begun else None
        elif tag not in VOID:
            walk.push(tag, m.group(3))
    walk.flush()
    return walk.blocks


def _after(html: str, at: int, tag: str) -> int:
    """Where the content of a dark element ends."""
    if tag == "head":
        # Its end tag may be left out; titles, styles and scripts inside are dark by themselves.
        return at
    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
    return close.end() if close else len(html)


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block."""
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        shape = f"words={min(7, int(math.log2(words)))}"
        link = f"linked={0 if share < 0.1 else 1 if share < 0.5 else 2 if share < 0.9 else 3}"
        rows.append(
            [*b.around, "tag=" + b.tag, shape, link, link + shape, "stop=" + str(b.text[-1] in ".!?:;\"'»…"), "mark=" + str(b.text[0] in "©·|»→•"),
             "first" if i == 0 else "last" if i == len(blocks) - 1 else "inside", "any"]
        )
    return rows


@dataclass(frozen=True)
class Crf:
    """``weights``: for main against rest, by feature; ``moves[a][b]``: label b after label a."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def label(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the labelling of all blocks with the highest sum of weights; 0 wins ties."""
        if not rows:
            return []
        get, m = self.weights.get, self.moves
        rest, main, back = 0.0, 0.0, []
        for i, row in enumerate(rows):
            gain = sum(get(f, 0.0) for f in row)
            if i == 0:
                rest, main = 0.0, gain
                continue
            stay, back0 = (rest + m[0][0], 0) if rest + m[0][0] >= main + m[1][0] else (main + m[1][0], 1)
            turn, back1 = (rest + m[0][1], 0) if rest + m[0][1] >= main + m[1][1] else (main + m[1][1], 1)
            rest, main = stay, turn + gain
            back.append((back0, back1))
        at = int(main > rest)
        out = [at]
        for steps in reversed(back):
            at = steps[at]
            out.append(at)
        return out[::-1]


def _log_add(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def train_crf(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by stochastic gradients with a rate per weight, over (features, labels) of pages."""
    w: dict[str, float] = {}
    squares: dict = {}
    moves = {(a, b): 0.0 for a in (0, 1) for b in (0, 1)}

    def step(store, key, gradient):
        gradient += decay * store.get(key, 0.0)
        squares[key] = squares.get(key, 0.0) + gradient * gradient
        store[key] = store.get(key, 0.0) - rate * gradient / (1e-6 + math.sqrt(squares[key]))

    for _ in range(epochs):
        for rows, labels in pages:
            n = len(rows)
            if not n:
                continue
            gain = [(0.0, sum(w.get(f, 0.0) for f in row)) for row in rows]
            ahead = [gain[0]]
            for i in range(1, n):
                ahead.append(tuple(gain[i][b] + _log_add(ahead[-1][0] + moves[0, b], ahead[-1][1] + moves[1, b]) for b in (0, 1)))
            behind = [(0.0, 0.0)]
            for i in range(n - 1, 0, -1):
                behind.append(tuple(_log_add(moves[a, 0] + gain[i][0] + behind[-1][0], moves[a, 1] + gain[i][1] + behind[-1][1]) for a in (0, 1)))
            behind.reverse()
            whole = _log_add(*ahead[-1])
            pull = {(a, b): 0.0 for a in (0, 1) for b in (0, 1)}
            for i in range(1, n):
                for a in (0, 1):
                    for b in (0, 1):
                        pull[a, b] += math.exp(ahead[i - 1][a] + moves[a, b] + gain[i][b] + behind[i][b] - whole) - (labels[i - 1] == a and labels[i] == b)
            for i in range(n):
                error = math.exp(ahead[i][1] + behind[i][1] - whole) - labels[i]
                if abs(error) > 1e-4:
                    for f in rows[i]:
                        step(w, f, error)
            for key, value in pull.items():
                step(moves, key, value)
    return Crf(w, ((moves[0, 0], moves[0, 1]), (moves[1, 0], moves[1, 1])))


def training_set(count: int = 600, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of labelled pages; the marker that a block begins with is taken off."""
    out = []
    for html, labels in labelled_pages(count, seed):
        blocks = leaf_blocks(html)
        marks = [re.match(r"©?·?\s*(@\d+@)\s*", b.text) or re.search(r"(@\d+@)\s*", b.text) for b in blocks]
        kept = [(b, m) for b, m in zip(blocks, marks) if m]
        for b, m in kept:
            b.text = (b.text[: m.start(1)] + b.text[m.end() :]).strip() or "x"
        out.append((block_features([b for b, _ in kept]), [labels[m.group(1)] for _, m in kept]))
    return out


def main_text(html: str | None, model: Crf) -> str:
    """Main blocks of a page, joined by line feeds; empty if there are none."""
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, y in zip(blocks, model.label(block_features(blocks))) if y)


def extract(pages: DataFrame, model: Crf | None = None, html: str = "html", prefix: str = "") -> DataFrame:
    """All columns of ``pages`` but the html, and its main ``text``, named with ``prefix``.

    Null and empty pages and pages without main blocks have the empty text. Repeated rows get equal texts; an empty table
    gives an empty result. A name that clashes raises ValueError. Without a model one is trained on ``labelled_pages``.
    """
    name = prefix + "text"
    keep = [c for c in pages.columns if c != html]
    if name in keep:
        raise ValueError(f"column {name} exists; choose another prefix")
    model = model or train_crf(training_set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [main_text(x.as_py(), model) for x in some.column(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], [*keep, name])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name != html)
    return pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`")).mapInArrow(run, f"{kinds}`{name}` string")
