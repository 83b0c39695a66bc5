"""The main text of web pages: a linear-chain conditional random field over the blocks of a page.

A block is the text between two boundaries of block elements. Its evidence are its ancestors (tags, and the words in
their class, id and role) and its own text (length, links, punctuation, place). The chain's transition weights make neighbouring blocks
agree; Viterbi's path says which are main text. The model is fitted on :mod:`labelled_pages`.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tableflow.llm.batches import extend
from tableflow.llm.labelled_pages import MAIN, labelled_pages
from tableflow.llm.quality import forward_backward

PAGES = 800  # labelled pages to fit on
STEPS = 180
RIDGE = 1e-2
KNOWN_PATHS = 50_000  # remembered ancestor paths of a task

# Fixed values of HTML: elements that begin a block, that have no content, whose content is no text, and that end an open <p>.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html ins legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = frozenset("br hr".split())
_TEXTLESS = "script|style|title|textarea|noscript|template|iframe|svg|object|canvas"
# An end tag that is left out: a new element of the first kind ends an open one of the second, up to an element of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_NO_P = ({"p"}, {"td", "th", "table", "button", "li", "div", "article", "section", "blockquote"})
_ATTRIBUTES = r"""(?>(?:[^>"']|"[^"]*"|'[^']*')*)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_TEXTLESS})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES}|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")


@dataclass(slots=True)
class Block:
    """``path``: ancestors from the outermost on, as (tag, words of its names)."""

    path: tuple
    text: str
    linked: int  # characters in links


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [word.lower() for match in _NAMES.finditer(attributes) for word in _WORD.findall(match[1] or match[2] or match[3] or "")]
    return tuple(sorted(set(found)))


def _close(path: list, kinds: set, within: set) -> None:
    """Drop the innermost open element of ``kinds`` and what is in it, unless one of ``within`` is met first."""
    for at in range(len(path) - 1, -1, -1):
        if path[at][0] in kinds:
            del path[at:]
            return
        if path[at][0] in within:
            return


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order.

    Character references are decoded, runs of white space are one space. Comments and elements without text (scripts, styles, the page's title)
    are left out. End tags may be missing, tags wrongly nested and the page cut off anywhere: an unfinished tag at the end is dropped.
    A quote that never ends does not reach beyond the next ``>``.
    """
    found: list[Block] = []
    path: list[tuple] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                found.append(Block(tuple(path), text, linked))
            parts.clear()
        linked = 0

    for match in _TOKEN.finditer(page):
        start, end = match.span()
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        tag = match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BREAKS:
            flush()
        elif tag == "a":
            in_link = not match[2]
        elif tag in BLOCKS:
            flush()
            if match[2]:
                for place in range(len(path) - 1, -1, -1):
                    if path[place][0] == tag:
                        del path[place:]
                        break
                continue
            if tag != "ins" and tag not in ("option", "optgroup"):
                _close(path, *_NO_P)
            if tag in _ENDS:
                _close(path, *_ENDS[tag])
            path.append((tag, _names(match[4])))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


def path_features(path: tuple) -> set[str]:
    """Features of a block's ancestors."""
    found = {"constant", f"own {path[-1][0]}" if path else "own none"}
    inner = False  # inside an article
    for tag, names in path:
        found.add(f"in {tag}")
        if inner:
            found.add(f"article {tag}")
        inner = inner or tag in ("article", "main")
        for name in names:
            found.add(f"name {name}")
            if len(name) > 5:
                found.add(f"start {name[:5]}")
            if inner:
                found.add(f"article name {name}")
    return found


_LENGTHS = (1, 3, 8, 20, 50)


def text_features(block: Block, place: int, count: int) -> list[str]:
    """Features of a block's own text and its place among the page's ``count`` blocks."""
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    last = text[-1]
    return [
        f"words {sum(words > n for n in _LENGTHS)}",
        "links none" if not share else "links few" if share < 0.3 else "links many" if share < 0.8 else "links only",
        "ends sentence" if last in ".!?…:;" else "ends letter" if last.isalpha() else "ends other",
        "sign" if "©" in text or "®" in text else "no sign",
        f"from start {min(place, 3)}",
        f"from end {min(count - 1 - place, 3)}",
    ]


@dataclass
class Model:
    weights: dict[str, float]
    steps: list[list[float]]  # log weights from label to label; 1 is main text

    def __post_init__(self):
        self._paths: dict[tuple, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "steps": self.steps, "_paths": {}}

    def evidence(self, blocks: list[Block]) -> list[float]:
        """Log-odds of main text from each block's own features."""
        weights, paths, out = self.weights, self._paths, []
        for place, block in enumerate(blocks):
            base = paths.get(block.path)
            if base is None:
                if len(paths) >= KNOWN_PATHS:
                    paths.clear()
                base = paths[block.path] = sum(weights.get(f, 0.0) for f in path_features(block.path))
            out.append(base + sum(weights.get(f, 0.0) for f in text_features(block, place, len(blocks))))
        return out

    def labels(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's path: the most likely labels of all blocks together. Ties go to main text."""
        (w00, w01), (w10, w11) = self.steps
        no = yes = 0.0
        came = []
        for i, odds in enumerate(self.evidence(blocks)):
            if i:
                came.append((yes + w10 >= no + w00, yes + w11 >= no + w01))
                no, yes = max(no + w00, yes + w10), max(no + w01, yes + w11) + odds
            else:
                yes = odds
        label = yes >= no
        found = [label] if blocks else []
        for to_no, to_yes in reversed(came):
            label = to_yes if label else to_no
            found.append(label)
        return found[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        return " ".join(b.text for b, main in zip(blocks, self.labels(blocks)) if main)


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page without its marks, and which are main text."""
    blocks = blocks_of(page)
    labels = [int(MAIN in b.text) for b in blocks]
    for block in blocks:
        block.text = block.text.replace(MAIN, "")
    return blocks, labels


def train(pages: list[str]) -> Model:
    """Weights by Adam steps on the conditional likelihood of the labelled pages' blocks."""
    rows, columns, y, first, names = [], [], [], [0], {}
    pairs = np.zeros((2, 2))
    for page in pages:
        blocks, labels = labelled_blocks(page)
        for place, block in enumerate(blocks):
            for feature in [*sorted(path_features(block.path)), *text_features(block, place, len(blocks))]:
                rows.append(len(y) + place)
                columns.append(names.setdefault(feature, len(names)))
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += 1
        y += labels
        first.append(len(y))
    x = np.zeros((len(y), len(names)), np.float32)
    x[rows, columns] = 1
    truth, starts, n = np.array(y, float), np.array(first), len(pages)
    params, m, v = np.zeros(len(names) + 4), 0.0, 0.0
    for step in range(1, STEPS + 1):
        good, seen = forward_backward(x @ params[:-4].astype(np.float32), starts, params[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (truth - good).astype(np.float32), (pairs - seen).ravel()]) / n - RIDGE / n * params
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({name: float(params[i]) for name, i in names.items()}, params[-4:].reshape(2, 2).tolist())


@lru_cache(maxsize=2)
def fitted(pages: int = PAGES) -> Model:
    """The model of the labelled pages, fitted once per process."""
    return train(labelled_pages(pages))


def extract(pages: DataFrame, markup: str, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """``pages`` with ``text``, their main text, and ``n_chars``, its code points; no shuffle.

    A null, an empty page and one without main text have the empty text. ``keep`` names the columns to carry along (default: all); those
    called like the new ones are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def run(columns):
        model = shared.value
        texts = [model.main_text(page) for page in columns[0].to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    added = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])
    return extend(pages, [F.col(f"`{markup}`")], added, run, keep)
