"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier, fitted to labelled
pages, gives each block the log odds of being content: what it costs to call it
boilerplate, or if negative, to call it content. These are the capacities of
its edges to the two terminals. Neighbouring blocks are tied by smoothness edges
that weaken with the number of element borders between them, and so are blocks
of one parent. The maximum flow between the terminals gives the minimum cut,
which separates content from boilerplate with the least total cost. Names of
classes and elements are features only: they don't decide alone.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of their own (those of raw text run to the page's end without an end tag, of others then only the tag is skipped), of inline markup, and without an end tag.
RAW = frozenset("script style iframe textarea title".split())
HIDDEN = frozenset("noscript template svg select object canvas math audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the second kind, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
#: Elements, and words in names (of a class, id or role), that mostly stand for boilerplate or content; words that say where in something a thing is; words of states.
BAD_TAGS = frozenset("nav footer aside menu button dialog fieldset".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "subscription login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "pagination pager skip search widget widgets copyright legal disclaimer contentinfo complementary".split()
)
GOOD_WORDS = frozenset("article content post story entry text articlebody".split())
GOOD_TAGS = frozenset(("article", "main"))
PLACE_WORDS = frozenset("body content text inner outer wrap wrapper area item items list box container block section row col column top bottom left right main primary secondary panel bar group slot zone thread links link title posts post stories signup site page".split())
STATE_WORDS = frozenset("no not without with has have is enabled disabled on off free open closed active hide show".split())
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDES = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_MAIN = re.compile(r"\bdata-main\b")
_OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r""">|=\s*["']""")
#: Characters after which a tag whose quotes don't close ends at its first ``>`` instead.
LONG_TAG = 1 << 16

#: What the classifier sees of a block.
FEATURES = ("bias", "bad_tag", "bad_name", "bad_part", "form", "good_tag", "good_name", "linked", "words", "stop", "heading", "paragraph", "short")
#: Ridge of the fit; smoothness of neighbours (over the borders between them) and of the next block with the same parent.
RIDGE, ADJACENT, SIBLING = 0.05, 3.0, 1.0


@functools.lru_cache(maxsize=4096)
def judge_name(name: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role names boilerplate, has such a word in it, or names content.

    In ``post-comments`` and ``comment-body`` the thing is the comments; in
    ``search-result`` or ``banner-image`` it is something else; ``no-sidebar``
    and ``share-enabled`` speak of a state.
    """
    words = _PARTS.findall(_CAMEL.sub(" ", name).lower())
    if not STATE_WORDS.isdisjoint(words):
        return False, False, False
    bad = [k for k, w in enumerate(words) if w in BAD_WORDS and not (w == "header" and k and words[k - 1] in GOOD_WORDS)]
    if bad:
        whole = all(w in PLACE_WORDS or w in BAD_WORDS for w in words[bad[-1] + 1:])
        return whole, not whole, False
    return False, False, not GOOD_WORDS.isdisjoint(words)


class Block:
    __slots__ = ("text", "marks", "linked", "parent", "tag", "near", "main")

    def __init__(self, text, marks, linked, parent, tag, near, main):
        #: marks: bad tag, number of the form (0: none), bad name, bad word, good tag, good name; near: borders since the block before.
        self.text, self.marks, self.linked, self.parent, self.tag, self.near, self.main = text, marks, linked, parent, tag, near, main


def tokens_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether an end tag, and attributes of each piece of markup, left to right.

    What isn't shown (comments, scripts, hidden elements) is one piece without a
    name. Each kind of end is searched for once after its last, so long pages
    with many beginnings and no end take linear time.
    """
    gone: dict[str, int] = {}
    ends: dict[str, re.Pattern] = {}

    def find(what: str, at: int) -> int:
        if at >= gone.get(what, len(page) + 1):
            return -1
        k = page.find(what, at)
        if k < 0:
            gone[what] = at
        return k

    def end_of_element(name: str, at: int) -> int:
        """After the end tag of ``name``; -1: there is none."""
        if at >= gone.get("</" + name, len(page) + 1):
            return -1
        m = ends.setdefault(name, re.compile(f"</{name}(?![a-z0-9])[^>]*>?", re.I)).search(page, at)
        if not m:
            gone["</" + name] = at
            return -1
        return m.end()

    def end_of_tag(at: int) -> int:
        first = find(">", at)
        if first < 0:
            return -1
        j = at
        while (m := _STOP.search(page, j, at + LONG_TAG)) is not None:
            if m[0] == ">":
                return m.start()
            j = find(m[0][-1], m.end()) + 1
            if not j or j > at + LONG_TAG:
                break
        return first

    at = 0
    while (m := _OPENS.search(page, at)) is not None:
        a = m.start()
        if m[0] == "<!--":
            b = find("-->", a + 4)
            at = len(page) if b < 0 else b + 3
            yield a, at, "", False, ""
            continue
        if page[a + 1] in "!?":
            b = find(">", a)
            if b < 0:
                return
            at = b + 1
            yield a, at, "", False, ""
            continue
        closing = page[a + 1] == "/"
        n = _NAME.match(page, a + 1 + closing)
        b = end_of_tag(n.end())
        if b < 0:
            return
        name, attributes, at = n[0].lower(), page[n.end():b], b + 1
        if not closing and name in RAW:
            done = end_of_element(name, at)
            at = len(page) if done < 0 else done
            yield a, at, "", False, " "
        elif not closing and name in HIDDEN and not attributes.endswith("/"):
            done = end_of_element(name, at)
            at = at if done < 0 else done
            yield a, at, "", False, " "
        elif name in HIDDEN:
            yield a, at, "", False, " "
        else:
            yield a, at, name, closing, attributes


def _marked(tag: str, attributes: str, marks: tuple, number: int) -> tuple:
    """The marks of an element, the ``number``-th of the page, inside one with ``marks``."""
    bad_tag, form, bad, part, good_tag, good = marks
    if tag in GOOD_TAGS:
        good_tag, form = True, 0
    if tag in BAD_TAGS or tag == "header" and not good_tag:
        bad_tag = True
    form = number if tag == "form" else form
    if attributes:
        if _HIDES.search(attributes):
            bad_tag = bad = True
        if tag not in ("html", "body", "article", "main"):
            for m in _NAMED.finditer(attributes):
                for name in (m[1] or m[2] or m[3] or "").split():
                    x, y, z = judge_name(name)
                    bad, part, good = bad or x, part or y, good or z
    return bad_tag, form, bad, part, good_tag, good


def blocks_of(page: str) -> list[Block]:
    """Text between the borders of block elements, with what the classifier needs."""
    out: list[Block] = []
    #: tag, number, marks, whether marked as content (in labelled pages)
    stack: list[tuple[str, int, tuple, bool]] = [("", 0, (False, 0, False, False, False, False), False)]
    number, links, pieces, linked = 0, 0, [], 0
    depth = lowest = 0

    def flush():
        nonlocal pieces, linked, depth, lowest
        if pieces:
            raw = "".join(pieces)
            text = " ".join((htmllib.unescape(raw) if "&" in raw else raw).split())
            if text:
                k = len(stack) - 1
                tag, _, marks, main = stack[k]
                out.append(Block(text, marks, min(1.0, linked / len(raw)), stack[k - 1][1] if k else 0, tag, max(1, depth + k - 2 * min(lowest, k)), main))
                depth = lowest = k
        pieces, linked = [], 0

    def close(k: int):
        nonlocal lowest
        del stack[k:]
        lowest = min(lowest, k - 1)

    at = 0
    for a, b, tag, closing, attributes in tokens_of(page):
        if a > at:
            pieces.append(page[at:a])
            if links:
                linked += a - at
        at = b
        if not tag:
            if attributes:
                pieces.append(attributes)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag == "br":
                pieces.append(" ")
            elif tag == "span" and not closing and attributes:
                marks = _marked(tag, attributes, stack[-1][2], number)
                if marks != stack[-1][2] and (marks[0] or marks[2]):
                    flush()
                    number += 1
                    stack.append(("div-span", number, marks, stack[-1][3]))
                elif stack[-1][0] in ("div-span", "in-span"):
                    stack.append(("in-span", number, stack[-1][2], stack[-1][3]))
            elif tag == "span" and stack[-1][0] in ("div-span", "in-span"):
                if not closing:
                    stack.append(("in-span", number, stack[-1][2], stack[-1][3]))
                elif stack[-1][0] == "in-span":
                    stack.pop()
                else:
                    flush()
                    close(len(stack) - 1)
            continue
        flush()
        if closing:
            links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        ended, within = IMPLIED.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if ended else ():
            if stack[k][0] in within:
                break
            if stack[k][0] in ended:
                close(k)
                if tag != "tr":
                    break
        number += 1
        _, _, marks, main = stack[-1]
        stack.append((tag, number, _marked(tag, attributes, marks, number), main or bool(attributes and _MAIN.search(attributes))))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row for each block. What speaks for content counts outside of boilerplate only; a form that holds most of the page isn't one to fill in."""
    out = np.zeros((len(blocks), len(FEATURES)))
    held: dict[int, int] = {}
    for b in blocks:
        held[b.marks[1]] = held.get(b.marks[1], 0) + len(b.text)
    half = sum(held.values()) / 2
    for row, b in zip(out, blocks):
        n = b.text.count(" ") + 1
        bad_tag, form, bad, part, good_tag, good = b.marks
        small = form > 0 and held[form] < half
        out_of = bad_tag or bad or small
        stop = n >= 4 and b.text[-1] in ".!?\u2026\"'\u201d\u00bb"
        heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
        row[:9] = 1, bad_tag, bad, part and not out_of, small, good_tag and not out_of, good and not out_of, b.linked, min(n, 60) ** 0.5 / 4
        if not out_of:
            row[9:] = stop, heading, b.tag in ("p", "pre", "blockquote"), n < 4
    return out


def fit(pages: list[str], ridge: float = RIDGE) -> np.ndarray:
    """Weights of the logistic regression of ``data-main`` on the features, by Newton's steps."""
    blocks = [b for page in pages for b in blocks_of(page)]
    x, y = features_of(blocks), np.array([b.main for b in blocks], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@functools.cache
def default_weights() -> np.ndarray:
    from .html_training import PAGES

    return fit(PAGES)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """The edges between blocks."""
    edges = [(k - 1, k, ADJACENT / b.near) for k, b in enumerate(blocks) if k]
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if (j := last.get(b.parent, k)) < k - 1:
            edges.append((j, k, SIBLING))
        last[b.parent] = k
    return edges


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a minimum cut; True: on the source's side, content.

    A positive gain is the capacity from the source, a negative one that to the
    sink. A block whose gain outweighs all its edges is on its side in every
    minimum cut; it is settled and its edges are added to its neighbours' gains,
    again and again. Maximum flows in level graphs settle what is left, which is
    seldom more than a few blocks.
    """
    n = len(gains)
    gain = [float(g) for g in gains]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    tied = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = [k for k in range(n) if abs(gain[k]) >= tied[k]]
    while queue:
        k = queue.pop()
        if label[k] is not None:
            continue
        label[k] = gain[k] > 0
        for j, c in near[k].items():
            if label[j] is None:
                gain[j] += c if label[k] else -c
                tied[j] -= c
                if abs(gain[j]) >= tied[j] - 1e-12:
                    queue.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        side = _flow(rest, gain, near)
        for k in rest:
            label[k] = k in side
    return label


def _flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source's side of the cut among ``rest``."""
    inside = set(rest)
    spare = {k: {j: c for j, c in near[k].items() if j in inside} for k in rest}
    source, sink = {k: max(gain[k], 0.0) for k in rest}, {k: max(-gain[k], 0.0) for k in rest}
    while True:
        level = {k: 0 for k in rest if source[k] > 1e-9}
        queue, reached = deque(level), False
        while queue:
            k = queue.popleft()
            reached |= sink[k] > 1e-9
            for j, c in spare[k].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        ahead = {k: [j for j in spare[k] if level.get(j) == level[k] + 1] for k in level}
        for start in [k for k in level if level[k] == 0]:
            path = [start]
            while path and source[start] > 1e-9:
                k = path[-1]
                if sink[k] > 1e-9:
                    flow = min([source[start], sink[k], *(spare[x][y] for x, y in zip(path, path[1:]))])
                    source[start] -= flow
                    sink[k] -= flow
                    for x, y in zip(path, path[1:]):
                        spare[x][y] -= flow
                        spare[y][x] = spare[y].get(x, 0.0) + flow
                    path = [start]
                    continue
                while ahead[k] and spare[k][ahead[k][-1]] <= 1e-9:
                    ahead[k].pop()
                if ahead[k]:
                    path.append(ahead[k][-1])
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    gains = features_of(blocks) @ (default_weights() if weights is None else weights)
    keep = minimum_cut(gains.tolist(), smoothness(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, keep) if y)


def extract_main_text(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` with ``text`` and ``n_chars`` (code points) of each page's main text.

    Row by row, so nothing is shuffled. Null html is empty, and a page without
    content has an empty text. Markup that doesn't end is read as far as it goes:
    see :func:`tokens_of`. A very long page is read whole. Repeated rows stay;
    other columns are ignored, and a key named ``text`` or ``n_chars`` gives way
    to the result. The classifier is fitted once, on the driver.
    """
    kinds, keys, weights = dict(pages.dtypes), tuple(k for k in keys if k not in ("text", "n_chars")), default_weights()
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_chars bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(x, weights) for x in frame.pop("__html")]
            yield frame.assign(text=pd.Series(texts, index=frame.index, dtype=object), n_chars=pd.Series([len(t) for t in texts], index=frame.index, dtype="int64"))

    return pages.select(*keys, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__html")).mapInPandas(run, schema)
