"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read from left to right into flat blocks of text, cut wherever a block-level
element begins or ends.  Each block is described by its words, the share of them inside
links, the same of the blocks before and after, and what it stands in: an element or a class
name that speaks of menus, adverts and the like and how plainly, an article, a heading.  A decision tree
trained on the blocks of the labelled pages below says which blocks are main text.

Markup need not be well formed: elements that are never closed end with what holds them.

Defined results: null or empty html gives empty text, as does a page without main text;
repeated rows give a row each; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they lay out text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style head noscript template svg math iframe object canvas audio video select button textarea title".split())

#: Silent elements whose text is no markup, so only their end tag ends them, and those that may hold each other.
RAW_TAGS = frozenset("script style textarea title".split())
NESTING_TAGS = frozenset("template object svg math".split())

#: Elements, and words of class, id and role names, that say a part is not main text.
APART_TAGS = frozenset("nav aside footer form menu dialog".split())
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget notice notices cookie cookies consent gdpr alert popup modal "
    "newsletter subscribe signup login form search comment comments reply replies disqus respond share sharing social "
    "related recommended pagination pager disclaimer copyright".split()
)
MAIN_NAMES = frozenset("article main content post entry story".split())

#: How far a part stands apart: a name that has such a word among others, a form, a name or element of its own, hidden.
#: An article within ends what is less than APART, main ends what is less than HIDDEN.
HINTED, FORM, APART, HIDDEN = 0.4, 0.8, 1.0, 2.0

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:\b(?:class|id|role)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})\b", re.I)


def _end_of_silent(page: str, name: str, at: int) -> int:
    """Where a silent element ends whose start tag ends at ``at``; one that is never closed ends at the next block tag."""
    close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(page, at)
    if name == "head":
        return close.end() if close else at
    if name in RAW_TAGS:
        return close.end() if close else len(page)
    if close and (name in NESTING_TAGS or not re.compile(rf"<{name}\b", re.I).search(page, at, close.start())):
        return close.end()
    block = _BLOCK.search(page, at)
    return block.start() if block else len(page)


def _apart_by_names(tokens: list[str]) -> float:
    """How far class, id and role names set a part apart."""
    level = 0.0
    for token in tokens:
        words = set(re.split(r"[^a-z]+", token)) - {""}
        if words & APART_NAMES:
            level = max(level, APART if words <= APART_NAMES else HINTED)
    return level


def flat_blocks(page: str) -> list[dict]:
    """Blocks in page order: text and what it stands in."""
    blocks, parts, linked = [], [], 0
    stack: list[tuple[str, float, bool, bool]] = []  # name, apart, main, link
    apart, main, link = 0.0, False, False
    heading = ""
    at, end = 0, len(page)

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(text for text, _ in parts)
            text = " ".join(raw.split())
            if text:
                inside = sum(len(t.split()) for t, in_link in parts if in_link)
                blocks.append({"text": text, "words": len(text.split()), "linked": inside, "apart": apart, "main": main, "heading": heading})
        parts = []

    def add(raw: str) -> None:
        if raw:
            parts.append((html.unescape(raw) if "&" in raw else raw, link))

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at: found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        block = name in BLOCK_TAGS
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if block:
                close_block()
            if depth is not None:
                del stack[depth:]
        else:
            if name in SILENT_TAGS and not found[3].rstrip().endswith("/"):
                at = _end_of_silent(page, name, at)
                continue
            if name == "br":
                add("\n")
                continue
            if block:
                close_block()
                # a block-level element ends an open paragraph, and an item the item before
                ended = {"p"} | ({name} if name in ("li", "dt", "dd", "td", "th", "tr", "option") else set())
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK_TAGS), None)
                if depth is not None and stack[depth][0] in ended:
                    del stack[depth:]
            if name in VOID_TAGS:
                continue
            _, was_apart, was_main, was_link = stack[-1] if stack else ("", 0.0, False, False)
            names, tokens = set(), []
            if "=" in found[3]:
                for groups in _NAMES.findall(found[3]):
                    tokens += "".join(groups).lower().split()
                    names.update(re.split(r"[^a-z]+", "".join(groups).lower()))
            is_main = name in ("article", "main") or (not names.isdisjoint(MAIN_NAMES) and names.isdisjoint(APART_NAMES))
            own = FORM if name == "form" else APART if name in APART_TAGS or (name == "header" and not was_main) else 0.0
            if name not in ("html", "body", "article", "main"):  # these hold everything, whatever their names say
                own = max(own, _apart_by_names(tokens))
            if _HIDDEN.search(found[3]):
                own = HIDDEN
            if (name == "article" or (name == "h1" and was_main)) and was_apart < APART or name == "main" and was_apart < HIDDEN:
                was_apart = 0.0
            stack.append((name, max(was_apart, own), was_main or is_main, was_link or name == "a"))
        _, apart, main, link = stack[-1] if stack else ("", 0.0, False, False)
        heading = next((tag for tag, *_ in reversed(stack) if tag in ("h1", "h2", "h3", "h4", "h5", "h6")), "")
    close_block()
    return blocks


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "apart", "main", "heading"]


def features(blocks: list[dict]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours beyond the page have no words."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b["words"] for b in blocks], dtype=float)
    density = np.array([b["linked"] / max(b["words"], 1) for b in blocks])
    before, after = np.concatenate([[0], words[:-1]]), np.concatenate([words[1:], [0]])
    d_before, d_after = np.concatenate([[0], density[:-1]]), np.concatenate([density[1:], [0]])
    stands = np.array([[min(b["apart"], APART), b["main"], bool(b["heading"])] for b in blocks], dtype=float)
    return np.column_stack([words, density, before, d_before, after, d_after, stands])


class Tree:
    """Decision tree by Gini impurity; ``feature, cut, below, above`` or a leaf's class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least):
        share = y.mean()
        if depth == 0 or share in (0.0, 1.0):
            return bool(share >= 0.5)
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, j] <= cut
                n = int(low.sum())
                if min(n, len(y) - n) < least:
                    continue
                p, q = y[low].mean(), y[~low].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, j, float(cut), low)
        if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
            return bool(share >= 0.5)
        _, j, cut, low = best
        return (j, cut, self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least))

    def predict(self, x: np.ndarray) -> list[bool]:
        out = []
        for row in x.tolist():
            node = self.root
            while not isinstance(node, bool):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            out.append(node)
        return out


_LONG = "The river rose through the night and by morning the lower fields stood under water, while the people of the village carried what they could to the church."
_MORE = "Nobody remembered such a flood, and the old bridge, which had been mended only last year, was gone before anyone thought of closing it."

# The labelled table: pages whose blocks of main text begin with an asterisk.
LABELLED = [
    f"<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>World news</a></li><li><a href=c>Sport</a></li></ul></nav>"
    f"<div class=ad>Buy two lamps and get a third one free today.</div><article><h1>*The flood</h1><p>*{_LONG}</p><p>*It rained.</p>"
    f"<p>*{_MORE}</p><p>*No.</p></article><footer>&copy; The Daily Post &middot; all rights reserved by the owners.</footer></body></html>",
    f"<body><header><a href=/>Valley Times</a> <p>News from the valley since 1890 and on every day of the week</p></header><main><h2>*Bridge lost</h2>"
    f"<p>*{_MORE} <a href=x>See the map</a>.</p><ul><li>*Two boats were found.</li><li>*Nobody was hurt in the end.</li></ul><p>*{_LONG}</p>"
    f"<div class=share><a href=1>Share</a> <a href=2>Send</a></div><section class=comments><h3>Comments</h3><p>I was there and it was far worse than you say, believe me.</p>"
    f"<p>Me too.</p></section></main><aside><h4>Most read</h4><p>Ten ways to dry a carpet without a machine, and why nobody uses them.</p></aside></body>",
    f"<body><div id=menu><a href=1>Start</a><a href=2>About us</a></div><div class=cookie-notice><p>We use cookies to make this site work better for you and for our partners.</p></div>"
    f"<div class=content><h1>*Report</h1><p>*{_LONG}</p><p>*Yes.</p><p>*{_MORE}</p></div><form><p>Your mail address</p><p>We write to you once a week and never sell what you tell us here.</p></form>"
    f"<div class=footer><p>Contact, imprint and terms of use of this site can be found on the pages below.</p></div></body>",
    f"<body><p><a href=1>Home</a></p><p><a href=1>Weather</a> <a href=2>Traffic</a> <a href=3>Prices</a></p><p>*{_LONG}</p><p>*{_MORE}</p><p>*{_LONG} {_MORE}</p><p>Top</p>"
    f"<p><a href=9>Back to the list of all pages</a></p></body>",
    f"<body><div><a href=1>One</a> | <a href=2>Two</a></div><div>Advertisement</div><div>*{_MORE}</div><div>*{_LONG}</div><div>*{_MORE} {_LONG}</div><div>Page 2</div><div><a href=4>Next page</a></div></body>",
    f"<body><article><header><h1>*A quiet week</h1></header><p>*{_MORE}</p><p>*{_LONG}</p><p>*Then it stopped.</p><blockquote>*We saw it come.</blockquote>"
    f"<div class=related><p>Also in this paper, the story of the mill that was built on sand by two brothers.</p><a href=1>Read</a></div></article></body>",
    "<body><nav><a href=1>First</a><a href=2>Second item</a></nav><article><h1>*One word</h1><p>*Over.</p></article><footer>All rights reserved.</footer></body>",
    f"<body><article><p>*One <a href=1>two</a> three.</p><p>*{_LONG}</p><p>*Short one here.</p><p>*{_MORE}</p><p><a href=1>More stories like this one</a></p><p><a href=2>Next story</a></p></article></body>",
    f"<body><nav><a href=1>Start</a></nav><article><h1>*Two hundred years</h1><p>*{_LONG} {_MORE}</p><p>*{_MORE} {_LONG}</p><p>*Gone.</p><p>*{_LONG} {_MORE} {_LONG}</p>"
    f"<h2>*What is left</h2><p>*{_MORE} {_MORE}</p><p>*{_LONG}</p><p>*{_MORE} {_LONG}</p><p>*It was late.</p></article><footer>Valley Times, printed on the first day of the week.</footer></body>",
    f"<body><div class=sidebar><p>{_LONG}</p><p>Tip of the day.</p></div><div class=post><p>*{_LONG} {_MORE}</p><p>*{_MORE} {_LONG} {_MORE}</p><p>*And then?</p><p>*{_MORE} {_LONG}</p></div>"
    f"<div id=comments><p>{_MORE} {_LONG}</p><p>First!</p></div></body>",
    f"<body><div>*{_LONG} {_MORE}</div><div>*{_MORE} {_LONG}</div><div>*{_LONG} {_MORE}</div><div>*{_MORE}</div><div>*{_LONG} {_LONG}</div><div>Print</div><div>Up</div></body>",
    f"<body><div class=site-header><a href=1>Valley Times</a></div><div class='page has-sidebar'><p>*{_LONG}</p><p>*{_MORE}</p><p>*{_LONG} {_MORE}</p><p>*{_MORE} {_LONG}</p></div>"
    f"<div class=left-sidebar><p><a href=1>Weather</a> <a href=2>Traffic</a></p><p>Tip of the day.</p><p>Most read</p></div><div class=site-footer>All rights reserved.</div></body>",
    f"<body><div class=main-menu><a href=1>Start</a> <a href=2>About us</a></div><div class=with-banner><p>*{_MORE} {_LONG}</p><p>*{_LONG}</p><p>*{_MORE}</p></div>"
    f"<div class=share-buttons><a href=1>Share</a> <a href=2>Send</a></div><div class=page-footer>Printed on the first day.</div></body>",
    f"<article><h1>*Early end</h1><p>*{_LONG}</p><p>*It rained.</p></article>", f"<article><p>*{_MORE}</p><p>*They all went home.</p></article>",
    f"<p>*{_LONG}</p>", "<p>*The bridge was gone.</p>", f"<div class=post><p>*{_LONG}</p></div>", "<div class=post>*Nobody was hurt.</div>",
    f"<div class=wide-banner><p>*{_LONG} {_MORE}</p></div>", "<div class=top-banner>Buy two lamps today.</div>",
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    rows, answers = [], []
    for page in LABELLED:
        blocks = flat_blocks(page)
        rows.append(features(blocks))
        answers += [block["text"].startswith("*") for block in blocks]
    return np.concatenate(rows), np.array(answers, dtype=float)


_TREE: list[Tree] = []


def tree() -> Tree:
    """Trained once a process; the same table gives the same tree."""
    if not _TREE:
        _TREE.append(Tree(*labelled_blocks()))
    return _TREE[0]


def main_text(page: str | None) -> str:
    blocks = flat_blocks(page or "")
    return "\n\n".join(b["text"] for b, keep in zip(blocks, tree().predict(features(blocks))) if keep)


def main_text_column(page: Column) -> Column:
    """Main text of whole pages, blocks joined by an empty line."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in pages], dtype=object)

    return of(page)
