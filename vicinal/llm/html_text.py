"""Main text of web pages: flat text blocks classified by a decision tree on shallow features of a block and its neighbours.

Word counts and link densities decide first.  What elements and class names
say is one more feature, a cue of four strengths: it is needed for prose that
is no main text, such as a reader's comment or an advert of two sentences,
which no density tells from a paragraph.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import lean

# How HTML elements and usual class names divide a page.
RAW = "script style noscript iframe textarea title".split()
#: Elements whose text is no main text; without a closing tag they end with their parent block.
HIDDEN = "template svg math object select option button canvas audio video map datalist".split()
FOREIGN = "svg math".split()
#: Parts of foreign elements that hold HTML, and tags that end foreign elements elsewhere.
INTEGRATION = "foreignobject desc annotation-xml".split()
BREAKOUT = """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre
ruby s small span strong strike sub sup table tt u ul var""".split()
BLOCKS = """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CONTENT = "article main".split()
BOILERPLATE = "nav footer aside header menu dialog search".split()
BOILERPLATE_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
BOILERPLATE_NAMES = """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus
footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted
recommended related remark remarks replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget""".split()
#: What may stand beside such a name without changing its meaning.
NEUTRAL_NAMES = """area bar block bottom box column container desktop fixed form global group inline inner item items left link links list message
mobile outer panel policy primary right row secondary section site slot small sticky text thread top unit user wrap wrapper""".split()
#: How strongly the elements around a block speak against it: a name among others, a form, an element, role or name of boilerplate.
WEAK, FORM, STRONG = 1, 2, 3

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(?P<close>/)?(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Block:
    text: str
    words: int = 0
    linked: int = 0
    content: bool = False  # inside an article or the main part
    cue: int = 0  # how strongly the elements around it speak against it


def _named(attrs: str) -> tuple[int, bool]:
    """The cue that an element's class, id and role give, and whether its role is that of main content."""
    cue, main = 0, False
    for m in ATTRIBUTE.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            if m[1].lower() == "role":
                main |= name.lower() in CONTENT
                cue = max(cue, STRONG if name.lower() in BOILERPLATE_ROLES else 0)
                continue
            parts = [x.lower() for x in NAME_PARTS.findall(name)]
            if not parts or parts[0] in ("has", "with", "no", "without"):
                continue
            known = [x in BOILERPLATE_NAMES for x in parts]
            if any(known) and all(k or x in NEUTRAL_NAMES or x.isdigit() for k, x in zip(known, parts, strict=True)):
                cue = STRONG
            elif known[0] or known[-1]:
                cue = max(cue, WEAK)
    return cue, main


def text_blocks(page: str) -> list[Block]:
    """The page's text between block tags, in order, white space turned into one blank; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open block elements: name, content, cue
    pieces: list[tuple[str, bool]] = []
    links = 0
    hidden: int | None = None  # where in the stack the first element stands whose text is left out

    def flush() -> None:
        if pieces and hidden is None:
            text = SPACE.sub(" ", "".join(t for t, _ in pieces)).strip()
            if text:
                linked = sum(len(t.split()) for t, a in pieces if a)
                _, content, cue = stack[-1] if stack else ("", False, 0)
                out.append(Block(text, len(text.split()), linked, content, cue))
            pieces.clear()

    def add(text: str) -> None:
        if hidden is None:
            pieces.append((text, links > 0))

    def foreign() -> bool:
        return next((s[0] in FOREIGN for s in reversed(stack) if s[0] in FOREIGN or s[0] in INTEGRATION), False)

    def drop(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal hidden
        del stack[k:]
        if hidden is not None and k <= hidden:
            hidden = None

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            add(html.unescape(page[at:lt]))
        if lt == end:
            break
        m = TAG.match(page, lt)
        if m is None:  # no tag: the character itself
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        closed = (m["attrs"] or "").endswith("/")
        if hidden is not None:
            if (name in BREAKOUT and not m["close"]) or (name == "p" and foreign()):
                while foreign():
                    drop(max(k for k, s in enumerate(stack) if s[0] in FOREIGN))
            if name in CONTENT and not m["close"] and stack[hidden][0] in ("button", "map"):
                drop(hidden)  # browsers show what stands in them
        if name in RAW_END and not m["close"]:
            if closed and hidden is not None and foreign():
                continue
            close = RAW_END[name].search(page, at)
            if close is None:
                at = end
            else:
                after = page.find(">", close.start())
                at = end if after < 0 else after + 1
            flush()
        elif name in HIDDEN or (hidden is not None and name in INTEGRATION):
            if m["close"]:
                k = max((k for k, s in enumerate(stack) if s[0] == name), default=-1)
                if k >= 0:
                    drop(k)
                continue
            if name in ("button", "option") and stack and stack[-1][0] == name:
                drop(len(stack) - 1)
            if name in ("button", "svg", "math"):
                add(" ")
            else:
                flush()
            if not (closed and (name in FOREIGN or (hidden is not None and foreign()))):
                _, content, cue = stack[-1] if stack else ("", False, 0)
                hidden = len(stack) if hidden is None else hidden
                stack.append((name, content, cue))
        elif hidden is not None and name not in BLOCKS:
            continue
        elif name == "a":
            links = 0 if m["close"] else 1
        elif name == "br":
            pieces.append((" ", False))
        elif name in BLOCKS:
            if hidden is None:
                flush()
                links = 0
            if name in VOID:
                continue
            if not m["close"]:
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                _, content, cue = stack[-1] if stack else ("", False, 0)
                named, main = _named(m["attrs"]) if name not in ("html", "body") and m["attrs"] else (0, False)
                if name in CONTENT or main:
                    # Only what surely is boilerplate around it speaks against an article: forms may hold whole pages.
                    content, cue = True, STRONG if cue == STRONG else 0
                elif name in BOILERPLATE and not (name == "header" and content):
                    cue = STRONG
                else:
                    cue = max(cue, named, FORM if name == "form" else 0)
                if not closed:
                    stack.append((name, content, cue))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if hidden is not None and k < hidden:  # ends with its parent block
                            hidden = None
                            flush()
                            links = 0
                        drop(k)
                        break
    flush()
    return out


#: What the tree sees: words and link density of the block and of its neighbours, whether it stands in an article, and the cue against it.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "cue")


def block_features(blocks: list[Block]) -> list[tuple[float, ...]]:
    shape = [(0.0, 0.0), *((float(b.words), b.linked / max(1, b.words)) for b in blocks), (0.0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], float(b.content), float(b.cue)) for i, b in enumerate(blocks)]


#: A small labelled table: a line for each part of a page, its blocks in order as words/linked words, then c in an article, w, f or s for
#: a weak cue, a form or a strong cue, and + for main text or - for what is not.
LABELLED = """
1/1s- 1/1s- 2/2s- 10/0s- 8/0c+ 60/0c+ 3/0c+ 25/2c+ 140/4c+ 9/0s-
1/1s- 3/3s- 2/2s- 1/1c+ 2/0c+ 1/0c+ 6/0s-
2/2- 1/1- 3/3- 8/0+ 60/0+ 25/2+ 75/0+ 6/6- 2/2- 3/3-
3/3- 2/2- 1/1- 2/2- 3/3- 9/0+ 40/0+ 55/1+ 80/0+ 15/0+ 2/2- 4/4- 2/2-
1/1- 1/1- 2/2- 1/1- 30/0+ 45/1+ 1/0+ 20/0+ 2/2- 2/2- 2/2-
2/0+ 2/0+
5/0+ 900/0+
3/0+
12/1+ 7/0+ 4/0+ 9/3+ 5/0+
8/0c+ 40/0c+ 6/6c+ 45/0c+ 12/12c+ 50/0c+ 2/2c+ 30/0c+
8/0+ 40/0+ 6/6+ 45/0+ 12/9+ 50/0+ 2/2+ 50/0+
7/0c+ 70/0c+ 55/0cs- 10/0cs- 3/3cs- 65/1c+ 90/0cs- 30/0cs- 4/0cs- 2/1cs-
1/1c- 2/2c- 3/3c- 60/0c+ 2/2c- 1/1c- 2/2c-
4/0c+ 2/2c- 1/1c- 3/3c- 1/1c- 2/0c+ 30/0c+
4/0c+ 5/5c+ 8/8c+ 6/6c+ 30/0c+ 7/7c+ 12/12c+
12/0s- 40/0s- 90/0s- 30/2s- 3/1s- 2/0s- 14/0s- 9/0+ 35/0+
45/0s- 200/3s- 20/0s- 1/0s- 5/0s- 60/0c+ 1/0s- 80/0s-
1/0w+ 1000/0+
7/0w+ 60/0+ 80/0+
4/0w+ 25/1w+ 40/0w+
3/0cw+ 45/0cw+ 70/3cw+ 12/0cw+ 30/0c+
60/0c+ 3/0cw+ 2/0cw+ 5/1cw+ 4/0cw+
8/0cw+ 1/0cw+ 6/0cw+ 10/0cw+
3/0w- 2/0w- 4/0w- 5/0w-
2/1w- 4/0w- 3/3w- 1/0w- 6/0w-
9/0+ 60/0+ 3/0f- 5/1f- 2/0f- 12/0f- 10/0s-
80/0f+ 120/2f+ 40/0f+ 35/1f+ 2/0f- 4/2f-
50/0+ 3/0f- 2/0f- 60/0s-
4/0f- 8/1f- 45/0+
12/0f- 6/0f- 70/0c+
1/0f- 3/0f- 6/0f- 15/0f-
5/5- 8/8- 12/12- 9/9- 7/7-
20/0+ 8/8- 9/9- 11/11-
6/6- 9/5- 7/7- 10/6- 4/4- 9/6-
50/0+ 9/5+ 60/0+ 10/4+ 40/0+
60/0+ 2/2- 3/3- 2/2- 5/0+
1/1- 1/1- 1/1-
2/2-
4/4- 40/36- 6/6-
"""


def labelled_rows(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of a table as ``LABELLED``."""
    x, y = [], []
    for line in table.split("\n"):
        found = re.findall(r"(\d+)/(\d+)(c?)([wfs]?)([+-])", line)
        x += block_features([Block("", int(n), int(k), bool(c), " wfs".index(cue or " ")) for n, k, c, cue, _ in found])
        y += [label == "+" for *_, label in found]
    return np.array(x), np.array(y, float)


@dataclass(frozen=True)
class Node:
    """A split of the tree (values up to ``at`` go left), or a leaf with the share of main text."""

    share: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def classify(self, x: tuple[float, ...]) -> bool:
        node = self
        while node.left is not None and node.right is not None:
            node = node.left if x[node.feature] <= node.at else node.right
        return node.share > 0.5


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A classification tree by Gini impurity, to pure leaves or the depth given."""
    share = float(y.mean())
    best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for at in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= at
                impurity = sum(part.mean() * 2 * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
                if impurity < best[0]:
                    best = (impurity, f, float(at))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1))


@functools.cache
def default_tree() -> Node:
    return grow_tree(*labelled_rows())


def main_text(page: str | None, tree: Node | None = None) -> str:
    """Blocks that the tree takes for main text, one a line; a null page is empty."""
    blocks = text_blocks(page or "")
    tree = tree or default_tree()
    return "\n".join(b.text for b, x in zip(blocks, block_features(blocks), strict=True) if tree.classify(x))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    Null or empty pages and pages without main text have an empty text; null
    ids and addresses stay null.  Tags that stay open, cut pages and stray
    characters are taken as browsers do.  Pages of any length are read whole.
    Repeated rows are kept, other columns left out, an empty table gives an
    empty result; nothing is shuffled.
    """
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
