"""Main text of HTML pages: flat text blocks, judged by a decision tree on their and their neighbours' words and links.

A page is a flat run of blocks. A block has its number of words and its link density, those of the
block before and after, the kind of element that it stands in (furniture such as ``nav``, none, or
``article`` and ``main``), whether the names of its containers suggest furniture, and whether a
tenth of the page's words or more stand in articles. A decision tree, grown on the labelled blocks of the small pages in
``LABELLED``, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm.work import table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_HOLDS = frozenset("article aside body details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td tr ul".split())
#: Elements that hold a page's furniture, or its article.
_FURNITURE = frozenset("aside dialog footer form menu nav".split())
_ARTICLE = frozenset("article main".split())
#: Words of names (class, id, role) that suggest furniture, weakly or strongly. A name counts if all its words are among these and the plain ones.
_WEAK = frozenset(
    "aside banner breadcrumb breadcrumbs byline complementary contentinfo copyright crumbs disclaimer follow footer form legal lightbox login masthead menu menubar nav navbar navigation pager pagination "
    "search share sharing sidebar signup skip social tags toolbar tooltip topbar widget widgets".split()
)
_STRONG = frozenset(
    "ad ads adslot advert advertisement advertising alert comment commentlist comments consent cookie cookies dialog discussion disqus gdpr modal newsletter notice notification overlay paywall popover popup promo promoted "
    "promotion recommended related replies reply responses skyscraper sponsor sponsored subscribe subscription teaser".split()
)
_PLAIN = frozenset("area bar block body bottom box btn button buttons card container content footnote group head header icon icons inner item items left link links list main outer page panel right row section site text title top wrap wrapper".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int  # 0: in a furniture element, 2: in an article, 1: in neither
    named: int  # 0: no, 1: weakly, 2: strongly named after furniture


def _named(tag: str) -> int:
    """How strongly the names in a tag suggest furniture."""
    found = 0
    for value in _NAMED.findall(tag):
        for name in "".join(value).lower().split():
            own = set(re.split(r"[^a-z]+", name)) - {""}
            if own and own <= _WEAK | _STRONG | _PLAIN:
                found = max(found, 2 if own & _STRONG else 1 if own & _WEAK else 0)
    return found


def blocks(page: str) -> list[Block]:
    """Runs of text between block-level tags, white space as single blanks, references decoded, in page order; scripts, styles, titles and comments are no text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, element, named
    pieces: list[tuple[str, bool]] = []
    element, named = 1, 0
    link = 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, in_link in pieces if in_link)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), element, named))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            pieces.append((page[at:upto], link > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if name in _RAW:
            if name in ("title", "textarea", "select", "button"):
                close()
            if not closing and not m[3].endswith("/"):
                stop = _RAW[name].search(page, at)
                at = stop.end() if stop else end
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name in _INLINE:
            continue
        close()
        link = 0
        if name not in _HOLDS:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif not m[3].endswith("/"):
            element, named = stack[-1][1:] if stack else (1, 0)
            if name != "body":
                own = _named(m[3])
                if name in _FURNITURE or (name == "header" and element != 2) or _HIDDEN.search(m[3]):
                    element = 0
                elif name in _ARTICLE and element == 1:
                    element = 2
                # A wrapper weakly named after its sidebar or menu may hold the article all the same.
                named = max(own, named if named == 2 or name not in _ARTICLE else 0)
            stack.append((name, element, named))
        element, named = stack[-1][1:] if stack else (1, 0)
    close()
    return out


FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "element", "named", "covered")
#: Small pages with labelled blocks: {n} stands for n words, [n] for n linked words, and a star before them marks main text.
LABELLED = """
<nav><ul><li>[1]<li>[1]<li>[2]</ul></nav><div class=ad>{9}</div><article><h1>*{6}</h1><p>*{60}<p>*{1}<p>*{45}*[2]<p>*{3}<p>*{120}</article><footer>{8}</footer>
<header>{3}[2]</header><nav>[1] [1] [1]</nav><main><h1>*{9}</h1><p>*{30}*[5]<h2>*{3}</h2><ul><li>*{4}<li>*{7}<li>*{2}</ul><p>*{80}</main><aside><p>{40}<p>{25}</aside><footer>{20}[3]</footer>
<div><div>[1]</div><div>[1]</div><div>[2]</div></div><h1>*{8}</h1><div>*{70}</div><div>*{45}*[3]</div><h2>*{4}</h2><div>*{90}</div><div>[6]</div><div>[5]</div><div>[7]</div><div>{4}</div>
<div><div>{2}</div><div>[1]</div></div><div>[3]</div><h1>*{7}</h1><div>*{28}</div><div>*{6}</div><div>*{55}</div><div>*{12}</div><div>*{33}</div><div>{3}[4]</div><div>[2]</div><div>{7}</div>
<div>[2]</div><div>[4]</div><div>[3]</div><div>*{150}</div><div>*{22}</div><div>*{64}</div><div>[5]</div><div>{1}[6]</div><div>[4]</div><div>{6}</div><div>{3}</div>
<article><header><h1>*{11}</h1><p>*{5}</header><p>*{40}<div class=share-box>{3}</div><p>*{35}<section class=social><p>*{48}<p>*{30}</section><div class=tags>[1] [1] [2]</div><div class=comments><p>{9}<p>{60}<p>{15}</div></article>
<article><h1>*{5}</h1><p>*{90}<form><p>{25}<p>{4}</form><nav>[3]</nav><aside>{70}</aside><p>*{16}<div class=sidebar><p>{5}<p>[4]</div><div class=promo>{30}[2]</div><p>*{50}<footer>{12}</footer></article>
<div class=cookie-notice><p>{30}<p>[2]</div><div class=header>{2}[3]</div><div class=content><h1>*{6}</h1><p>*{75}<p>*{18}<p>*{52}</div><div class=related><p>[8]<p>[9]</div><div class=comments><p>{45}<p>{80}</div><div class=footer>{14}</div>
<div class=menu><p>[1]<p>[2]<p>[1]</div><div class=page><h2>*{5}</h2><p>*{100}<p>*{42}*[4]<p>*{9}<p>*{61}</div><div class=newsletter>{22}</div><div class=legal>{35}</div>
<main><p>*{14}<p>*{2}<p>*{26}*[10]<div class=ads>{12}</div><p>*{70}<ul><li>[5]<li>[6]<li>[4]<li>[7]</ul></main><div>{11}</div><div>{60}</div><div>{33}</div>
<article><p>*{8}<p>*{8}<p>*{1}<p>*{5}</article><section><h2>{2}</h2><div>{38}</div><div>{51}</div><div>{19}</div></section><footer>{5}</footer>
<article><div class=comment>{100}</div><div class=notice>{18}</div><div class=byline>{4}</div><h1>*{10}</h1><div class=box>*{44}</div><div class=header>*{25}</div><p>*{31}<p>*[12]<p>*{40}</article><div>{90}</div><div>{14}[1]</div>
<h1>*{9}</h1><p>*{20}<p>*{35}<p>*{26}<p>*{85}<p>*{4}<p>*{47}<p>[1] [1] [1] [1]<p>{5}[2]
<div class=nav>[2]</div><div class=search>{2}</div><article><p>*{3}<p>*{2}<p>*{70}<p>*{20}*[18]<p>*{9}<div class=widget><p>[3]<p>{4}[5]</div></article><div class=responses><p>{28}<p>{75}</div>
<article><ul><li>[4]<li>[3]<li>[5]<li>[4]</ul><p>*{65}<p>*[6]<p>*{12}<p>*{7}*[7]<p>*{30}</article><div>[3]</div><p>{9}
<article><h1>*{5}</h1><p>*{50}<p>*{9}</article>
<article><h1>*[6]</h1><p>*{40}<p>*{12}<p>*[9]<p>*{25}<p>*[2]<p>*{66}<p>*[5]</article>
<div class=ad>{40}</div><article><h1>*[9]</h1><p>*[30]<p>*{80}<h2>*[4]</h2><p>*{10}<p>*{6}*[6]<p>*[20]</article>
<nav>[1] [1]</nav><main><p>*{3}</main>
<article><p>*{1}</article>
<nav><ul><li>[1]<li>[2]</ul></nav><article><p>*{2}<p>*{4}</article>
<p>*{40}
<header>{4}</header><h1>*{6}</h1><p>*{90}<p>*{30}
<div>[2]</div><div>*{60}</div><div>*{35}</div>
<article><p>*{45}<ul><li>[3]<li>[6]<li>[5]<li>[2]<li>[8]</ul></article><footer>{3}</footer>
<nav><ul><li>[6]<li>[9]<li>[12]<li>[4]</ul></nav><article><h1>*[7]</h1><p>*{90}<p>*[3]<p>*{30}<p>*[11]</article><footer><p>[8]<p>[3]<p>[14]</footer>
<header><p>[9]<p>{8}</header><nav>[40]</nav><article><p>*{12}<p>*[12]<p>*{14}</article><aside><p>[12]<p>{30}[20]<p>{9}<p>[7]</aside><footer>[60]</footer>
<nav>[2]</nav><article><h1>*{4}</h1><p>*{20}<p>*[8]<p>*{70}<p>*[6]</article><nav>[7]<p>[10]</nav>
<article><p>*{1}<p>*[3]<p>*{1}<p>*{2}<p>*[2]<p>*{1}<p>*{4}<p>*[5]<p>*{9}<p>*[1]<p>*{3}</article>
<article><div class=header><h1>*{5}</h1></div><p>*{40}<ul><li>[2]<li>[4]<li>[1]<li>[3]</ul><p>*{8}<p>*[4]<p>*{6}<ul><li>[7]<li>[9]<li>[8]<li>[6]</ul></article><div class=header>{3}</div>
<div>[1]</div><div>[3]</div><h1>*{4}</h1><div>*{60}</div><h2>*{3}</h2><div>*{44}</div><h2>*{2}</h2><div>*{80}</div><div>[4]</div><div>{3}</div><div>{4}</div>
<div>{2}</div><div>{3}</div><div>[5]</div><h1>*{3}</h1><div>*{38}</div><h2>*{4}</h2><div>*{50}</div><h2>*{1}</h2><div>*{31}</div><div>[6]</div><div>{2}</div><div>[1]</div>
<p>{3}<p>[2]<div>{12}[9]</div><div>[8]</div><div>{5}[12]</div><div>{2}</div><div>[6]</div>
"""


@dataclass
class Tree:
    """Node i splits on feature[i] <= cut[i] to left[i], else to right[i]; feature -1: a leaf with value cut[i]."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            on = at[inner]
            at[inner] = np.where(x[rows[inner], feature[on]] <= cut[on], left[on], right[on])
        return cut[at] >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1) -> Tree:
    """Gini tree; equal gains go to the earlier feature and the lower cut."""
    tree = Tree([], [], [], [])

    def node(rows: np.ndarray, deep: int) -> int:
        me = len(tree.feature)
        for part, value in ((tree.feature, -1), (tree.cut, float(y[rows].mean())), (tree.left, -1), (tree.right, -1)):
            part.append(value)
        best = (1e-9, -1, 0.0)
        n, share = len(rows), y[rows].mean()
        if deep and 0 < share < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], y[order].cumsum()
                k = np.arange(1, n)
                a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
                gain = share * (1 - share) - (k * a * (1 - a) + (n - k) * b * (1 - b)) / n
                gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = 0
                if gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[me], tree.cut[me] = best[1], best[2]
            tree.left[me], tree.right[me] = node(rows[low], deep - 1), node(rows[~low], deep - 1)
        return me

    node(np.arange(len(y)), depth)
    return tree


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; before the first and after the last block there are 0 words."""
    words = np.array([0, *(b.words for b in found), 0], float)
    share = np.array([0, *(100 * b.linked / b.words for b in found), 0], float)
    own = np.array([(b.element, b.named) for b in found], float).reshape(-1, 2)
    inside = words[1:-1] * ((own[:, 0] == 2) & (own[:, 1] < 2))
    covered = np.full(len(found), float(10 * inside.sum() >= max(1, words.sum())))
    return np.column_stack((words[1:-1], share[1:-1], words[:-2], share[:-2], words[2:], share[2:], own, covered))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    x, y = [], []
    for page in LABELLED.split("\n"):
        page = re.sub(r"(\*?)\[(\d+)\]", r"<a>\1{\2}</a>", page)
        found = blocks(re.sub(r"(\*?)\{(\d+)\}", lambda m: ("yes " if m[1] else "no ") * int(m[2]), page))
        x.append(features(found))
        y += [b.text.startswith("yes") for b in found]
    return np.concatenate(x), np.array(y, float)


def trained() -> Tree:
    return grow(*labelled())


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, tree.predict(features(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and text of every row; null and empty pages, and pages without main text, have an empty text.

    Repeated rows come back once each, null ids and urls stay null. Pages are read whole, however long.
    Other columns are not read, whatever their names. An empty table gives no rows. No shuffle.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
