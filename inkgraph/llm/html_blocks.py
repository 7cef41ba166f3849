"""Main-text extraction from web pages by shallow text features.

A page becomes a flat sequence of text blocks, cut at block-level tags. Each block
has its number of words and its link density (share of words inside links), the same
of the block before and of the block after, whether it is a heading or a paragraph, and what the enclosing
elements say of themselves. A decision tree classifies blocks as content or not. It is trained by `train_tree` on the
blocks of `LABELLED`, a small table of pages whose blocks are labelled by hand: with and without
semantic tags, with and without class names.

What an element says of itself is one feature among the others: the nearest element that says anything counts (an
article inside a container with an odd name is an article again), names such as ``has-comments`` or ``with-sidebar`` say
what an element has, not what it is; a name of several words is judged as a whole (`_off`). Whether any enclosing element is off the article is a feature of its own.

Defined results: null or empty html gives an empty text; markup cut short at the end of the
page is dropped; ``<`` that opens no tag is text; script, style and
comments are never text, nor are noscript, svg, object and form controls (what a browser that runs scripts does not show as text), formulas are; a ``<br>`` is white space inside its block; a page without content
blocks gives an empty text; a very long page takes time in proportion to its length, however deep it nests; rows that repeat are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import free_names, table

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text.
SILENT_TAGS = frozenset("script style noscript template svg iframe object canvas textarea title head button select audio video".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template svg select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words in class, id and role, that name what is not the article ...
OFF_TAGS = frozenset("nav footer header aside form menu dialog fieldset".split())
OFF_WORDS = re.compile(r"(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|topbar|breadcrumb\w*|header|footer|foot|masthead|sidebar\w*|side|widget\w*|aside|related|recommend\w*|share|sharing|social|cookie\w*|consent|notice\w*|popup|modal|overlay|alert|newsletter|subscribe\w*|signup|login|search|form|comment\w*|replies|reply|disqus|discussion|respond|pagination|pager|copyright|legal|disclaimer|skip|toolbar|tags|complementary|contentinfo)")
#: ... and what is.
ON_TAGS = frozenset("article main".split())
ON_WORDS = re.compile(r"(?:article|articlebody|content|main|post|entry|story|body|text)")
#: Words among these that are as common in names of other things: a name of several words is off by them only where the rest are words of layout.
AMBIGUOUS = frozenset("side form social legal notice alert search share sharing header foot skip tags discussion reply respond related aside ad promo login banner".split())
#: Words of layout, which say nothing of what is inside.
LAYOUT = frozenset("area bar block body bottom box btn button buttons cell col column container content entry field footer group head heading icon icons inner item items left line link links list main menu message msg nav outer panel post posts right row section side slot small text title top unit wide widget wrap wrapper zone".split())
#: A name that begins so says what an element has or how it looks.
HAS = frozenset("has with no without is show hide hidden js page layout theme".split())
#: One that ends so names an arrangement, not a part.
ARRANGED = frozenset("layout page grid theme".split())
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*+)(>|\Z)|([^<]+|<)", re.DOTALL)
#: As in HTML: quotes count only right after the equals sign; an unquoted value may hold some, and a stray one ends nothing.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: int
    paragraph: int
    named: int
    inside: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _off(parts: list[str]) -> bool:
    """Whether a whole name says that it is not the article: ``site-footer`` and ``ad-slot`` do, ``side-effects`` and ``form-of-government`` do not."""
    off = [x for x in parts if OFF_WORDS.fullmatch(x)]
    if len(parts) == 1 or not off:
        return bool(off)
    if all(x in LAYOUT or x.isdigit() or OFF_WORDS.fullmatch(x) for x in parts):
        return True
    return OFF_WORDS.fullmatch(parts[-1]) is not None and parts[-1] not in AMBIGUOUS or any(x not in AMBIGUOUS for x in off if x is parts[0])


def _named(tag: str, attributes: str) -> int:
    """-1: not the article; 1: the article; 0: does not say."""
    if tag in OFF_TAGS:
        return -1
    on = tag in ON_TAGS
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind not in ("class", "id", "role", "hidden", "style"):
            continue
        if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return -1
        if kind in ("hidden", "style") or tag in ("html", "body"):
            continue
        for name in value.split():
            parts = [x.lower() for x in _PART.split(name) if x]
            if not parts or len(parts) > 1 and (parts[0] in HAS or parts[-1] in ARRANGED):
                continue
            if _off(parts) and not (on and tag in ON_TAGS and not OFF_WORDS.fullmatch(parts[0])):
                return -1
            on = on or any(ON_WORDS.fullmatch(x) for x in parts)
    return int(on)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements, what the nearest that says anything says, and whether any is off the article
    opened: Counter[str] = Counter()  # tags of the open elements, so that none is looked for in vain
    in_link = in_heading = 0

    def shut(i: int) -> None:
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, named, inside = stack[-1] if stack else ("", 0, 0)
                paragraph = any(x[0] in ("p", "blockquote", "pre") for x in stack[-4:])
                out.append(Block(text, len(text.split(" ")), len(html.unescape("".join(linked)).split()), int(in_heading > 0), int(paragraph), named, inside))
            parts.clear()
            linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m[5] is not None:
            parts.append(m[5])
            if in_link:
                linked.append(m[5])
            continue
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if not m[4]:
            break  # a tag cut short by the end of the page
        if m[1]:
            if tag in BLOCK_TAGS:
                close()
            if tag in VOID_TAGS:
                continue
            if tag == "a":
                in_link = 0
                linked.append(" ")
            if tag in HEADINGS:
                in_heading = 0
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    shut(i)
                    break
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS or tag in SILENT_TAGS and tag != "head":
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            in_link = 1
        if tag in HEADINGS:
            in_heading = 1
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # these end an open one of their kind
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    shut(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "article", "section", "dl"):
                    break
        _, outer, inside = stack[-1] if stack else ("", 0, 0)
        own = _named(tag, attributes)
        opened[tag] += 1
        stack.append((tag, own if own < 0 or own > 0 and (outer >= 0 or tag in ON_TAGS) else outer, int(inside or own < 0)))
    close()
    return out


FEATURES = ("named", "inside", "words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "paragraph")
# Labelled by hand: +n is n words of content, -n is n words that are not, #n is n more words of the same block.
LABELLED = [
    # plain containers, no names
    "<div><a>-1</a></div><div><a>-1</a></div><div><a>-2</a></div><h1>+8</h1><div><p>+60</p><p>+2</p><p>+30</p><p>+45</p><p>+3</p></div><div>-7</div>",
    "<div><p>+60</p><p>+2</p><p>+30</p></div>",
    "<div><p>+60</p><p>+25</p><p>+4</p></div>",
    "<p>+12</p><p>+9</p><p>+80</p><p>+1</p>",
    "<p>+1</p>", "<p>+5</p><p>+3</p>", "<div>+70</div><div>+35</div>", "<h1>+6</h1><p>+15</p>",
    "<table><tr><td><a>-1</a></td><td><a>-2</a></td><td><a>-1</a></td></tr><tr><td><h2>+5</h2><p>+50 <a>#3</a> #20</p><p>+18</p><p>+90</p></td></tr><tr><td>-5 <a>#2</a></td></tr></table>",
    "<ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-3</a></li></ul><h1>+9</h1><p>+40</p><ul><li>+6</li><li>+14</li><li>+9</li></ul><p>+33</p><h2>+4</h2><p>+120</p><p>+8</p><div><a>-4</a></div><div><a>-6</a></div><div>-6</div>",
    "<div><a>-2</a> | <a>#2</a> | <a>#1</a></div><div>+55</div><div>+20</div><div>+75 <a>#6</a></div><div><a>-9</a></div><div><a>-8</a></div><div>-8 <a>#2</a></div>",
    "<h1>+7</h1><div>-4 <a>#2</a></div><p>+24</p><p>+31 <a>#8</a> #4</p><blockquote>+22</blockquote><pre>+16</pre><p>+5</p><div><a>-1</a> <a>#1</a> <a>#1</a></div>",
    "<p><a>-5</a></p><p><a>-7</a></p><p>+70</p><p>+6 <a>#2</a></p><p>+64</p><p><a>-6</a></p>",
    "<div><p>+40</p><p>+7 <a>#9</a> #3</p><p>+55</p></div><div><h3>-2</h3><ul><li><a>-7</a></li><li><a>-9</a></li><li><a>-8</a></li></ul></div>",
    "<ul><li><a>-2</a></li><li>-2</li><li><a>-1</a></li><li>-3</li><li><a>-2</a></li></ul><h1>+6</h1><p>+30</p><ul><li>+2</li><li>+3</li><li>+2</li></ul><p>+28</p>",
    "<div>+42</div><ul><li>+1</li><li>+2</li><li>+4</li></ul><div>+31</div><div><a>-3</a></div><div>-2</div><div><a>-3</a></div>",
    # semantic tags, no names
    "<header><a>-2</a><p>-9</p></header><nav><ul><li><a>-1</a></li><li><a>-1</a></li></ul></nav><main><h1>+7</h1><p>+50</p><p>+3</p><p>+26</p></main><aside><h3>-2</h3><p>-30</p></aside><footer><p>-14</p><p>-60</p></footer>",
    "<nav><a>-1</a></nav><article><h1>+8</h1><p>+2</p><p>+44</p><div>+30</div><ul><li>+3</li><li><a>+4</a></li></ul><p>+1</p></article><footer>-6</footer>",
    "<article><h1>+5</h1><p>+65</p><aside><p>-25</p></aside><p>+40</p><form><p>-9</p></form><p>+2</p></article><aside><article><h3>-6</h3><p>-12 <a>#2</a></p></article></aside>",
    "<main><p>+12</p><p>+6</p></main><footer><div>-3</div><div>-90</div></footer>", "<article><p>+1</p></article>", "<article><p>+9</p><p>+7</p></article>",
    "<article><p>+30</p><p>+5 <a>#8</a></p><p>+28</p></article>", "<article>+200</article>", "<main><ul><li>+2</li><li>+5</li><li>+1</li></ul></main>",
    # names
    "<div class='menu'><a>-1</a><p>-8</p></div><div id='content'><h1>+6</h1><p>+35</p><p>+70</p><p>+4</p></div><div class='sidebar'><p>-40</p><p>-22</p></div><div id='footer'><p>-20</p></div>",
    "<div class='ad'>-11</div><article><h1>+9</h1><p>+60</p><p>+14</p></article><div class='ad'>-9</div><section class='comments'><p>-34</p><p>-60</p><p>-12</p></section><footer>-4</footer>",
    "<div id='cookie-notice'><p>-16</p></div><div class='post'><p>+48</p><p>+3</p></div><div class='comments'><div><p>-50</p></div><div><p>-9</p></div></div>",
    "<div class='newsletter'><p>-12</p></div><div class='story'><p>+20</p><p>+33</p></div><div class='related'><h3>-2</h3><p>-28</p></div><div id='disqus'><p>-45</p><p>-70</p><p>-3</p></div>",
    "<div id='main' class='with-sidebar'><h1>+6</h1><p>+52</p><p>+2</p><div class='sidebar'><p>-18</p></div></div>",
    "<article class='post has-comments'><p>+60</p><p>+24</p><p>+5</p></article><div class='comment-list'><article class='comment'><p>-30</p></article><article class='comment'><p>-8</p></article></div>",
    "<div class='sidebar-left'><article><h1>+7</h1><p>+58</p><p>+3</p><p>+47</p></article></div>", "<div class='banner'><p>-65</p></div><p>+50</p><p>+41</p>",
    "<div class='sponsored'><p>-38</p></div><div class='entry'><p>+1</p><p>+90</p></div><div class='share'>-3</div><div class='tags'><a>-1</a> <a>#1</a></div>",
    "<div class='header-layout'><article><p>+29</p><p>+36</p><p>+7</p></article></div>", "<div class='widget'><p>-26</p><p>-44</p></div><div class='text'><p>+10</p></div>",
]
_SIGN = re.compile(r"([-+#])(\d+)")


def labelled(pages: list[str] | None = None) -> list[tuple]:
    """Features and class of every block of the labelled pages."""
    rows = []
    for page in LABELLED if pages is None else pages:
        words = lambda m: " ".join([{"+": "yes", "-": "no", "#": "word"}[m[1]], *["word"] * (int(m[2]) - 1)])
        found = blocks(_SIGN.sub(words, page))
        rows += [(*features(found, i), int(b.text.startswith("yes"))) for i, b in enumerate(found)]
    return rows


def train_tree(rows: list[tuple], depth: int = 12) -> tuple | int:
    """A binary tree by Gini impurity: (feature, threshold, at most, above), or the class of a leaf."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple]) -> float:
        k = sum(r[-1] for r in part)
        return 2 * k * (len(part) - k) / len(part)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            score = impurity(low) + impurity(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut, low, high)
    if best is None or best[0] >= impurity(rows) - 1e-12:
        return int(2 * ones >= len(rows))
    _, f, cut, low, high = best
    return f, cut, train_tree(low, depth - 1), train_tree(high, depth - 1)


def classify(tree: tuple | int, features: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


NONE = Block("", 0, 0, 0, 0, 0, 0)


def features(found: list[Block], i: int) -> tuple:
    b, p, q = found[i], found[i - 1] if i else NONE, found[i + 1] if i + 1 < len(found) else NONE
    return b.named, b.inside, b.words, b.density, p.words, p.density, q.words, q.density, b.heading, b.paragraph


def main_text(page: str | None, tree: tuple | int) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for i, b in enumerate(found) if classify(tree, features(found, i)))


def extract(pages: DataFrame, column: str = "html", tree: tuple | int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep``, which pass as they are, and text and n_chars, from the whole html of every row."""
    tree = train_tree(labelled()) if tree is None else tree
    if clash := {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError(f"columns to keep are named as results: {sorted(clash)}")
    place = free_names([*keep, "text", "n_chars"], "page_html")[0]
    chosen = pages.select(*keep, F.col(column).alias(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
