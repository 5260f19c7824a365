"""HTML main text with a site style tree.

The pages of a host are merged into one tree: an element is known by its path of
tags and attributes from the body, its presentation on a page is the sequence of
its child elements, and its content are the text blocks below it. An element
whose presentation varies over the pages, or whose blocks are new on each page,
matters; one that looks and reads alike on all of them is a template. Branches
of low importance are removed from each page, then marked furniture (menus,
forms, scripts ...), and the blocks that are left are the text. Inside an
article a name that only mentions furniture ("share-price") is no more than a
hint: it takes links or a lower importance on the host to remove such a branch.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .urls import host_of

#: Weight of an element's own presentation against the content below it; importance at or below which a branch goes.
GAMMA, LEAST = 0.9, 0.25
#: Importance at or below which a branch goes whose name mentions furniture; weight of a single article against the text beside it.
LEAST_HINTED, ARTICLE_WEIGHT = 0.6, 2
#: Content importance at or below which a single block of an article goes.
EMPTY = 0.05
#: Distinct pages of a host that must show an element before its importance counts.
MIN_PAGES = 8
#: Elements deeper than this belong to their ancestor at this depth; parts of an element's name kept.
MAX_DEPTH = 24

#: How HTML elements behave.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select option".split())
DROPPED = frozenset("head script style noscript template iframe svg math object canvas select option button textarea input nav footer aside form menu dialog fieldset label title".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("html body".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form td th blockquote".split())
#: Words in class, id and role that name furniture, and those that name the article.
FURNITURE = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|widget|menu|nav\w*|breadcrumbs?|footer|foot|"
                       r"header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|"
                       r"social|related|recommend\w*|comments?|discussion|responses|feedback|disqus|replies|respond|pagination|pager|copyright|legal|disclaimer|"
                       r"search|skip|complementary|contentinfo|navigation|form|trending|popular|teasers?|sr-only|visually-hidden)(?:$|[\s_-])")
ASIDE = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|reply|replies|related|promo\w*|sponsor\w*|ads?|advert\w*|teasers?)(?:$|[\s_-])")
#: Parts of a name that say nothing about what is named, so that the part before them does ("share-buttons" are furniture, a "share-price" is not).
EMPTY_PART = re.compile(r"(?i)(?:[a-z]?\d[\dx]*|[a-z]|box|bar|block|list|links?|buttons?|icons?|tools?|wrap|wrapper|wrapping|container|holder|area|section|group|panel|pane|slot|unit|"
                        r"row|col|column|inner|outer|top|bottom|left|right|center|desktop|mobile|module|component|region|zone|thread|posts|articles|stories|message|msg|text|"
                        r"form|title|heading|label)$")
_PART = re.compile(r"[A-Za-z0-9]+")
TITLE = re.compile(r"(?i)(?:^|[\s_-])(?:header|masthead|banner)(?:$|[\s_-])")
ARTICLE = re.compile(r"(?i)(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HEADING = re.compile(r"h[1-6]$")
_DIGITS = re.compile(r"\d{2,}")


@dataclass
class Element:
    tag: str
    path: int                       # hash of the names from the body down
    above: tuple["Element", ...]
    hard: bool                      # furniture by its tag, or hidden, or inside such
    named: tuple["Element", ...]    # elements named like furniture, from the outermost to this one
    article: bool                   # inside an article
    names: str = ""                 # class, id and role
    out: bool = False               # furniture, once the whole page is known
    shared: bool = False            # an ancestor's children continue here (inline or too deep)
    muted: bool = False             # inline furniture, or inside it: its text is left out of the block around it
    story: bool = False             # inside an article or an element named like one
    hinted: bool = False            # inside a story, with a name that mentions furniture
    linked: bool = False            # inside a link
    children: list[int] = field(default_factory=list)


@dataclass
class Block:
    text: str
    element: Element
    links: int = 0                  # characters of it inside links


def names_furniture(names: str) -> bool:
    """Whether a class, id or role names furniture itself: the last part that says anything is such a word."""
    for name in names.split():
        parts = _PART.findall(name)
        while len(parts) > 1 and EMPTY_PART.match(parts[-1]) and not FURNITURE.match(parts[-1]):
            parts.pop()
        if parts and FURNITURE.fullmatch(parts[-1]):
            return True
        if FURNITURE.fullmatch(name):                              # words that hold a hyphen themselves
            return True
    return False


def parse(page: str | None) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order and the elements met, of any bytes: unclosed and stray tags are repaired as browsers do."""
    blocks: list[Block] = []
    root = Element("body", 0, (), False, (), False)
    elements, stack = [root], [root]
    parts: list[str] = []
    links = 0
    owner = root

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(Block(text, owner, min(links, len(text))))
        links = 0

    def close(to: int) -> None:
        nonlocal owner
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        del stack[to:]
        owner = next(e for e in reversed(stack) if not e.shared)

    page, at = page or "", 0
    while True:
        m = _TOKEN.search(page, at)
        parts.append(" " if stack[-1].muted else page[at:m.start() if m else len(page)])
        if stack[-1].linked:
            links += len(parts[-1])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:                                           # an end tag: closes the nearest open element of its name
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in RAW:                                             # content is not markup; none of it is article text
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            parts.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    close(i)
                    if tag not in ("td", "th", "tr"):
                        break
                elif stack[i].tag in SCOPES - {"td", "th"}:
                    break
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3] or m[6] or "")}
        names = " ".join(filter(None, (attrs.get("class"), attrs.get("id"), attrs.get("role"))))
        parent = stack[-1]
        article = parent.article or tag in ("article", "main")
        story = parent.story or article or bool(names and ARTICLE.search(names))
        hinted = False
        if not names or tag == "main":
            named = False
        elif tag == "article" or (not parent.article and ARTICLE.search(names)):
            named = bool(ASIDE.search(names))
        elif tag == "header" and parent.article:                   # the head of an article holds its title
            named = bool(ASIDE.search(names))
        else:
            named = bool(FURNITURE.search(names))
        if named and parent.story and tag != "article" and not names_furniture(names):
            named, hinted = False, True
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        hard = tag in DROPPED or hidden or (tag == "header" and not article)
        muted = parent.muted or (tag not in BLOCK and (named or hard))
        if tag in BLOCK:
            flush()
        if tag not in BLOCK or (len(stack) > MAX_DEPTH and not named and not hard):
            e = Element(tag, parent.path, parent.above, parent.hard or muted, parent.named, article, shared=True, muted=muted)
            e.linked = parent.linked or tag == "a"
        else:
            base = next(x for x in reversed(stack) if not x.shared)
            name = f"{tag}.{_DIGITS.sub('#', names)}"
            e = Element(tag, xxhash.xxh3_64_intdigest(name.encode(), base.path) >> 1, base.above + (base,), parent.hard or hard, parent.named, article, names, muted=muted)
            e.hinted, e.linked = hinted, parent.linked
            if tag in ("h1", "h2") and article:                    # so does an element of it that is named so
                e.named = tuple(x for x in e.named if not x.article or not TITLE.search(x.names) or ASIDE.search(x.names))
            if named:
                e.named += (e,)
            base.children.append(xxhash.xxh3_64_intdigest(name.encode()) >> 1)
            elements.append(e)
            owner = e
        e.story = story
        stack.append(e)
    flush()
    _settle(blocks, elements)
    return blocks, elements


def _settle(blocks: list[Block], elements: list[Element]) -> None:
    """Decide what is furniture.

    A name is no proof for a wrapper that holds most of the page's text and its
    article or top heading, nor, unless it names comments or adverts, for a part
    of an article with most of the page's text. A hint is followed if half of the
    branch are links.
    """
    whole, held, holds, hints = 0, {}, set(), {}
    for b in blocks:
        if not b.element.hard:
            whole += len(b.text)
            for e in (*b.element.above, b.element):
                if e.hinted:
                    text, links = hints.get(id(e), (0, 0))
                    hints[id(e)] = text + len(b.text), links + b.links
            for e in b.element.named:
                held[id(e)] = held.get(id(e), 0) + len(b.text)
                inside = b.element.above[b.element.above.index(e) + 1:] + (b.element,) if e is not b.element else ()
                if any(x.tag in ("article", "main", "h1") for x in inside) or (e.tag not in ("article", "main") and e.article and not ASIDE.search(e.names)):
                    holds.add(id(e))
    wrappers = {e for e in holds if 2 * held[e] > whole}
    listed = {e for e, (text, links) in hints.items() if 2 * links >= text and 2 * text <= whole}
    for e in {id(x): x for x in (*elements, *(b.element for b in blocks))}.values():
        e.out = e.hard or any(id(n) not in wrappers for n in e.named) or any(id(x) in listed for x in (*e.above, e))


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _tree_rows(batches: Iterator[pa.RecordBatch]):
    """(page, host, path, presentation, block): one row per element path and page with block null, one per text block below it."""
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for page, host, source in zip(*(b.column(c).to_pylist() for c in range(3))):
            blocks, elements = parse(source)
            looks: dict[int, list[int]] = {}
            for e in elements[1:]:
                if not e.out:
                    looks.setdefault(e.path, []).extend(e.children)
            seen = set()
            for x in blocks:
                if not x.element.out:
                    h = block_hash(x.text)
                    seen.update((e.path, h) for e in (*x.element.above, x.element) if e.path)
            rows = [(p, xxhash.xxh3_64_intdigest(repr(_runs(c)).encode()) >> 1, None) for p, c in looks.items()] + [(p, None, h) for p, h in seen]
            for p, look, h in rows:
                for col, v in zip(cols, (page, host, p, look, h)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                                         names=["page", "host", "path", "look", "block"])


def _runs(children: list[int]) -> list[int]:
    """A child sequence with runs of one element counted once: two or ten paragraphs are one presentation."""
    return [c for i, c in enumerate(children) if not i or c != children[i - 1]]


def importance(rows: DataFrame) -> DataFrame:
    """(host, path, importance) of the elements of merged pages: rows (page, host, path, look, block).

    m is the number of distinct pages that show the element. Presentation
    importance is the entropy of its presentations to base m; content
    importance is one minus the mean evenness (log n / log m for a block on n of the m
    pages) over its blocks, each as often as it occurs. They combine as
    (1 - GAMMA^l) * presentation + GAMMA^l * content with l presentations.
    """
    looks = rows.where("look IS NOT NULL").groupBy("host", "path", "look").agg(F.count("*").alias("n"))
    element = looks.groupBy("host", "path").agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("nlogn")) \
        .where(F.col("m") >= MIN_PAGES)
    blocks = rows.where("block IS NOT NULL").groupBy("host", "path", "block").agg(F.count("*").alias("n"))
    content = blocks.groupBy("host", "path").agg(F.sum("n").alias("b"), F.sum(F.col("n") * F.log("n")).alias("evenness"))
    log_m = F.log("m")
    presentation = (log_m - F.col("nlogn") / F.col("m")) / log_m
    content_imp = F.coalesce(1 - F.col("evenness") / F.col("b") / log_m, F.lit(0.0))
    share = F.pow(F.lit(GAMMA), F.least(F.col("l"), F.lit(1000)))
    return element.join(content, ["host", "path"], "left").select(
        "host", "path", (F.round(((1 - share) * presentation + share * content_imp) * 1e9) / 1e9).alias("importance"))


def common_blocks(rows: DataFrame) -> DataFrame:
    """(host, path, block) of blocks on nearly all of the distinct pages that show an element: content importance of EMPTY or less."""
    element = rows.where("look IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_PAGES)
    blocks = rows.where("block IS NOT NULL").groupBy("host", "path", "block").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return blocks.join(element, ["host", "path"]).where(1 - F.log("n") / F.log("m") <= EMPTY).select("host", "path", "block")


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _branch(kept: list[Block], low: set[int]) -> list[Block]:
    """The blocks of the articles, or those beside them if these have more text that is no template of the host.

    A single article counts ``ARTICLE_WEIGHT`` times, unless an element beside it is named
    like one; several may be cards and count once. On a tie the articles are taken.
    """
    inside = [b for b in kept if b.element.article]
    if not inside:
        return kept
    outermost = {id(next(e for e in (*b.element.above, b.element) if e.tag in ("article", "main") or e is b.element)) for b in inside}
    around = {id(e) for b in inside for e in (*b.element.above, b.element)}
    beside = [b for b in kept if not b.element.article and not any(e.path in low for e in (*b.element.above, b.element))]
    alike = [b for b in beside if any(id(e) not in around and ARTICLE.search(e.names) for e in (*b.element.above, b.element))]
    if len(outermost) == 1 and _size(alike) > _size(inside):
        return alike
    return beside if _size(beside) > (ARTICLE_WEIGHT if len(outermost) == 1 else 1) * _size(inside) else inside


def main_text(page: str | None, low: set[int] = frozenset(), common: set[int] = frozenset(), doubted: set[int] = frozenset()) -> str:
    """Blocks of a page that are in no furniture and no branch of ``low`` paths, joined by two line breaks.

    Of the page's articles and the text beside them, one is taken (``_branch``). An
    article copied to many pages of its host is still their text: a branch with half
    of the text or more stays, and the paragraphs and headings of an article do not
    go with its branch. Blocks of an article other than headings go one by one if
    they are ``common`` to the host's pages and have less than half of the text.
    Branches of ``low`` or ``doubted`` paths whose name hints at furniture go whole.
    """
    kept = _branch([b for b in parse(page)[0] if not b.element.out], low)
    if low or doubted:
        held: dict[int, int] = {}
        for b in kept:
            for path in {e.path for e in (*b.element.above, b.element)}:
                held[path] = held.get(path, 0) + len(b.text)
        whole = _size(kept)
        going = {p for p, n in held.items() if (p in low or p in doubted) and 2 * n < whole}
        kept = [b for b in kept if not any(e.path in going and (e.hinted or e.path in low and not (e.article and e.tag in TEXT)) for e in (*b.element.above, b.element))]
    if common:
        alike = [b for b in kept if b.element.article and not HEADING.match(b.element.tag) and block_hash(b.text) in common]
        if 2 * _size(alike) < _size(kept):
            gone = {id(b) for b in alike}
            kept = [b for b in kept if id(b) not in gone]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null and empty pages have an empty text; a null url or one without ``://``
    belongs to the host "". Equal pages of a host count once in its style tree.
    Rows without an id are extracted by marks alone; rows that repeat an id
    share the branches found for it. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("host"))
    # Every page's elements; of equal pages of a host, one stands for all.
    digest = stage(rows.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", "host", F.xxhash64("html").alias("d1"), F.hash("html").alias("d2"))
                   .groupBy("host", "d1", "d2").agg(F.min("page_id").alias("first")), "html-distinct")
    tree = rows.where("page_id IS NOT NULL").select("page_id", "host", "html").mapInArrow(
        _tree_rows, "page long, host string, path long, look long, block long")
    tree = stage(tree, "html-elements")
    distinct = tree.join(digest.select(F.col("first").alias("page")).distinct(), "page", "left_semi")
    low = stage(importance(distinct).where(F.col("importance") <= LEAST_HINTED).select("host", "path", (F.col("importance") > LEAST).alias("doubted")), "html-low")
    alike = stage(common_blocks(distinct).select("host", "path", "block"), "html-common")
    # A page's own elements and blocks at most.
    marked = tree.where("look IS NOT NULL").select("page", "host", "path").join(low, ["host", "path"]) \
        .select("page", F.when(~F.col("doubted"), F.col("path")).alias("path"), F.lit(None).cast("long").alias("block"), F.when(F.col("doubted"), F.col("path")).alias("doubt")) \
        .unionAll(tree.where("block IS NOT NULL").join(alike, ["host", "path", "block"], "left_semi").select("page", F.lit(None).cast("long").alias("path"), "block", F.lit(None).cast("long").alias("doubt")))
    marked = stage(marked.groupBy("page").agg(F.collect_set("path").alias("low"), F.collect_set("block").alias("common"), F.collect_set("doubt").alias("doubted")), "html-marked")

    def run(batches):
        for b in batches:
            text = [main_text(h, *(set(x or ()) for x in marks)) for h, *marks in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return rows.join(marked, rows["page_id"] == marked["page"], "left").select("page_id", "url", "html", "low", "common", "doubted") \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
