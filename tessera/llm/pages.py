"""Main text of raw web pages by nearest-URL page differencing.

1. Each page is cut into lines (the text of one block). What markup names as no main text is no line: scripts,
   styles, forms, menus, headers, footers, sidebars, and elements that have a word of FURNITURE as a class, id or
   role. A form, header or element so named that contains an article or main element is a wrapper and not dropped,
   unless it lies within an article itself. Within an article names count less: paragraphs, headings, list items and
   cells go only by the words of ADVERTS, other elements also by those of FURNITURE, and what is named by a word of
   DOUBTFUL there stays a line, marked as doubtful. Lines in an article or main element are marked with it. Blocks
   named as reader comments (`_remark`: a class or id of several words, or a comment's item type) go anywhere, also
   articles that are so named; those that follow an article are dropped with the articles in them.
2. Pages of one host are put in the order of their URL paths; each page is paired with its nearest one before and
   after. All their lines are aligned by longest common subsequence. If almost all of a page is shared (COPY) the two
   are copies of one page and that pair deletes nothing; if both pairs are such, what all three share is deleted,
   unless nothing were left.
3. Shared lines are deleted, with one exception: those of an article or main element that are not doubtful are kept as
   quotations, but for those at its beginning and end that are mostly links and stand there on both neighbours (no
   copies) too, in that order: these belong to the site. Plain lines there stay, as nothing but menus, notices and
   the like may be dropped from an article.
4. Of what is left the marked lines are the text if they are at least half of it, or if there was no page to compare
   with; else the marks say nothing and all lines left are the text. An article much shorter than the longest one
   (CARD) that is mostly links, or named by a word of CARDS, is a teaser of another page and goes.

Defined cases: null html gives the empty text; a null or odd URL is a
host of its own text; a host's only page is paired with none; repeated rows each get a row, with equal texts;
several pages under one page_id are ordered by URL and a hash of the html.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, stored

# Names of HTML elements, and words in class, id and role that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option canvas audio video xmp noembed noframes".split())
WRAPPERS = frozenset("form fieldset".split())
DROPPED = RAW | frozenset("head nav footer aside form button dialog menu fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split())
MAIN = frozenset(("article", "main"))
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dt dd td th pre caption figcaption".split())
ADVERTS = "ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|newsletter"
MENUS = "notice|alert|banner|sidebar|aside|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|masthead|footer|popup|modal|overlay|subscribe|subscription|signup|login|share|sharing|social|comment|comments|commentlist|respond|disqus|reply|replies|related|recommended|pagination|pager|toolbar|contentinfo|complementary"
DOUBTFUL = "side|header|widget|skip|search"
CARDS = "card|teaser|preview|excerpt|summary|promo|related|recommended"


REMARKS = "comment|comments|respond|disqus|reply|replies"
PARTS = "list|thread|body|section|area|form|item|container|wrapper|wrap|content|box|block|author|meta|text"
NO_PARTS = "no|has|with|without|hide|show|allow|open|closed"


def _words(words: str) -> re.Pattern:
    """Any of the words as a whole one, with a number behind it or not."""
    return re.compile(rf"(?<!\S)(?:{words})(?:[_-]?\d+)?(?!\S)", re.I)


ADVERT, MENU, DOUBT, TEASER = _words(ADVERTS), _words(f"{ADVERTS}|{MENUS}"), _words(DOUBTFUL), _words(CARDS)
FURNITURE = _words(f"{ADVERTS}|{MENUS}|{DOUBTFUL}")

# A class or id made of several words is that of reader comments if its last word says so, or its first before a part of them.
REMARK = re.compile(rf"(?<!\S)(?!(?:{NO_PARTS})[_-])(?:(?:[a-z0-9]+[_-]+)*(?:{REMARKS})|(?:{REMARKS})[_-]+(?:{PARTS}))(?:[_-]*\d+)?(?!\S)", re.I)
REMARK_HEADED = re.compile(rf"(?<!\S)(?:{REMARKS})(?:[_-]+(?:{PARTS}))?(?:[_-]*\d+)?(?!\S)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
REMARK_TYPE = re.compile(r"itemtype\s*=\s*[\"']?[^\s\"'>]*/(?:User)?Comments?\b|itemprop\s*=\s*[\"']?comment\b", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<)", re.S)
MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
ROLE_MAIN = re.compile(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody", re.I)
COPY = 0.8
CARD = 0.25
LINKED = 1 / 3
MATCHES = 16  # a line, beyond which lines are aligned by rows of bits
START, END = (1 << 63) - 2, (1 << 63) - 1
KEPT, DOUBTED, UNWANTED = range(3)


def _remark(tag: str, attributes: str) -> bool:
    """Whether markup names a block as reader comments; the id of a section without a class is often that of its heading, so less counts there."""
    if not attributes or tag in INLINE or tag in TEXTUAL and tag != "li" or tag in ("html", "body", "main"):
        return False
    marks = [(m[1].lower(), next(x for x in m.groups()[1:] if x is not None)) for m in MARKS.finditer(attributes)]
    named = REMARK_HEADED if tag == "section" and all(name == "id" for name, _ in marks) else REMARK
    return any(named.search(CAMEL.sub("-", x)) for _, x in marks) or bool(REMARK_TYPE.search(attributes))


def _judged(tag: str, attributes: str, in_main: bool) -> int:
    """Whether markup names an element as no main text."""
    if tag in DROPPED or tag == "header" and not in_main:
        return UNWANTED
    if tag in ("html", "body", *MAIN) or not attributes:
        return KEPT
    if HIDDEN.search(attributes):
        return UNWANTED
    marks = [next(x for x in m.groups()[1:] if x is not None) for m in MARKS.finditer(attributes)]
    if not in_main:
        return UNWANTED if any(FURNITURE.search(x) for x in marks) else KEPT
    if any((ADVERT if tag in TEXTUAL else MENU).search(x) for x in marks) and not (tag == "section" and "id" in attributes and "class" not in attributes):
        return UNWANTED
    return DOUBTED if tag not in TEXTUAL and any(DOUBT.search(x) for x in marks) else KEPT


@dataclass(eq=False)
class Element:
    """An open element; movable: it is no longer dropped once an article or main element opens in it."""

    tag: str
    dropped: bool
    region: int  # number of the article or main element that it is, or 0
    movable: bool
    doubted: bool


@dataclass
class Line:
    text: str
    region: int  # the innermost article or main element, 0 for none
    doubted: bool
    linked: int  # code points in links
    card: bool  # whether the region's name is that of a teaser


def lines(page: str | None) -> list[Line]:
    """The page's lines in order."""
    found: list[tuple[list[tuple[str, bool, tuple[Element, ...]]], int, bool]] = []  # parts with the elements that may drop them
    parts: list[tuple[str, bool, tuple[Element, ...]]] = []
    stack: list[Element] = []
    blocking: list[Element] = []
    regions: list[int] = [0]
    cards: set[int] = set()
    count = doubted = links = 0

    def flush() -> None:
        if parts:
            found.append((parts.copy(), regions[-1], doubted > 0))
            parts.clear()

    def close(to: int) -> None:
        nonlocal doubted, links
        while len(stack) > to:
            e = stack.pop()
            doubted -= e.doubted
            links -= e.tag == "a"
            if e.region:
                regions.pop()
            if blocking and blocking[-1] is e:
                blocking.pop()

    at, page = 0, page or ""
    while m := TOKEN.match(page, at):
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            if not blocking or all(e.movable for e in blocking):
                parts.append((text, links > 0, tuple(blocking)))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            if tag == "br":
                parts.append(("\n", False, ()))
            else:
                flush()
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if k is not None:
                close(k)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1].tag == tag:
            close(len(stack) - 1)
        remark = _remark(tag, attributes)
        is_main = tag in MAIN and not remark or bool(attributes and ROLE_MAIN.search(attributes))
        judged = KEPT if is_main else UNWANTED if remark else _judged(tag, attributes, len(regions) > 1)
        if is_main:
            if all(e.movable for e in blocking):
                for e in blocking:
                    e.dropped = False
                blocking.clear()
            count += 1
            regions.append(count)
            if any(TEASER.search(next(x for x in m.groups()[1:] if x is not None)) for m in MARKS.finditer(attributes or "")):
                cards.add(count)
        e = Element(tag, judged == UNWANTED, count if is_main else 0, len(regions) == 1 and (tag in WRAPPERS or tag not in DROPPED) and not (remark and (count or tag == "article")), judged == DOUBTED)
        stack.append(e)
        doubted += e.doubted
        links += tag == "a"
        if e.dropped:
            blocking.append(e)
    flush()
    out = []
    for every, region, doubt in found:
        kept = [(t, link) for t, link, drop in every if not any(e.dropped for e in drop)]
        text = " ".join(references.unescape("".join(t for t, _ in kept)).split())
        if text:
            out.append(Line(text, region, doubt, min(len(text), sum(len(t) for t, link in kept if link)), region in cards))
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each beginning of a, from the empty one: a number with a 0 at each place of b where the longest common subsequence grows."""
    row = full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, h in enumerate(b):
        where[h] = where.get(h, 0) | 1 << j
    yield row
    for h in a:
        hit = row & where.get(h, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _in_bits(a: list[int], b: list[int], most: int = 1 << 27) -> list[int]:
    """Places in a of a longest common subsequence; a is halved until its rows fit into `most` bits, so memory is bounded."""
    if len(a) > 1 and len(a) * len(b) > most:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _in_bits(a[:half], b[:cut], most) + [half + i for i in _in_bits(a[half:], b[cut:], most)]
    rows, out, j = list(_rows(a, b)), [], len(b)
    for i in range(len(a), 0, -1):
        under = (1 << j) - 1
        if (rows[i] & under).bit_count() < (rows[i - 1] & under).bit_count():  # a[i - 1] is part of it, with its last equal under j
            j = next(k for k in range(j - 1, -1, -1) if b[k] == a[i - 1])
            out.append(i - 1)
    return out[::-1]


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b: as the longest rising run of matching places, or by rows
    of bits where lines that repeat make the matches many."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(begin), *range(len(a) - end, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(len(b) - end - 1, begin - 1, -1):
        where.setdefault(b[j], []).append(j)
    left = a[begin : len(a) - end]
    if sum(len(where.get(h, ())) for h in left) > MATCHES * (len(a) + len(b)):
        return shared | {begin + i for i in _in_bits(left, b[begin : len(b) - end])}
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []  # the place in a that ends the best run of each length, with the run before it
    for i in range(begin, len(a) - end):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        shared.add(node[0])
        node = node[1]
    return shared


def _linked(line: Line) -> bool:
    return 2 * line.linked >= len(line.text)


def _at_edge(inside: list[int], neighbour: list[int]) -> int:
    """How many of these lines (of one article, from its beginning) begin an article of the neighbour as well."""
    most = 0
    for j, x in enumerate(neighbour):
        if x == START:
            k = 0
            while k < len(inside) and j + 1 + k < len(neighbour) and inside[k] == neighbour[j + 1 + k]:
                k += 1
            most = max(most, k)
    return most


def _deleted(page: list[Line], hashes: list[int], neighbours: list[list[int]]) -> set[int]:
    """Places of the lines that differencing deletes; neighbours as sequence() gives them."""
    total = sum(len(x.text) for x in page)
    shared = [common(hashes, [h for h in other if h not in (START, END)]) for other in neighbours]
    copies = [sum(len(page[i].text) for i in places) >= COPY * total for places in shared]
    every = set.intersection(*shared) if len(shared) > 1 else set()
    if shared and all(copies):
        gone = every if len(every) < len(page) else set()
    else:
        gone = set().union(*(places for places, copy in zip(shared, copies) if not copy))
    out = {i for i in gone if not page[i].region or page[i].doubted}
    if len(shared) > 1 and not any(copies):
        mirrored = [[{START: END, END: START}.get(h, h) for h in reversed(other)] for other in neighbours]
        for region in {x.region for x in page} - {0}:
            inside = [i for i, x in enumerate(page) if x.region == region]
            own = [hashes[i] for i in inside]
            first, last = (min(_at_edge(o, other) for other in others) for o, others in ((own, neighbours), (own[::-1], mirrored)))
            if first + last < len(inside):  # the whole is no edge of it
                out.update(i for i in (*inside[:first], *inside[len(inside) - last :]) if _linked(page[i]))
    return out


def main_text(page: list[Line], neighbours: list[list[int]]) -> str:
    """The page's text; neighbours: the sequences of the pages it is paired with."""
    gone = _deleted(page, _hashes(page), neighbours)
    left = [x for i, x in enumerate(page) if i not in gone]
    mass: dict[int, int] = {}
    for x in left:
        mass[x.region] = mass.get(x.region, 0) + len(x.text)
    most = max((n for region, n in mass.items() if region), default=0)
    marked = sum(mass.values()) - mass.get(0, 0)
    if most and (not neighbours or marked >= mass.get(0, 0)):
        linked: dict[int, int] = {}
        for x in left:
            linked[x.region] = linked.get(x.region, 0) + x.linked
        small = {x.region for x in left if mass[x.region] < CARD * most and (x.card or linked[x.region] >= LINKED * mass[x.region])}
        left = [x for x in left if x.region and x.region not in small]
    return " ".join(x.text for x in left)


def _hashes(page: list[Line]) -> list[int]:
    """Signed 64-bit hashes of the lines; two values are left for marks."""
    return [xxhash.xxh64_intdigest(x.text.encode("utf-8", "surrogatepass")) % ((1 << 64) - 2) - (1 << 63) for x in page]


def sequence(page: list[Line]) -> list[int]:
    """The hashes of the lines, with START and END where an article or main element begins and ends."""
    out, region = [], 0
    for x, h in zip(page, _hashes(page)):
        if x.region != region:
            out += [END] * (region > 0) + [START] * (x.region > 0)
            region = x.region
        out.append(h)
    return out + [END] * (region > 0)


@dataclass
class Page:
    """A page in the order of its range; copies: how many equal rows there are."""

    key: tuple
    page_id: int | None
    url: str | None
    html: str | None
    copies: int = 1

    def __post_init__(self) -> None:
        self.lines = lines(self.html)
        self.hashes = sequence(self.lines)

    def text(self, *neighbours: list[int] | None) -> str:
        return main_text(self.lines, [n for n in neighbours if n is not None])


def _packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in parts:
        yield pd.Series([None if p is None else zstandard.compress(p.encode("utf-8", "surrogatepass"), 3) for p in pages], dtype=object)


def _unpacked(page: bytes | None) -> str | None:
    return None if page is None else zstandard.decompress(page).decode("utf-8", "surrogatepass")


WALKED = "_range int, role string, copies long, page_id long, url string, text string, html string, host string, hashes array<long>, beside array<long>"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pages of a range in order. Each is compared with both neighbours; the first and the last come out unfinished
    (with what is known of the neighbour inside), as they have one in another range."""
    part, count, before = -1, 0, None
    held: Page | None = None

    def beside(other: Page | None, page: Page) -> list[int] | None:
        return other.hashes if other is not None and other.key[0] == page.key[0] else None

    def row(page: Page, after: Page | None, last: bool = False) -> tuple:
        if count > 1 and not last:
            return part, "done", page.copies, page.page_id, page.url, page.text(beside(before, page), beside(after, page)), None, None, None, None
        role = "both" if count == 1 and last else "last" if last else "first"
        return part, role, page.copies, page.page_id, page.url, None, page.html, page.key[0], page.hashes, beside(before if last else after, page)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WALKED.split(", ")]).astype({"page_id": "Int64"})

    for b in batches:
        out = []
        for part, *key, page_id, url, page in b.itertuples(index=False, name=None):
            if held is not None and held.key == tuple(key):
                held.copies += 1
                continue
            now = Page(tuple(key), None if pd.isna(page_id) else int(page_id), url, _unpacked(page))
            if held is not None:
                count += 1
                out.append(row(held, now))
            before, held = held, now
        yield frame(out)
    if held is not None:
        count += 1
        yield frame([row(held, None, last=True)])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    listed = lambda x: None if x is None else np.asarray(x).tolist()
    for b in batches:
        out = [(r.copies, None if pd.isna(r.page_id) else int(r.page_id), r.url, Page((), None, None, r.html).text(listed(r.one), listed(r.other))) for r in b.itertuples(index=False)]
        yield pd.DataFrame(out, columns=["copies", "page_id", "url", "text"]).astype({"page_id": "Int64"})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Pages move once, into ranges of (host, path), where neighbours follow each other; what is left are the first and
    the last page of each range, which meet those of the ranges beside.
    """
    url, prefix = F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?"
    keys = {"_host": F.lower(F.regexp_extract(url, prefix + "([^/?#]*)", 1)), "_path": F.regexp_extract(url, prefix + "[^/?#]*([^?#]*)", 1), "_id": F.coalesce("page_id", F.lit(-(1 << 63))), "_hash": F.xxhash64("html", "url")}
    packed = F.pandas_udf(_packed, "binary")("html").alias("html")  # a page is less than half its size on the way
    dealt = pages.select(*[v.alias(k) for k, v in keys.items()], "page_id", "url", packed).repartitionByRange(partitions(pages.sparkSession), *keys).sortWithinPartitions(*keys)
    walked = stored(dealt.select(F.spark_partition_id().alias("_range"), "*").mapInPandas(_walk, WALKED), "pages", "zstd")
    edges = walked.where("role <> 'done'")
    order = Window.orderBy("_range", F.col("role") == "last")  # two narrow rows per range at most
    near = lambda f: F.when(f("host").over(order) == F.col("host"), f("hashes").over(order))
    narrow = edges.select("_range", "role", "host", "hashes", "beside").withColumns({"before": near(F.lag), "after": near(F.lead)})
    one = F.when(F.col("role") == "last", F.col("beside")).otherwise(F.col("before")).alias("one")
    other = F.when(F.col("role") == "first", F.col("beside")).otherwise(F.col("after")).alias("other")
    ends = edges.select("_range", "role", "copies", "page_id", "url", "html").join(narrow.select("_range", "role", one, other), ["_range", "role"])
    ends = ends.select("copies", "page_id", "url", "html", "one", "other").mapInPandas(_finish, "copies long, page_id long, url string, text string")
    every = walked.where("role = 'done'").select("copies", "page_id", "url", "text").unionByName(ends)
    every = every.withColumn("_", F.explode(F.sequence(F.lit(1), "copies")))
    return every.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
