"""Main text of web pages: differencing against the page of the nearest URL.

Pages of a host are ordered by path; each is held against the neighbour whose path shares the
longer beginning. Text lines of the two are aligned by a longest common subsequence, and lines
that both have are template, not content. Markup is evidence: elements that cannot hold content
(menus, forms, scripts and the like) are out, names of classes put lines in doubt or out, and the
plain text of the main article, told by how much text it has, stays even where another page quotes
it. All other lines are left to the differencing.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.url_rules import LOWER, PARTS, UPPER
from rolecast.session import cut_lineage

#: A comment or declaration, or a tag with its name and attributes; quotes may hide a ">".
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "template", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no content of a page.
ASIDE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "object", "canvas", "audio", "video", "search"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Words of a class or id that name what is not content.
ASIDE_WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion sidebar cookie cookies "
    "consent gdpr notice notices disclaimer comment comments commentlist disqus respond reply replies newsletter subscribe signup "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager share sharing social related "
    "recommended recommendations widget login banner masthead footer teaser teasers".split()
)
#: Marks of a template part only outside of an article, where a header holds no title of its own.
OUTER_WORDS = {"header", "top", "bottom", "skip"}
#: Words that say what shape a part has, not what it is about.
SHAPE_WORDS = set(
    "area bar block body bottom box button buttons card cards container footer form group header holder inner item items label left "
    "link links list outer page panel post right row section site slot space text title top unit user wrap wrapper zone".split()
)
#: What markup says of a part: nothing against it, in doubt, no content.
PLAIN, DOUBT, OUT = range(3)
#: Places outside of any article: in the main element, or anywhere else.
IN_MAIN, ELSEWHERE = -1, -2


def _named(value: str, in_article: bool) -> int:
    """What the names in a class or id say: OUT if one tells of nothing but template, DOUBT if it also tells of other things."""
    says = PLAIN
    for name in value.split():
        words = set(WORD.findall(name))
        marks = words & ASIDE_WORDS if in_article else words & (ASIDE_WORDS | OUTER_WORDS)
        if marks:
            rest = words - ASIDE_WORDS - SHAPE_WORDS - OUTER_WORDS
            says = max(says, OUT if all(w.isdigit() for w in rest) else DOUBT)
    return says


@lru_cache(maxsize=4096)
def _evidence(name: str, attributes: str, in_article: bool) -> int:
    """PLAIN, DOUBT or OUT for what stands in an element.

    Inside an article an id may name the topic of a section, so that it gives a doubt at most.
    """
    if name in ASIDE or (name == "header" and not in_article):
        return OUT
    if not attributes or name in ("html", "body", "main"):
        return PLAIN
    says = PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            says = max(says, _named(value, in_article))
        elif key == "id":
            says = max(says, min(_named(value, in_article), DOUBT if in_article else OUT))
        elif key == "role" and value in ASIDE_ROLES:
            return OUT
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return OUT
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
    return says


def _content_places(prose: Counter[int], inner: set[int]) -> set[int]:
    """The places that hold the page's content, by their letters outside of links.

    That is the longest article, with others that stand beside it and are half as long; an article
    within another (a reader's answer, say) counts only if it is the longest. Where text outside of
    articles is over twice as long, the articles are teasers and that text is the content.
    """
    articles = [a for a in prose if a >= 0]
    main, elsewhere = prose[IN_MAIN], prose[ELSEWHERE]
    if articles:
        best = max(articles, key=lambda a: (prose[a], -a))
        if 2 * prose[best] >= max(main, elsewhere):
            return {best, *(a for a in articles if a not in inner and 2 * prose[a] >= prose[best])}
    return {IN_MAIN} if IN_MAIN in prose and 2 * main >= elsewhere else {ELSEWHERE}


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, content, certain) of each block: ``content`` unless markup says no, ``certain`` if it is also in no doubt.

    Certain are plain lines of an article, other than those that are links as a whole.
    """
    lines: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    #: Open elements: name, what they say, whether a header of an article, the article they open (or none).
    open_tags: list[tuple[str, int, bool, int | None]] = []
    #: How many elements of a name are open, and how many say DOUBT or OUT.
    opened: Counter[str] = Counter()
    said = [0, 0, 0]
    header = 0
    articles: list[int] = []
    inner: set[int] = set()
    #: Letters outside of links by place; an article that says OUT is none.
    prose: Counter[int] = Counter()
    linked = plain = False
    at = count = 0

    def flush() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            level = OUT if said[OUT] else DOUBT if said[DOUBT] else PLAIN
            if header and not any(t[0] in HEADINGS for t in open_tags[-4:]):
                level = OUT
            place = articles[-1] if articles else IN_MAIN if opened["main"] else ELSEWHERE
            lines.append((text, level, place, plain))
            if level < OUT:
                prose[place] += len(text) if plain else 0
        plain = False

    def add(text: str) -> None:
        nonlocal plain
        parts.append(text)
        plain = plain or (not linked and not text.isspace())

    def close(position: int) -> None:
        nonlocal header
        for name, says, is_header, article in open_tags[position:]:
            opened[name] -= 1
            said[says] -= 1
            header -= is_header
            if article is not None:
                articles.pop()
        del open_tags[position:]

    # What is found inside raw text is no tag, so the search goes on from where that ends.
    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if name == "a":
                linked = False
            # Without the count, stray end tags would each search all open elements.
            if opened[name]:
                close(next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in BLOCK and open_tags and open_tags[-1][0] == "p":
            close(len(open_tags) - 1)
        if name == "a":
            linked = "href" in m[3].lower()
        says = _evidence(name, m[3], bool(articles))
        is_header = name == "header" and bool(articles)
        article = None
        if name == "article":
            article, count = count, count + 1
            if articles:
                inner.add(article)
            articles.append(article)
            if says < OUT and not said[OUT]:
                prose[article] += 0
        elif name == "main" and not said[OUT]:
            prose[IN_MAIN] += 0
        open_tags.append((name, says, is_header, article))
        opened[name] += 1
        said[says] += 1
        header += is_header
    if at < len(page):
        add(page[at:])
    flush()
    places = _content_places(prose, inner)
    return [
        (text, level < OUT and place in places, level == PLAIN and place in places and place >= 0 and plain)
        for text, level, place, plain in lines
    ]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by increasing runs of matches."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, value in enumerate(a):
        for j in places.get(value, ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k] = j
                nodes[k] = node
    found, node = [], nodes[-1] if nodes else None
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def _near(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes of each page, and which of its content lines are open to doubt."""
    for batch in batches:
        hashes, doubtful = [], []
        for page in batch.column(3):
            lines = page_lines(page.as_py() or "")
            hashes.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _, _ in lines])
            doubtful.append([i for i, (_, content, certain) in enumerate(lines) if content and not certain])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(doubtful, pa.list_(pa.int32()))],
            ["key", "host", "path", "lines", "doubtful"],
        )


def _template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubtful lines that the nearer neighbour has as well."""
    for batch in batches:
        keys, shared = [], []
        for row in batch.to_pylist():
            before = _near(row["path"], row["before_path"])
            after = _near(row["path"], row["after_path"])
            other = row["after_lines"] if after > before else row["before_lines"]
            common = set(common_lines(row["lines"], other)) if other is not None else set()
            if drop := [i for i in row["doubtful"] if i in common]:
                keys.append(row["key"])
                shared.append(drop)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shared, pa.list_(pa.int32()))], ["key", "shared"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, shared in zip(batch.column(2), batch.column(3)):
            dropped = set(shared.as_py() or ())
            lines = page_lines(page.as_py() or "")
            texts.append("\n".join(t for i, (t, content, _) in enumerate(lines) if content and i not in dropped))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page; blocks of the text are joined by line feeds.

    Pages are paired over the distinct (host, path) of a host, so that copies of one page are not
    held against each other; the page with the smallest key stands for its place. Pages without a
    host have no neighbour and keep all lines that markup does not rule out. A null page is an empty one; null or
    repeated ids and repeated rows are worked on each by itself, equal rows alike. Other columns
    are not read.
    """
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    url = F.coalesce("url", F.lit(""))
    key = F.unhex(F.sha2(F.concat_ws("\x00", url, "html"), 256))
    outlines = cut_lineage(
        source.select(
            key.alias("key"),
            F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
            F.regexp_extract(url, PARTS, 2).alias("path"),
            "html",
        ).mapInArrow(_outlines, "key binary, host string, path string, lines array<long>, doubtful array<int>")
    )
    places = outlines.filter("host <> ''").groupBy("host", "path").agg(F.min_by("lines", "key").alias("lines"))
    # A host may hold a third of all pages, so its order is spread over tasks by range, not gathered.
    ordered = cut_lineage(
        places.repartitionByRange("host", "path")
        .sortWithinPartitions("host", "path")
        .select("*", F.monotonically_increasing_id().alias("position"))
    )
    part = F.shiftright("position", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    # One number per task of the sort.
    offsets, total = {}, 0
    for row in sorted(sizes, key=lambda r: r.part):
        offsets[row.part] = total
        total += row.n
    start = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]) if offsets else F.create_map()
    nth = (F.element_at(start, part) if offsets else F.lit(0).cast("long")) + F.col("position").bitwiseAND((1 << 33) - 1)
    numbered = ordered.select("host", "path", "lines", nth.alias("nth"))

    def neighbour(name: str, step: int) -> DataFrame:
        return numbered.select(
            (F.col("nth") + step).alias("nth"), F.col("host").alias("host"),
            F.col("path").alias(f"{name}_path"), F.col("lines").alias(f"{name}_lines"),
        )

    near = (
        numbered.drop("lines")
        .join(neighbour("before", 1), ["nth", "host"], "left")
        .join(neighbour("after", -1), ["nth", "host"], "left")
        .drop("nth")
    )
    asked = outlines.filter(F.size("doubtful") > 0).dropDuplicates(["key"]).join(near, ["host", "path"])
    shared = cut_lineage(
        asked.select("key", "path", "lines", "doubtful", "before_path", "before_lines", "after_path", "after_lines")
        .mapInArrow(_template, "key binary, shared array<int>")
    )
    return (
        source.withColumn("key", key)
        .join(shared, "key", "left")
        .select("page_id", "url", "html", "shared")
        .mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
    )
