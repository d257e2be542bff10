"""Main text of web pages by differencing with the nearest page, checked against structure.

A page becomes lines, one for each block of text.  Every page is paired with the
page of its host whose URL path is nearest, all lines of both are aligned by
their longest common subsequence, and the shared lines go, for they belong to
the host's template.  Structure is a check on that, as templates also differ
from page to page and articles also share lines: elements that the markup names
as boilerplate (menus, footers, adverts, forms, comments ...) go whether shared
or not, and a shared line stays if it is body text of an article, that is text
beside links in a paragraph, heading, list, table or quotation of it.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bucket_count, from_blocks, ordered_blocks, ship

# A comment, an element whose content is no text, a declaration or a tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that are never part of an article.
DROPPED = frozenset("nav footer aside form button menu dialog head header".split())
#: Words of a class, id or role that mark an element the same way.
MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent notice notices sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header masthead comment comments disqus promo popup modal newsletter subscribe share social related search alert".split())
#: Elements whose start and end bound a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold body text within an article.
BODY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary".split())
#: What the markup says of a line.
OPEN, LOOSE, TEXT = 0, 1, 2
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _marked(tag: str, attrs: str, lenient: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main") or tag == "article" and lenient:
        return False
    for m in _ATTR.finditer(attrs):
        if MARKS.intersection(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


def page_lines(source: str) -> list[tuple[str, int]]:
    """The lines that the markup doesn't drop: ``TEXT`` of an article, ``LOOSE`` in one, or ``OPEN``, outside.

    Where an element named as boilerplate was never closed it may swallow the
    article; a page that would lose all its articles so is read once more, and
    an article then ends such an element and isn't itself taken for boilerplate.
    """
    tokens = list(_TOKEN.finditer(source))
    out = _lines(source, tokens, False)
    if not any(kind for _, kind in out) and any((m["tag"] or "").lower() in ("article", "main") for m in tokens):
        return _lines(source, tokens, True)
    return out


def _lines(source: str, tokens: list[re.Match], lenient: bool) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    text: list[str] = []
    drop, depth = "", 0  # the dropped element that is open, and how many of its kind
    main, link, body = 0, False, 0
    beside = False  # whether the line has text beside links
    at = 0

    def end_line():
        nonlocal beside
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, OPEN if not main else TEXT if body and beside else LOOSE))
        beside = False

    for m in tokens:
        if not drop and m.start() > at:
            text.append(source[at : m.start()])
            beside = beside or not link and not text[-1].isspace()
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if drop:
            if tag == drop and tag not in VOID and not m["attrs"].endswith("/"):
                depth += -1 if closing else 1
                if not depth:
                    drop = ""
            elif lenient and tag in ("article", "main") and not closing and drop not in ("article", "main"):
                drop, depth, main = "", 0, main + 1  # an element that was left open ends here
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            link = not closing
        if tag in BLOCKS:
            end_line()
            link = False
            body = int(tag in BODY and not closing) if tag in BODY or tag == "div" or tag in ("article", "main", "section") else body
        if not closing and tag not in VOID and not m["attrs"].endswith("/") and not (tag == "header" and main) and _marked(tag, m["attrs"], lenient):
            if tag not in BLOCKS:
                end_line()
            drop, depth = tag, 1
        elif tag in ("article", "main"):
            main = max(0, main + (-1 if closing else 1))
    if not drop:
        text.append(source[at:])
        beside = beside or not link and not text[-1].isspace()
    end_line()
    return out


def common_lines(x: list[str], y: list[str]) -> list[bool]:
    """Which lines of ``x`` are in its longest common subsequence with ``y``.

    Bit-parallel: a row of the table is one integer with a bit for each line of x.
    """
    bits: dict[str, int] = {}
    for i, line in enumerate(x):
        bits[line] = bits.get(line, 0) | 1 << i
    full = (1 << len(x)) - 1
    row, rows = full, []
    for line in y:
        u = row & bits.get(line, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    shared = [False] * len(x)
    i, j = len(x), len(y)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> (i - 1) & 1):
                i -= 1
                shared[i] = True
    return shared


def main_text(lines: list[tuple[str, int]], nearest: list[tuple[str, int]] | None) -> str:
    """The lines that the nearest page doesn't share, and the shared ones that are an article's text."""
    shared = common_lines([line for line, _ in lines], [line for line, _ in nearest or ()])
    return "\n".join(line for (line, kind), gone in zip(lines, shared, strict=True) if kind == TEXT or not gone)


def url_key(url: str, page_id: int | None = None) -> str:
    """Host and path segments, such that near pages of a host sort together; then query and page_id, which part pages of one path."""
    number = "" if page_id is None else f"{page_id + (1 << 63):020d}"
    try:
        parts = urlsplit(url)
        path = "\x02".join([(parts.netloc or "").lower(), *parts.path.rstrip("/").split("/")[1:]])
        return f"{path}\x01{parts.query}\x01{number}"
    except ValueError:
        return f"\x02{url}\x01\x01{number}"


def _nearest(keys: list[str], i: int) -> int | None:
    """The neighbour in URL order of the same host that shares more leading segments; the next one on a tie."""

    def near(j: int) -> int:
        if not 0 <= j < len(keys):
            return 0
        n = 0
        for a, b in zip(keys[i].split("\x01")[0].split("\x02"), keys[j].split("\x01")[0].split("\x02"), strict=False):
            if a != b:
                break
            n += 1
        return n

    after, before = near(i + 1), near(i - 1)
    if not max(after, before):
        return None
    return i + 1 if after >= before else i - 1


OUT = "page_id long, url string, text string, n_chars long"


def _extract(key, t):
    rows = from_blocks(t.column("payload").to_pylist()).sort_by([("key", "ascending"), ("page_id", "ascending"), ("html", "ascending")])
    # a bucket's neighbours by range come first and last; the ends of all buckets don't meet
    keys = rows.column("key").to_pylist()
    extra = rows.column("extra").to_pylist()
    own_keys = [k for k, e in zip(keys, extra, strict=True) if not e]
    keep = [i for i, (k, e) in enumerate(zip(keys, extra, strict=True)) if not e or (e > 0 and k > own_keys[-1]) or (e < 0 and k < own_keys[0])]
    rows = rows.take(keep)
    keys, extra = [keys[i] for i in keep], [extra[i] for i in keep]
    sources, lines = rows.column("html"), {}

    def of(i: int) -> list[tuple[str, int]]:
        if i not in lines:
            lines[i] = page_lines(sources[i].as_py())
        return lines[i]

    ids, urls, texts = [], [], []
    for i, e in enumerate(extra):
        if not e:
            own, near = of(i), None
            if own and (j := _nearest(keys, i)) is not None:
                near = of(j)
            ids.append(rows.column("page_id")[i].as_py())
            urls.append(rows.column("url")[i].as_py())
            texts.append(main_text(own, near))
        lines.pop(i - 2, None)
    return pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def _keyed(batches):
    for b in batches:
        keys = pa.array([url_key(u or "", i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([keys, *b.columns], ["key", *b.schema.names])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages (page_id, url, html, ...)``.

    A null or empty html gives an empty text.  A null url sorts as an empty one,
    on a host of its own; pages of one path are neighbours, by query and page_id.
    Repeated rows each give a row; an empty table gives none; other columns are
    not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.mapInArrow(_keyed, "key string, page_id long, url string, html string")
    return ordered_blocks(keyed, bucket_count(pages), neighbours=("next", "previous")).groupBy("bucket").applyInArrow(_extract, OUT)


def op6_query(pages: DataFrame) -> DataFrame:
    """The main text of each page."""
    return extract_text(pages)
