"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: tags, told apart by the elements around them and their class, and
blocks of text. The occurrence vector of a token says how often each page of its host has it;
tokens of one vector form a class. A class is valid if enough pages have it and it holds a tag:
texts that only come together (copies of an article) are no template. Texts of valid classes are
template, all others fill its slots. The text of a page is what its slots hold, save those in
elements that say themselves that they are no content (menus, forms, adverts, comments and so on);
if the page marks an article or a main part, its slots are those inside. There a text is template
only if the block it stands in is of its class too, as a line that many articles cite is content;
an article of which nothing would be left is a copy and stays whole. The order and the nesting of
the classes are not worked out.

Vectors are never collected: a vector is the bitwise sum of a hash per page and count, which is
added up before the shuffle, so a host with most of all pages costs one row per token and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch, maybe_broadcast

# Pages that must share a class before it counts as template.
MIN_PAGES = 5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
NO_CONTENT = frozenset(
    "aside button datalist dialog footer form head header iframe input menu nav noframes noscript object option"
    " script select style svg template textarea title".split()
)
CONTENT = frozenset(("article", "main"))
# An element of this name ends an open one of the same name unless one of these is in between.
SIBLINGS = {
    "li": frozenset(("ul", "ol", "menu")),
    "dt": frozenset(("dl",)),
    "dd": frozenset(("dl",)),
    "tr": frozenset(("table",)),
    "td": frozenset(("table", "tr")),
    "th": frozenset(("table", "tr")),
    "option": frozenset(("select", "datalist")),
}
_NAMES = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alerts?|sidebar|menu"
    r"|nav(?:bar|igation)?|breadcrumbs?|foot(?:er)?|masthead|comments?|repl(?:y|ies)|discussion|disqus"
    r"|social|shar(?:e|ing)|related|newsletter|subscribe|subscription|popup|modal|widget|login|signup|search"
    r"|disclaimer|pagination|pager"
)
NO_CONTENT_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NAMES}|side|head(?:er)?)(?:$|[\s_-])", re.IGNORECASE)
# Inside an article a name rules an element out only if all its parts are such words or say nothing:
# "related-links" does, "related-work" and "article-head" do not.
_PLAIN = (
    r"\d+|a|area|article|bar|block|body|bottom|box|buttons?|container|content|form|group|inner|items?|inline|left|lists?|links?"
    r"|main|messages?|outer|page|panel|post|posts|reader|right|row|section|site|slot|small|text|the|thread|top|unit|user|wrap(?:per)?"
)
NO_CONTENT_INSIDE = re.compile(
    rf"(?:(?:{_PLAIN})[_-])*(?:{_NAMES})(?:[_-](?:{_NAMES}|{_PLAIN}))*", re.IGNORECASE
)
# Elements that are text themselves: an id on them is an anchor.
TEXT_ELEMENTS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
NO_CONTENT_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.IGNORECASE)


def _no_content(name: str, rest: str, inside: bool) -> bool:
    if name in NO_CONTENT:
        return True
    if name in CONTENT or name in ("html", "body") or not rest.strip():
        return False
    if _HIDDEN.search(rest):
        return True
    for key, *values in _ATTRIBUTE.findall(rest):
        value = unescape("".join(values))
        key = key.lower()
        if key in ("class", "id") and not inside and NO_CONTENT_NAME.search(value):
            return True
        if key == "class" or (key == "id" and name not in TEXT_ELEMENTS):
            if inside and any(map(NO_CONTENT_INSIDE.fullmatch, value.split())):
                return True
        if key == "role" and value.lower() in NO_CONTENT_ROLE:
            return True
    return False


def _class_of(rest: str) -> str:
    if "class" not in rest.lower():
        return ""
    return next(("".join(v) for k, *v in _ATTRIBUTE.findall(rest) if k.lower() == "class"), "")


def tokens(html: str) -> Iterator[tuple[str, str, bool | str, bool]]:
    """The page as ('tag', token, content, open) and ('text', text, content, open) in page order.

    ``content`` is whether the tag begins an article or main part; of a text in one it is the tag of
    the block around it, of other texts it is empty;
    ``open`` whether no element around it rules it out. White space inside a text is one space; empty texts are left out.
    """
    stack: list[tuple[str, bool, bool, str]] = []  # name, in content, ruled out, tag of the block
    said: list[str] = []
    at, size = 0, len(html)

    def block() -> Iterator[tuple[str, str, bool | str, bool]]:
        text = " ".join("".join(said).split())
        said.clear()
        if text:
            _, content, closed, tag = stack[-1] if stack else ("", False, False, "")
            yield "text", text, tag if content else "", not closed

    while at < size:
        match = _TOKEN.search(html, at)
        if match is None:
            said.append(unescape(html[at:]))
            break
        if match.start() > at:
            said.append(unescape(html[at : match.start()]))
        at = match.end()
        name = match["name"] or match["name2"]
        if not name:
            continue
        name = name.lower()
        closing = bool(match["close"] or match["close2"])
        rest = match["rest"] or match["rest2"] or ""
        if name == "br":
            said.append(" ")
            continue
        is_block = name in BLOCKS
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            ends = depth is not None and (is_block or any(entry[2] for entry in stack[depth:]))
            if is_block or ends:
                yield from block()
            if depth is not None and (is_block or not any(entry[0] in BLOCKS for entry in stack[depth + 1 :])):
                del stack[depth:]
            continue
        out, own = _no_content(name, rest, bool(stack) and stack[-1][1]), ""
        if is_block or out:
            yield from block()
        if is_block:
            barrier = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS and stack[k][0] != "p"), -1)
            open_p = next((k for k in range(len(stack) - 1, barrier, -1) if stack[k][0] == "p"), None)
            if open_p is not None:
                del stack[open_p:]
            if name in SIBLINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SIBLINGS[name]:
                        break
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            path = "/".join(entry[0] for entry in stack if entry[0] in BLOCKS and entry[0] != "p")
            ruled_out = out or bool(stack) and stack[-1][2]
            own = f"{path}/{name}.{_class_of(rest)}"
            yield "tag", own, name in CONTENT and not ruled_out, not ruled_out
        if name in VOID or rest.rstrip().endswith("/") and not is_block and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
            continue
        _, content, closed, tag = stack[-1] if stack else ("", False, False, "")
        stack.append((name, content or (name in CONTENT and not closed), closed or out, own or tag))
    yield from block()


def _signed(data: str) -> int:
    code = xxhash.xxh3_64_intdigest(data)
    return code - (1 << 64) if code >> 63 else code


def _key(text: str, around: bool | str) -> int:
    """A text as a token; texts in an article or main part are told apart by the block around them."""
    return _signed(f"{around}\0{text}" if around else text)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: its occurrence vector, pages, kind and the block that must be of its class."""
    names = ["host", "token", "tag", "around", "vector", "pages"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        found: dict[tuple[str | None, int, bool, int | None], list[int]] = {}
        for row, host, html in zip(*(batch.column(k) for k in range(3))):
            row, host = row.as_py(), host.as_py()
            counts: dict[tuple[int, bool, int | None], int] = {}
            for kind, value, content, free in tokens(html.as_py() or ""):
                if kind == "tag":
                    key = (_signed(value), True, None)
                elif free:
                    key = (_key(value, content), False, _signed(content) if content else None)
                else:
                    continue
                counts[key] = counts.get(key, 0) + 1
            for (token, tag, around), count in counts.items():
                entry = found.setdefault((host, token, tag, around), [0, 0])
                entry[0] ^= _signed(f"{row}:{count}")
                entry[1] += 1
        if found:
            rows = [(*key, *value) for key, value in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, fixed in zip(batch.column(2), batch.column(3)):
            template = set(fixed.as_py() or ())
            inside, whole, outside, marked = [], [], [], False
            for kind, value, content, free in tokens(html.as_py() or ""):
                if kind == "tag":
                    marked = marked or content
                elif free:
                    slot = not (template and _key(value, content) in template)
                    if content:
                        whole.append(value)
                    if slot:
                        (inside if content else outside).append(value)
            texts.append("\n".join((inside or whole) if marked else outside))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The main text of every page.

    Returns a row per row of ``pages``: page_id, url, text, n_chars. Only page_id, url and html are
    read. A null or empty page has an empty text; pages without a host (null or odd url) are one
    host; a repeated page counts each time. Blocks are joined by line breaks in page order.
    An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    hosted = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host"),
    )
    seen = hosted.select(F.monotonically_increasing_id().alias("row"), "host", "html").mapInArrow(
        _vectors, "host string, token long, tag boolean, around long, vector long, pages long"
    )
    summed = scratch.store(
        seen.groupBy("host", "token", "tag", "around").agg(
            F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages")
        ).where(F.col("pages") >= min_pages),
        "tokens",
    )
    classes = (
        summed.groupBy("host", "vector", "pages")
        .agg(F.max("tag").alias("has_tag"), F.count(F.lit(1)).alias("tokens"))
        .where("has_tag AND tokens > 1")
        .select("host", "vector", "pages")
    )
    free = summed.where("NOT tag AND around IS NULL").join(classes, ["host", "vector", "pages"], "left_semi")
    blocks = summed.where("tag").select("host", F.col("token").alias("around"), "vector", "pages")
    nested = summed.where("around IS NOT NULL").join(blocks, ["host", "around", "vector", "pages"], "left_semi")
    fixed = scratch.store(free.select("host", "token").unionByName(nested.select("host", "token")), "fixed")
    # Fixed texts of a host, at most as many as its shortest page has blocks.
    by_host = fixed.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    joined = hosted.join(maybe_broadcast(by_host, fixed.count()), "host", "left")
    texts = joined.select("page_id", "url", "html", "fixed").mapInArrow(
        _extract, "page_id long, url string, text string"
    )
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
