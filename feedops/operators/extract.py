"""HTML extraction (B1, B2, B7, B8): one Arrow stage, then columns.

Pages contain unclosed tags, so no XML function can read them. ``mapInPandas`` turns each page into one row of typed
arrays; everything after that (link rules, fall-backs, "first element decides") is array expressions on that row, so the
whole extraction needs no shuffle and a page's rows never leave their task.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions import urls
from feedops.functions.expr import blank_to_null, evaluated, let

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag of these closes an open one of the same kind, up to the enclosing container.
_SIBLINGS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Block tags that end an open paragraph.
_ENDS_P = frozenset("p div ul ol table section article header footer nav h1 h2 h3 h4 h5 h6 pre form".split())


@dataclass(frozen=True)
class ListingSpec:
    """Where rows and their titles are on a listing page (simple selectors, see ``_compiled``)."""

    row: str
    title: str | None
    icon: str
    link_attribute_of_row: bool = False


# Selectors of the two site layouts.
TABLE_ROWS = ListingSpec("tr.ub-content", 'td.gall_tit a[href*="/board/view/"]', ".icon_pic")
HYBRID_ROWS = ListingSpec("div.vrow.hybrid", "a.title.hybrid-title", ".media-icon")
COLUMN_ROWS = ListingSpec("a.vrow.column", "span.title", ".media-icon", link_attribute_of_row=True)
BODY_IMAGES, CONTENT_BLOCK = "div.article-body", ".fr-view.article-content"
ATTACHMENT_LINKS = "div.appending_file_box ul li a[href]"
INLINE_IMAGES = (".writing_view_box img", ".write_div img")
EMOTICON_CLASS, EMOTICON_TYPE = "arca-emoticon", "emoticon"

_ROW = "list_pos int, layout string, href string, title string, has_image boolean, classes array<string>, data_type string"
_TAG = "pos int, kind string, href string, data_original string, src string, data_originalurl string, data_orig string, label string, classes array<string>, data_type string"


_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
# Elements whose content is text up to their own end tag.
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style", "textarea", "title")}


class _Node:
    """An element; attributes and texts are decoded only where a selector or a result asks for them."""

    __slots__ = ("tag", "raw", "parent", "children", "_attrs", "_classes")

    def __init__(self, tag: str, raw: str, parent: _Node | None) -> None:
        self.tag, self.raw, self.parent = tag, raw, parent
        self.children: list = []
        self._attrs = self._classes = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for name, double, single, bare in _ATTRIBUTE.findall(self.raw):
                self._attrs.setdefault(name.lower(), unescape(double or single or bare))
        return self._attrs

    @property
    def classes(self) -> list[str]:
        if self._classes is None:
            self._classes = self.attrs.get("class", "").split() if "class" in self.raw.lower() else []
        return self._classes

    def walk(self) -> Iterator[_Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield unescape(child)
            else:
                stack.extend(reversed(child.children))


def _closed(node: _Node, tag: str, stops: tuple[str, ...]) -> _Node:
    """The open element after closing the nearest ``tag`` above; unchanged if there is none before a stop."""
    at = node
    while at.parent is not None and at.tag != tag:
        if at.tag in stops:
            return node
        at = at.parent
    return node if at.parent is None else at.parent


def _tree(html: str | None) -> _Node:
    root = at = _Node("", "", None)
    text, pos = html or "", 0
    for found in iter(lambda: _TOKEN.search(text, pos), None):
        if found.start() > pos:
            at.children.append(text[pos : found.start()])
        pos = found.end()
        closing, tag, raw = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            at = _closed(at, tag, ())
            continue
        if tag in _SIBLINGS:
            at = _closed(at, tag, _SIBLINGS[tag])
        elif tag in _ENDS_P:
            at = _closed(at, "p", ("td", "th", "li", "div", "table"))
        node = _Node(tag, raw, at)
        at.children.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(text, pos)
            node.children.append(text[pos : end.start() if end else len(text)])
            pos = end.end() if end else len(text)
        elif tag not in _VOID and not raw.endswith("/"):
            at = node
    if pos < len(text):
        at.children.append(text[pos:])
    return root


# Compiled selectors of this worker. A plain dict, because the stage travels to workers by value.
_SELECTORS: dict[str, list] = {}


def _compiled(selector: str) -> list[tuple[str, tuple[str, ...], str, str, str]]:
    """Descendant chain of ``tag.class[attr*="x"]`` steps as (tag, classes, attribute, operator, value)."""
    if selector in _SELECTORS:
        return _SELECTORS[selector]
    steps = []
    for step in selector.split():
        plain, _, condition = step.rstrip("]").partition("[")
        tag, *classes = plain.split(".")
        operator = next((o for o in ("*=", "^=", "=") if o in condition), "")
        name, value = condition.split(operator, 1) if operator else (condition, "")
        steps.append((tag, tuple(classes), name, operator, value.strip("\"'")))
    _SELECTORS[selector] = steps
    return steps


def _fits(node: _Node, step: tuple) -> bool:
    tag, classes, name, operator, value = step
    if (tag and node.tag != tag) or any(c not in node.classes for c in classes):
        return False
    if not name:
        return True
    found = node.attrs.get(name)
    if found is None:
        return False
    return {"": True, "*=": value in found, "^=": found.startswith(value), "=": found == value}[operator]


def _select(root: _Node, selector: str) -> Iterator[_Node]:
    """Matches below ``root`` in document order; ancestors outside ``root`` may complete the chain."""
    *outer, last = _compiled(selector)
    for node in root.walk():
        if not _fits(node, last):
            continue
        at, wanted = node.parent, list(outer)
        while wanted and at is not None:
            if _fits(at, wanted[-1]):
                wanted.pop()
            at = at.parent
        if not wanted:
            yield node


def _first(root: _Node, selector: str) -> _Node | None:
    return next(_select(root, selector), None)


def _text(node: _Node) -> str:
    return "".join(node.strings()).strip()


def _joined_text(node: _Node) -> str:
    return "".join(s.strip() for s in node.strings())


def _may_match(html: str | None, selectors: Iterable[str]) -> bool:
    """False when every selector names a class that the text does not contain: such a page need not be parsed."""
    text = html or ""
    wanted = [[c for _, classes, *_ in _compiled(s) for c in classes] for s in selectors]
    found = any(all(c in text for c in classes) for classes in wanted)
    if found or "&" not in text:
        return found
    text = unescape(text)  # a class may be written with entities
    return any(all(c in text for c in classes) for classes in wanted)


def _listing_rows(html: str | None, specs: dict[str, ListingSpec], joined: bool) -> list[dict]:
    if not _may_match(html, [spec.row for spec in specs.values()]):
        return []
    root, rows = _tree(html), []
    for layout, spec in specs.items():
        for row in _select(root, spec.row):
            title = _first(row, spec.title) if spec.title else row
            href = None if title is None else (row if spec.link_attribute_of_row else title).attrs.get("href", "")
            rows.append({
                "list_pos": len(rows), "layout": layout, "href": href,
                "title": None if title is None else (_joined_text if joined else _text)(title),
                "has_image": _first(row, spec.icon) is not None,
                "classes": row.classes, "data_type": row.attrs.get("data-type"),
            })
    return rows


def _tag_row(node: _Node, kind: str, pos: int) -> dict:
    get = node.attrs.get
    return {"pos": pos, "kind": kind, "href": get("href"), "data_original": get("data-original"), "src": get("src"),
            "data_originalurl": get("data-originalurl"), "data_orig": get("data-orig"), "label": _joined_text(node),
            "classes": node.classes, "data_type": get("data-type")}


def _body_tags(html: str | None, body_selector: str, content_selector: str, tag: str) -> list[dict]:
    if not _may_match(html, (body_selector, content_selector)):
        return []
    root = _tree(html)
    body, content = _first(root, body_selector), _first(root, content_selector)
    nodes = list(_select(body, tag)) if body else []
    if content and not (body is not None and content.parent is body):
        nodes += list(_select(content, tag))
    return [_tag_row(n, "body", i) for i, n in enumerate(nodes)]


def _first_tags(html: str | None, attachments: str, inline: tuple[str, ...]) -> list[dict]:
    if not _may_match(html, (attachments, *inline)):
        return []
    root = _tree(html)
    found = [("attachment", n) for n in _select(root, attachments)]
    inline_ids = {id(n) for selector in inline for n in _select(root, selector)}
    found += [("inline", n) for n in root.walk() if id(n) in inline_ids]
    return [_tag_row(n, kind, i) for i, (kind, n) in enumerate(found)]


# Fixed value: characters of HTML read before their trees are given back, and that one frame of results answers.
SLICE_CHARACTERS = 2_000_000


def _slices(html: pd.Series, most: int = SLICE_CHARACTERS) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive runs of pages that reach ``most`` characters each; a longer page is one alone or ends its run."""
    begin = taken = 0
    for i, text in enumerate(html):
        taken += len(text) if isinstance(text, str) else 0
        if taken >= most:
            yield begin, i + 1
            begin, taken = i + 1, 0
    if begin < len(html):
        yield begin, len(html)


def _per_page(pages: DataFrame, name: str, element: str, read, keep: tuple[str, ...]) -> DataFrame:
    """Run ``read(html) -> list of dicts`` on every page; only ``keep`` and the array leave the Arrow stage.

    A batch is read in slices: the elements of a page point at each other, so without a collection they would pile up beside all rows of the batch.
    """
    kept = pages.select(*keep, "html")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("html").schema.fields)

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, end in _slices(batch["html"]):
                part = batch.iloc[begin:end]
                out = part[list(keep)].astype({c: object for c in keep if part[c].dtype == "str"})
                out[name] = [read(html) for html in part["html"]]
                yield out
                del out
                gc.collect()

    return kept.mapInPandas(stage, f"{fields}, {name} array<struct<{_ddl(element)}>>")


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(","))


def is_notice(classes: Column, data_type: Column) -> Column:
    """Notice rows of either layout."""
    by_class = F.exists(classes, lambda c: (c == "notice") | c.startswith("notice-"))
    return F.coalesce(by_class, F.lit(False)) | F.coalesce(data_type == "icon_notice", F.lit(False))


def extract_rows_table(pages: DataFrame, spec: ListingSpec = TABLE_ROWS, base: str = urls.SINGLE_BASE,
                       host: str = "gall.dcinside.com", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """B1: rows in document order with link, post id and image flag; rows without a title link drop out."""
    def read(html: str | None) -> list[dict]:
        return _listing_rows(html, {"table": spec}, joined=False)

    rows = _per_page(pages, "_rows", _ROW, read, keep).select(*keep, F.explode("_rows").alias("_r")).select(*keep, "_r.*")
    link = urls.board_link(base, F.col("href"), host)
    return rows.filter(F.col("href").isNotNull()).select(
        *keep, "list_pos", "href", "title", "has_image", is_notice(F.lit(None).cast("array<string>"), F.col("data_type")).alias("is_notice"),
        link.alias("link"), urls.post_id_from_query(link).alias("post_id"),
    )


def extract_rows_hybrid(pages: DataFrame, hybrid: ListingSpec = HYBRID_ROWS, column: ListingSpec = COLUMN_ROWS,
                        base: str = urls.MULTI_BASE, host: str = "arca.live", keep: tuple[str, ...] = ("page_id",),
                        id_pattern: str = r"/b/[^/]+/([0-9]+)", need_icon: bool = True) -> DataFrame:
    """B2: valid image rows of the hybrid layout; only a page without any falls back to the column layout."""
    def read(html: str | None) -> list[dict]:
        return _listing_rows(html, {"hybrid": hybrid, "column": column}, joined=True)

    def described(r: Column) -> Column:
        link = F.when(r["href"] != "", urls.canonical_link(base, r["href"], host))
        return F.struct(r["list_pos"].alias("list_pos"), r["layout"].alias("layout"), r["href"].alias("href"),
                        r["title"].alias("title"), r["has_image"].alias("has_image"),
                        is_notice(r["classes"], F.lit(None).cast("string")).alias("is_notice"), link.alias("link"))

    def valid(r: Column) -> Column:
        wanted = r["has_image"] if need_icon else F.lit(True)
        return ~r["is_notice"] & wanted & r["link"].isNotNull() & (F.regexp_extract(r["link"], id_pattern, 1) != "")

    good = _per_page(pages, "_rows", _ROW, read, keep).withColumn("_rows", F.filter(F.transform("_rows", described), valid))
    layout = F.when(F.exists("_rows", lambda r: r["layout"] == "hybrid"), F.lit("hybrid")).otherwise("column")
    chosen = good.withColumn("_layout", layout).withColumn("_rows", F.filter("_rows", lambda r: r["layout"] == F.col("_layout")))
    # The outer form: a plain explode makes the planner evaluate the whole array once more to skip empty ones.
    rows = chosen.select(*keep, F.explode_outer("_rows").alias("_r")).filter(F.col("_r").isNotNull()).select(*keep, "_r.*")
    return rows.drop("is_notice").withColumn("post_id", urls.post_id_from_path(F.col("link"), id_pattern))


def extract_media_all(pages: DataFrame, keep: tuple[str, ...] = ("post_id",), body: str = BODY_IMAGES,
                      content: str = CONTENT_BLOCK, tag: str = "img") -> DataFrame:
    """Media elements of a post body in page order, without emoticons."""
    def read(html: str | None) -> list[dict]:
        return _body_tags(html, body, content, tag)

    tags = _per_page(pages, "_tags", _TAG, read, keep).select(*keep, F.explode("_tags").alias("_t")).select(*keep, "_t.*")
    emoticon = F.array_contains("classes", EMOTICON_CLASS) | F.coalesce(F.col("data_type") == EMOTICON_TYPE, F.lit(False))
    return tags.filter(~emoticon).withColumnRenamed("pos", "img_pos").drop("kind", "label", "data_original")


def media_candidates(tags: DataFrame, policy: urls.UrlPolicy = urls.MULTI_MEDIA, base: str = urls.MULTI_BASE) -> DataFrame:
    """Ordered candidate URLs of every element that has an allowed one."""
    ordered = urls.ordered_candidates(F.col("data_originalurl"), F.col("src"), F.col("data_orig"), base, policy)
    return (
        evaluated(tags, "_urls", ordered).filter(F.size("_urls") > 0)
        .withColumn("primary_url", F.get("_urls", F.lit(0)))
        .withColumn("fallback_urls", F.slice("_urls", 2, F.size("_urls"))).drop("_urls")
    )


def extract_media_first(pages: DataFrame, keep: tuple[str, ...] = ("post_id",), post_url: str = "post_url",
                        policy: urls.UrlPolicy = urls.SINGLE_MEDIA, attachments: str = ATTACHMENT_LINKS,
                        inline: tuple[str, ...] = INLINE_IMAGES, default_name: str = "dcinside.jpg") -> DataFrame:
    """The one element that decides a post. Allowed attachments come before inline media, and the first element with
    any URL wins even if its URLs are all rejected later. Posts without such an element have no row."""
    def read(html: str | None) -> list[dict]:
        return _first_tags(html, attachments, inline)

    kept = (*keep, post_url) if post_url not in keep else keep
    pages = _per_page(pages, "_tags", _TAG, read, kept)
    allowed = F.filter("_tags", lambda t: (t["kind"] == "attachment") & urls.is_allowed_url(
        urls.resolve(F.col(post_url), F.coalesce(t["href"], F.lit(""))), policy))
    inline_tags = F.filter("_tags", lambda t: t["kind"] == "inline")
    deciding = let(allowed, lambda files: F.when(F.size(files) > 0, files).otherwise(inline_tags))
    # An element without any URL is passed over before URLs are resolved.
    with_url = F.filter(deciding, lambda t: F.coalesce(blank_to_null(t["href"]), blank_to_null(t["data_original"]), blank_to_null(t["src"])).isNotNull())
    first = let(F.get(with_url, F.lit(0)), lambda t: F.when(t.isNotNull(), F.struct(
        t["kind"].alias("kind"), t["label"].alias("label"),
        urls.source_urls(F.col(post_url), t["href"], t["data_original"], t["src"]).alias("urls"))))
    decided = evaluated(pages, "_first", first).filter(F.col("_first").isNotNull())
    primary = F.get("_first.urls", F.lit(0))
    return decided.select(
        *keep, F.col("_first.kind").alias("kind"), primary.alias("primary_url"),
        F.slice("_first.urls", 2, F.size("_first.urls")).alias("fallback_urls"),
        urls.filename_hint(primary, F.lit(default_name), F.col("_first.label"), 255).alias("filename_hint"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
