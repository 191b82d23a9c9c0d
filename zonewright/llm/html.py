"""Main text of web pages, by consensus on each host's paths.

Every page names the container that holds most of its text, as a path of tags, classes and ids with
numbers generalised away. The pages of a host vote; the paths that win are then used to extract from
all its pages, so that a page whose own guess is off (a stub under a long notice, say) is read like
its siblings. A page without any of its host's winning paths falls back on its own container. Parts
that are not the article (menus, side bars, hidden ones) are left out everywhere, and neither they nor
what lies in them is a container.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import lean, materialize, slices, table

# Names from the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg math iframe object canvas audio video select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body center div main section table tbody td tr".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: An element of the first kind ends an open one of the second, within the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Parts that are not the article, by tag, role and word of a class or id.
BOILER_TAGS = set("aside button dialog footer form head header input label menu nav".split())
BOILER_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILER_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager "
    "pagination popup promo promotion reactions recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: A class with one of these words tells of a page's layout or state, not of the part itself.
LAYOUT_WORDS = set("closed disabled enabled has no open with without".split())
#: Share of the page's text from which an article's own element is taken as it is, and share of a winning
#: path's text from which a winning path within it is taken instead.
ARTICLE, INNER = 0.3, 0.3
#: A path wins with this share of its host's votes, two at least; so a host has 50 at most.
SHARE = 0.02

_MARK = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NUMBERS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Elements of a page in order, each with its parent and label, and the pieces of text between tags.
    The page is read once from left to right; time grows with its length."""

    def __init__(self, html: str):
        self.tags, self.parents, self.labels, self.off, self.main = ["html"], [-1], ["html"], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # element and text; None: a block ends or begins
        self._stack, self._open_tags = [0], Counter(["html"])
        self._html, self._last, self._unquoted = html, html.rfind(">"), set()
        self._read()

    def _read(self) -> None:
        html, at = self._html, 0
        n = len(html)
        while at < n:
            m = _MARK.search(html, at)
            if not m or m.end() > self._last + 1:  # no tag ends any more
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            if not m[2]:
                start, end = ("<!--", "-->") if html.startswith("<!--", m.start()) else ("<![CDATA[", "]]>") if html.startswith("<![CDATA[", m.start()) else ("", ">")
                stop = html.find(end, m.start() + len(start))
                at = stop + len(end) if stop >= 0 else n
                continue
            tag, stop = m[2].lower(), self._tag_end(m.end())
            at = stop + 1
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                close = _raw_end(tag).search(html, at)
                at = html.find(">", close.end()) + 1 if close and close.end() <= self._last else n
            else:
                self._open(tag, html[m.end() : stop])

    def _tag_end(self, at: int) -> int:
        """Where a tag's > is; one in a quoted value is not. There is one, by _read()."""
        first = None
        while m := _STOP.search(self._html, at):
            if not m[1]:
                return m.start()
            first = m.end() if first is None else first
            close = -1 if m[1] in self._unquoted else self._html.find(m[1], m.end())
            if close < 0:
                self._unquoted.add(m[1])  # nor does one close further on
                break
            at = close + 1
        return self._html.find(">", at if first is None else first)

    def _text(self, text: str) -> None:
        self.pieces.append((self._stack[-1], text))

    def _pop_to(self, depth: int) -> None:
        for element in self._stack[depth:]:
            self._open_tags[self.tags[element]] -= 1
            if self.tags[element] in BLOCK:
                self.pieces.append((element, None))
        del self._stack[depth:]

    def _depth(self, tags: set[str], within: set[str]) -> int | None:
        if not any(self._open_tags[t] for t in tags):
            return None
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in tags:
                return depth
            if tag in within:
                return None
        return None

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag in ("br", "hr"):
            self.pieces.append((self._stack[-1], None))
        if tag in VOID:
            return
        if tag == "body" or tag in BLOCK:
            depth = self._depth({"head"}, set())
            if depth:
                self._pop_to(depth)
        if tag == "body" and self._open_tags["body"]:
            return
        if tag in CLOSES_P:
            depth = self._depth({"p"}, CONTAINER | {"li", "dd", "blockquote", "th"})
            if depth:
                self._pop_to(depth)
        if tag in SIBLINGS:
            depth = self._depth(*SIBLINGS[tag])
            if depth:
                self._pop_to(depth)
        found: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'"))
        parent, element = self._stack[-1], len(self.tags)
        names = sorted({f".{c}" for c in found.get("class", "").split()}) + [f"#{i}" for i in found.get("id", "").split()[:1]]
        self.tags.append(tag)
        self.parents.append(parent)
        self.labels.append(tag + _NUMBERS.sub("0", "".join(names)).replace(">", "_"))
        self.off.append(self.off[parent] or self._is_boiler(tag, found))
        self.main.append(tag in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "") == "articleBody")
        self._open_tags[tag] += 1
        if tag in BLOCK:
            self.pieces.append((element, None))
        self._stack.append(element)

    def _close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return  # what follows belongs to the body still
        if tag == "br":
            self.pieces.append((self._stack[-1], None))
            return
        depth = self._depth({tag}, set() if tag in CONTAINER or tag in BLOCK - {"p"} else CONTAINER)
        if depth:
            self._pop_to(depth)

    @staticmethod
    def _is_boiler(tag: str, found: dict[str, str]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in BOILER_TAGS or found.get("role", "").lower() in BOILER_ROLES or "hidden" in found:
            return True
        if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        for name in (*found.get("class", "").split(), found.get("id", "")):
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & BOILER_WORDS and not words & LAYOUT_WORDS:
                return True
        return False

    def _sizes(self) -> tuple[list[int], list[bool]]:
        """Characters of each element's text that is not in links or left out, and whether the element is
        in a link or left out itself."""
        n = len(self.tags)
        good, linked = [0] * n, [False] * n
        for e in range(1, n):
            linked[e] = linked[self.parents[e]] or self.tags[e] == "a" or self.off[e]
        for element, text in self.pieces:
            if text and not linked[element]:
                good[element] += len(text) - text.count(" ") if not text.isspace() else 0
        for e in range(n - 1, 0, -1):
            good[self.parents[e]] += good[e]
        return good, linked

    def container(self) -> tuple[int, int]:
        """The element that holds the page's text, and that text's length; without text, 0.

        That is the article's or main element, whole, if it has its share; else the smallest container
        beside which no text is left but boilerplate and links."""
        (good, linked), n = self._sizes(), len(self.tags)
        best = max((e for e in range(1, n) if self.main[e] and not linked[e]), key=lambda e: (good[e], -e), default=0)
        if best:
            alike = [e for e in range(1, n) if self.main[e] and not linked[e] and self.parents[e] == self.parents[best] and self.labels[e] == self.labels[best]]
            if sum(good[e] for e in alike) >= ARTICLE * good[0]:
                return best, good[best]
        at, children = 0, {}
        for e in range(1, n):
            children.setdefault(self.parents[e], []).append(e)
        while good[at]:
            deeper = next((e for e in children.get(at, ()) if not linked[e] and good[e] == good[at]), None)
            if deeper is None or self.tags[deeper] not in CONTAINER:
                break
            at = deeper
        return at, good[at]

    def path(self, element: int) -> str:
        """Labels from the root down to an element."""
        out = []
        while element >= 0:
            out.append(self.labels[element])
            element = self.parents[element]
        return ">".join(out[::-1])

    def text(self, roots: set[int]) -> str:
        """Text of these elements without the parts that are not the article."""
        inside = [False] * len(self.tags)
        for e in range(len(self.tags)):
            inside[e] = (e in roots or (e > 0 and inside[self.parents[e]])) and not self.off[e]
        parts = [" " if text is None else entities.unescape(text) for element, text in self.pieces if inside[element] or text is None]
        return " ".join("".join(parts).split())

    def _at(self, paths: tuple[str, ...], good: list[int]) -> list[set[int]]:
        """For each path the elements there: article and main elements all, of others the one with the
        most text. None of them is left out or lies in a part that is."""
        found: list[list[int]] = [[] for _ in paths]
        places = [_trie(paths).get("html")]
        for number in places[0][1] if places[0] else ():
            found[number].append(0)
        for e in range(1, len(self.tags)):
            above = places[self.parents[e]]
            place = above[0].get(self.labels[e]) if above and not self.off[e] else None
            places.append(place)
            for number in place[1] if place else ():
                found[number].append(e)
        return [{e for e in own if self.main[e]} or {max(own, key=lambda e: (good[e], -e))} if own else set() for own in found]

    def extract(self, paths: list[str]) -> str:
        """Text at the first of the paths that this page has with text, or at the deepest one within that
        which holds its share of it (INNER); without any, that of the page's own container."""
        paths, (good, _) = tuple(paths), self._sizes()
        at = self._at(paths, good)
        for k, roots in enumerate(at):
            size = sum(good[e] for e in roots)
            if not size:
                continue
            within = [i for i, path in enumerate(paths) if path.startswith(paths[k] + ">") and sum(good[e] for e in at[i]) >= INNER * size]
            if found := self.text(at[max(within, key=lambda i: len(paths[i]), default=k)]):
                return found
        own, _ = self.container()
        if not self.main[own]:
            return self.text({own})
        alike = (e for e in range(len(self.tags)) if self.main[e] and self.parents[e] == self.parents[own] and self.labels[e] == self.labels[own])
        return self.text({*alike})


@functools.lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


@functools.lru_cache(maxsize=1024)
def _trie(paths: tuple[str, ...]) -> dict:
    """Label to (the same for the labels below, numbers of the paths that end here)."""
    out: dict = {}
    for number, path in enumerate(paths):
        below, labels = out, path.split(">")
        for label in labels:
            place = below.setdefault(label, ({}, []))
            below = place[0]
        place[1].append(number)
    return out


def host(url):
    """The host of a URL in lower case, '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """_host, _path and _size for each page that has text: its container and the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_html"):
                hosts, paths, sizes = [], [], []
                for name, source in zip(part.column("_host"), part.column("_html"), strict=True):
                    page = Page(source.as_py() or "")
                    element, size = page.container()
                    if size:
                        hosts.append(name.as_py())
                        paths.append(page.path(element))
                        sizes.append(size)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["_host", "_path", "_size"])

    return pages.select("_host", "_html").mapInArrow(run, "_host string, _path string, _size long")


def winners(cast: DataFrame, share: float = SHARE) -> DataFrame:
    """_host and _paths: the host's paths with at least two votes and its share of them, by votes, then by
    text, then by name. Counts are combined before they are shuffled, so a host with very many pages is
    a few rows to each task, and written once, as they are looked at twice."""
    counted = materialize(cast.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_votes"), F.sum("_size").alias("_text")), "host-votes")
    total = counted.groupBy("_host").agg(F.sum("_votes").alias("_all"))
    won = counted.join(total, "_host").filter((F.col("_votes") >= 2) & (F.col("_votes") >= share * F.col("_all")))
    order = F.struct((-F.col("_votes")).alias("v"), (-F.col("_text")).alias("t"), F.col("_path").alias("p"))
    return won.groupBy("_host").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]).alias("_paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: id, url, text and n_chars (its code points).

    A null page counts as empty and gives empty text; a null URL belongs to the host without a name.
    Repeated rows vote as often as they occur, and are extracted alike; a very long page is read in one
    pass; an empty table gives an empty table. A host has few paths (SHARE), so the join brings bounded
    rows to each page; it splits hosts with very many pages. Other columns are not read."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(F.col(url_col)).alias("_host"))
    best = materialize(winners(votes(rows)), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_html"):
                found = [
                    Page(source.as_py() or "").extract(paths.as_py() or [])
                    for source, paths in zip(part.column("_html"), part.column("_paths"), strict=True)
                ]
                columns = [part.column("_id"), part.column("_url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_url", "text", "n_chars"])

    joined = rows.join(best, "_host", "left").select("_id", "_url", "_html", "_paths")
    return joined.mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
