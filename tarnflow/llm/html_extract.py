"""Main text of HTML pages by consensus of their host: pages score containers, hosts vote on tag-class paths, winners extract."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import Stage, blank_to_empty, slices, table

#: Fixed values of HTML and of common page templates.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center details div main section table tbody td tr html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
NESTED = frozenset("audio canvas math object select svg template video".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button fieldset head datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form toolbar".split())
CELLS = frozenset("caption tbody td tfoot th thead tr table".split())
#: A start tag of the first kind ends an open one of the second, up to one of the third.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
IMPLIED = {k: (a.split(), b.split()) for k, (a, b) in IMPLIED.items()}
#: Words in names (classes and ids) of what is no article; of readers' own words; that tell nothing; that turn a name around.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner bookmarks breadcrumb breadcrumbs cookie consent cookies copyright disclaimer donate dropdown footer gdpr legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices pager pagination paywall popup promo promotion recommend recommendations recommended register related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar widget widgets alert warning feedback rating ratings respond response responses reviews".split()
)
READERS = frozenset("comment comments discussion disqus replies reply".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons center col column container content fixed global group holder icon icons inner item items left link links list main module outer overlay page panel post posts right row section side site slot space sticky text thread title top unit wrap wrapper zone".split())
TURNED = frozenset("has hide is no non not without with".split())

#: A tag with its quoted values whole, and one that ends at the next bracket whatever is quoted.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)>")
NO_TEXT = RAW | NESTED
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
ENDS = {n: re.compile(rf"<(/?){n}(?=[\s/>])", re.I) for n in NO_TEXT}
HEAVY = ("class", "id", "role", "hidden", "style", "aria-hidden")

#: A host's paths with at least this share of its votes are tried on its pages.
MIN_SHARE = 0.1
#: A text on one path of so many pages of a host at least, and of every second page that has the path, belongs to the host's frame.
FRAME_PAGES = 3
#: Winners of so many hosts at most are broadcast (200 bytes each, about); more are joined by shuffle.
BROADCAST_HOSTS = 50_000


class Kind(NamedTuple):
    """What a start tag says of its element: its step in a path, whether it is switched off, the strength of its hints, whether it heads an article."""

    step: str
    off: bool
    hint: int
    anchor: bool
    plain: bool


def hint_of(name: str) -> int:
    """1: a part of the name is a hint word; 2: the whole name is; 3: it names readers' comments."""
    words = [w.lower() for w in PART.findall(name)]
    if not words or words[0] in TURNED or not any(w in HINTS or w in READERS for w in words):
        return 0
    if all(w in HINTS or w in READERS or w in NEUTRAL for w in words):
        return 3 if any(w in READERS for w in words) else 2
    return 1


_kinds: dict[tuple[str, str], Kind] = {}


def kind_of(tag: str, attributes: str) -> Kind:
    """Templates repeat their tags, so kinds are remembered; the memory is emptied when it has many."""
    known = _kinds.get((tag, attributes))
    if known is None:
        found: dict[str, str] = {}
        for k, v in ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), html.unescape(v[1:-1] if v[:1] in ('"', "'") else v))
        classes, role = found.get("class", "").split(), found.get("role", "").lower().strip()
        anchor = tag in ("article", "main", "h1") or role in ("article", "main")
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSEEN.search(found.get("style", "")) is not None
        # A page's whole form may be its frame, so forms count as hints.
        hint = 2 if tag == "form" else max((hint_of(c) for c in (*classes, found.get("id", ""))), default=0)
        if tag in ("html", "body") or (anchor and hint < 3):
            hint = 0
        step = ".".join([f"{tag}@{role}" if role in ("article", "main") else tag, *sorted({re.sub(r"[>.]", "_", DIGITS.sub("0", c.lower())) for c in classes})])
        known = Kind(step, tag in BOILERPLATE or hidden or role in ROLES, hint, anchor, not any(k in found for k in HEAVY))
        if len(_kinds) >= 20_000:
            _kinds.clear()
        if len(attributes) < 500:
            _kinds[tag, attributes] = known
    return known


class Page:
    """Elements and text of a page, read leniently: unclosed and stray tags do as browsers do, nearly.  One pass, linear in the page."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.kind = [0], [""], [Kind("", False, 0, False, True)]
        self.box = [0]  # the container that each element is or lies in
        self._path, self._steps = [0], {}  # number of each element's path; by the path's parent and last step
        self.text: list[tuple[int, int, bool, str]] = []  # element, block, in a link, text
        self._stack, self._depths, self._blocks, self._block, self._links = [0], defaultdict(list), [], 0, False
        self._td, self._th = self._depths["td"], self._depths["th"]
        self._own: list[int] | None = None
        self._endless: set[str] = set()
        self._read(source)
        self.off = self._resolve([k.off for k in self.kind])
        self._heed_hints()

    # Reading

    def _read(self, source: str) -> None:
        begin = scan = 0
        last, tag = source.rfind(">"), TAG
        while True:
            lt = source.find("<", scan)
            if lt < 0:
                self._add(source[begin:])
                return
            m = tag.match(source, lt) if lt < last else None
            if m is None:
                slash = source.startswith("/", lt + 1)
                mark = source[lt + 1 + slash : lt + 2 + slash]
                if not (mark.isascii() and mark.isalpha()) and (slash or mark not in ("!", "?") or not mark):
                    scan = lt + 1
                    continue
                if lt > last:  # a tag or comment cut off by the page's end
                    self._add(source[begin:lt])
                    return
                if mark.isalpha():
                    # A quote that never closes: from here on a tag ends at the next bracket.
                    tag, scan = LOOSE, lt
                    continue
                if begin < lt:
                    self._add(source[begin:lt])
                begin = scan = self._declared(source, lt)
                continue
            if begin < lt:
                self._add(source[begin:lt])
            begin, (mark, name, attributes) = m.end(), m.groups()
            name = name.lower()
            if mark:
                self._close(name)
            elif name in NO_TEXT:
                begin = self._skip(name, source, begin)
            else:
                if name == "a":
                    after = NEXT_LINK.search(source, begin)
                    self._links = after is not None and after[1] == "/" and "href" in attributes.lower()
                self._open(name, attributes)
            scan = begin

    def _declared(self, source: str, lt: int) -> int:
        """Where a comment, declaration or instruction ends.  Marked sections are text."""
        if source.startswith("<!--", lt):
            end = COMMENT_END.search(source, lt + 2)
            return end.end() if end else len(source)
        if source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt + 9)
            end = len(source) if end < 0 else end
            self._add(source[lt + 9 : end].replace("&", "&amp;"))
            return min(len(source), end + 3)
        return source.find(">", lt) + 1

    def _skip(self, name: str, source: str, at: int) -> int:
        """Where an element without text ends.  A script or style that never ends takes the rest of the page; others that never end hide nothing."""
        if name in self._endless:
            return at
        depth, end = 1, -1
        if source.endswith("/>", 0, at) and name in ("svg", "math"):
            return at
        for m in ENDS[name].finditer(source, at):
            if m[1]:
                depth, end = depth - 1, m.end()
                if not depth or name in RAW:
                    break
            else:
                depth += 1
        if end < 0:
            self._endless.add(name)
            return len(source) if name in ("script", "style") else at
        past = source.find(">", end)
        return past + 1 if past >= 0 else len(source)

    def _add(self, text: str) -> None:
        if text:
            self.text.append((self._stack[-1], self._block, self._links, html.unescape(text) if "&" in text else text))

    def _cut(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._depths[self.tag[self._stack.pop()]].pop()
        while self._blocks and self._blocks[-1] >= depth:
            self._blocks.pop()

    def _open(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self._block += 1
            # A block ends an open paragraph, with what inline elements are open in it.
            if self._blocks and self.tag[self._stack[self._blocks[-1]]] == "p":
                self._cut(self._blocks[-1])
            if name in IMPLIED:
                ended, until = IMPLIED[name]
                floor = max((self._depths[t][-1] for t in until if self._depths[t]), default=0)
                low = min((d for t in ended for d in reversed(self._depths[t][-2:]) if d > floor), default=0)
                if low:
                    self._cut(low)
        if name in VOID:
            if name == "br":
                self.text.append((self._stack[-1], self._block, True, " "))
            return
        kind = kind_of(name, attributes)
        if not block and kind.plain and not self._depths[name]:
            return
        above = self._stack[-1]
        node = len(self.tag)
        self.parent.append(above)
        self.tag.append(name)
        if name == "header" and not kind.off and not any(self._depths[t] for t in ("article", "main")):
            kind = kind._replace(off=True)
        self.kind.append(kind)
        if name in CONTAINERS:
            self.box.append(node)
            self._path.append(self._steps.setdefault((self._path[above], kind.step), len(self._steps) + 1))
        else:
            self.box.append(self.box[above])
            self._path.append(self._path[above])
        self._depths[name].append(len(self._stack))
        if block:
            self._blocks.append(len(self._stack))
        self._stack.append(node)

    def _close(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self._block += 1
        elif name == "a":
            self._links = False
        open_ = self._depths[name]
        if not open_:
            return
        depth = open_[-1]
        if not block and self._blocks and self._blocks[-1] > depth:
            return
        if (self._td or self._th) and name not in CELLS and max(self._td[-1:] + self._th[-1:]) > depth:
            return  # what is open around a cell isn't closed in it
        self._cut(depth)

    # Boilerplate

    def _resolve(self, own: list[bool]) -> list[bool]:
        """Switched off with what is around."""
        off = [own[0]]
        for k in range(1, len(own)):
            off.append(own[k] or off[self.parent[k]])
        self._own = None
        return off

    def _heed_hints(self) -> None:
        """Switch off what hints name, but for what holds most of a page's text and every head of an article in it, and for all of a page's text.

        A hint that is only a part of a name counts for small elements without a heading of an article.
        """
        if not any(k.hint for k in self.kind):
            return
        n, hard = self.unlinked(), self.off
        total, heads = n[0], [int(k.anchor and n[i] > 0) for i, k in enumerate(self.kind)]
        if not total:
            return
        for i in range(len(heads) - 1, 0, -1):
            heads[self.parent[i]] += heads[i]
        most = [2 * x > total for x in n]
        named = [k.hint == 3 or (k.hint == 2 and not (most[i] and heads[i] == heads[0])) or (k.hint == 1 and 4 * n[i] <= total and not heads[i]) for i, k in enumerate(self.kind)]
        for wanted in (named, [x and not m for x, m in zip(named, most)]):
            self.off = self._resolve([a or b for a, b in zip(hard, wanted)])
            if self.unlinked()[0]:
                return
        self.off, self._own = hard, None

    def unlinked(self) -> list[int]:
        """Characters of text within each element that are no link and no boilerplate."""
        if self._own is None:
            own = [0] * len(self.tag)
            for node, _, linked, text in self.text:
                if not linked and not self.off[node]:
                    own[node] += len(text.strip())
            for k in range(len(own) - 1, 0, -1):
                own[self.parent[k]] += own[k]
            self._own = own
        return self._own

    # Paths

    def path(self, node: int) -> str:
        """Tags and classes of the containers from the page down; digits in them are 0."""
        out: list[str] = []
        while node > 0:
            if self.box[node] == node:
                out.append(self.kind[node].step)
            node = self.parent[node]
        return "".join(f">{s}" for s in reversed(out))

    def number(self, path: str) -> int | None:
        """The number of a path on this page; None if it has none such."""
        at: int | None = 0
        for step in path.split(">")[1:]:
            at = self._steps.get((at, step))
            if at is None:
                return None
        return at

    def within(self, number: int | None) -> list[bool]:
        """Which elements lie in elements of a path; all for the empty path."""
        inside = [number == 0]
        for k in range(1, len(self.tag)):
            inside.append(inside[self.parent[k]] or (self._path[k] == number and self.box[k] == k))
        return inside

    def held(self) -> dict[int, int]:
        """Unlinked text within the elements of each path, which never lie in one another."""
        n, out = self.unlinked(), defaultdict(int)
        out[0] = n[0]
        for k in range(1, len(n)):
            if self.box[k] == k:
                out[self._path[k]] += n[k]
        return out

    def scores(self) -> dict[int, float]:
        """Text that is no link, for the container that holds it and by half for the next one out; links count against both."""
        out: dict[int, float] = defaultdict(float)
        for node, _, linked, text in self.text:
            n = len(text.strip())
            if n and not self.off[node]:
                own = self.box[node]
                n = -n if linked else n
                out[own] += n
                if own > 0:
                    out[self.box[self.parent[own]]] += n / 2
        return out

    def best(self) -> tuple[int, float, int]:
        """An element on the path of the page's text, the score, and one on the path of the container that scores best in it.

        The text is the article or main element around that container; without one, the lowest container around it that holds all
        unlinked text of the page.  Without text: elements 0.
        """
        found = self.scores()
        if not found:
            return 0, 0.0, 0
        # Containers on one path are parts of one text.
        by_path: dict[int, float] = defaultdict(float)
        first: dict[int, int] = {}
        for node, score in found.items():
            path = self._path[node]
            by_path[path] += score
            if path not in first or score > found[first[path]]:
                first[path] = node
        path, score = max(by_path.items(), key=lambda x: (x[1], -first[x[0]]))
        core = node = first[path]
        outer = None
        while node > 0:
            if self.tag[node] == "article" or (self.kind[node].anchor and self.tag[node] != "h1" and self.box[node] == node and outer is None):
                outer = node
            node = self.parent[node]
        if outer is not None:
            return outer, score, outer
        held, node = self.held(), core
        while node and held[self._path[node]] < held[0]:
            node = self.box[self.parent[node]]
        return node, score, core

    def direct(self) -> dict[int, int]:
        """A hash of path and text for each container that has unlinked text of its own."""
        parts: dict[int, list[str]] = defaultdict(list)
        for node, _, linked, text in self.text:
            if not linked and not self.off[node]:
                parts[self.box[node]].append(text)
        out = {}
        for box, texts in parts.items():
            words = " ".join("".join(texts).split())
            if words:
                out[box] = xxhash.xxh64_intdigest(f"{self.path(box)}\0{words}") >> 1
        return out

    def extract(self, top: int, core: int, frame: frozenset[int] = frozenset()) -> str:
        """Blocks within the elements on the path of ``top``, without what is boilerplate there; all elements for 0.

        Elements outside those on the path of ``core`` that hold links only are left out, unless they are headings, and so are texts of ``frame``.
        """
        number, inner = self._path[top], self._path[core]
        inside = self.within(number)
        if inner != number:
            kept, n = self.within(inner), self.unlinked()
            for k in range(1, len(self.tag)):
                kept[k] = kept[k] or kept[self.parent[k]] or self.tag[k] in HEADINGS
            inside = [i and (kept[k] or n[k] > 0) for k, i in enumerate(inside)]
        if frame:
            texts = self.direct()
            gone = {box for box, h in texts.items() if h in frame}
            if any(inside[box] and box not in gone for box in texts):  # a page of the frame's texts only keeps them
                inside = [i and self.box[k] not in gone for k, i in enumerate(inside)]
        blocks: dict[int, list[str]] = defaultdict(list)
        for node, block, _, text in self.text:
            if inside[node] and not self.off[node]:
                blocks[block].append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in joined if x)


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or None) if url else None
    except ValueError:
        return None


VOTES = "host string, path string, score double, block long, page long, new int"


def _vote(batches):
    """A page's vote for its path, and a row for the text of each container: it may belong to the host's frame.

    ``block`` names a text with its path, ``page`` the page's own text, ``new`` is 1 for a page's first text on a path.
    """
    for batch in slices(batches):
        rows: list[tuple] = []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(url)
            if host is None:
                continue
            page = Page(source)
            top, score, core = page.best()
            if score <= 0:
                continue
            rows.append((host, page.path(top), score, None, None, 1))
            blocks = page.direct()
            own = blocks.get(core, 0)
            seen: set[int] = set()
            for box, h in blocks.items():
                rows.append((host, page.path(box), None, h, own, int(page._path[box] not in seen)))
                seen.add(page._path[box])
        cols = list(zip(*rows)) or [[]] * 6
        types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [x.split()[0] for x in VOTES.split(", ")])


def _host(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], [*batch.schema.names, "host"])


def extract_text(source: str, paths: list[str] | None = None, frame: list[int] | None = None) -> tuple[str, bool]:
    """The text by the first of the host's paths that holds all the page's own text has, else by the page's own best; and whether the host chose."""
    page = Page(source)
    top, _, core = page.best()
    own, held = page._path[top], page.held()
    for path in paths or []:
        number = page.number(path)
        if number is not None and (number == own or held.get(number, 0) >= held[own] > 0):
            node = top if number == own else page._path.index(number)
            return page.extract(node, core, frozenset(frame or ())), True
    return page.extract(top, core, frozenset(frame or ())), False


def text_of(source: str, paths: list[str] | None = None) -> str:
    return extract_text(source, paths)[0]


def _extract(batches):
    for batch in slices(batches):
        found = [extract_text(h, p, f) for h, p, f in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "frame")))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.bool_())], ["page_id", "url", "text", "by_host"])


def host_rules(src: DataFrame) -> DataFrame:
    """``voted, paths, frame`` of each host: the paths that won votes, best first, and the texts of its frame.

    All counts are pre-aggregated by host and path or text.  A text of the frame is one that at least FRAME_PAGES pages with different texts hold on
    the same path, and at least every second page that has the path.
    """
    votes = src.select("url", "html").mapInArrow(_vote, VOTES)
    told = Stage(votes.groupBy("host", "path", "block").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("score"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum("new").alias("pages")), "host-votes").df
    counted = told.where("block IS NULL")
    all_votes = counted.groupBy("host").agg(F.sum("n").alias("all"))
    fit = counted.join(all_votes, "host").where(F.col("n") >= MIN_SHARE * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("n"), -F.col("score"), F.col("path").alias("path"))))  # 1 / MIN_SHARE entries at most
    winners = fit.groupBy(F.col("host").alias("voted")).agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))
    blocks = told.where("block IS NOT NULL")
    on_path = blocks.groupBy("host", "path").agg(F.sum("pages").alias("pages"))
    frame = blocks.where((F.col("n") >= FRAME_PAGES) & (F.col("lo") != F.col("hi"))).drop("pages").join(on_path, ["host", "path"]).where(2 * F.col("n") >= F.col("pages"))
    frame = frame.groupBy(F.col("host").alias("voted")).agg(F.sort_array(F.collect_set("block")).alias("frame"))
    return winners.join(frame, "voted", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per input row: ``page_id, url, text, by_host``.

    Each page scores its containers by text that isn't linked and votes for its best one's generalised path (tags with classes, digits
    as 0), and names the texts beside it.  Both are counted by host, pre-aggregated, so a host with a third of all pages is a few rows a task.
    A host's paths with a tenth of its votes at least, and the texts that its pages repeat, go back to its pages: by broadcast if
    at most ``broadcast_hosts`` hosts voted, else by a join that splits hot hosts.  Every page is then read again and extracted by the first
    path that holds all of the page's own text, without the repeated texts; ``by_host`` tells whether a host's path did it.

    Null and empty html give an empty text.  Pages with a null or unreadable url choose for themselves.  Repeated rows are extracted alike.
    Ties in a vote go to the higher score, then to the path that sorts first.  Pages are read in time linear in their length, however deep or
    malformed.  An empty table gives no rows; other columns are ignored.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), blank_to_empty(F.col(html_col)).alias("html"))
    winners = Stage(host_rules(src), "host-paths").df
    small = winners.count() <= broadcast_hosts
    schema = T.StructType([*src.schema.fields, T.StructField("host", T.StringType())])
    joined = src.mapInArrow(_host, schema).join(F.broadcast(winners) if small else winners, F.col("host") == F.col("voted"), "left")
    out = T.StructType([src.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("by_host", T.BooleanType())])
    return joined.select("page_id", "url", "html", "paths", "frame").mapInArrow(_extract, out)


def op1_consensus_paths(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by_host")
