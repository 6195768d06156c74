"""Main text of web pages by consensus of each host's pages on a container path."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, split_join, written

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(>|\Z)", re.S)
_CLASS = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I | re.S)
_RAW = {"script", "style", "title", "textarea", "noembed", "noframes", "xmp", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose open end tag a following element implies.
_ENDS_P = set("address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_BOUND = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
#: Blocks that hold text of their parent and are no containers themselves.
_LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr tbody thead ul ol dl table hr summary center".split())
#: Fixed lists: elements that never hold main text, and words of class, id and role that speak against a container.
_DROP = set("nav footer aside button select option datalist script style noscript template iframe object svg canvas dialog menu head title fieldset audio video".split())
_DROP_WORDS = set(
    "nav navbar navigation menu menubar sidebar side footer ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist disqus replies reply respond reactions social share sharing related recommended breadcrumb breadcrumbs pagination pager widget toolbar skip masthead complementary contentinfo".split()
)
_HEADER_WORDS = {"header", "topbar"}
#: A compound name speaks against its container if it ends in such a word, or begins with one and goes on with words of
#: structure (share-buttons, not share-price); not if it tells a state (with-sidebar).
_STATES = set("with without has have no not non is show hide js".split())
_STRUCTURE = set(
    "box bar list lists item items link links block blocks area section container wrapper wrap inner outer content panel row col column button buttons btn icon icons title text body top bottom left right field slot unit image img header heading holder group set grid post posts news articles author count more primary secondary mobile desktop fixed sticky toggle message strip zone main".split()
)
#: What a container's score is multiplied by, for each container about it and itself that is marked weakly (a form, a
#: compound name) or by a whole word.
WEIGHTS = {1: 0.1, 2: 0.05}
#: Share of the page's own best text that the host's path must hold to be taken.
AGREE = 0.5


def mark_of(name: str, names: list[str], words: set[str]) -> int:
    """0, 1 (weak) or 2: what the names in class, id and role, split at white space, say against a container."""
    mark = 1 if name == "form" else 0
    for x in names:
        x = re.sub(r"\d+", "", x)
        if x in words:
            return 2
        parts = [y for y in re.split(r"[^a-z]+", x) if y]
        if len(parts) == 1 and parts[0] in words:
            return 2
        if len(parts) < 2 or _STATES & set(parts):
            continue
        if parts[-1] in words or (parts[0] in words and all(y in _STRUCTURE or y in words for y in parts[1:])):
            mark = 1
    return mark


class Page:
    """Containers and text blocks of a page, from one pass over its tokens.

    Time and memory grow in proportion to the source: a container's path is a
    hash made from its parent's, and places of open elements are kept by name,
    so neither deep nesting nor odd end tags are searched through.
    """

    def __init__(self, source: str | None):
        # of each container: its parent, element, mark (3: never text), path, step of the path, whether article or main stands above
        self.up, self.tags, self.marks, self.paths, self.steps, self.inside = [-1], [""], [0], [0], [""], [False]
        self.blocks: list[tuple[int, str]] = []
        self.worth: list[int] = []  # of each block, its length less twice that of its links
        self.titled: set[int] = set()  # containers with a heading of their own
        self._parse(source or "")
        self._weigh()
        self._lift()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # (element, its container), inline elements left out
        places: dict[str, list[int]] = defaultdict(list)  # of each element's name, where it stands on the stack
        text: list[str] = []
        linked, link_at = 0, -1  # letters in links of the block, and the stack's height where a link was opened
        end = len(source)

        def flush():
            nonlocal linked
            if text:
                got = " ".join("".join(text).split())
                if got:
                    at = stack[-1][1] if stack else 0
                    self.blocks.append((at, got))
                    self.worth.append(max(0, len(got) - 2 * linked))
                    if stack and stack[-1][0] in ("h1", "h2", "h3"):
                        self.titled.add(at)
                text.clear()
            linked = 0

        def close(k):
            nonlocal link_at
            flush()
            while len(stack) > k:
                places[stack.pop()[0]].pop()
            if link_at > k:
                link_at = -1

        at = 0
        while at < end:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if link_at >= 0:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                if name == "a":
                    link_at = -1
                elif name not in _INLINE:
                    if places[name]:
                        close(places[name][-1])
                    else:
                        flush()
                continue
            if name == "br":
                text.append(" ")
                continue
            if not m.group(4) and at == end and m.group(4) != ">":
                break
            if name in _INLINE:
                if name == "a":
                    link_at = len(stack)
                continue
            if name not in ("img", "input", "wbr", "link", "meta", "source", "track", "embed"):
                if name in _ENDS_P and stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in _SIBLING:
                    bound = max((places[b][-1] for b in _BOUND.get(name, {"dl", "table", "select", "ul", "ol"}) if places[b]), default=-1)
                    first = [places[s][k] for s in _SIBLING[name] if (k := bisect_right(places[s], bound)) < len(places[s])]
                    if first:
                        close(min(first))
                flush()
            if name in _VOID:
                continue
            if name in _RAW:
                close_at = _raw_end(name).search(source, at)
                at = close_at.end() if close_at else end
                continue
            parent = stack[-1][1] if stack else 0
            places[name].append(len(stack))
            stack.append((name, self._open(name, m.group(3), parent)))
        flush()

    def _open(self, name: str, attributes: str, parent: int) -> int:
        names: list[str] = []
        classes, hidden = "", False
        if attributes and not attributes.isspace():
            for a in _CLASS.finditer(attributes):
                key, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
                if key in ("class", "id", "role"):
                    names += value.split()
                    if key == "class":
                        classes = ".".join(sorted({re.sub(r"\d+", "#", x) for x in value.split()}))
                else:
                    hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
        mark = 0
        if hidden or name in _DROP:
            mark = 3
        elif name not in ("html", "body", "article", "main"):
            header = not self.inside[parent] and (name == "header" or mark_of("", names, _HEADER_WORDS))
            mark = 2 if header else mark_of(name, names, _DROP_WORDS)
        if name in _LEAF and not mark:
            return parent
        step = f"{name}{'.' if classes else ''}{classes}"
        path = int.from_bytes(hashlib.blake2b(f"{self.paths[parent]}/{step}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        for column, x in ((self.up, parent), (self.tags, name), (self.marks, mark), (self.paths, path), (self.steps, step), (self.inside, self.inside[parent] or name in ("article", "main"))):
            column.append(x)
        return len(self.up) - 1

    def _weigh(self) -> None:
        """Score the containers before anything but hidden text and elements of _DROP is left out: names only lower a score."""
        n = len(self.up)
        own, sure, weight = [0] * n, [False] * n, [1.0] * n
        for (at, _), worth in zip(self.blocks, self.worth):
            own[at] += worth
        for i in range(n):
            up = self.up[i]
            sure[i] = self.marks[i] == 3 or (up >= 0 and sure[up])
            weight[i] = (weight[up] if up >= 0 else 1.0) * WEIGHTS.get(self.marks[i], 1.0)
        score = [float(x) for x in own]
        for i in range(1, n):
            if not self.marks[i] and self.up[i] > 0:  # a marked container's text isn't text of the one about it
                score[self.up[i]] += own[i] / 2
        self.sure = sure
        self.score = [0.0 if sure[i] else score[i] * weight[i] * (1.5 if self.tags[i] in ("article", "main") else 1.0) for i in range(n)]

    def _lift(self) -> None:
        """lifted: of each container the one about it that is its article or main, or has a heading of its own beside it; else itself."""
        self.lifted = []
        for i, up in enumerate(self.up):
            stays = self.tags[i] == "article" or up <= 0 or self.marks[i] or self.tags[up] in ("html", "body") or not (self.tags[up] in ("article", "main") or up in self.titled)
            self.lifted.append(i if stays else self.lifted[up])

    def best(self) -> int:
        """The container of the highest score, the first of equal ones, lifted; -1 if none has text."""
        i = max(range(len(self.score)), key=lambda k: (self.score[k], -k))
        return self.lifted[i] if self.score[i] > 0 else -1

    def votes(self) -> list[tuple[int, float]]:
        """(container, share) of all containers with text; a share goes to the container that it is lifted to."""
        total = sum(self.score)
        return [(self.lifted[i], x / total) for i, x in enumerate(self.score) if x > 0]

    def tail(self, i: int) -> str:
        """The last steps of a container's path, to read."""
        steps = []
        while i > 0 and len(steps) < 4:
            steps.append(self.steps[i])
            i = self.up[i]
        return "/" + "/".join(reversed(steps))

    def under(self, path: int) -> list[str]:
        """The blocks, in page order, of the containers with this path, without marked containers below them."""
        inside: list[bool] = []
        for i, up in enumerate(self.up):
            inside.append((up >= 0 and inside[up] and not self.marks[i]) or (self.paths[i] == path and not self.sure[i]))
        return [t for at, t in self.blocks if inside[at]]

    def main_text(self, path: int | None) -> str:
        """The text under the host's path; of the page's own best container if that path is missing or holds
        less than AGREE of it."""
        own = self.best()
        if own < 0:
            return ""
        best = self.under(self.paths[own])
        voted = self.under(path) if path is not None and path != self.paths[own] else best
        blocks = voted if sum(map(len, voted)) >= AGREE * sum(map(len, best)) else best
        return "\n\n".join(blocks)


_raw_ends: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _raw_ends:
        _raw_ends[name] = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)
    return _raw_ends[name]


def host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path (a hash), tail (its last steps, to read): each page's containers vote by their share of its scores;
    the path with most votes wins, ties by the hash. Votes are summed by batch, by task, and then by host and path."""

    def task():
        def each(c):
            votes: Counter = Counter()
            tails: dict[int, str] = {}
            for h, source in zip(c["host"].to_pylist(), c["html"].to_pylist()):
                page = Page(source)
                for i, share in page.votes():
                    votes[h, page.paths[i]] += int(1_000_000 * share)
                    if page.paths[i] not in tails:
                        tails[page.paths[i]] = page.tail(i)
            return {"host": [h for h, _ in votes], "path": [p for _, p in votes], "tail": [tails[p] for _, p in votes], "votes": list(votes.values())}

        return each

    votes = map_rows(pages.select(host("url").alias("host"), "html"), ["host", "html"], "host string, path long, tail string, votes long", task)
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.min("tail").alias("tail"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "path", "tail")).alias("x")).select("host", "x.path", "x.tail")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text by its host's winning path.

    Null html is empty: empty text. A null or odd url is the host "". Rows that
    repeat come out each, an empty table gives no rows, other columns are
    ignored. Pages meet their host's path by split_join: those of hosts with
    more than one page in HOT by a broadcast of the fewer than HOT such hosts,
    the others by shuffle, whatever the number of hosts.
    """
    pages = pages.select("page_id", "url", "html")
    counts = pages.groupBy(host("url").alias("host")).agg(F.count("*").alias("pages"))
    winners = written(counts.join(host_paths(pages), "host", "left").select("host", "path", "pages"))
    total = winners.agg(F.sum("pages")).first()[0] or 0
    joined = split_join(pages.withColumn("host", host("url")), winners, ["host"], "pages", total)

    def task():
        def each(c):
            texts = [Page(h).main_text(p) for h, p in zip(c["html"].to_pylist(), c["path"].to_pylist())]
            return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    kind = dict(pages.dtypes)
    return map_rows(joined, ["page_id", "url", "html", "path"], f"page_id {kind['page_id']}, url string, text string, n_chars long", task)
