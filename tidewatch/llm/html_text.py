"""Main-text extraction (op7) by consensus host paths.

1. A page is parsed once into blocks, each under its chain of containers, and staged.  A
   container's generalised path is its chain of tag and class names with digits replaced;
   it scores the readable text of its blocks, and half goes to the one above.
2. Each page votes for its paths with their shares of the page, and with a digest of the
   text that stands in each.  Votes are summed by (host, path) in Spark: paths with at least
   MIN_SHARE of the host's votes (so never more than 2 / MIN_SHARE of them) and a fifth of
   the best one's win; paths with one and the same text on three or more pages, while
   that of the best one differs, are boilerplate.
3. The text is taken again around that of the host's winners which scores most on the page
   (a page without any takes its own best path): the whole main or article element around
   it, or else all containers reached while the one above holds more readable text.
   Boilerplate, other articles of the same main, and containers of links beside the
   path stay out; a first-level heading before the text stays in.

Left out by element: menus, asides, footers, headers outside an article, scripts, styles,
hidden elements.  Forms and the class or id words of NOISE leave out an element too, but
not one that holds the page's headline, its main element or an article, and, where
nothing else is readable, no longer the outermost of those elements.  An element of these
kinds without an end tag ends where the next section starts.

Defined cases: null or empty html -> empty text; markup without any text -> empty;
text without markup -> that text; a null url is a host of its own (''), so such
pages vote together; null page_id stays null; repeated rows vote and are returned each.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_bound, staged
from .graph import join_classes

READABLE, MIN_SHARE, SAME_PAGES = 25, 0.02, 3
QUOTED = r"\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])"
#: comments, declarations, and tags; of a tag with an unbalanced quote, what stands before the next bracket
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|{QUOTED})*+>|[^<>]*>)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "title"}
#: left out without a break of the block around them
INLINE_OUT = {"button", "select", "option", "svg", "canvas", "object", "embed", "audio", "video", "map", "datalist", "math"}
SECTION_OUT = {"head", "nav", "aside", "footer", "dialog", "menu"}
SOFT_OUT = {"form", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"html", "body", "main", "article", "section", "div", "td", "blockquote", "center", "header"}
BLOCK = CONTAINER | SECTION_OUT | SOFT_OUT | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "table", "thead", "tbody", "tfoot", "tr", "th", "caption", "figure", "figcaption", "hr", "address", "details", "summary", "hgroup", "legend"}
#: elements whose class or id words are heeded
WORDED = {"div", "section", "p", "ul", "ol", "dl", "li", "table", "figure", "td", "center", "details", "address", "header"}
STARTS_SECTION = {"body", "main", "article", "section", "div", "nav", "aside", "header", "footer", "form", "h1"}
MAY_LACK_END = re.compile(r"<(/?)(head|nav|aside|footer|dialog|menu|form|fieldset|header)(?=[\s/>])", re.I)
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "td": {"td", "tr", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
#: fixed words of class and id names
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "promo", "promos", "promotion", "promotions", "banner", "banners",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "popup", "popups", "modal", "modals", "overlay", "newsletter", "newsletters", "subscribe", "subscription",
    "sidebar", "sidebars", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "footer", "footers", "pagefooter", "masthead", "topbar", "toolbar",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "teaser", "teasers", "recommended", "recommendations", "share", "sharing", "social",
    "widget", "widgets", "pagination", "pager", "login", "signup", "search", "skip", "copyright",
}
WHOLE_NAMES = {"side", "side-bar"}
#: with such a first or last part a class tells a state or a topic, not what the element is
STATE_FIRST = {"has", "with", "no", "is", "without", "not", "category", "cat", "tag", "topic", "format", "type", "status", "term"}
STATE_LAST = {"open", "closed", "enabled", "disabled", "on", "off", "free", "layout"}
COMMENT_NAMES = {"comment", "comments", "comment-body", "reply", "commentlist", "comment-list"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
SPACE = re.compile(r"\s+")


class Element:
    """An open container, or an element that is left out."""

    __slots__ = ("parent", "tag", "path", "out", "soft", "talk", "whole", "article", "brief")

    def __init__(self, parent: Element | None, tag: str, name: str, out: bool, soft: bool, talk: bool, brief: bool):
        self.parent, self.tag, self.out, self.soft, self.talk, self.brief = parent, tag, out, soft, talk, brief
        self.path = parent.path + "/" + name if parent is not None and (tag in CONTAINER) else parent.path if parent is not None else ""
        self.whole = self.article = False  # holds the headline or main element; holds an article

    def level(self) -> int:
        """Softly left-out elements around and including this one."""
        n, e = 0, self
        while e is not None:
            n += e.soft and not e.whole and (e.talk or not e.article)
            e = e.parent
        return n


def noisy_name(value: str) -> bool:
    for token in value.lower().split():
        parts = [re.sub(r"\d+$", "", p) for p in re.split(r"[_-]+", token) if p]
        if token in WHOLE_NAMES or (parts and not NOISE.isdisjoint(parts) and parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST):
            return True
    return False


def _judge(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """(hidden or of a left-out role, softly left out, by comment words, generalised name)."""
    out, soft, talk, name = False, tag in SOFT_OUT, False, tag
    if len(attributes) > 1:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (key == "role" and value.lower() in ROLES_OUT):
                out = True
            elif key in {"class", "id"}:
                said = not COMMENT_NAMES.isdisjoint(value.lower().split())
                if (tag in WORDED and noisy_name(value)) or (tag == "article" and said):
                    soft = True
                    talk |= said
                if key == "class" and value:
                    name = tag + "." + ".".join(sorted(re.sub(r"\d+", "#", c) for c in value.split()))
    return out, soft, talk, name


def _without_end(page: str) -> set[int]:
    """Places of those start tags that have no end tag of their own."""
    open_: dict[str, list[int]] = {}
    for m in MAY_LACK_END.finditer(page):
        at = open_.setdefault(m[2].lower(), [])
        if not m[1]:
            at.append(m.start())
        elif at:
            at.pop()
    return {i for at in open_.values() for i in at}


def every_block(page: str) -> list[tuple[Element, str, int, bool]]:
    """(element, text, characters inside links, first-level heading) of every block not left out by its element, in page order."""
    top = here = Element(None, "", "", False, False, False, False)
    names, buffer, found = [""], [], []
    skip = linked = in_link = inside = heading = quotes = 0
    lacking = _without_end(page)
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                found.append((here, text, linked, heading > 0))
        linked = 0

    def leave() -> None:
        nonlocal here, skip, inside, quotes
        skip -= here.out
        inside -= here.tag in {"main", "article"}
        quotes -= here.tag == "blockquote"
        names.pop()
        here = here.parent

    while at < n:
        m = MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at and not skip:
            buffer.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag == "h1":
                flush()
                heading = 0
            if tag in names:
                if tag in BLOCK:
                    flush()
                while names[-1] != tag:
                    leave()
                leave()
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "br" and not skip:
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag in BLOCK:
            flush()
            while here is not top and (tag in CLOSED_BY.get(names[-1], ()) or (here.brief and tag in STARTS_SECTION)):
                leave()
            if tag in {"h1", "main", "article"} and not skip:
                heading = tag == "h1"
                e = here
                while e is not None and not (e.whole if tag != "article" else e.article):
                    if tag == "article":
                        e.article = True
                    else:
                        e.whole = True
                    e = e.parent
        out, soft, talk, name = _judge(tag, m[3])
        out = out or tag in INLINE_OUT or (tag in SECTION_OUT and not (tag == "footer" and quotes)) or (tag == "header" and not inside)
        if out or soft or tag in CONTAINER:
            here = Element(here, tag, name, out, soft, talk, m.start() in lacking)
            names.append(tag)
            skip += out
            inside += tag in {"main", "article"}
            quotes += tag == "blockquote"
    if not skip:
        flush()
    return found


def readable(block: tuple) -> bool:
    return len(block[1]) >= READABLE and 2 * block[2] < len(block[1])


def page_blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """(path, text, characters inside links, first-level heading) of the blocks that are kept of a page."""
    found = every_block(page)
    level: dict[int, int] = {}
    for e, *_ in found:
        if id(e) not in level:
            level[id(e)] = e.level()
    for most in sorted(set(level.values())):
        kept = [(e.path, text, linked, head) for e, text, linked, head in found if level[id(e)] <= most]
        if any(readable(b) or any(x.split(".")[0] in {"article", "main"} for x in b[0].split("/")) for b in kept):
            return kept
    return [(e.path, text, linked, head) for e, text, linked, head in found]


def container_scores(found: list[tuple]) -> dict[str, float]:
    """Readable characters by container path; half of a container's own goes to the one above it."""
    own: dict[str, float] = {}
    for path, text, linked, _ in found:
        weight = len(text) * max(0.0, 1 - 2 * linked / max(1, len(text)))
        if len(text) < READABLE:
            weight *= 0.2
        share = 1.0
        while True:
            own[path] = own.get(path, 0.0) + weight * share
            if not path:
                break
            path, share = path.rpartition("/")[0], share * 0.5
    return own


def best_paths(found: list[tuple]) -> list[tuple[str, float]]:
    scores = container_scores(found)
    total = sum(len(b[1]) for b in found)
    return sorted(((p, s / total) for p, s in scores.items() if s > 0), key=lambda x: (-x[1], -len(x[0]), x[0])) if total else []


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _is_page(path: str) -> bool:
    return path.rpartition("/")[2].split(".")[0] in {"", "html", "body"}


def _first(names: list[str], tag: str, after: int = 0) -> int:
    return next((i for i in range(after, len(names)) if names[i].split(".")[0] == tag), -1)


def _link_paths(found: list[tuple]) -> set[str]:
    """Containers at least half of whose own text is links."""
    size: dict[str, list[int]] = {}
    for path, text, linked, _ in found:
        s = size.setdefault(path, [0, 0])
        s[0] += len(text)
        s[1] += linked
    return {p for p, (n, l) in size.items() if 2 * l >= n}


def around(found: list[tuple], path: str) -> list[tuple]:
    """The blocks of the whole text that a path belongs to."""
    names = path.split("/")
    links = _link_paths(found)
    at = _first(names, "main")
    if at >= 0:
        top = "/".join(names[: at + 1])
        own = _first(names, "article", at)
        article = "/".join(names[: own + 1]) if own >= 0 else None
        others: set[str] = set()  # containers of other articles, below the main element and apart from the text's own article
        for p in {b[0] for b in found} if article else ():
            parts = p.split("/")
            i = _first(parts, "article", at)
            if i >= 0 and _under(p, top) and "/".join(parts[: i + 1]) != article:
                others |= {c for c in ("/".join(parts[:k]) for k in range(at + 2, i + 2)) if not _under(article, c)}

        def kept(b: tuple) -> bool:
            if not _under(b[0], top) or (b[0] in links and not _under(b[0], article or path)):
                return False
            return not others or _under(b[0], article) or not any(_under(b[0], c) if c.rpartition("/")[2].split(".")[0] == "article" else b[0] == c for c in others)
    else:
        at = _first(names, "article")
        if at >= 0:
            top = "/".join(names[: at + 1])

            def kept(b: tuple) -> bool:
                return _under(b[0], top)
        else:
            top = path
            while top:
                above = top.rpartition("/")[0]
                more = [b for b in found if _under(b[0], above) and not _under(b[0], top) and b[0] not in links]
                if not any(map(readable, more)):
                    break
                top = above
            if _is_page(top):
                # of the page itself, only containers with something readable
                child = lambda p: p if p == top else top + "/" + p[len(top) + 1 :].split("/")[0]
                good = {child(b[0]) for b in found if _under(b[0], top) and b[0] not in links and readable(b)}

                def kept(b: tuple) -> bool:
                    return _under(b[0], path) or (_under(b[0], top) and b[0] not in links and child(b[0]) in good)
            else:

                def kept(b: tuple) -> bool:
                    return _under(b[0], path) or (_under(b[0], top) and b[0] not in links)
    chosen = [kept(b) for b in found]
    first = chosen.index(True) if True in chosen else 0
    return [b for i, b in enumerate(found) if chosen[i] or (i < first and b[3])]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(found: list[tuple], winners: set[int] = frozenset(), same: set[int] = frozenset()) -> str:
    """The text of a page's blocks, given digests of its host's winning and boilerplate paths."""
    if same:
        own = [b for b in found if digest(b[0]) not in same]
        if any(map(readable, own)):
            found = own
    scores = best_paths(found)
    path = next((p for p, _ in scores if digest(p) in winners), scores[0][0] if scores else None)
    return "\n".join(b[1] for b in (found if path is None else around(found, path)))


_VOTES = pa.list_(pa.struct([("path", pa.int64()), ("share", pa.float64()), ("body", pa.int64())]))
PARSED = "page_id long, url string, host string, votes array<struct<path:long,share:double,body:long>>, paths array<string>, place array<int>, linked array<int>, head array<int>, lines string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for page in batch.column("html"):
            page = page.as_py()
            found = page_blocks(page) if page else []
            own: dict[str, list[str]] = {}
            for b in found:
                own.setdefault(b[0], []).append(b[1])
            paths = list(own)
            number = {p: i for i, p in enumerate(paths)}
            votes = [{"path": digest(p), "share": s, "body": digest("\n".join(own[p])) if p in own else None} for p, s in best_paths(found)]
            for column, value in zip(out, (votes, paths, [number[b[0]] for b in found], [b[2] for b in found], [i for i, b in enumerate(found) if b[3]], "\n".join(b[1] for b in found))):
                column.append(value)
        kinds = (_VOTES, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *(pa.array(c, k) for c, k in zip(out, kinds))], ["page_id", "url", "host", "votes", "paths", "place", "linked", "head", "lines"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for paths, place, linked, head, lines, winners, same in zip(*(batch.column(c).to_pylist() for c in ("paths", "place", "linked", "head", "lines", "winners", "same"))):
            heads = set(head)
            found = [(paths[p], t, k, i in heads) for i, (p, t, k) in enumerate(zip(place, lines.split("\n"), linked))] if place else []
            text.append(main_text(found, set(winners or ()), set(same or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(parsed: DataFrame) -> DataFrame:
    """(host, copies, winners, same): pages, winning paths and boilerplate paths of each host, as digests."""
    votes = parsed.select("host", F.explode("votes").alias("v")).select("host", "v.*")
    by_path = votes.groupBy("host", "path").agg(F.sum("share").alias("score"), F.count("*").alias("n"), F.count("body").alias("bodies"), F.min("body").alias("low"), F.max("body").alias("high"))
    by_path = by_path.withColumn("score", F.round("score", 6))
    pages = parsed.groupBy("host").agg(F.count("*").alias("copies"))
    best = by_path.groupBy("host").agg(F.sum("score").alias("total"), F.max("score").alias("top"), F.max(F.when(F.col("bodies") > 0, F.struct("score", (F.col("low") != F.col("high")).alias("differs"), "path"))).alias("b"))
    judged = by_path.join(best, "host").join(pages, "host")
    wins = (F.col("score") >= 0.2 * F.col("top")) & (F.col("score") >= MIN_SHARE * F.col("total"))
    same = F.col("b.differs") & (F.col("bodies") >= SAME_PAGES) & (F.col("bodies") >= MIN_SHARE * F.col("copies")) & (F.col("low") == F.col("high"))
    # both lists are bounded by MIN_SHARE, the first by 2 / MIN_SHARE paths
    kept = judged.where(wins | same).groupBy("host").agg(F.collect_list(F.when(wins & ~same, F.col("path"))).alias("winners"), F.collect_list(F.when(same, F.col("path"))).alias("same"))
    return pages.join(kept, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    byte_bound(pages.sparkSession)
    parsed = staged(rows.mapInArrow(_parse, PARSED), "pages")
    hosts = staged(host_paths(parsed), "hosts")
    # the hosts of more than a thousandth of the pages are broadcast, so a hot one is in no task alone
    chosen = join_classes(parsed.drop("votes"), hosts, key="host")
    return chosen.mapInArrow(_choose, "page_id long, url string, text string, n_chars long")
