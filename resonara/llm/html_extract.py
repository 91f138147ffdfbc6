"""Main text of web pages.

Pages are read into blocks: runs of text between block-level tags, each with
the region it stands in.  Where a page marks its article (``article``,
``main`` or the like), the blocks inside it are candidates, without the
navigation, forms, notices, adverts and comments inside; where it doesn't, the
blocks that markup leaves open are.  Then, on all pages, the text repeated
between pages of the host decides: token streams of its pages are concatenated,
a suffix array over them finds runs of at least MIN_REPEAT tokens that occur on
several pages, and candidates that such runs cover by more than half go.
Others stay whole, so that a phrase that another page happens to have doesn't
vanish from a sentence.  Marked and open pages of a host are compared apart.
Among open pages a repeat stands on two at least and on HOST_SHARE of the
host's.  Articles quote the same lines (see README for figures), so inside
marked ones a repeat has to stand on more than MARKED_SHARE of the host's
pages, and on MARKED_PAGES that aren't near copies: a notice or a line of links
that the site puts into its articles.

Pages that are copies or near copies of each other (see ``near_dedup``) are one
page here, so an article doesn't vanish because another page has it too.  A
page of which nothing would be left keeps its blocks: all it says stands
elsewhere, so repeats can't tell its article from the rest.  A form is left
out, but one that holds the article, or most of an unmarked page's text, is the
page.

Hosts are cut into groups of about HOST_PAGES pages by hash of the page, so
that no suffix array grows with the corpus.  A run of MIN_REPEAT tokens (a
window) that stands on a share of a host's pages stands on that share of one
group's at least; windows that do in some group are counted again over the
whole host, so none is missed and none goes in error.  Near copies are looked
for among open pages, and among marked pages that hold such a window.

Defined results: null or empty html gives empty text; unclosed and misplaced
tags end where the enclosing block does; undecodable references stay; pages
with a null url share a host; repeated pages are read one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.llm import near_dedup
from resonara.llm.common import VOCABULARY_ROWS, checkpointed, small_batches, utf8, window_hashes

MIN_REPEAT = 5
HOST_PAGES = 256
#: Share of a host's open pages, copies counted once, on which a repeat has to stand.
HOST_SHARE = 0.02
#: Pages that aren't near copies, and share of the host's pages to be exceeded, on which a repeat inside marked articles has to stand.
MARKED_PAGES, MARKED_SHARE = 20, 0.5

# HTML elements by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("aside button canvas dialog footer head iframe input label menu nav noscript object option script search select style svg template textarea title".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block element of the first kind ends.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
#: Words of class, id or role that mark what isn't main text, wherever it stands.
UNWANTED = frozenset(
    "ad ads adbox adsense advert advertisement advertorial alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "contentinfo cookie cookies consent disqus footer form header menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion related respond search share sharing sidebar sidenav skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words among them that also name ordinary content: they count only where the rest of the name says where or how it stands.
AMBIGUOUS = frozenset("banner form menu notice notices pager related respond search share sharing skip social widget".split())
PLACING = frozenset("area bar bottom box button buttons block blocks bubble col column float group icon icons inner item items left line link links list main media nav outer panel post posts right row section sidebar site sticky strip text top unit widget".split()) | UNWANTED
#: Marks that are part of an article when they stand inside one.
TITLING = frozenset(["header", "banner"])
#: Words of a name that say it lays out a page rather than being the thing.
LAYOUT = frozenset("wrap wrapper container with has no layout page main content article".split())
ARTICLE = frozenset(["article", "main"])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")
_GAPS = re.compile(r"\s+")

OPEN_REGION, ARTICLE_REGION, FORM_REGION = 0, 1, 2


def _marks(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether attributes mark what isn't main text; whether they mark main text."""
    unwanted = main = False
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.lower()
            if name == "hidden" or name == "aria-hidden" and "true" in value:
                unwanted = True
            elif name in ("class", "id", "role"):
                for one in value.strip("\"'").split():
                    words = set(_NAME.findall(one))
                    bad = words & UNWANTED - (TITLING if inside else frozenset())
                    if bad <= AMBIGUOUS and not words <= PLACING:
                        bad = frozenset()
                    unwanted = unwanted or bool(bad) and (not words & LAYOUT or "comments" in words or "comment" in words)
                    main = main or name == "role" and bool(words & ARTICLE)
            elif name == "itemprop":
                main = main or "articlebody" in value
    return unwanted, main


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block of a page that may be main text, in order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    # An open element: name, whether its content is skipped, the region of its content.
    open_: list[tuple[str, bool, int]] = []
    skip, region = False, OPEN_REGION

    def flush() -> None:
        if held:
            text = _GAPS.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((region, text))
            held.clear()

    def close(n: int) -> None:
        nonlocal skip, region
        del open_[n:]
        skip, region = (open_[-1][1], open_[-1][2]) if open_ else (False, OPEN_REGION)

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if not skip:
            held.append(page[at : tag.start() if tag else size])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if tag[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if any(x[0] in BLOCKS for x in open_[k:]):
                        flush()
                    close(k)
                    break
                if name not in BLOCKS and open_[k][0] in BLOCKS:
                    break  # an inline end tag doesn't end a block
            else:
                if block:
                    flush()
            continue
        if name == "br":
            if not skip:
                held.append(" ")
            continue
        if block:
            flush()
            for k in range(len(open_) - 1, -1, -1):
                if name in ENDED_BY.get(open_[k][0], ()):
                    close(k)
                    break
                if open_[k][0] in BLOCKS and open_[k][0] not in ENDED_BY:
                    break
        if name in VOID:
            continue
        unwanted, main = _marks(tag[3], region == ARTICLE_REGION)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = end.end() if end else size
            if end and page[at - 1] != ">":
                at = page.find(">", at) + 1 or size
            continue
        if block or name in SKIPPED or unwanted or main:
            flush_first = name in SKIPPED or unwanted
            if flush_first and not block:
                flush()
            inside = region == ARTICLE_REGION or name in ARTICLE or main
            hidden = skip or name in SKIPPED or (unwanted and name not in ("html", "body") and not (name == "form" and not inside)) or (name == "form" and inside) or (name == "header" and not inside)
            where = ARTICLE_REGION if inside else FORM_REGION if name == "form" else region
            open_.append((name, hidden, where))
            skip, region = hidden, where
        elif not tag[3].endswith("/"):
            open_.append((name, skip, region))
    flush()
    return out


def host_of(url: str | None) -> str:
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def suffix_array(stream: np.ndarray, most: int | None = None) -> np.ndarray:
    """Starts of the suffixes of an integer stream in order, by doubling of ranked prefixes; in order of their first ``most`` tokens at least."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < (n if most is None else min(n, most)) and len(rank) and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        step *= 2
    return order


def common_prefixes(stream: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of what each suffix shares with the one before it in order."""
    n = len(stream)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    padded = np.r_[stream, -np.arange(1, most + 1)]
    same = np.ones(n - 1, bool)
    for k in range(most):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        same &= (order[1:] + k < n) & (order[:-1] + k < n)
        shared[1:] += same
        if not same.any():
            break
    return shared


def _repeats(pages: list[list[int]], least: int, like: list[int] | None, least_pages: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Streams of the distinct pages as one, where in it runs of ``least`` tokens of enough pages begin, the ends of its pages, and each page's number in it."""
    distinct: dict[tuple, int] = {}
    marks, numbers = [], []
    for k, p in enumerate(pages):
        if distinct.setdefault(tuple(p), len(distinct)) == len(marks):
            marks.append(len(marks) if like is None else like[k])
        numbers.append(distinct[tuple(p)])
    # A separator of its own ends each page, so that no run crosses pages.
    parts = [np.array([*p, 0], np.int64) for p in distinct]
    for k, p in enumerate(parts):
        p[-1] = -1 - k
    stream = np.concatenate(parts) if parts else np.empty(0, np.int64)
    page = np.repeat(np.unique(marks, return_inverse=True)[1].astype(np.int64), [len(p) for p in parts])
    order = suffix_array(stream, least)
    shared = common_prefixes(stream, order, least)
    # Neighbours in order that share a long enough prefix form a group; it counts if it has suffixes of enough pages.
    group = np.cumsum(shared < least)
    starts = order
    if len(order):
        pairs = np.unique(group * np.int64(len(parts)) + page[order]) // len(parts)
        starts = order[(np.bincount(pairs, minlength=group[-1] + 1) >= least_pages)[group]]
    return stream, starts, np.cumsum([len(p) for p in parts]).tolist(), numbers


def repeated(pages: list[list[int]], least: int = MIN_REPEAT, like: list[int] | None = None, least_pages: int = 2) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of at least ``least`` tokens, each ``least`` of which stand on ``least_pages`` pages.

    Equal pages, and pages with an equal number in ``like``, are one.
    """
    stream, starts, ends, numbers = _repeats(pages, least, like, least_pages)
    covered = np.zeros(len(stream) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + least, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return [inside[ends[k] - len(p) - 1 : ends[k] - 1] for k, p in zip(numbers, pages, strict=True)]


def repeated_windows(pages: list[list[int]], least: int = MIN_REPEAT, like: list[int] | None = None, least_pages: int = 2) -> np.ndarray:
    """Hashes of the runs of ``least`` tokens that stand on ``least_pages`` of the pages, counted as in ``repeated``."""
    stream, starts, ends, _ = _repeats(pages, least, like, least_pages)
    whole = np.ones(len(stream) + 1, bool)
    for end in ends:  # a run that holds a page's separator is of one page alone
        whole[max(0, end - least) : end] = False
    if len(stream) < least:
        return np.empty(0, np.int64)
    return np.unique(windows_of(stream, least)[starts[whole[starts]]])


def stream_of(page: list[str]) -> list[int]:
    """Hashes of the tokens of a page's blocks."""
    return [xxhash.xxh3_64_intdigest(w) >> 1 for b in page for w in b.split()]


def digest_of(stream: list[int]) -> int:
    """A digest of a page's tokens that Spark can hold as a long."""
    return xxhash.xxh3_64_intdigest(np.array(stream, np.int64).tobytes()) - (1 << 63)


def windows_of(stream: list[int] | np.ndarray, least: int) -> np.ndarray:
    """A hash, as a long, of the ``least`` tokens that begin at each place."""
    return window_hashes(np.array(stream, np.int64).view(np.uint64), least).view(np.int64)


def _without(blocks: list[list[str]], inside: np.ndarray) -> list[str]:
    """The blocks but those of whose tokens more than half are ``inside``; all of them if none would stay."""
    at, kept = 0, []
    for b in blocks:
        hits = int(inside[at : at + len(b)].sum())
        at += len(b)
        if 2 * hits <= len(b) and b:
            kept.append(" ".join(b))
    return kept or [" ".join(b) for b in blocks]


def without_repeats(pages: list[list[str]], least: int = MIN_REPEAT, like: list[int] | None = None, least_pages: int = 2) -> list[list[str]]:
    """The blocks of each page but those of whose tokens more than half lie in repeated runs; all of them if none would stay.

    ``like`` numbers the pages, near copies alike.
    """
    found = repeated([stream_of(page) for page in pages], least, like, least_pages)
    return [_without([b.split() for b in page], inside) for page, inside in zip(pages, found, strict=True)]


def without_windows(text: str, windows: np.ndarray, least: int = MIN_REPEAT) -> str:
    """A page's text without the blocks of whose tokens more than half lie in ``windows``."""
    page = text.split("\n\n")
    stream = stream_of(page)
    hits = np.flatnonzero(np.isin(windows_of(stream, least), windows))
    if not len(hits):
        return text
    inside = np.zeros(len(stream), bool)
    for k in range(least):
        inside[hits + k] = True
    return "\n\n".join(_without([b.split() for b in page], inside))


def candidates(page: str) -> tuple[bool, list[str]]:
    """Whether a page marks its article, and the blocks that markup leaves to choose from: the article's, or the open ones."""
    found = blocks(page)
    by_region = {k: [t for region, t in found if region == k] for k in (OPEN_REGION, ARTICLE_REGION, FORM_REGION)}
    if by_region[ARTICLE_REGION]:
        return True, by_region[ARTICLE_REGION]
    size = {k: sum(len(t.split()) for t in texts) for k, texts in by_region.items()}
    return False, [t for _, t in found] if size[FORM_REGION] > size[OPEN_REGION] else by_region[OPEN_REGION]


def read_page(page: str) -> tuple[str | None, list[str]]:
    """One page without its host: the candidates of a page that marks its article as text, else None; and the open blocks if it doesn't."""
    marked, left = candidates(page)
    if marked:
        return "\n\n".join(left), []
    return (None, left) if left else ("", [])


def _met(rows: DataFrame, listed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows``, which hold texts, joined with ``listed``, which is sent to them unless it is long."""
    listed = checkpointed(listed)
    return rows.join(F.broadcast(listed) if listed.count() <= near_dedup.BROADCAST_ROWS else listed, keys, how)


def _groups(rows: DataFrame, least: int, wanted) -> DataFrame:
    """host, groups, pages (distinct ones of a group) and windows of each group (host, part) of ``rows``.

    Windows are those that stand on ``wanted(pages, first row)`` of the group's pages at least; ``like`` numbers these.
    """

    def by_group(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        like = group["like"].to_pylist()
        number = len(set(like))
        own = repeated_windows([stream_of([t]) for t in group["text"].to_pylist()], least, like, max(1, wanted(number, first)))
        return pa.table({"host": pa.array([first["host"]], pa.string()), "groups": pa.array([first["groups"]], pa.int64()), "pages": pa.array([number], pa.int64()), "windows": pa.array([own], pa.list_(pa.int64()))})

    return rows.groupBy("host", "part").applyInArrow(by_group, "host string, groups long, pages long, windows array<long>")


def _holders(rows: DataFrame, of_host: DataFrame, least: int) -> DataFrame:
    """``rows`` (host, page, text) that hold windows of their host's (host, windows), with those that they hold."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text, windows in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                mine = np.unique(windows_of(stream_of([text]), least))
                own.append(mine[np.isin(mine, windows.values.to_numpy())])
            cells = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.int64()))], ["host", "page", "text", "windows"])
            yield cells.filter(pa.array([len(x) > 0 for x in own], pa.bool_()))

    met = _met(rows.select("host", "page", "text"), of_host, ["host"]).select("host", "page", "text", "windows")
    return met.mapInArrow(held, "host string, page long, text string, windows array<long>")


def _likes(texts: DataFrame) -> DataFrame:
    """page and like, the lowest of its near copies, of the pages (page, text) that aren't that themselves."""
    return near_dedup.cluster(texts, "page", "text").select("page", F.col("component_id").alias("like")).filter("page <> like").distinct()


def _open_windows(left: DataFrame, least: int, host_pages: int, host_share: float) -> DataFrame:
    """host and window of the repeats of open pages (id, host, page, text)."""
    copies = checkpointed(_likes(left.select("page", "text")))
    placed = _met(left, copies, ["page"], "left").withColumn("like", F.coalesce("like", "page"))
    n_pages = F.count_distinct("like")
    least_pages = F.greatest(F.lit(2), F.ceil(n_pages * host_share)).cast("int")
    sizes = checkpointed(placed.groupBy("host").agg(F.ceil(F.count("*") / host_pages).alias("groups"), n_pages.alias("n_pages"), least_pages.alias("least_pages")).filter("n_pages >= least_pages").drop("n_pages"))
    # Near copies may lie in several groups, so of T pages one group needs T divided by the number of groups.
    grouped = _met(placed, sizes, ["host"]).withColumn("part", F.pmod(F.xxhash64("id", "text"), F.col("groups")))
    near = checkpointed(_groups(grouped.select("host", "part", "groups", "least_pages", "like", "text"), least, lambda _, first: -(-first["least_pages"] // first["groups"])))
    several = near.filter("groups > 1").select("host", F.explode("windows").alias("window")).distinct().groupBy("host").agg(F.collect_list("window").alias("windows"))
    of_page = _met(_holders(left, several, least).select("host", "page", F.explode("windows").alias("window")), copies, ["page"], "left")
    counted = of_page.select("host", "window", F.coalesce("like", "page").alias("like")).distinct().groupBy("host", "window").agg(F.count("*").alias("n_pages"))
    enough = _met(counted, sizes, ["host"]).filter("n_pages >= least_pages").select("host", "window")
    return near.filter("groups = 1").select("host", F.explode("windows").alias("window")).union(enough)


def _marked_windows(left: DataFrame, hosts: DataFrame, least: int, host_pages: int, marked_pages: int, marked_share: float) -> DataFrame:
    """host and window of the repeats inside the articles of marked pages (id, host, page, text); ``hosts`` has the host of every page."""
    sizes = hosts.groupBy("host").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= marked_pages)
    sizes = sizes.select("host", F.ceil(F.col("n_rows") / host_pages).alias("groups"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(key not in seen)
                if len(seen) >= VOCABULARY_ROWS:
                    seen.clear()
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    # Equal pages share a group, so that the groups' numbers add up; a task sends each but once.
    distinct = left.select("host", "page", "text").mapInArrow(once, "host string, page long, text string")
    grouped = _met(distinct, sizes, ["host"]).select("host", F.pmod(F.xxhash64("page"), F.col("groups")).alias("part"), "groups", F.col("page").alias("like"), "text")
    near = checkpointed(_groups(grouped, least, lambda pages, _: int(pages * marked_share) + 1))
    totals = near.groupBy("host").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= marked_pages)
    some = checkpointed(near.select("host", F.explode("windows").alias("window")).distinct().join(totals.select("host"), "host").groupBy("host").agg(F.collect_list("window").alias("windows")))
    none = some.select("host", F.explode("windows").alias("window"))
    if some.isEmpty():
        return none
    holders = checkpointed(_holders(left, some, least))
    of_page = holders.select("host", "page", F.explode("windows").alias("window")).distinct()
    enough = of_page.groupBy("host", "window").agg(F.count("*").alias("n_pages")).join(totals, "host").filter(F.col("n_pages") > F.floor(F.col("pages") * marked_share))
    enough = checkpointed(enough.filter(F.col("n_pages") >= marked_pages).select("host", "window"))
    if enough.isEmpty():
        return none.filter(F.lit(False))
    likes = _met(of_page.join(enough, ["host", "window"], "left_semi"), _likes(holders.select("page", "text")), ["page"], "left")
    classes = likes.groupBy("host", "window").agg(F.count_distinct(F.coalesce("like", "page")).alias("n_pages"))
    return classes.filter(F.col("n_pages") >= marked_pages).select("host", "window")


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html", least: int = MIN_REPEAT, host_pages: int = HOST_PAGES, host_share: float = HOST_SHARE, marked_pages: int = MARKED_PAGES, marked_share: float = MARKED_SHARE) -> DataFrame:
    """id, url and main text of every page."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = [pages.schema[k].dataType.simpleString() for k in range(2)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(b.decode("utf-8", "replace")) for b in utf8(batch.column(2))]
            digests = [xxhash.xxh3_64_intdigest(" ".join(left)) - (1 << 63) for _, left in rows]
            cells = [pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array([m for m, _ in rows], pa.bool_()), pa.array(["\n\n".join(left) for _, left in rows], pa.string()), pa.array(digests, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["id", "url", "host", "marked", "text", "page"])

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host_of(u) for u in batch.column(0).to_pylist()], pa.string())], ["host"])

    # Marked pages are read again, which costs less than storing all texts; open ones, needed several times, are stored.
    found = pages.mapInArrow(read, f"id {kinds[0]}, url {kinds[1]}, host string, marked boolean, text string, page long")
    opened = checkpointed(found.filter("not marked and text <> ''").drop("marked"))
    shared = _marked_windows(found.filter("marked"), pages.select("url").mapInArrow(hosts, "host string"), least, host_pages, marked_pages, marked_share).withColumn("marked", F.lit(True))
    if not opened.isEmpty():
        shared = shared.union(_open_windows(opened, least, host_pages, host_share).withColumn("marked", F.lit(False)))
    shared = checkpointed(shared.groupBy("host", "marked").agg(F.collect_list("window").alias("windows")))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if w.values is None else without_windows(t, w.values.to_numpy(), least) for t, w in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    if not shared.isEmpty():
        found = _met(found, shared, ["host", "marked"], "left").select("id", "url", "text", "windows").mapInArrow(cleaned, f"id {kinds[0]}, url {kinds[1]}, text string")
    return found.select(F.col("id").alias(id_column), F.col("url").alias(url), "text")
