"""HTML extraction with a host suffix array.

Pages are cut into text blocks by their markup. Per shard of a host (at most about ``shard_pages`` pages by hash, so that a host of any
size is many groups) the token streams of all blocks are concatenated and their suffixes sorted to the depth of ``min_tokens`` by prefix
doubling: suffixes of one rank begin with one substring of that many tokens. Substrings on ``min_pages`` distinct pages of the host or
more are repeated. Where a host is many shards and has pages without a marked article, each shard gives its distinct substrings (as
64-bit hashes) with their pages; Spark sums these by host, and the repeated ones come back to the shards that hold them. On hosts of
many shards whose pages all mark their article, nothing is to be cut. No result hangs on how a host was dealt into shards.

What becomes of a block: regions that markup names as something else than text (menus, footers, adverts, forms, comments ...)
never count. Where a page marks its article (``article``, ``main``), the article's blocks are the text: repetition does not take from
them, as copies of an article are articles too. On other pages the remaining blocks lose their repeated substrings and keep their unique runs.

Defined results. Null or blank html: text ''. Null url: the host ''. Null page_id and repeated pages: each row on its own.
Unclosed and misnested tags: a closing tag closes its nearest open element and all within it; without one it is ignored.
Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import freed, materialize, mix64, require, signed, slices, word_hashes, words

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>?""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Names of HTML elements and of page regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg math iframe object title textarea head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CELL = frozenset("br td th option".split())
DROP = frozenset("nav footer aside form button select dialog menu datalist fieldset".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
REGIONS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond share sharing social related recommended widget login pagination pager copyright disclaimer".split()
)


def _opens(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(never text, an article) for a start tag."""
    article = name in ARTICLE
    drop = name in DROP or name == "header" and not inside
    if attrs and not drop and name not in ("html", "body"):
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role":
                drop |= value in ROLES
                article |= value in ARTICLE
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                drop |= key == "hidden" or not article
            elif not article:
                named = set(re.split(r"[^a-z]+", value))
                drop |= bool(named & REGIONS) or not inside and bool(named & {"header", "masthead"})
    return drop, article


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(region, tokens) of the blocks in page order; regions: a article, u undecided, d never text."""
    out: list[tuple[str, list[str]]] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, open regions that are never text, open articles
    region, at, low = "u", 0, None

    def close() -> None:
        tokens = html.unescape("".join(held)).split() if held else []
        held.clear()
        if tokens:
            out.append((region, tokens))

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in RAW and not ends:
            if name == "svg" and attrs.endswith("/"):
                continue
            low = low or page.lower()
            if len(low) != len(page):  # folding that changes lengths: find the end without it
                low = page
            end = low.find(f"</{name}", at)
            stop = low.find(">", end) if end >= 0 else -1
            if name != "head" or end >= 0:
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if name in CELL:
            held.append(" ")
        if name in BLOCK:
            close()
        if name in VOID or name == "td" or name == "th":
            continue
        if ends:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != name:
                k -= 1
            if k >= 0:
                del stack[k:]
        else:
            drops, articles = stack[-1][1:] if stack else (0, 0)
            if name in BLOCK and stack and stack[-1][0] == "p":
                stack.pop()
            drop, article = _opens(name, attrs, articles > 0)
            if not attrs.endswith("/") or name in BLOCK:
                stack.append((name, drops + drop, articles + article))
        drops, articles = stack[-1][1:] if stack else (0, 0)
        new = "d" if drops else "a" if articles else "u"
        if new != region:
            close()
            region = new
    close()
    return out


def suffixes(streams: list[np.ndarray], min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, page, text) of each place of the concatenated streams; each page ends in a token of its own. Equal ranks: equal ``min_tokens`` tokens."""
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    text = np.concatenate([np.zeros(0, np.int64), *(x for k, s in enumerate(streams) for x in (s, [top + k]))]).astype(np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    n, rank, k = len(text), text, 1
    while k < min_tokens:
        shift = min(k, min_tokens - k)
        key = rank * (int(rank.max()) + 2)
        key[: max(n - shift, 0)] += rank[shift:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k += shift
    return rank, page, text


def pages_of(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """On how many distinct pages each rank is found."""
    n_pages = int(page.max()) + 1
    return np.bincount(np.unique(rank * n_pages + page) // n_pages, minlength=int(rank.max()) + 1)


def covered(hits: np.ndarray, page: np.ndarray, n_pages: int, min_tokens: int) -> list[np.ndarray]:
    """For each page, which tokens lie within ``min_tokens`` of a hit."""
    edge = np.zeros(len(page) + min_tokens + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + min_tokens, -1)
    cover = np.cumsum(edge)[: len(page)] > 0
    ends = np.searchsorted(page, np.arange(n_pages), "right")
    return [cover[a : b - 1] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)] if n_pages else []


def repeated(streams: list[np.ndarray], min_tokens: int, min_pages: int) -> list[np.ndarray]:
    """For each page's token numbers, which tokens lie in a substring of ``min_tokens`` found on ``min_pages`` pages."""
    if len(streams) < min_pages:
        return [np.zeros(len(s), bool) for s in streams]
    rank, page, _ = suffixes(streams, min_tokens)
    return covered(np.flatnonzero(pages_of(rank, page)[rank] >= min_pages), page, len(streams), min_tokens)


def substrings(streams: list[np.ndarray], names: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each rank's substring, its pages, rank of each place, page of each place); a substring over a page's end has pages 0."""
    rank, page, text = suffixes(streams, min_tokens)
    _, first = np.unique(rank, return_index=True)
    pages = pages_of(rank, page)
    last = np.minimum(first + min_tokens - 1, len(text) - 1)
    whole = (first + min_tokens <= len(text)) & (page[first] == page[last]) & (text[last] < len(names))
    names = np.append(names, np.uint64(0))
    h = np.zeros(len(first), np.uint64)
    for k in range(min_tokens):
        h = mix64(h + names[np.minimum(text[np.minimum(first + k, len(text) - 1)], len(names) - 1)])
    return h, np.where(whole, pages, 0), rank, page


def numbered(pages: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each page's tokens as numbers, and the 64-bit hash of each number's token."""
    numbers: dict[str, int] = {}
    streams = [np.array([numbers.setdefault(t, len(numbers)) for b in page for t in b.split(" ")], np.int64) for page in pages]
    data = np.frombuffer(" ".join(numbers).encode(), np.uint8)
    starts, lengths, _ = words(np.array([0, len(data)]), data)
    return streams, word_hashes(data, starts, lengths)


def main_text(regions: list[str], pages: list[list[str]], covers: list[np.ndarray]) -> list[tuple[str, int, int, int]]:
    """(text, blocks, tokens, tokens cut as repeated) of each page, from its blocks' regions and texts and which of its tokens repeat."""
    out = []
    for region, page, cover in zip(regions, pages, covers):
        kept, at, cut = [], 0, 0
        for kind, block in zip(region, page):
            tokens = block.split(" ")
            mine = cover[at : at + len(tokens)]
            at += len(tokens)
            if kind == "u" and "a" not in region:
                block = " ".join(t for t, c in zip(tokens, mine.tolist()) if not c)
                cut += int(mine.sum())
            elif kind != "a":
                continue
            if block:
                kept.append(block)
        out.append(("\n\n".join(kept), len(kept), len(cover), cut))
    return out


def _parse(batches):
    for batch in batches:
        for piece in slices(batch, "html"):
            found = [blocks(h or "") for h in piece.column("html").to_pylist()]
            regions = pa.array(["".join(r for r, _ in page) for page in found], pa.string())
            texts = pa.array([zlib.compress("\n".join(" ".join(tokens) for _, tokens in page).encode()) for page in found], pa.binary())
            yield pa.record_batch([*(piece.column(c) for c in ("page_id", "url", "host", "shard")), regions, texts], ["page_id", "url", "host", "shard", "regions", "packed"])


def _texts(packed: pa.ChunkedArray) -> list[list[str]]:
    """The block texts of each page; they hold no line break, and travel packed."""
    texts = [zlib.decompress(p).decode() for p in packed.to_pylist()]
    return [t.split("\n") if t else [] for t in texts]


def _flagged(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """``df`` with the other columns of ``hosts`` (of, ...), sent to all tasks while they are few."""
    hosts = F.broadcast(hosts) if hosts.count() <= 100_000 else hosts
    return df.join(hosts, df.host == F.col("of"), "left").drop("of")


def extract(pages: DataFrame, shard_pages: int = 512, min_tokens: int = 8, min_pages: int = 3) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks, n_tokens, n_repeated (tokens that were cut from the page as repeated; none where it marks its article)."""
    pages = require(pages, "page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    pages = pages.withColumn("host", host)
    hosts = pages.groupBy("host").agg(F.ceil(F.count("*") / shard_pages).alias("shards"))
    large = materialize(hosts.filter("shards > 1").select(F.col("host").alias("of"), "shards"), "hosts")
    spread = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shards", F.lit(1)))
    dealt = _flagged(pages, large).withColumn("shard", spread).drop("shards")
    parsed = dealt.mapInArrow(freed(_parse), f"page_id {kind}, url string, host string, shard long, regions string, packed binary")
    open_hosts = None
    if not large.isEmpty():
        parsed = materialize(parsed, "pages")
        unmarked = parsed.filter(~F.contains("regions", F.lit("a"))).select(F.col("host").alias("of")).distinct()
        open_hosts = materialize(unmarked.join(large, "of", "left_semi").withColumn("wide", F.lit(True)), "open")

    def distinct(key, table):
        streams, names = numbered(_texts(table.column("packed")))
        h, n, _, _ = substrings(streams, names, min_tokens)
        h, n = signed(h[n > 0]), n[n > 0]
        return pa.table([pa.array([key[0].as_py()] * len(h), pa.string()), pa.array([key[1].as_py()] * len(h), pa.int64()), pa.array(h), pa.array(n, pa.int64())], ["host", "shard", "h", "n"])

    def run(table: pa.Table, wide: np.ndarray | None) -> pa.Table:
        regions, texts = table.column("regions").to_pylist(), _texts(table.column("packed"))
        streams, names = numbered(texts)
        if wide is None:
            covers = repeated(streams, min_tokens, min_pages)
        else:
            h, n, rank, page = substrings(streams, names, min_tokens)
            covers = covered(np.flatnonzero(((n > 0) & np.isin(signed(h), wide))[rank]), page, len(streams), min_tokens)
        text, n_blocks, n_tokens, n_repeated = zip(*main_text(regions, texts, covers))
        columns = [table.column("page_id"), table.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
        return pa.table(columns + [pa.array(c, pa.int64()) for c in (n_blocks, n_tokens, n_repeated)], ["page_id", "url", "text", "n_chars", "n_blocks", "n_tokens", "n_repeated"])

    schema = f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_tokens long, n_repeated long"
    if open_hosts is None or open_hosts.isEmpty():
        return parsed.groupBy("host", "shard").applyInArrow(lambda t: run(t, None), schema)
    parsed = _flagged(parsed, open_hosts)
    found = materialize(parsed.filter("wide").select("host", "shard", "packed").groupBy("host", "shard").applyInArrow(distinct, "host string, shard long, h long, n long"), "substrings")
    often = found.groupBy("host", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    back = found.select("host", "shard", "h").join(often, ["host", "h"], "left_semi")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        wide = right.column("h").to_numpy() if left.column("wide")[0].as_py() else None
        return run(left, wide)

    return parsed.groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInArrow(cut, schema)
