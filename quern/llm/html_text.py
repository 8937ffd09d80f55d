"""Main text of web pages: page structure, and a suffix array over the pages of a host.

Each page falls into blocks in one of three zones: chrome (menus, headers, footers, forms and the like, by element,
role or class), article (in an article or main element) and body (all else). If a page marks an article, that is its
main text, with the passages that other pages repeat. Of other pages the array decides: of each host, the word streams
outside of articles are concatenated and their suffixes sorted, as far as the first RUN words. Where RUN words stand on
several distinct pages they are boilerplate: blocks of such words go, and runs of RUN or more of them are cut out of
others, whose unique runs stay.

Rows of equal content on a host are one page. Hosts of many words are dealt into shards by content; each shard's array
tells which windows of RUN words it has and the least and largest page that has them, and what the shards tell of a window is
put together. So neither the shards nor the order of rows change a result.

Results for odd input: null or empty html gives an empty text; broken markup is read as far as it goes (unclosed
elements end with their parent, an open comment or declaration with the page), in time that grows with its length;
repeated rows give repeated rows; a page without host is compared with such pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash64, partitions, without
from .components import cut, few
from .shingles import scramble

RUN = 8
#: Words of a shard, about.
WORDS = 400_000
HARD, CHROME, ARTICLE, BODY = "h", "c", "a", "b"

#: Elements by what they mean for the zone of their text. Fixed values of HTML.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|head|title"
CHROME_TAGS = frozenset("nav header footer aside select textarea label dialog menu input option fieldset button".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "section"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sidebar menu nav navbar navigation cookie cookies consent gdpr notice comment comments "
    "disqus footer header masthead promo promoted sponsor sponsored social share sharing related recommended newsletter subscribe subscription signup "
    "breadcrumb breadcrumbs popup modal overlay toolbar widget pagination pager login search".split()
)
#: What stands in a tag after its name: up to so many pieces of plain or quoted signs, so that open quotes cost no rescans.
GIVEN = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,512}+"
MARKUP = re.compile(
    rf"(?is)<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{GIVEN}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<with>{GIVEN})>|<[!?/][^>]*+(?:>|\Z)"
)
#: Names that say how an article shows a part of itself, rather than that the part belongs to something else.
SHOWN = frozenset("widget social share sharing overlay toolbar modal popup pager pagination".split())
#: First parts of names of what has such a part, or lacks it.
HAVING = frozenset("has with no without hide show is".split())
#: Names of parts that hold articles of others: no article inside is that of the page.
OTHERS = frozenset("comment comments disqus related recommended".split())
ATTRIBUTE = re.compile(r"(?s)([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _named(value: str, inside: bool) -> str:
    """The chrome word that a class or id is named after, or "": whole names, and outside of articles first and last parts too."""
    for name in value.split():
        if inside:
            if name in CHROME_CLASSES and name not in SHOWN:
                return name
            continue
        parts = re.split(r"[_\-]+", name)
        for part in (parts[0], *(parts[-1:] if parts[0] not in HAVING else ())):
            if part in CHROME_CLASSES:
                return part
    return ""


def _zone(tag: str, given: str, zone: str) -> str:
    """The zone of an element in an element of this zone.

    Chrome elements and hidden ones stay chrome whatever they hold. A form, or an element that only its name or role
    makes chrome, may hold the article of the page.
    """
    inside = zone == ARTICLE
    if zone == HARD or tag in CHROME_TAGS and not (tag == "header" and inside):
        return HARD
    found = HARD if tag == "form" and inside else CHROME if tag == "form" else zone
    for m in ATTRIBUTE.finditer(given) if given and tag not in ("html", "body") else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        word = _named(value, inside) if name == "class" or name == "id" and not inside else ""
        if inside and tag in HEADINGS:
            word = word if word in OTHERS else ""
        if word or name == "role" and value in CHROME_ROLES:
            found = HARD if inside or word in OTHERS or found == HARD else CHROME
    return ARTICLE if tag in MAIN_TAGS and found in (zone, BODY) else found


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """Zone and text of each block of a page, in order; raw elements and comments are left out."""
    page = page or ""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = [("", BODY)]
    # Depths in the stack of the open elements of each name, and of all that are not inline.
    open_: dict[str, list[int]] = {}
    outer: list[int] = []
    at = 0

    def close(depth: int) -> None:
        for tag, _ in stack[depth:]:
            open_[tag].pop()
        while outer and outer[-1] >= depth:
            outer.pop()
        del stack[depth:]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((stack[-1][1], text))

    for m in MARKUP.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
        elif m["end"]:
            depth = open_[tag][-1] if open_.get(tag) else 0
            if not depth:
                if tag not in INLINE:
                    flush()
                continue
            if tag not in INLINE or stack[depth - 1][1] != stack[-1][1]:
                flush()
            close(depth)
        elif tag not in VOID:
            if tag not in INLINE:
                flush()
                closed = "p" if tag not in ("li", "dt", "dd", "tr", "td", "th") else tag
                if outer and stack[outer[-1]][0] == closed:
                    close(outer[-1])
            zone = _zone(tag, m["with"], stack[-1][1])
            if tag in INLINE and zone != stack[-1][1]:
                flush()
            open_.setdefault(tag, []).append(len(stack))
            outer.extend([len(stack)] if tag not in INLINE else [])
            stack.append((tag, zone))
        elif tag not in INLINE:
            flush() if tag in ("hr",) else None
    held.append(page[at:])
    flush()
    return out


Block = tuple[str, str]


def suffix_ranks(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of the concatenated streams: the rank of its first `run` numbers, its stream, and how far its end is.

    The suffixes are ordered by doubling the compared length up to `run`, a power of two. No run crosses a stream's end.
    """
    lengths = np.array([len(s) for s in streams], np.int64)
    total = int(lengths.sum()) + len(streams)
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    left = np.repeat(ends, lengths + 1) - np.arange(total)
    inside = left > 0
    rank = np.empty(total, np.int64)
    rank[inside] = np.unique(np.concatenate(streams), return_inverse=True)[1] if inside.any() else 0
    rank[~inside] = -1 - np.arange(len(streams))  # every end differs
    rank = np.unique(rank, return_inverse=True)[1]
    k = 1
    while k < run:
        second = np.zeros(total, np.int64)
        second[: max(total - k, 0)] = rank[k:] + 1
        rank = np.unique(rank * (total + 2) + second, return_inverse=True)[1]
        k *= 2
    return rank, owner, left


_WORDS: Memo = Memo(hash64, 1 << 18)


def stream_of(blocks: list[Block]) -> list[np.ndarray]:
    """Hashes of the words of blocks outside of articles; what stands before and after an article is apart."""
    parts: list[list[int]] = [[]]
    for zone, text in blocks:
        if zone == ARTICLE:
            parts.append([])
        else:
            parts[-1] += map(_WORDS.__getitem__, text.encode("utf-8", "surrogatepass").split())
    return [np.array(p, np.uint64) for p in parts if p]


def windows(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of the windows of `run` words, in order."""
    out = stream[: max(0, len(stream) - run + 1)].copy()
    for i in range(1, run):
        out = scramble(out) + stream[i : i + len(out)]
    return scramble(out).view(np.int64)


def told_windows(pages: list[list[np.ndarray]], names: list[int], alone: bool, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pages of a shard: hashes of their windows, with the least and largest name of a page that has it.

    alone: whether no other shard has pages of this host, so that windows of one page need not be told.
    """
    streams = [s for page in pages for s in page]
    by_name = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    page_of = np.repeat(place, [len(p) for p in pages])
    if not streams:
        return (np.zeros(0, np.int64),) * 3
    rank, owner, left = suffix_ranks(streams, run)
    fits = np.flatnonzero(left >= run)
    rank, page = rank[fits], page_of[owner[fits]]
    order = np.lexsort((page, rank))
    rank, page = rank[order], page[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rank)), bool), rank[1:] != rank[:-1])))
    last = np.append(first[1:], len(rank)) - 1
    every = np.concatenate([np.concatenate((windows(s, run), np.zeros(len(s) + 1 - max(0, len(s) - run + 1), np.int64))) for s in streams])
    low, high = page[first], page[last] if len(rank) else page
    kept = low < high if alone else np.ones(len(first), bool)
    names = np.array(names, np.int64)[by_name]
    return every[fits[order[first]]][kept], names[low[kept]], names[high[kept]]


def unique_words(words: list[str], covered: list[bool], run: int = RUN) -> list[str]:
    """The words of a block without covered runs of `run` words or more; nothing if all are covered."""
    if all(covered):
        return []
    out, at = [], 0
    for gone, stretch in groupby(covered):
        n = len(list(stretch))
        out += words[at : at + n] if not gone or n < run else []
        at += n
    return out


def unique_runs(blocks: list[Block], repeated: set[int], run: int = RUN) -> str:
    """The text of the body blocks of a page, without the runs that windows among the repeated ones cover."""
    words = [text.split() for _, text in blocks]
    stream = stream_of(blocks)
    found = windows(stream[0], run).tolist() if stream else []
    covered = np.zeros(sum(map(len, words)) + 1, np.int64)
    for at in (i for i, h in enumerate(found) if h in repeated):
        covered[at] += 1
        covered[min(at + run, len(covered) - 1)] -= 1
    gone = (np.cumsum(covered) > 0).tolist()
    out, at = [], 0
    for (zone, _), own in zip(blocks, words):
        text = " ".join(unique_words(own, gone[at : at + len(own)], run))
        at += len(own)
        if zone == BODY and text:
            out.append(text)
    return "\n".join(out)


def _pack(blocks: list[Block]) -> bytes:
    return zstandard.ZstdCompressor(3).compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"))


def _unpack(data: bytes) -> list[Block]:
    return [(zone, text) for zone, text in json.loads(zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass"))]


def _read(pages: pd.Series) -> pd.DataFrame:
    """Text (null if the page marks no article), name of the content, blocks that the array reads, and their words."""
    rows = []
    for page in pages:
        blocks = blocks_of(page)
        article = [text for zone, text in blocks if zone == ARTICLE]
        name = int.from_bytes(hashlib.blake2b(repr(blocks).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        rest = [(zone, text if zone != ARTICLE else "") for zone, text in blocks]
        rows.append(("\n".join(article) if article else None, name, _pack(rest), sum(text.count(" ") + 1 for zone, text in rest if text)))
    return pd.DataFrame(rows, columns=["text", "name", "rest", "words"])


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, hash, low, high) of windows, from pages that come sorted by host and shard."""

    def told(key: tuple, pages: list, names: list) -> pd.DataFrame:
        hashes, low, high = told_windows(pages, names, key[2] == 1)
        return pd.DataFrame({"host": key[0], "hash": hashes, "low": low, "high": high})

    pages, names, last = [], [], None
    for batch in batches:
        for host, shard, shards, name, rest in zip(batch["host"], batch["shard"], batch["shards"], batch["name"], batch["rest"]):
            if (host, shard, shards) != last:
                if pages:
                    yield told(last, pages, names)
                pages, names, last = [], [], (host, shard, shards)
            pages.append(stream_of(_unpack(rest)))
            names.append(name)
    if pages:
        yield told(last, pages, names)


def _page_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            some = batch.iloc[at : at + 64]
            found = [np.unique(np.concatenate([windows(s) for s in stream_of(_unpack(rest))] or [np.zeros(0, np.int64)])) for rest in some["rest"]]
            sizes = list(map(len, found))
            yield pd.DataFrame({"host": np.repeat(some["host"].to_numpy(), sizes), "name": np.repeat(some["name"].to_numpy(), sizes), "hash": np.concatenate(found)})


def _cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [unique_runs(_unpack(rest), set(found) if found is not None else set()) for rest, found in zip(batch["rest"], batch["found"])]
        yield pd.DataFrame({"host": batch["host"], "name": batch["name"], "cut": texts})


def extract(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df without its html, with text and n_chars (code points); columns of df with these names are replaced."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit(""))
    read = F.pandas_udf(_read, "text string, name long, rest binary, words long")
    pages = without(df.withColumns({"__html": F.col(html), "__host": host}), html, "text", "n_chars")
    pages = cut(pages.withColumn("__read", read("__html")).drop("__html"))
    told = pages.select(F.col("__host").alias("host"), "__read.*")
    contents = told.groupBy("host", "name").agg(F.first("rest").alias("rest"), F.max("words").alias("words"), F.max(F.col("text").isNull()).alias("open"))
    contents = cut(contents.where("words > 0"))
    shards = contents.groupBy("host").agg(F.ceil(F.sum("words") / WORDS).cast("int").alias("shards")).where("shards > 1")
    dealt = contents.join(few(cut(shards)), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("name"), F.col("shards")).cast("int")).select("host", "shard", "shards", "name", "rest")
    dealt = dealt.repartition(partitions(df), "host", "shard").sortWithinPartitions("host", "shard", "name")
    found = dealt.mapInPandas(_shards, "host string, hash long, low long, high long")
    repeated = found.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "hash")
    # Pages that mark no article get what the arrays of their host have found.
    unmarked = contents.where("open").select("host", "name", "rest")
    covered = unmarked.mapInPandas(_page_windows, "host string, name long, hash long").join(repeated, ["host", "hash"])
    covered = covered.groupBy("host", "name").agg(F.collect_list("hash").alias("found"))
    texts = unmarked.join(covered, ["host", "name"], "left").mapInPandas(_cut_texts, "host string, name long, cut string")
    texts = cut(texts)
    pages = pages.withColumn("__name", F.when(F.col("__read.text").isNull(), F.col("__read.name")))
    out = pages.join(texts.select(F.col("host").alias("__h"), F.col("name").alias("__n"), "cut"), (F.col("__host") == F.col("__h")) & (F.col("__name") == F.col("__n")), "left")
    out = out.withColumn("text", F.coalesce("__read.text", "cut", F.lit(""))).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.drop("__host", "__read", "__name", "__h", "__n", "cut")
