"""Main text of web pages: markup read into blocks, and boilerplate found by a suffix array of each host's pages.

A host of any size has one suffix array in effect, in buckets: blocks of pages sort the suffixes of
their own token streams to DEPTH tokens, and send each bucket, by the hash of these tokens and the
host, one packed run of the distinct ones; a bucket merges its runs, and tells each block which of
its suffixes begin on other pages too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.blocks import bucket_bounds, layout, pack_bits, pack_keys, unpack_bits, unpack_keys
from voxelith.llm.common import byte_buffer, mix, pack, unpack, word_hashes, word_spans
from voxelith.llm.substring import window_hashes

#: Tokens of the shortest substring that counts as repeated: a power of two, the depth to which suffixes are sorted.
DEPTH = 8
#: A block of text is boilerplate if repeated substrings cover so much of its tokens.
COVERED = 0.8

# Fixed values of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = set("script style textarea noscript template iframe object svg math title select".split())
_MAIN = {"article", "main"}
_APART = set("nav footer aside form button dialog menu head label".split())
_PARTS = set("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion cookie cookies consent newsletter subscribe sidebar comment comments respond disqus navbar nav navigation menu breadcrumb breadcrumbs banner popup modal notice notices footer masthead related share sharing social".split())
#: Words that don't change what a class or id with one of the former means.
_PLAIN = set("site page main top bottom left right center inner outer wrapper wrap container content box block section area bar list item items link links button buttons btn icon icons widget widgets header head title text body group row col column columns primary secondary global mobile desktop sticky fixed floating form signup slot unit id post posts article articles story stories js media this us me now".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Block:
    """A run of text between block tags; where: 'main' in the article, 'apart' in boilerplate markup, else 'other'."""

    text: str
    where: str
    linked: int


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id stands for boilerplate: one of its words does, and no other says something else."""
    words = {w.lower() for w in _WORDY.findall(name)}
    return not words.isdisjoint(_PARTS) and all(w in _PARTS or w in _PLAIN or w.isdigit() for w in words)


def _apart(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _APART or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id") and any(map(_names_boilerplate, value.split())):
            return True
        if name == "hidden" or (name == "role" and value.lower() in _ROLES) or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """A page's text blocks in order, references decoded and white space made single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, in main, apart, inside a line
    parts: list[str] = []
    linked, links, where, silent, at, end = 0, 0, "other", False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append(Block(text, where, linked))
            parts.clear()
        linked = 0

    def settle() -> None:
        nonlocal where, silent
        silent = bool(stack) and stack[-1][3]  # what is apart inside a line leaves the line whole
        if silent:
            return
        where = "other" if not stack else "apart" if stack[-1][2] else "main" if stack[-1][1] else "other"

    def close(tag: str, bounds: tuple = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                settle()
                return
            if stack[k][0] in bounds:
                return

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            piece = m[0]
            if silent:
                continue
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if links:
                    linked += len(piece)
            elif piece.startswith("<![CDATA["):
                parts.append(html.escape(piece[9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                shut = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in _BLOCK:
            flush()
            if closing:
                close(tag)
            elif tag not in _VOID:
                close("p", ("article", "main", "div", "section", "td", "li", "nav", "aside", "footer", "header", "form"))
                if tag == "li":
                    close("li", ("ul", "ol", "menu", "nav"))
                if tag == "body":
                    close("head")
                in_main = tag in _MAIN or (bool(stack) and stack[-1][1])
                stack.append((tag, in_main, (bool(stack) and stack[-1][2]) or _apart(tag, attributes, in_main), False))
                settle()
        elif tag in _VOID:
            continue
        elif closing:
            if any(entry[0] == tag for entry in stack):
                close(tag, tuple(_BLOCK))
        elif tag == "head" or any(entry[0] == tag and entry[3] for entry in stack) or _apart(tag, attributes, bool(stack) and stack[-1][1]):
            stack.append((tag, bool(stack) and stack[-1][1], True, True))
            settle()
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, page: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` tokens, by prefix doubling; -1 where the page ends sooner."""
    rank, width = tokens.astype(np.int64), 1
    alive = np.ones(len(tokens), bool)
    while width < depth:
        far = np.zeros(len(rank), np.int64)
        far[:-width] = rank[width:]
        alive[:-width] &= alive[width:] & (page[:-width] == page[width:])
        alive[-width:] = False
        _, rank = np.unique(rank * (int(far.max(initial=0)) + 1) + far, return_inverse=True)
        width *= 2
    return np.where(alive, rank, -1)


class _Pages:
    """Parsed pages with the suffixes of their token streams.

    A stream is a page's text outside of its article: text that also stands in an article is
    quoted or copied there, no boilerplate. No suffix reaches over an article.
    """

    def __init__(self, hosts: list[str], parsed: list[list[Block]]):
        import xxhash

        self.parsed = parsed
        flat = [(k, b) for k, found in enumerate(parsed) for b in found]
        raw, at = byte_buffer(pa.array([b.text for _, b in flat], pa.string()))
        starts, ends, self.sizes = word_spans(raw, at)
        tokens = word_hashes(raw, starts, ends)
        block = np.repeat(np.arange(len(flat)), self.sizes)
        page = np.array([k for k, _ in flat], np.int64)
        article = np.array([b.where == "main" for _, b in flat], bool)
        #: A run of blocks of one page and outside of its article.
        run = np.cumsum(np.concatenate([[True], (page[1:] != page[:-1]) | article[1:] | article[:-1]])) if len(flat) else page
        self.open = ~article[block]
        ranks = suffix_ranks(np.unique(tokens, return_inverse=True)[1], run[block], DEPTH) if len(tokens) >= DEPTH else np.full(len(tokens), -1)
        self.at = np.flatnonzero((ranks >= 0) & self.open)
        self.tokens = len(tokens)
        host = np.array([xxhash.xxh64_intdigest(h) for h in hosts], np.uint64)
        own = page[block[self.at]]
        hashes = window_hashes(tokens, DEPTH)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        keys = mix(hashes + mix(host)[own] if len(self.at) else hashes)
        content = np.array([xxhash.xxh64_intdigest(h + "\n" + "\n".join([b.text for b in found])) for h, found in zip(hosts, parsed, strict=True)], np.uint64)
        self.keys, self.place = np.unique(keys, return_inverse=True)
        #: For each distinct suffix the least and the greatest hash of a page with it: one page's text, or more.
        self.least, self.most = np.full(len(self.keys), ~np.uint64(0)), np.zeros(len(self.keys), np.uint64)
        np.minimum.at(self.least, self.place, content[own] if len(own) else hashes)
        np.maximum.at(self.most, self.place, content[own] if len(own) else hashes)

    def texts(self, repeated: np.ndarray) -> list[str]:
        """Main texts, given which of the distinct suffixes begin on other pages too."""
        edge = np.zeros(self.tokens + DEPTH + 1, np.int64)
        hits = self.at[repeated[self.place]]
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + DEPTH, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: self.tokens] > 0)])
        ends = np.cumsum(self.sizes)
        share = (covered[ends] - covered[ends - self.sizes]) / np.maximum(1, self.sizes)
        out, k = [], 0
        for found in self.parsed:
            kept = [b.text for b in found if b.where == "main"]
            if not kept:
                kept = [b.text for i, b in enumerate(found, k) if b.where == "other" and share[i] < COVERED and 2 * b.linked <= len(b.text)]
            k += len(found)
            out.append("\n".join(kept))
        return out


def main_texts(pages: list[str]) -> list[str]:
    """Main texts of pages of one host.

    Where markup doesn't tell the article from the rest, blocks covered by substrings of DEPTH
    tokens or more that distinct pages repeat are boilerplate and go, and the unique runs
    stay. An article's own text stays even if another page has it too: copies and quotations are
    no boilerplate. Pages of equal text are one page.
    """
    made = _Pages([""] * len(pages), [blocks(p) for p in pages])
    return made.texts(made.least != made.most)


_KINDS = ("main", "apart", "other")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages; text is empty where a page has none.

    Null html counts as empty and null urls share one host. All pages of a host are compared,
    in blocks and buckets that only say where work is done. Pages are dealt by their own hash,
    so that neither a hot host nor a page with many copies gathers in one task. Other columns are left out.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"), "url", host.alias("host"))
    placed, n, bits = layout(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for html_ in batch.column("text").to_pylist():
                found = blocks(html_)
                rows.append((compress("\n".join([b.text for b in found]).encode()), pack(np.array([(_KINDS.index(b.where), b.linked) for b in found], np.int64).ravel())))
            columns = [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("doc_id"), batch.column("url"), batch.column("host"), *columns], ["block", "page_id", "url", "host", "texts", "marks"])

    def parsed(table: pa.Table) -> _Pages:
        expand = zstandard.ZstdDecompressor().decompress
        made = []
        for texts, marks in zip(table["texts"].to_pylist(), table["marks"].to_pylist(), strict=True):
            marks = unpack(marks, np.int64).reshape(-1, 2).tolist()
            made.append([Block(t, _KINDS[k], linked) for t, (k, linked) in zip(expand(texts).decode().split("\n"), marks, strict=False)])
        return _Pages(table["host"].to_pylist(), made)

    def emit(table: pa.Table) -> pa.Table:
        block, made = table["block"][0].as_py(), parsed(table)
        at = bucket_bounds(made.keys, bits)
        runs = [(b, slice(x, y)) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
        content, which = np.unique(made.least, return_inverse=True)
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in runs], pa.int32()),
                "block": pa.array([block] * len(runs), pa.int64()),
                "keys": pa.array([pack_keys(made.keys[x]) for _, x in runs], pa.binary()),
                "pages": pa.array([pack_keys(content[np.unique(which[x])]) for _, x in runs], pa.binary()),
                "page": pa.array([pack(np.unique(which[x], return_inverse=True)[1].astype(np.int32)) for _, x in runs], pa.binary()),
                "more": pa.array([pack_bits(made.least[x] != made.most[x]) for _, x in runs], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        runs = [unpack_keys(b) for b in table["keys"].to_pylist()]
        page = np.concatenate([unpack_keys(c)[unpack(p, np.int32)] for c, p in zip(table["pages"].to_pylist(), table["page"].to_pylist(), strict=True)])
        more = np.concatenate([unpack_bits(b, len(k)) for b, k in zip(table["more"].to_pylist(), runs, strict=True)])
        keys, place = np.unique(np.concatenate(runs), return_inverse=True)
        least, most, again = np.full(len(keys), ~np.uint64(0)), np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
        np.minimum.at(least, place, page)
        np.maximum.at(most, place, page)
        again[place[more]] = True
        again |= least != most
        ends = np.cumsum([len(k) for k in runs])[:-1]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "again": pa.array([pack_bits(x) for x in np.split(again[place], ends)], pa.binary())})

    def extract(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return out.empty_table()
        made = parsed(table)
        at, again = bucket_bounds(made.keys, bits), np.zeros(len(made.keys), bool)
        for b, flags in zip(answers["bucket"].to_pylist(), answers["again"].to_pylist(), strict=True):
            again[at[b] : at[b + 1]] = unpack_bits(flags, at[b + 1] - at[b])
        return pa.table([table["page_id"], table["url"], pa.array(made.texts(again), pa.string())], schema=out)

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    dealt = placed.mapInArrow(read, "block long, page_id long, url string, host string, texts binary, marks binary").repartition(n, "block")
    sent = dealt.groupBy("block").applyInArrow(emit, "bucket int, block long, keys binary, pages binary, page binary, more binary")
    answers = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(count, "block long, bucket int, again binary").repartition(n, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(extract, "page_id long, url string, text string")
