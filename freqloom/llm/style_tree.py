"""Main-text extraction with site style trees.

The DOMs of all pages of a host are merged into its style tree (pages with and without a main article
have one each): a node is the chain of element names with their classes, and knows on how many of the
host's distinct pages it stands, which sequences of children it has there (its styles) and on how many
pages each word of its texts stands.  Two entropies, as shares of their largest values, make a node's
importance.  Presentation: how much its styles differ from page to page.  Content: how little its words
repeat, over its distinct words or over the words of each page.  The composite importance of a node with
l styles is

    (1 - DECAY ** l) * presentation + DECAY ** l * mean composite importance of what it holds,

the mean weighted by words; a leaf has its content importance only.  What is much depends on the host:
prose repeats its common words, the more the more pages there are.  So the measure is the host's own
main section, the branch with the most words (not one that names announce as noise)
and what stands beside it.  With r the larger of the two
ratios of (1 - composite importance) of a branch to that of the heaviest branch, and m the host's distinct
pages that have the branch, it stays on a page where

    prior + WEIGHT * m / (m + PAGES) * evidence >= 0,   evidence = log2(margin / r) within -1 and 1

and the margin is ``INNER`` in the main section and ``OUTER`` elsewhere and for what names announce as noise.  The prior is what the page itself
says.  Element names, roles and comment classes that announce what a main text is not (menus, headers,
footers, sidebars, forms, comments) decide; so do class names that announce it (adverts, notices); class names that only hint at it, and being inside or beside the main
article, shift the bound.  The main article is the ``main`` element or the ``article`` with the most text, if it
holds a third of the page's text outside announced noise.

Words are counted by their hashes, every word of every branch.

Pages are parsed once, into blocks, which are kept as Parquet in the shared folder; copies of a page count
once in the tree.  A page gets the fates of its own branches only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, shared_dir, small_batches

DECAY, WEIGHT, PAGES = 0.9, 8.0, 8
INNER, OUTER = 2.5, 0.75
#: A section that holds more of its host's words is the whole page.
WHOLE = 0.99
#: The heaviest branch counts as repeating this much at least.
LEAST_REPEAT = 0.01
#: Priors of zones, of announced noise, of classes that announce it, of a hint at it, of an article inside the main one.
INSIDE, BESIDE, NEUTRAL, ANNOUNCED, NAMED, HINT, NESTED = 2.0, -2.0, 1.0, -20.0, -11.0, -1.5, -4.0
#: Branches at or below this prior are no measure of a host's main text, if there are others.
NO_MEASURE = INSIDE + NAMED
#: Branches with more words on a page are long; words are counted whose hashes lie below LIMIT, in long ones too: all.
FEW_WORDS, LIMIT = 32, 1 << 63
#: (host, branch, word) counts that a task holds before it passes them on, 24 bytes each a few times over; counts in a batch of rows.
HELD_COUNTS, TOLD_ROWS = 1_000_000, 50_000
#: A branch's words are dealt by the first bits of their hashes, to eight parts; so many hashes of a row are packed.
PART_SHIFT, PACKED_WORDS = 61, 64
#: Rows of turned branches, of pages that have one and of copies, up to which they are broadcast (8 to 100 bytes each).
BROADCAST_ROWS = 100_000

#: Fixed values of HTML: elements without an end tag, and those that break lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Which open element a start tag ends, and up to which element to look for it.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: What may stand in a head; anything else ends it.
HEAD_TAGS = frozenset("title meta link base script style noscript template".split())
#: Never text of a page.
SILENT_TAGS = frozenset("head title script style noscript template iframe object embed svg canvas audio video button select textarea math".split())
#: Presentation: what announces noise.
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies reply".split())
NOISE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead share sharing social related recommended newsletter subscribe subscription signup login toolbar widget widgets pagination pager skip".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))
#: Words that tell nothing beside a word of noise: comment-list is noise, share-price may not be.
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons card cards col column container content entries entry form global group head icon icons inner item items left links list main middle outer page panel post posts primary right row secondary section site slot stories strip text thread title top unit wrap wrapper".split()
)
#: A class name with one of these tells about its page, such as no-sidebar.
TELLING_WORDS = frozenset("with without no has layout".split())
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


class Node(NamedTuple):
    """A block element; prior is its own."""

    parent: int
    tag: str
    name: str
    prior: float


class Opened(NamedTuple):
    """An open element: its node (of an inline element: the one around), and whether its text counts, or lies in an article or main."""

    tag: str
    node: int
    silent: bool
    content: bool


class Block(NamedTuple):
    branch: int
    prior: float
    text: str


def named_prior(tag: str, attrs: dict[str, str], content: bool) -> float:
    """What the names of an element say; content: it lies in an article or main."""
    if tag in ("html", "body", "main"):
        return 0.0
    if tag in NOISE_TAGS or tag == "header" and not content or attrs.get("role", "").lower() in NOISE_ROLES:
        return ANNOUNCED
    noise = NOISE_WORDS if content else NOISE_WORDS | HEADER_WORDS
    hint = 0.0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {x.lower() for x in WORD.findall(name)}
        if not words & noise or words & TELLING_WORDS:
            continue
        if words - noise <= PLAIN_WORDS and (tag != "article" or words & COMMENT_WORDS):
            if words & COMMENT_WORDS:
                return ANNOUNCED
            hint = NAMED
        hint = min(hint, HINT)
    return hint


class PageParser(HTMLParser):
    """Collects block elements and texts of a page; mends missing end tags as browsers do.  Linear in the page's length."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "", "", 0.0)]
        self.styles, self.last_child = [0], [""]
        self.stack: list[Opened] = []
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.texts: list[tuple[int, str]] = []

    def top(self) -> Opened:
        return self.stack[-1] if self.stack else Opened("", 0, False, False)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                self.texts.append((self.top().node, text))

    def pop_to(self, at: int) -> None:
        if any(x.tag in BLOCK for x in self.stack[at:]):
            self.flush()
        self.open.subtract(x.tag for x in self.stack[at:])
        del self.stack[at:]

    def find(self, tags: str, within: str) -> int | None:
        wanted = [x for x in tags.split() if self.open[x]]
        if not wanted:
            return None
        bounds = within.split()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in wanted:
                return at
            if self.stack[at].tag in bounds:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag not in HEAD_TAGS and (at := self.find("head", "body")) is not None:
            self.pop_to(at)
        if tag in BLOCK:
            self.flush()
            if tag not in ("option", "optgroup") and (at := self.find("p", "button")) is not None:
                self.pop_to(at)
        if tag in ENDS and (at := self.find(*ENDS[tag])) is not None:
            self.pop_to(at)
        if tag in VOID:
            return
        around = self.top()
        silent, content, node = around.silent or tag in SILENT_TAGS, around.content or tag in ("article", "main"), around.node
        if not silent:
            said = {k: v or "" for k, v in attrs}
            role = said.get("role", "").lower()
            content = content or role in ("main", "article")
            silent = tag not in ("html", "body") and ("hidden" in said or said.get("aria-hidden") == "true" or bool(HIDDEN.search(said.get("style", ""))))
            if not silent:
                prior = named_prior(tag, said, around.content)
                if tag in BLOCK:
                    node = self.add(around.node, "main" if role == "main" else "article" if role == "article" else tag, self.name(tag, said), prior)
                else:  # inside a line of text
                    silent = prior <= NAMED
        self.stack.append(Opened(tag, node, silent, content))
        self.open[tag] += 1

    @staticmethod
    def name(tag: str, attrs: dict[str, str]) -> str:
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        return ".".join([tag, *sorted(set(re.sub(r"\d+", "0", named).split()))])

    def add(self, parent: int, tag: str, name: str, prior: float) -> int:
        self.nodes.append(Node(parent, tag, name, prior))
        self.styles.append(0)
        self.last_child.append("")
        if name != self.last_child[parent]:  # a list is alike however long
            self.styles[parent] = xxhash.xxh64_intdigest(name, self.styles[parent])
            self.last_child[parent] = name
        return len(self.nodes) - 1

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            self.pop_to(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == tag))
        elif tag in BLOCK:
            self.flush()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment is skipped; one that is not closed takes the rest."""
        if short := re.compile("-?>").match(self.rawdata, i + 4):
            return short.end()
        end = re.compile("--!?>").search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Anything else that begins with ``<!``, known or not, is skipped up to the next ``>``."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.top().silent:
            self.pieces.append(data)


class Page:
    """Nodes of a page with their keys in the style tree (0 based; node 0 is the page), priors and texts."""

    def __init__(self, html: str) -> None:
        parser = PageParser()
        parser.feed(html)
        parser.close()
        parser.flush()
        self.nodes, self.texts = parser.nodes, parser.texts
        self.styles = parser.styles
        self.main = self.find_main()
        self.place()

    def find_main(self) -> int:
        """The node of the main article, or -1."""
        noise, held = [False] * len(self.nodes), [0] * len(self.nodes)
        for k, x in enumerate(self.nodes[1:], 1):
            noise[k] = noise[x.parent] or x.prior <= NAMED
        for k, text in self.texts:
            held[k] += 0 if noise[k] else len(text)
        for k in range(len(self.nodes) - 1, 0, -1):
            held[self.nodes[k].parent] += held[k]
        best = -1
        for tag in ("article", "main"):
            found = [k for k, x in enumerate(self.nodes) if x.tag == tag and held[k]]
            best = max(found, key=lambda k: (held[k], -k), default=-1)
            if best >= 0 and (tag == "main" or 3 * held[best] >= held[0]):
                return best
        return -1

    def place(self) -> None:
        n, outside = len(self.nodes), NEUTRAL if self.main < 0 else BESIDE
        self.keys, self.priors, self.names = [int(outside == BESIDE)] * n, [outside] * n, [""] * n
        inside, said = [False] * n, [0.0] * n
        for k, x in enumerate(self.nodes[1:], 1):
            p = x.parent
            inside[k] = inside[p] or k == self.main
            nested = inside[p] and x.tag == "article" and self.nodes[self.main].tag == "article"
            said[k] = min(said[p], x.prior, NESTED if nested else 0.0)
            self.priors[k], self.names[k] = (INSIDE if inside[k] else outside) + said[k], x.name
            self.keys[k] = xxhash.xxh64_intdigest(f"{self.names[k]} {self.priors[k]}", self.keys[p])

    def blocks(self) -> list[Block]:
        return [Block(signed(self.keys[k]), self.priors[k], text) for k, text in self.texts]

    def tree(self) -> list[dict]:
        """The page's share of its host's tree: its nodes that hold text, with their words and those of all they hold."""
        own, held = [0] * len(self.nodes), [0] * len(self.nodes)
        for k, text in self.texts:
            own[k] += text.count(" ") + 1
        for k in range(len(self.nodes) - 1, -1, -1):
            held[k] += own[k]
            if k:
                held[self.nodes[k].parent] += held[k]
        found: dict[int, dict] = {}
        styles: dict[int, set[int]] = {}
        for k, x in enumerate(self.nodes):
            if held[k]:
                key = self.keys[k]
                styles.setdefault(key, set()).add(self.styles[k])
                node = found.setdefault(key, {"branch": signed(key), "parent": signed(self.keys[x.parent]) if k else None, "name": self.names[k], "prior": self.priors[k], "own": 0, "held": 0})
                node["own"] += own[k]
                node["held"] += held[k]
        for key, x in found.items():
            x["style"] = signed(sum(styles[key]) % (1 << 64))
        return list(found.values())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_blocks(html: str) -> list[Block]:
    """The blocks that the page's own prior keeps."""
    return [b for b in Page(html).blocks() if b.prior >= 0]


def host_of(url: str) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


NODES = pa.list_(pa.struct([("branch", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("prior", pa.float64()), ("own", pa.int64()), ("held", pa.int64()), ("style", pa.int64())]))
BLOCKS = pa.list_(pa.struct([("branch", pa.int64()), ("prior", pa.float64()), ("text", pa.string())]))


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, id, url, host, root, digest, nodes, blocks) of each page, written to the shared folder; row is a number of its own, root the tree."""
    small_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(x) for x in batch.column(3).to_pylist()]
            digests = [int.from_bytes(hashlib.sha256((x.as_py() or "").encode("utf-8", "replace")).digest()[:8], "big", signed=True) for x in batch.column(3)]
            blocks = [[b._asdict() for b in p.blocks()] for p in found]
            columns = [pa.array([p.keys[0] for p in found], pa.int32()), pa.array(digests, pa.int64()), pa.array([p.tree() for p in found], NODES), pa.array(blocks, BLOCKS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "url", "host", "root", "digest", "nodes", "blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    out = f"id {kinds['id']}, url {kinds['url']}, host string, root int, digest long, nodes array<struct<branch: long, parent: long, name: string, prior: double, own: long, held: long, style: long>>, blocks array<struct<branch: long, prior: double, text: string>>"
    folder = f"{shared_dir(pages.sparkSession)}/pages-{uuid.uuid4().hex}"
    src.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return pages.sparkSession.read.parquet(folder)


def distinct_pages(parsed: DataFrame) -> DataFrame:
    """parsed without the second and later copies of a page of a host."""
    rows = parsed.select("host", "digest", "row")
    many = rows.groupBy("host", "digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    more = cut(rows.join(many, ["host", "digest"]).where("row > first").select("row"))
    return parsed.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "row", "left_anti")


def summed(group: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by group and word, in that order."""
    order = np.lexsort((word, group))
    group, word, n = group[order], word[order], n[order]
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))[: len(group)]
    return group[at], word[at], np.add.reduceat(n, at) if len(at) else n


def packed(words: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** PART_SHIFT by Elias and Fano: how far their leading bits rise, then the other bits of each."""
    low = PART_SHIFT + 1 - len(words).bit_length()
    rises = np.zeros(len(words) + (1 << PART_SHIFT - low), np.uint8)
    rises[(words >> low) + np.arange(len(words))] = 1
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.concatenate([rises, bits[:, 64 - low :].ravel()])).tobytes()


def unpacked(code: bytes, n: int) -> np.ndarray:
    low = PART_SHIFT + 1 - n.bit_length()
    rises, found = n + (1 << PART_SHIFT - low), np.unpackbits(np.frombuffer(code, np.uint8))
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - low :] = found[rises : rises + n * low].reshape(n, low)
    return np.flatnonzero(found[:rises]) - np.arange(n) << low | np.packbits(bits, axis=1).view(">u8").ravel().astype(np.int64)


def word_counts(pages: DataFrame) -> DataFrame:
    """(host, root, branch, word, n): on how many of the distinct pages a branch has the word (hashed; any digits are alike).

    Shuffled are rows of a branch's words, a row for each of eight ranges of hashes, with their counts in a task, a byte each if none is over 255.
    A task takes its pages by host, so it tells a branch's words once unless one host has more than it holds; rows of many words are packed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple] = []
        size = 0

        def told(size: int) -> pa.RecordBatch:
            group, word, n = (x[:size] for x in held[0])
            part = word >> PART_SHIFT
            at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
            ends = np.append(at[1:], len(group)).tolist()
            rest = word - (part << PART_SHIFT)
            words, short, counts, keys = rest.astype("<i8").tobytes(), n.astype("u1").tobytes(), n.astype("<u4").tobytes(), list(groups)
            few = (np.maximum.reduceat(n, at) < 256).tolist()
            rows = [(*keys[g], p, y - x, words[8 * x : 8 * y] if y - x < PACKED_WORDS else packed(rest[x:y]), short[x:y] if f else counts[4 * x : 4 * y]) for g, p, x, y, f in zip(group[at].tolist(), part[at].tolist(), at.tolist(), ends, few)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "root", "branch", "part", "size", "words", "counts"])

        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            if not len(flat):
                continue
            page = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            hosts, roots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group = np.array([groups.setdefault((hosts[p], roots[p], b), len(groups)) for p, b in zip(page.tolist(), flat.field("branch").to_pylist())])
            texts = pc.split_pattern(flat.field("text").cast(pa.large_string()), " ")
            sizes = texts.value_lengths().to_numpy(zero_copy_only=False)
            coded = texts.flatten().dictionary_encode()
            hashes = [xxhash.xxh64_intdigest(w if w.isalpha() else DIGITS.sub("0", w)) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
            words, code = np.unique(np.array(hashes, np.uint64).view(np.int64), return_inverse=True)
            places, place = np.unique(page * len(groups) + group, return_inverse=True)  # a branch of a page
            once = np.sort(np.repeat(place, sizes) * len(words) + code[coded.indices.to_numpy(zero_copy_only=False)])
            once = once[np.append(True, once[1:] != once[:-1])]
            held.append((places[once // len(words)] % len(groups), words[once % len(words)], np.ones(len(once), np.int64)))
            size += len(once)
            if size >= HELD_COUNTS:
                held = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if 2 * size >= HELD_COUNTS:  # the last host may go on
                    first = next((k for k, x in enumerate(groups) if x[0] == hosts[-1]), len(groups))
                    done = int(np.searchsorted(held[0][0], first))
                    if 2 * (size - done) >= HELD_COUNTS:
                        first, done = len(groups), size
                    yield told(done)
                    group, word, n = (x[done:] for x in held[0])
                    groups, size = {x: k for k, x in enumerate(list(groups)[first:])}, size - done
                    held = [(group - first, word, n)] if size else []
        if held:
            held = [summed(*map(np.concatenate, zip(*held)))]
            yield told(len(held[0][0]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        done: list[tuple] = []
        size = ready = 0

        def both() -> tuple[np.ndarray, np.ndarray]:
            words, counts = map(np.concatenate, zip(*held))
            return (words, counts) if len(held) == 1 else summed(np.zeros(len(words), np.int8), words, counts)[1:]

        def told() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(done)), [len(x[1]) for x in done])
            kinds = (pa.string(), pa.int32(), pa.int64())
            keys = [pa.array([x[0][k] for x in done], kind).take(pa.array(at)) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(np.concatenate([x[k] for x in done])) for k in (1, 2))], ["host", "root", "branch", "word", "n"])

        for batch in batches:
            for *k, part, n, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                k.append(part)
                if key is not None and k != key:
                    done.append((key, *both()))
                    ready += len(done[-1][1])
                    held, size = [], 0
                    if ready >= TOLD_ROWS:
                        yield told()
                        done, ready = [], 0
                key = k
                rest = np.frombuffer(words, "<i8") if n < PACKED_WORDS else unpacked(words, n)
                held.append((rest + (part << PART_SHIFT), np.frombuffer(counts, "u1" if len(counts) == n else "<u4").astype(np.int64)))
                size += len(held[-1][0])
                if size >= HELD_COUNTS and len(held) > 1:
                    held = [both()]
                    size = len(held[0][0])
        if key is not None:
            done.append((key, *both()))
            yield told()

    small_batches(pages.sparkSession)
    key = ["host", "root", "branch", "part"]
    counts = pages.select("host", "root", "blocks").sortWithinPartitions("host").mapInArrow(count, "host string, root int, branch long, part int, size int, words binary, counts binary")
    return counts.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge, "host string, root int, branch long, word long, n long")


def weighty() -> Column:
    """How much a branch counts as a host's heaviest."""
    return F.struct((F.col("own") > 0).alias("any"), (F.col("prior") > NO_MEASURE).alias("fit"), "own")


def importance(pages: DataFrame) -> DataFrame:
    """The hosts' style trees: (host, root, branch, parent, name, prior, pages, own, held, presentation, by_word, by_page, composite, composite_page, section).

    pages: distinct pages with the branch; own, held: words of its own texts and of all it holds; by_word,
    by_page: content importance over its distinct words, and over the words of each page; composite,
    composite_page: the composite importance with either; section: in its tree's main section.
    """
    key = ["host", "root", "branch"]
    nlogn = F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    nodes = pages.select("host", "root", F.explode("nodes").alias("x")).select("host", "root", "x.*")
    styles = nodes.groupBy(*key, "parent", "name", "prior", "style").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"), F.sum("held").alias("held"))
    sums = styles.groupBy(*key, "parent", "name", "prior").agg(F.sum("n").alias("pages"), nlogn.alias("nlogn"), F.count(F.lit(1)).alias("styles"), F.max((F.col("style") != 0).cast("int")).alias("any"), F.sum("own").alias("own"), F.sum("held").alias("held"))
    words = word_counts(pages).groupBy(*key).agg(F.sum(F.log(F.col("n").cast("double"))).alias("logs"), F.count(F.lit(1)).alias("words"), nlogn.alias("word_nlogn"), F.sum("n").alias("word_pages"))
    m = F.log(F.col("pages").cast("double"))

    def repeats(total: Column, of: Column) -> Column:
        """One less the entropies' mean as a share of the largest over the pages; one page tells nothing: 1."""
        return F.when(F.col("pages") > 1, 1 - total / of / m).otherwise(1.0)

    share = F.when(F.col("any") == 0, 1.0).otherwise(F.pow(F.lit(DECAY), F.col("styles")))  # a leaf has no children in any style
    own = F.col("own") > 0
    full = sums.join(words, key, "left").select(
        *key,
        "parent",
        "name",
        "prior",
        "pages",
        "own",
        "held",
        share.alias("share"),
        repeats(F.col("nlogn"), F.col("pages")).alias("presentation"),
        F.when(own, repeats(F.col("logs"), F.col("words"))).alias("by_word"),
        F.when(own, repeats(F.col("word_nlogn"), F.col("word_pages"))).alias("by_page"),
    )
    full = cut(full)
    most = full.groupBy("host", "root").agg(F.max(F.struct(weighty(), "branch", "parent")).alias("x"), F.sum("own").alias("all"))
    parents = most.select("host", "root", F.col("x.branch").alias("heaviest"), F.col("x.parent").alias("branch"), "all")
    tops = parents.join(full.select(*key, "held"), key, "left")
    section = F.when(F.col("held") <= WHOLE * F.col("all"), F.col("branch")).otherwise(F.col("heaviest"))
    tops = tops.select("host", "root", section.alias("top"))
    adds = [((1 - F.col("share")) * F.col("presentation") * F.col("held") + F.col("share") * F.col("own") * F.coalesce(c, F.lit(0.0))) for c in ("by_word", "by_page")]
    state = full.join(tops, ["host", "root"]).select(*key, F.col("parent").alias("at"), F.col("share").alias("own_share"), *[a.alias(c) for a, c in zip(adds, ("a", "b"))], (F.col("branch") == F.col("top")).alias("section"))
    # What a node adds to one above is weighted by the shares between: pointers to ancestors double their reach.
    above = state.select("host", "root", F.col("branch").alias("at"), F.col("own_share").alias("weight"))
    state = cut(state.join(above, ["host", "root", "at"], "left").select(*key, "at", "weight", "a", "b", "section"))
    while not state.where("at IS NOT NULL").isEmpty():
        up = state.where("at IS NOT NULL").groupBy("host", "root", F.col("at").alias("branch")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"{c}_more") for c in "ab"])
        above = state.select("host", "root", F.col("branch").alias("at"), F.col("at").alias("next"), F.col("weight").alias("further"), F.col("section").alias("in"))
        new = state.join(above, ["host", "root", "at"], "left").join(up, key, "left")
        sums = [(F.col(c) + F.coalesce(f"{c}_more", F.lit(0.0))).alias(c) for c in "ab"]
        state = cut(new.select(*key, F.col("next").alias("at"), (F.col("weight") * F.col("further")).alias("weight"), *sums, (F.col("section") | F.coalesce("in", F.lit(False))).alias("section")))
    composite = [F.round(F.col(c) / F.col("held"), 9).alias(n) for c, n in (("a", "composite"), ("b", "composite_page"))]
    return full.join(state, key).select(*key, "parent", "name", "prior", "pages", "own", "held", "presentation", "by_word", "by_page", *composite, "section")


def judged(tree: DataFrame, weight: float = WEIGHT, pages: float = PAGES) -> DataFrame:
    """The branches of a tree with own texts, and (evidence, stays, turned): turned where the tree overrules the prior."""
    own = tree.where("own > 0")
    heaviest = own.groupBy("host", "root").agg(F.max(F.struct(weighty(), "branch", "composite", "composite_page")).alias("x"))
    heaviest = heaviest.select("host", "root", *[F.greatest(F.lit(LEAST_REPEAT), 1 - F.col(f"x.{c}")).alias(f"of_{c}") for c in ("composite", "composite_page")])
    r = F.greatest(*[(1 - F.col(c)) / F.col(f"of_{c}") for c in ("composite", "composite_page")])
    margin = F.when(F.col("section") & (F.col("prior") > NO_MEASURE), INNER).otherwise(OUTER)
    evidence = F.when(r <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.log2(margin / r))))
    done = own.join(heaviest, ["host", "root"]).withColumn("evidence", F.round(evidence, 9)).drop("of_composite", "of_composite_page")
    total = F.col("prior") + weight * F.col("pages") / (F.col("pages") + pages) * F.col("evidence")
    return done.withColumn("stays", total >= 0).withColumn("turned", F.col("stays") != (F.col("prior") >= 0))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weight: float = WEIGHT, least_pages: float = PAGES) -> DataFrame:
    """(id, url, text) for each page: the blocks that stay, in page order, joined by a line feed.

    Character references are decoded, white space in a block becomes one space.  A null html or a page
    without main text has an empty text; malformed markup is read as browsers do; rows may repeat (each
    gets its text; in the tree they count once); a null url has an empty host; other columns are ignored,
    whatever their names; an empty table gives no rows.  A page of any length or nesting takes linear
    time and memory.
    """
    parsed = parse(pages, id_col, url_col, html_col)
    turned = cut(judged(importance(distinct_pages(parsed)), weight, least_pages).where("turned").select("host", "root", "branch"))
    own = parsed.select("row", "host", "root", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["branch"]))).alias("branch"))
    few = turned.count() <= BROADCAST_ROWS
    own = cut(own.join(F.broadcast(turned) if few else turned, ["host", "root", "branch"]).groupBy("row").agg(F.collect_list("branch").alias("turned")))
    few = own.count() <= BROADCAST_ROWS  # pages with a turned branch
    wide = parsed.join(F.broadcast(own) if few else own, "row", "left")
    fits = F.filter("blocks", lambda b: (b["prior"] >= 0) != F.coalesce(F.array_contains("turned", b["branch"]), F.lit(False)))
    text = F.array_join(F.transform(fits, lambda b: b["text"]), "\n")
    return wide.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
