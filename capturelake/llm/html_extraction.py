"""Main text of web pages, by a site style tree.

The element trees of all pages of a host are merged: two elements are one node if
their paths of tags and classes are equal. Of each node the tree keeps on how many pages it
is, the sequences of children it has (its styles) and, where it holds text, the
texts and link targets seen there (its contents). Importance comes from entropy, to the base of the number of
pages m:

content       1 - the mean entropy of the node's contents over pages: contents that
              are the same on all pages make it 0, contents of one page each make it 1
presentation  the entropy of the node's styles
composite     (1 - g^l) * presentation + g^l * the mean importance of the contents
              below it, for l styles and g = ``DECAY``

A node on at least ``MIN_PAGES`` pages is noise if its own importance and that of all
nodes below it is under ``THRESHOLD``. A page loses its blocks in noisy branches, and each
block whose text is in the same node on most pages of the host, with an importance of its own (1 - ln k / ln m, on k of m pages)
under ``THRESHOLD``: a line that is the same everywhere goes though its neighbours of the same node are stories. Some things
are known without a tree and go by what they are: menus, site headers, footers, asides, forms,
scripts and the like by tag, role or class; and an article element, where a page
has one, bounds the text. Inside of it the tree decides as anywhere else. Classes are only a guess: an article or main element, or a leaf that the tree
rates ``WORTH`` or more, counts within a sidebar, widget or banner; one in what is named
comments, related and the like, where a page has no other; and a page whose classes would leave nothing keeps
what only they would remove.
Copies of one page share all they have, which says nothing of them: pages of a host with the same text (markup,
scripts and styles aside) count as one page in all sums, each of n copies with a weight of 1/n. Noise is
removed whatever its share of a page.

All statistics are sums that are formed in each task before rows are shuffled, over
keys of host, path and content; no host and no node is gathered. Texts are read three times and not shuffled, unless
more than ``BROADCAST_NODES`` texts have copies.

Nulls and odd input: null or empty html has empty text. Pages without a host are a
site of their own each. A page that breaks off inside a tag ends before it. Repeated
pages each have a row. Empty tables give no rows. Own columns stay, whatever their names. A page of any length is held whole by one task;
elements nested deeper than ``DEPTH`` have no nodes of their own, but are opened, skipped and closed as any.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, bounded_batches, free_name, in_parts, written

THRESHOLD, DECAY, MIN_PAGES = 0.2, 0.9, 5
#: Importance from which a leaf counts in a wrapper that its class names as noise; the key of such a leaf is ``leaf ^ OPENED``.
WORTH, OPENED = 0.8, 0x5DEECE66D1B54A32
#: Why a block is skipped: a wrapper's class; a class of what has articles of its own; an article element in that; what it is.
WRAPPED, OTHERS, OTHERS_ARTICLE, NOTHING = 1, 2, 3, 4
#: Noisy nodes that are sent to all executors, at most; beyond, they are joined by host.
BROADCAST_NODES = 500_000
#: Length of paths in the tree; what is nested deeper counts there as lying in the last node of its path.
DEPTH = 500
#: Counters that a task holds before it passes them on.
COUNTERS = 200_000

# What elements are, and words of classes, ids and roles that name what is no article.
RAW = frozenset("script style textarea title xmp".split())
EMBEDDED = frozenset("noscript iframe template svg math object canvas audio video noembed noframes".split())
#: Elements of these lie within themselves only by a forgotten end tag.
FLAT = EMBEDDED - frozenset("template svg math object".split())
#: What ends the search for an element that a start tag closes.
STOPS = EMBEDDED | {"table"}
P_STOPS, LI_STOPS, DL_STOPS, TABLE, NO_STOPS = STOPS | {"td", "th", "button"}, STOPS | {"ul", "ol", "menu"}, EMBEDDED | {"dl"}, frozenset({"table"}), frozenset()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html head td th tr tbody thead tfoot option caption".split())
NEVER = frozenset("nav footer aside form button select fieldset menu dialog option legend label input head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv adsense adslot adunit advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments respond reply replies disqus discussion pagination pager toolbar search skip tags".split())
#: Those of NOISE_WORDS that name a place in the layout, which can as well hold the article.
WRAPPER_WORDS = frozenset("widget widgets sidebar side rail banner header masthead topbar toolbar notice notices notification alert popup modal overlay lightbox search skip tags".split())
#: Words that may stand beside a noise word in a class name, as may those of an article ("sponsored-content", "post-comments"); with any other word the name says something else.
BESIDE = frozenset("a area articles bar block body bottom box button col column container entries feed footer form global google group inline inner item items left link links list main native outer page posts primary reader readers right secondary section site slot space stories text the thread top unit user users wrap wrapper zone".split())
#: Those of NOISE_WORDS that beside an article's word name a part of the article; words that say what an element has beside it ("has-sidebar").
HEADS, HOLDING = frozenset("banner header masthead".split()), frozenset("has no not with without".split())
ARTICLE_WORDS = frozenset("article post entry story articlebody postcontent entrycontent articlecontent content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _words(label: str) -> set[str]:
    return set(_WORDS.findall(_SPLIT.sub(" ", label).lower()))


def _guess(label: str) -> int:
    """What a whole class name or id says of an element: WRAPPED, OTHERS or 0. A noise word wins over an article's word beside it."""
    words = _words(label)
    noise = words & NOISE_WORDS
    if not noise or words & HOLDING or words - NOISE_WORDS - BESIDE - ARTICLE_WORDS:
        return 0
    if noise - WRAPPER_WORDS:
        return OTHERS
    return 0 if words & ARTICLE_WORDS and not noise - HEADS else WRAPPED


def _of_article(label: str) -> bool:
    """Whether a class name or id says that an element is an article: by an article's word, and no noise word."""
    words = _words(label)
    return bool(ARTICLE_WORDS & {*words, "".join(_WORDS.findall(label.lower()))}) and not words & NOISE_WORDS


@functools.lru_cache(maxsize=50_000)
def _traits(tag: str, attrs: str) -> tuple[str, int, int, str]:
    """Name of an element in paths; why it is noise by itself, or 0; whether it is an article (1: by class, 2: by role); its link target."""
    name, never, article, link = tag, NOTHING if tag in NEVER else 0, 0, ""
    if attrs and not attrs.isspace():
        own = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        labels = f"{own.get('class', '')} {own.get('id', '')}".split()
        classes = " ".join(sorted(set(re.sub(r"\d+", "#", own.get("class", "").lower()).split())))
        name = f"{tag}.{classes}" if classes else tag
        role = own.get("role", "").lower()
        if role in NOISE_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
            never = NOTHING
        elif not never and tag not in ("html", "body", "main"):
            never = max(map(_guess, labels), default=0)
            if tag == "article" and never != OTHERS:
                never = 0  # where an article stands in the layout doesn't matter
        article = 2 if role in ("main", "article") or own.get("itemprop") == "articleBody" else int(tag in ("div", "section", "td") and any(map(_of_article, labels)))
        link = own.get("href", "")
    return name, never, article, link


@functools.lru_cache(maxsize=200_000)
def _child(parent: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{name}") - (1 << 63)


def _value(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def repeat_key(block: Block) -> int:
    """A block's leaf and text in one number."""
    return block.chain[-1] ^ _value(block.text)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-z/!?][^>]*(?:>|\Z)", re.S | re.I)


def copy_key(page: str, host: str) -> int:
    """Equal for pages of a host with the same text; links, markup, scripts, styles and spacing may differ."""
    return xxhash.xxh3_64_intdigest(f"{host} {' '.join(_MARKUP.sub(' ', page).split())}") - (1 << 63)


def _pairs(page: str, tag: str, at: int) -> set[int]:
    """Where the start tags of an embedded element end that have an end tag, from ``at`` on."""
    paired, open_ = set(), []
    for m in re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.S | re.I).finditer(page, at):
        if m[1] is None:
            continue
        if m[1]:
            if open_:
                paired.add(open_.pop())
        elif not m[0].endswith("/>"):
            if tag in FLAT:
                open_.clear()
            open_.append(m.end())
    return paired


class Block:
    """A run of text between block borders, and where it is."""

    __slots__ = ("article", "chain", "links", "skip", "tag", "text")

    def __init__(self, text, chain, tag, skip, article, links):
        self.text, self.chain, self.tag, self.skip, self.article, self.links = text, chain, tag, skip, article, links


class _Open:
    """An open element. ``owner``: the nearest block-level element, itself included; ``chain``: its path of nodes;
    ``own``: whether the last of these is its own."""

    __slots__ = ("article", "block", "chain", "children", "header", "name", "node", "own", "owner", "skip", "tag")

    def __init__(self, tag, name, node, skip, article, header, block, parent):
        self.tag, self.name, self.node, self.skip, self.article, self.header, self.block = tag, name, node, skip, article, header, block
        self.children: list[str] = []
        self.owner = self if block else parent.owner
        self.own = block and parent is not None and node != parent.owner.node
        self.chain = () if not block or not parent else (*parent.owner.chain, node) if self.own else parent.owner.chain


def parse(page: str | None, host: str, with_styles: bool = False) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of a page in order, and (node, style) of each block-level element if asked for.

    ``article`` of a block is 3 inside an article element, 2 inside main or what has such a role, 1 inside of what
    is an article by class, else 0.
    """
    blocks: list[Block] = []
    styles: list[tuple[int, int]] = []
    root = _Open("", "", _child(0, host), 0, 0, False, True, None)
    stack, held, linked, links, at = [root], [], 0, [], 0
    pairs: dict[str, set[int]] = {}
    places: dict[str, list[int]] = {}
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join(raw.split())
            if text:
                top = stack[-1].owner
                skip = top.skip or (NOTHING if top.header and top.tag not in HEADINGS else 0)
                blocks.append(Block(text, top.chain or (root.node,), top.tag, skip, top.article, (min(1.0, linked / len(text)), tuple(links))))
            held.clear()
            links.clear()
            linked = 0

    def close(n: int) -> None:
        """Close all elements from place n of the stack on."""
        if n == len(stack) - 1:
            top = stack[n]
            if top.block:
                flush()
                if with_styles and top.own:
                    styles.append((top.node, xxhash.xxh3_64_intdigest(",".join(top.children)) - (1 << 63)))
            places[top.tag].pop()
            stack.pop()
            return
        blocks_ = [o for o in stack[n:] if o.block]
        if blocks_:
            flush()
            if with_styles:
                styles.extend((o.node, xxhash.xxh3_64_intdigest(",".join(o.children)) - (1 << 63)) for o in reversed(blocks_) if o.own)
        for o in stack[n:]:
            places[o.tag].pop()
        del stack[n:]

    def push(tag: str, name: str, node: int, skip: int, article: int, header: bool, block: bool, top: _Open) -> None:
        if tag in places:
            places[tag].append(len(stack))
        else:
            places[tag] = [len(stack)]
        stack.append(_Open(tag, name, node, skip, article, header, block, top))

    def said(chunk: str) -> None:
        nonlocal linked
        if stack[-1].skip and not stack[-1].owner.skip:
            return  # hidden within a line
        text = entities.unescape(chunk) if "&" in chunk else chunk
        held.append(text)
        if in_link:
            linked += len(text.strip())

    def place_of(tag: str, stop: frozenset) -> int:
        """Place of the last open element of that name; 0 if there is none, or a stop after it."""
        if not (at_ := places.get(tag)):
            return 0
        n = at_[-1]
        if len(stack) - n < 8:
            for o in stack[n + 1 :]:
                if o.tag in stop:
                    return 0
            return n
        for other in stop:
            if (at_ := places.get(other)) and at_[-1] > n:
                return 0
        return n

    page = page or ""
    scan = _TOKEN.match
    find = page.find
    while True:
        lt = find("<", at)
        if lt < 0:
            said(page[at:])
            break
        if lt > at:
            said(page[at:lt])
        m = scan(page, lt) or _LOOSE.match(page, lt)  # the second for a tag whose quotes don't pair
        if not m:
            if lt + 1 < len(page) and (page[lt + 1].isalpha() or page[lt + 1] == "/") and find(">", lt) < 0:
                break  # a tag that the page breaks off in
            end = find(">", lt) if page[lt + 1 : lt + 2] == "/" else -1
            if end < 0:
                held.append("<")
                at = lt + 1
            else:
                at = end + 1  # "</" and no name
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag == "br":
                held.append(" ")
            elif n := place_of(tag, STOPS if tag == "p" or tag not in BLOCKS else TABLE if tag not in ("table", "html", "body") else NO_STOPS):
                close(n)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            held.append(" ")
            at = end.end() if end else len(page)
            continue
        if tag in EMBEDDED:
            held.append(" ")
            if tag not in pairs:
                pairs[tag] = _pairs(page, tag, lt)
            if at in pairs[tag]:  # else it is empty: self-closed, or its end tag is missing
                top = stack[-1]
                push(tag, tag, top.node, NOTHING, top.article, top.header, False, top)
            continue
        if tag in ("br", "wbr", "img"):
            held.append(" " if tag == "br" else "")
            continue
        name, never, article, link = (_traits if len(m[3]) < 500 else _traits.__wrapped__)(tag, m[3])
        if tag in BLOCKS:
            if tag in CLOSES_P and (n := place_of("p", P_STOPS)):
                close(n)
            elif tag in ("td", "th", "tr") and (n := place_of(tag, STOPS)):
                close(n)
            elif tag == "option" and stack[-1].tag == "option":
                close(len(stack) - 1)
            if tag == "li" and (n := place_of("li", LI_STOPS)):
                close(n)
            elif tag in ("dt", "dd") and (n := place_of("dt", DL_STOPS) or place_of("dd", DL_STOPS)):
                close(n)
            flush()
            if tag == "hr":
                continue
        elif tag in VOID:
            continue
        if tag == "a":
            if link:
                links.append(link)
            in_link += 1
        top = stack[-1]
        inside = max(top.article, 3 if tag == "article" else 2 if tag == "main" or article == 2 else article)
        header = tag == "header" or top.header
        skip = top.skip
        if skip and (article == 2 or tag in ("main", "article")):
            if skip == WRAPPED or (skip < NOTHING and tag == "main"):
                skip = 0
            elif skip == OTHERS:
                skip = OTHERS_ARTICLE
        if tag == "header" and not top.article:
            never = NOTHING
        if never:
            skip = OTHERS if skip == OTHERS_ARTICLE and never < NOTHING else max(skip, never)
        block = tag in BLOCKS
        if block:
            parent = top.owner
            if not parent.children or parent.children[-1] != name:  # a run of like children counts once
                parent.children.append(name)
            node = _child(parent.node, name) if len(parent.chain) < DEPTH else parent.node
        else:
            node = top.node
        if block or not m[3].endswith("/"):
            push(tag, name, node, skip, inside, header, block, top)
    close(1)
    flush()
    return blocks, styles


def main_text(page: str | None, host: str, noise) -> str:
    """The text of a page, given the noisy nodes, keys of repeated texts, and keys of leaves that count in a wrapper
    (anything that has ``in``, and is false if empty)."""
    blocks, _ = parse(page, host)
    left = [b for b in blocks if not b.skip or (b.skip == WRAPPED and b.chain[-1] ^ OPENED in noise)]
    if not any(b.article for b in left) and any(b.skip == OTHERS_ARTICLE for b in blocks):
        left = [b for b in blocks if b.skip == OTHERS_ARTICLE]
    if not left:
        left = [b for b in blocks if b.skip < NOTHING]
    bound = max((b.article for b in left), default=0)
    chosen = [b for b in left if b.article == bound] if bound else left
    if bound == 1 and 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in left if b.links[0] < 0.8):
        bound, chosen = 0, left  # a class name alone bounds the text only if that has most of it
    if not bound:  # menus that no tag or class names: lists that are links nearly all
        chosen = [b for b in chosen if not (b.tag in ("li", "td", "div", "ul", "dd") and b.links[0] >= 0.8)]
    kept = [b for b in chosen if not any(n in noise for n in b.chain) and repeat_key(b) not in noise] if noise else chosen
    return "\n\n".join(b.text for b in kept)


STATS = "node long, kind string, value long, n double, x double, p double, chain array<long>"


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in in_parts(b, 1)):
        keys = [copy_key(page, host) if page and (host := host_of(url)) else None for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"copy": pa.array(keys, pa.int64())})


class _Copies:
    """Numbers of pages by copy key, 1 where there is none."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def __getitem__(self, key: int) -> int:
        i = int(np.searchsorted(self.keys, key))
        return int(self.counts[i]) if i < len(self.keys) and int(self.keys[i]) == key else 1


def _statistics(batches: Iterator[pa.RecordBatch], copies=None) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages, with the number of a page's copies from ``copies`` or a third column: pages of each node; occurrences of each style; occurrences
    of each content with n ln n summed over pages, and its pages; the host and the nodes above each content, with 1 where it was in a wrapper."""
    pages: dict[int, float] = {}
    styles: dict[tuple[int, int], float] = {}
    contents: dict[tuple[int, int], list[float]] = {}
    chains: dict[tuple[int, bool], tuple[int, ...]] = {}

    def flush():
        rows = [(k, "pages", 0, float(n), 0.0, 0.0, None) for k, n in pages.items()]
        rows += [(k, "style", s, float(n), 0.0, 0.0, None) for (k, s), n in styles.items()]
        rows += [(k, "content", c, n, x, p, None) for (k, c), (n, x, p) in contents.items()]
        rows += [(k, "chain", int(w), 0.0, 0.0, 0.0, list(c)) for (k, w), c in chains.items()]
        for d in (pages, styles, contents, chains):
            d.clear()
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            names = ("node", "kind", "value", "n", "x", "p", "chain")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for batch in (p for b in batches for p in in_parts(b, 1)):
        counts = [None] * batch.num_rows if copies is not None else batch.column(2).to_pylist()
        for url, page, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts, strict=True):
            host = host_of(url)
            if not page or not host:
                continue
            w = 1.0 / (copies.value[copy_key(page, host)] if copies is not None else count or 1)
            blocks, own = parse(page, host, with_styles=True)
            root = _child(0, host)
            seen = {root}
            for node, style in own:
                seen.add(node)
                styles[node, style] = styles.get((node, style), 0) + w
            here: dict[tuple[int, int], int] = {}
            for b in blocks:
                leaf = b.chain[-1]
                seen.update(b.chain)
                chains.setdefault((leaf, b.skip == WRAPPED), (root, *b.chain[:-1]))
                for c in (b.text, *b.links[1]):
                    key = leaf, _value(c)
                    here[key] = here.get(key, 0) + 1
            for key, n in here.items():
                s = contents.setdefault(key, [0.0, 0.0, 0.0])
                s[0] += w * n
                s[1] += w * n * math.log(n)
                s[2] += w
            for node in seen:
                pages[node] = pages.get(node, 0) + w
        if len(contents) + len(styles) > COUNTERS:
            yield from flush()
    yield from flush()


def _weighted(src: DataFrame) -> DataFrame:
    """Statistics of the pages (u, h), where copies count as one page."""
    light = src.mapInArrow(_copy_keys, "copy long").where("copy is not null")
    many = written(light.groupBy("copy").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    if many.count() <= BROADCAST_NODES:
        rows = many.collect()  # BROADCAST_NODES at most
        held = src.sparkSession.sparkContext.broadcast(_Copies(np.array([r.copy for r in rows], dtype=np.int64), np.array([r.copies for r in rows], dtype=np.int64)))
        return src.mapInArrow(functools.partial(_statistics, copies=held), STATS)
    keyed = src.mapInArrow(_with_copy_key, "u string, h string, copy long")
    return keyed.join(many, "copy", "left").select("u", "h", "copies").mapInArrow(_statistics, STATS)


def _with_copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in in_parts(b, 1)):
        yield from (pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), k.column(0)], names=["u", "h", "copy"]) for k in _copy_keys([batch]))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The tree of ``trees``."""
    return trees(pages, url_col, html_col)[0]


def trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """A written table of the nodes of all hosts' trees on MIN_PAGES pages or more: node, pages,
    content and presentation importance (null where it has none), composite, noise, and opened if it counts in a wrapper.
    Also a table of the keys of texts that most pages of their host repeat."""
    bounded_batches(pages.sparkSession)
    stats = written(_weighted(pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h"))), "tree")
    m = stats.where("kind = 'pages'").groupBy("node").agg(F.round(F.sum("n"), 6).alias("m")).where(F.col("m") >= MIN_PAGES)
    each = stats.where("kind = 'content'").groupBy("node", "value").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.round(F.sum("p"), 6).alias("p"))
    content = each.groupBy("node").agg(F.avg(F.log("n") - F.col("x") / F.col("n")).alias("spread"))
    style = stats.where("kind = 'style'").groupBy("node", "value").agg(F.sum("n").alias("n"))
    style = style.groupBy("node").agg(F.count("*").alias("styles"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))
    tree = m.join(content, "node", "left").join(style, "node", "left")
    share = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.log("m"))))
    tree = tree.select("node", "m", "styles", (1 - share("spread")).alias("content"), share("entropy").alias("presentation"))
    tree = written(tree, "nodes")
    leaves = tree.where("content is not null").select("node", "m", "content")
    chains = stats.where("kind = 'chain'").groupBy("node").agg(F.first("chain").alias("chain"), F.max("value").alias("wrapped"))
    below = leaves.join(chains, "node").select(F.explode(F.concat(F.expr("slice(chain, 2, size(chain))"), F.array("node"))).alias("node"), "m", "content")
    opened = leaves.join(chains, "node").where((F.col("wrapped") == 1) & (F.col("content") >= WORTH)).select("node", F.lit(True).alias("opened"))
    below = below.groupBy("node").agg(F.max("content").alias("most"), (F.sum(F.col("m") * F.col("content")) / F.sum("m")).alias("mean"))
    fade = F.pow(F.lit(DECAY), F.coalesce("styles", F.lit(1)))
    composite = F.when(F.col("presentation").isNull(), F.col("mean")).otherwise((1 - fade) * F.col("presentation") + fade * F.col("mean"))
    own = F.coalesce("content", composite)
    out = tree.join(below, "node").join(opened, "node", "left").withColumn("composite", composite)
    often = each.where(F.col("p") > MIN_PAGES ** (1 - THRESHOLD)).join(chains.select("node", F.col("chain")[0].alias("host")), "node")
    often = often.join(m.withColumnRenamed("node", "host"), "host").where((2 * F.col("p") > F.col("m")) & (1 - F.log("p") / F.log("m") < THRESHOLD))
    repeats = written(often.select(F.col("node").bitwiseXOR(F.col("value")).alias("node")), "repeats")
    return written(out.select("node", "m", "content", "presentation", "composite", ((own < THRESHOLD) & (F.col("most") < THRESHOLD)).alias("noise"), F.coalesce("opened", F.lit(False)).alias("opened")), "importance"), repeats


class _Nodes:
    """A set of nodes as a sorted array."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = np.sort(nodes)
        self.known = frozenset(self.nodes.tolist()) if len(nodes) <= 100_000 else None

    def __len__(self) -> int:
        return len(self.nodes)

    def __contains__(self, node: int) -> bool:
        if self.known is not None:
            return node in self.known
        i = int(np.searchsorted(self.nodes, node))
        return i < len(self.nodes) and int(self.nodes[i]) == node


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with one more column, and its name: the main text of each page."""
    name = free_name(pages, "text")
    tree, repeats = trees(pages, url_col, html_col)
    noise = tree.where("noise").select("node").union(repeats).union(tree.where("opened").select(F.col("node").bitwiseXOR(F.lit(OPENED))))
    fields = [T.StructField(name, T.StringType())]
    n = noise.count()
    blocks = max(1, -(-n // BROADCAST_NODES))
    # the nodes go out in one piece as long as that is small; else each page asks for its own nodes
    if blocks == 1:
        found = np.array([r.node for r in noise.collect()], dtype=np.int64)  # BROADCAST_NODES at most
        held = pages.sparkSession.sparkContext.broadcast(_Nodes(found))
        key = free_name(pages, "page_source")
        src = pages.withColumn(key, F.struct(F.col(url_col).alias("u"), F.col(html_col).alias("h")))
        return _texts(src, key, fields, lambda row: held.value).drop(key), name
    own = free_name(pages, "own_nodes")
    asked = pages.select(F.xxhash64(url_col, html_col).alias("page"), url_col, html_col).mapInArrow(_nodes_of, "page long, node long").distinct()
    mine = asked.join(noise, "node").groupBy("page").agg(F.collect_list("node").alias(own))  # nodes of one page
    page = free_name(pages, "page_key")
    joined = pages.withColumn(page, F.xxhash64(url_col, html_col)).join(mine.withColumnRenamed("page", page), page, "left")
    key = free_name(joined, "page_source")
    src = joined.withColumn(key, F.struct(F.col(url_col).alias("u"), F.col(html_col).alias("h"), F.col(own).alias("o")))
    return _texts(src, key, fields, lambda row: frozenset(row.get("o") or ())).drop(key, own, page), name


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in in_parts(b, 2)):
        keys, nodes = [], []
        for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = {n for b in parse(page, host_of(url))[0] for n in (*b.chain, repeat_key(b), b.chain[-1] ^ OPENED)}
            keys += [key] * len(own)
            nodes += own
        yield pa.RecordBatch.from_pydict({"page": pa.array(keys, pa.int64()), "node": pa.array(nodes, pa.int64())})


def _texts(src: DataFrame, key: str, fields: list[T.StructField], noise_of) -> DataFrame:
    def make():
        def run(rows):
            return [[main_text(r["h"], h := host_of(r["u"]), noise_of(r) if h else ()) for r in rows]]

        return run

    return add_from_text(src, key, fields, make)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    light = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found, text = extract(light)
    return found.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))
