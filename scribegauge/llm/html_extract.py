"""Main-text extraction by wrapper induction.

Pages of a host are aligned with a reference tree of the host by simple tree
matching (the largest order-preserving match of two labelled trees).  The
reference is grown from all pages of the host: nodes of a page without a
partner are merged into it, first inside each task, then over the tasks.
Siblings are nodes of their own, whatever their labels.  A slot that has the
same text on all its pages, of which at least ``MIN_PAGES`` differ, is template;
one whose text varies is content.  Pages with the same text count once.  Slots
seen on too few pages are undecided; where the page marks its article
(``article`` or ``main``) the mark decides them, else they are kept.  Elements
that say what they are (menus, headers, footers, forms, adverts, notices,
comments and so on) are never content, but the headings in an article's header
are.  A block has the slot of its block element, whatever inline elements are in
it; inline elements that are no content leave the block in one piece.

Statistics cover all pages: three scans, one aggregation by host of the trees
grown inside each task, one by (host, slot) with partial sums, and joins of one
row per host, which is broadcast if its measured size is small and joined by a
split shuffle if not.  How pages are spread over tasks can change the order in
which a reference grows, and so which of several equally large matches is taken.

Defined results: null html gives an empty text; a null or host-less url has no
wrapper, so only the element roles count; broken markup, open elements and cut
tags are closed as browsers do; repeated rows are extracted each; an empty
table gives no rows; extra columns are ignored.  Text nested deeper than
``MAX_DEPTH`` is part of the slot around it there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, checkpointed, map_rows
from .url_filter import url_host

#: Elements nested deeper belong to the slot of the one they are in at this depth.
MAX_DEPTH = 200
#: Different pages from which on a slot is decided: template with one text, content with several.
MIN_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head nav header footer aside form script style noscript iframe template button select option textarea "
    "dialog menu object svg canvas audio video title input label fieldset".split()
)
#: Words in class, id or role that mark an element as something other than content.
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside header masthead footer foot "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies discussion respond share sharing social related recommended "
    "recommendations pagination pager toolbar widget tags search contentinfo complementary form legal copyright".split()
)
#: A start tag of the key closes an open element of the values.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("table ul ol dl body html div section article main td".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Za-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no class, id or role takes out.
WHOLE = frozenset("html body main article".split())


class Page:
    """Blocks and slot tree of one page."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, bool, int]] = []  # text, inside article or main, slot
        self.labels: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.has_main = False

    def shape(self) -> str:
        return "\n".join(f"{p} {name}" for p, name in zip(self.parents, self.labels))


@functools.lru_cache(maxsize=4096)
def _role(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Label of an element for alignment, whether its tag is never content, and whether a class, id or role says so."""
    named, marked = "", False
    for kind, a, b, c in ATTRIBUTE.findall(attrs):
        kind, value = kind.lower(), a or b or c
        if kind not in ("class", "id", "role"):
            continue
        marked = marked or any(token in ROLE_WORDS for token in value.lower().split())
        words = WORD.findall(value)
        if kind == "class" and words and not named:
            named = "." + words[0].lower()
    return tag + named, tag in NEVER, marked and tag not in WHOLE


class Open(NamedTuple):
    """An open element: whether its text is never content, or only that of headings is, and where it stands."""

    tag: str
    never: bool
    headings_only: bool
    around: tuple[int, ...]  # marked elements
    main: bool
    slot: int
    block: int  # slot of the block that it is in


def parse(html: str) -> Page:
    page = Page()
    stack = [Open("#root", False, False, (), False, 0, 0)]
    parts: list[tuple[str, tuple[int, ...]]] = []
    holder = (False, 0)
    marks = 0
    cleared: set[int] = set()  # marked elements that hold an article or main
    blocks: list[tuple[list[tuple[str, tuple[int, ...]]], bool, int]] = []

    def flush() -> None:
        nonlocal parts
        if parts:
            blocks.append((parts, *holder))
            parts = []

    def add(raw: str) -> None:
        nonlocal holder
        top = stack[-1]
        if not raw:
            return
        if top.never or top.headings_only:
            if parts:
                parts.append((" ", ()))
            return
        if not parts:
            holder = (top.main, top.block)
        parts.append((unescape(raw) if "&" in raw else raw, top.around))

    def close_to(depth: int) -> None:
        if any(entry.tag in BLOCK for entry in stack[depth:]):
            flush()
        del stack[depth:]

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if found is None:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            if parts:
                parts.append((" ", ()))
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in SCOPE:
                    break
            flush()
        for closed in CLOSES.get(tag, ()):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == closed:
                    close_to(depth)
                    break
                if stack[depth].tag in SCOPE and stack[depth].tag not in ("td", "th"):
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
            at = size if end is None else end.start()
            if end is not None:
                close = html.find(">", at)
                at = size if close < 0 else close + 1
            continue
        label, never, marked = _role(tag, found[3])
        outer = stack[-1]
        around, slot, headings_only = outer.around, outer.slot, outer.headings_only and tag not in HEADINGS
        if marked:
            marks += 1
            around = (*around, marks)
        if len(stack) <= MAX_DEPTH:
            page.labels.append(label)
            page.parents.append(slot)
            slot = len(page.labels) - 1
        if tag == "header" and outer.main and not outer.never:
            never, headings_only = False, True  # it holds the title of the article
        never = never or outer.never
        is_main = tag in ("article", "main") and not never
        page.has_main = page.has_main or is_main
        if is_main:
            cleared.update(around)
        stack.append(Open(tag, never, headings_only, around, is_main or outer.main, slot, slot if tag in BLOCK else outer.block))
    flush()
    for held, main, slot in blocks:
        text = " ".join("".join(text for text, around in held if cleared.issuperset(around)).split())
        if text:
            page.blocks.append((text, main, slot))
    return page


class Tree(NamedTuple):
    """Nodes in document order; equal subtrees have equal codes."""

    labels: list[str]
    kids: list[list[int]]
    sizes: list[int]
    codes: list[int]


@functools.lru_cache(maxsize=256)
def _tree(shape: str) -> Tree:
    labels, kids, parents = [], [], []
    for i, line in enumerate(shape.split("\n")):
        parent, _, label = line.partition(" ")
        parents.append(int(parent))
        labels.append(label)
        kids.append([])
        if parents[i] >= 0:
            kids[parents[i]].append(i)
    sizes, codes = [1] * len(labels), [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        codes[i] = xxhash.xxh3_64_intdigest(f"{labels[i]} {[codes[k] for k in kids[i]]}")
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]
    return Tree(labels, kids, sizes, codes)


@functools.lru_cache(maxsize=256)
def simple_tree_matching(shape: str, reference: str) -> tuple[int, ...]:
    """Node of ``reference`` for each node of ``shape``, or -1."""
    one, two = _tree(shape), _tree(reference)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def score(a: int, b: int) -> int:
        """Size of the match of two nodes of the same label; equal subtrees match in whole."""
        return one.sizes[a] if one.codes[a] == two.codes[b] else matched(a, b)[0]

    def matched(a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        key = one.codes[a], two.codes[b]
        if key in known:
            return known[key]
        left, right = one.kids[a], two.kids[b]
        # Equal subtrees at the heads and the tails of two lists can always be matched first.
        head, most = 0, min(len(left), len(right))
        while head < most and one.codes[left[head]] == two.codes[right[head]]:
            head += 1
        tail = 0
        while tail < most - head and one.codes[left[-1 - tail]] == two.codes[right[-1 - tail]]:
            tail += 1
        rows, cols = left[head : len(left) - tail], right[head : len(right) - tail]
        best = [[0] * (len(cols) + 1)]
        for x in rows if cols else ():
            above, row, label = best[-1], [0], one.labels[x]
            for j, y in enumerate(cols):
                top = max(above[j + 1], row[j])
                row.append(max(top, above[j] + score(x, y)) if label == two.labels[y] else top)
            best.append(row)
        pairs = [(k, k) for k in range(head)] + [(len(left) - 1 - k, len(right) - 1 - k) for k in range(tail)]
        i, j = len(best) - 1, len(cols)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((head + i, head + j))
        equal = sum(one.sizes[x] for x in (*left[:head], *left[len(left) - tail :]))
        known[key] = best[-1][-1] + equal + 1, pairs
        return known[key]

    mapped = [-1] * len(one.labels)
    todo = [(0, 0)] if one.labels[0] == two.labels[0] else []
    while todo:
        a, b = todo.pop()
        if one.codes[a] == two.codes[b]:
            mapped[a : a + one.sizes[a]] = range(b, b + one.sizes[a])
            continue
        mapped[a] = b
        todo.extend((one.kids[a][i], two.kids[b][j]) for i, j in matched(a, b)[1])
    return tuple(mapped)


def merge_trees(reference: str, shape: str) -> str:
    """``reference`` with the nodes of ``shape`` that have no partner in it, each before the next that has one."""
    mapped = simple_tree_matching(shape, reference)
    if -1 not in mapped:
        return reference
    one, two = _tree(shape), _tree(reference)
    partner = {b: a for a, b in enumerate(mapped) if b >= 0}
    lines: list[str] = []

    def write(parent: int, a: int | None, b: int | None) -> None:
        """Write the node ``a`` of the page and ``b`` of the reference, which are one if both are given."""
        at = len(lines)
        lines.append(f"{parent} {two.labels[b] if b is not None else one.labels[a]}")
        left, i = (one.kids[a] if a is not None else []), 0
        for y in two.kids[b] if b is not None else ():
            x = partner.get(y)
            if x is not None:
                while left[i] != x:
                    write(at, left[i], None)
                    i += 1
                i += 1
            write(at, x, y)
        for x in left[i:]:
            write(at, x, None)

    write(-1, 0, 0)
    return "\n".join(lines)


def main_text(
    html: str, reference: str | None = None, template: frozenset[int] = frozenset(), content: frozenset[int] = frozenset()
) -> str:
    """Text of one page, given its host's reference tree and decided slots."""
    page = parse(html)
    mapped = simple_tree_matching(page.shape(), reference) if reference is not None and (template or content) else None
    kept = []
    for text, main, slot in page.blocks:
        node = -1 if mapped is None else mapped[slot]
        if node in content or (node not in template and (main or not page.has_main)):
            kept.append(text)
    return "\n\n".join(kept)


SLOTS = pa.schema(
    [("host", pa.string()), ("slot", pa.int32()), ("pages", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())]
)


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _slot_statistics(pages: DataFrame) -> DataFrame:
    """``host, slot, n, low, high`` over all pages; expects ``host, html, reference``.

    ``n`` counts pages with different texts, exactly up to ``MIN_PAGES``.
    """

    def batch(found: dict) -> pa.RecordBatch:
        rows = [(h, s, *v) for (h, s), v in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SLOTS)], schema=SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[list[int], int, int]] = {}
        for part in batches:
            for host, html, reference in zip(*(part.column(i) for i in range(3))):
                page, host = parse(html.as_py() or ""), host.as_py()
                if not page.blocks:
                    continue
                mapped = simple_tree_matching(page.shape(), reference.as_py())
                told = _code("\n".join(text for text, _, _ in page.blocks))
                texts: dict[int, list[str]] = {}
                for text, _, slot in page.blocks:
                    texts.setdefault(mapped[slot], []).append(text)
                texts.pop(-1, None)
                for slot, held in texts.items():
                    code = _code("\n".join(held))
                    seen, low, high = found.get((host, slot), ([], code, code))
                    if len(seen) < MIN_PAGES and told not in seen:
                        seen = [*seen, told]
                    found[host, slot] = (seen, min(low, code), max(high, code))
            if len(found) > 100_000:
                yield batch(found)
                found = {}
        if found:
            yield batch(found)

    schema = "host string, slot int, pages array<long>, low long, high long"
    sent = pages.select("host", "html", "reference").mapInArrow(run, schema)
    told = F.size(F.array_distinct(F.flatten(F.collect_list("pages"))))
    return sent.groupBy("host", "slot").agg(told.alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


TREES = pa.schema([("host", pa.string()), ("reference", pa.string())])
#: Characters of grown trees that a task holds before it sends them on.
TREE_CHARS = 32 << 20


def grow_references(hosted: DataFrame) -> DataFrame:
    """``host, reference``: the merged tree of all pages of each host that have any element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown: dict[str, str] = {}
        held = 0
        for part in batches:
            for host, html in zip(part.column(0), part.column(1)):
                page, host = parse(html.as_py() or ""), host.as_py()
                if len(page.labels) == 1 and not page.blocks:
                    continue
                before = grown.get(host)
                grown[host] = page.shape() if before is None else merge_trees(before, page.shape())
                held += len(grown[host]) - len(before or "")
            if held > TREE_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in zip(*grown.items())], schema=TREES)
                grown, held = {}, 0
        if grown:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in zip(*grown.items())], schema=TREES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One tree at a time: rows come by host."""
        current: tuple[str, str] | None = None
        for part in batches:
            for host, tree in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if current is not None and current[0] == host:
                    current = host, merge_trees(current[1], tree)
                    continue
                if current is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in current], schema=TREES)
                current = host, tree
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in current], schema=TREES)

    schema = "host string, reference string"
    sent = hosted.select("host", "html").mapInArrow(run, schema).distinct()
    return sent.repartition("host").sortWithinPartitions("host", "reference").mapInArrow(merge, schema)


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host, reference, template, content``: one row per host with decided slots; expects ``host, html``."""
    hosted = pages.where("host != ''")
    references = checkpointed(grow_references(hosted))
    stats = _slot_statistics(hosted.join(broadcast_if_small(references), "host")).where(F.col("n") >= MIN_PAGES)
    constant = F.col("low") == F.col("high")
    decided = stats.groupBy("host").agg(
        F.collect_list(F.when(constant, F.col("slot"))).alias("template"),
        F.collect_list(F.when(~constant, F.col("slot"))).alias("content"),
    )
    return checkpointed(references.join(decided, "host"))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    hosted = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    wrapped = hosted.join(broadcast_if_small(induce_wrappers(hosted)), "host", "left")

    def setup():
        def process(cols):
            out = []
            for page_id, url, html, reference, template, content in zip(*cols):
                text = main_text(html or "", reference, frozenset(template or ()), frozenset(content or ()))
                out.append((page_id, url, text, len(text)))
            return out

        return process

    return map_rows(
        wrapped, ["page_id", "url", "html", "reference", "template", "content"],
        "page_id long, url string, text string, n_chars long", TEXTS, setup, slice_rows=128,
    )
