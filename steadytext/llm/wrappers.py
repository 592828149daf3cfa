"""Main text of web pages by wrapper induction.

Pages become trees of blocks, with runs of like siblings folded into one slot. Each host has a
reference page, and every page of the host is aligned with it by simple tree matching. Text
that stays the same where pages are aligned is template; what varies is content. Blocks whose
tag or class says that they are no article (menus, notices, adverts, forms, comments and so on)
are left out whether they vary or not.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from steadytext.llm.scan import pieces
from steadytext.llm.storage import stored
from steadytext.operators.frames import join_lookup

CONSTANT = 0.5         # share of a host's aligned pages that show an item of the template
LEAST_PAGES = 3        # pages that must be aligned before anything is template

# HTML element kinds and the words that mark blocks beside the article.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math",
       "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
          "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search",
          "section", "summary", "table", "ul"}
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
         "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"},
         "p": {"td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "dd"}}
BESIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog",
               "header", "fieldset", "audio", "video", "canvas", "map", "search"}
BESIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb",
                "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
                "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
                "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related",
                "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social",
                "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "form", "search", "dialog",
                "alert", "alertdialog", "menu", "menubar", "toolbar"}

_OPEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_STOP = re.compile(r"[>\"']")
DEPTH = 100            # blocks nested deeper are read as one after another
CELLS = 1 << 20        # cells of a table of child pairs that are held at a time
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                    re.I | re.S)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """A block: its label, whether it lies beside the article, and text or blocks inside."""

    __slots__ = ("tag", "label", "beside", "inside")

    def __init__(self, tag: str, label: str, beside: bool) -> None:
        self.tag, self.label, self.beside, self.inside = tag, label, beside, []


def _node(tag: str, attributes: str, in_article: bool) -> Node:
    marks = {k.lower(): v.strip("\"'").lower() for k, v in _MARKS.findall(attributes)} \
        if attributes else {}
    names = " ".join(sorted(f"{marks.get('class', '')} {marks.get('id', '')}".split()))
    # inside an article a mere part of a name (share-price) says nothing
    words = names.split() if in_article else _WORDS.findall(names)
    beside = (tag in BESIDE_TAGS and not (tag == "header" and in_article)
              or "hidden" in marks or marks.get("role") in BESIDE_ROLES
              or tag not in ("html", "body", "article", "main")
              and any(w in BESIDE_WORDS for w in words))
    return Node(tag, f"{tag} {names}", beside)


def _tag_end(raw: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; -1 if no bracket closes it.

    A bracket inside quotes does not count; a quote that is never closed is no quote.
    """
    while True:
        stop = _STOP.search(raw, at)
        if stop is None:
            return -1
        if stop[0] == ">":
            return stop.end()
        close = raw.find(stop[0], stop.end())
        at = close + 1 if close >= 0 else stop.end()


def _tags(raw: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags; comments and declarations have no name.

    Raw elements (scripts, styles) are one tag up to their end. Reads the page once.
    """
    at = 0
    while found := _OPEN.search(raw, at):
        if found[2] is None:
            close = "-->" if found[0] == "<!--" else ">"
            end = raw.find(close, found.end())
            at = end + len(close) if end >= 0 else len(raw)
            yield found.start(), at, "", "", ""
            continue
        end = _tag_end(raw, found.end())
        if end < 0:        # nothing after it can be a tag either
            return
        name, attributes = found[2].lower(), raw[found.end():end - 1]
        if name in RAW and not found[1] and not attributes.endswith("/"):
            last = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(raw, end)
            close = raw.find(">", last.start()) if last else -1
            end = close + 1 if close >= 0 else len(raw)
        yield found.start(), end, found[1], name, attributes
        at = end


def parse(page: str) -> Node:
    """The tree of a page. Missing end tags are implied; unknown ends are ignored.

    Blocks beyond ``DEPTH`` follow one another at that depth, each of them beside the article if
    one around it is.
    """
    root = Node("#root", "#root", False)
    stack, deep, at = [root], [], 0
    for start, end, slash, tag, attributes in _tags(page):
        if start > at:
            stack[-1].inside.append(page[at:start])
        at = end
        if not tag or tag in RAW or (tag in INLINE and tag not in VOID):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].inside.append(" ")
            continue
        if slash:
            if any(t == tag for t, _ in deep):
                while deep.pop()[0] != tag:
                    pass
                del stack[DEPTH:]
                if deep:       # the rest of the block around it
                    stack.append(Node("#deep", "#deep", any(b for _, b in deep)))
                    stack[-2].inside.append(stack[-1])
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    deep.clear()
                    break
            continue
        ends = {"p"} if tag in ENDS_P else SAME_END.get(tag, ())
        scope = SCOPE["p" if tag in ENDS_P else tag] if ends and tag != "body" else ()
        for i in range(len(stack) - 1, 0, -1):
            if deep:
                break
            if stack[i].tag in ends:
                del stack[i:]
                break
            if stack[i].tag in scope:
                break
        node = _node(tag, attributes, any(n.tag in ("article", "main") for n in stack))
        if len(stack) >= DEPTH:
            if tag == "p" and deep and deep[-1][0] == "p":
                deep.pop()
            deep.append((tag, node.beside))
            node.beside = any(b for _, b in deep)
            del stack[DEPTH:]
        stack[-1].inside.append(node)
        stack.append(node)
    if at < len(page):
        stack[-1].inside.append(page[at:])
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


class Slot:
    """A node of the folded tree: label, items (texts of like leaf siblings) and child slots."""

    __slots__ = ("label", "items", "children", "keep", "main")

    def __init__(self, label: str, keep: bool, main: bool) -> None:
        self.label, self.keep, self.main = label, keep, main
        self.items: list[str] = []
        self.children: list[Slot] = []


def fold(node: Node, keep: bool = True, main: bool = False) -> Slot:
    """Slots of a tree. Consecutive leaf siblings with one label share a slot.

    Text beside child blocks is a block of its own, so that page order is kept.
    """
    keep = keep and not node.beside
    main = main or node.tag in ("article", "main")
    slot, text = Slot(node.label, keep, main), []

    def leaf(label: str, value: str, kept: bool, inner: bool) -> None:
        if not value:
            return
        last = slot.children[-1] if slot.children else None
        if last is None or last.label != label or last.children or last.keep != kept:
            last = Slot(label, kept, inner)
            slot.children.append(last)
        last.items.append(value)

    for child in node.inside:
        if isinstance(child, str):
            text.append(child)
            continue
        leaf("#text", _clean(text), keep, main)
        text.clear()
        if any(not isinstance(x, str) for x in child.inside):
            slot.children.append(fold(child, keep, main))
        else:
            leaf(child.label, _clean(child.inside), keep and not child.beside,
                 main or child.tag in ("article", "main"))
    leaf("#text", _clean(text), keep, main)
    return slot


def _code(text: str) -> int:
    """63-bit code of an item's text."""
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 | zlib.adler32(data) >> 1


def skeleton(page: str) -> tuple:
    """(label, item codes, children) of a page, with no text."""
    def bare(slot: Slot) -> tuple:
        return slot.label, [_code(t) for t in slot.items], [bare(c) for c in slot.children]

    return bare(fold(parse(page)))


def align(page: Slot, reference: tuple) -> dict[int, Slot]:
    """Simple tree matching: reference slot number (preorder) -> slot of the page.

    Roots match if their labels do; children are matched in order so that the number of
    matched slots is largest.
    """
    number, count = {}, 0
    todo = [reference]
    while todo:
        node = todo.pop()
        number[id(node)] = count
        count += 1
        todo.extend(reversed(node[2]))

    numbers: dict[tuple, int] = {}      # structure -> its number
    shape: dict[int, int] = {}          # slot -> number of its structure, equal ones alike
    sizes: dict[tuple[int, int], int] = {}

    def shape_of(node) -> int:
        if id(node) not in shape:
            label, inner = (node.label, node.children) if isinstance(node, Slot) else (node[0], node[2])
            shape[id(node)] = numbers.setdefault((label, *map(shape_of, inner)), len(numbers))
        return shape[id(node)]

    def parted(a: Slot, b: tuple) -> tuple[list, list, list]:
        """Children of one structure at both ends, which belong together, and those between."""
        ours, theirs, low = a.children, b[2], 0
        least = min(len(ours), len(theirs))
        while low < least and shape_of(ours[low]) == shape_of(theirs[low]):
            low += 1
        end = 0
        while end < least - low and shape_of(ours[-1 - end]) == shape_of(theirs[-1 - end]):
            end += 1
        both = [*zip(ours[:low], theirs[:low]), *zip(ours[len(ours) - end:], theirs[len(theirs) - end:])]
        return both, ours[low:len(ours) - end], theirs[low:len(theirs) - end]

    def size_of(a: Slot, b: tuple) -> int:
        """Slots that match at most."""
        if a.label != b[0]:
            return 0
        key = shape_of(a), shape_of(b)
        if key not in sizes:
            both, ours, theirs = parted(a, b)
            sizes[key] = 1 + sum(size_of(x, y) for x, y in both) + (
                int(_last_row(Gains(ours, theirs))[-1]) if ours and theirs else 0)
        return sizes[key]

    class Gains:
        """What matching one of our children with each of theirs adds."""

        def __init__(self, ours: list, theirs: list) -> None:
            self.ours, self.theirs, self.known = ours, theirs, {}
            self.places: dict[str, list[int]] = {}
            for j, y in enumerate(theirs):
                self.places.setdefault(y[0], []).append(j)

        def __len__(self) -> int:
            return len(self.ours)

        def step(self, i: int, line: np.ndarray) -> np.ndarray:
            """The row of best sizes after child ``i``, from the one before it."""
            kind = shape_of(self.ours[i])
            if kind not in self.known:
                at = self.places.get(self.ours[i].label, [])
                self.known[kind] = np.array(at, np.int64), np.array(
                    [size_of(self.ours[i], self.theirs[j]) for j in at], np.int32)
            at, gain = self.known[kind]
            upto = np.searchsorted(at, len(line) - 1)
            at, gain = at[:upto], gain[:upto]
            new = line.copy()
            if upto:
                new[at + 1] = np.maximum(new[at + 1], line[at] + gain)
                np.maximum.accumulate(new, out=new)
            return new

    found, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        if a.label != b[0]:
            continue
        found[number[id(b)]] = a
        both, ours, theirs = parted(a, b)
        todo += both
        if ours and theirs:
            todo += [(ours[i], theirs[j]) for i, j in _in_order(Gains(ours, theirs), len(theirs))]
    return found


def _last_row(gains) -> np.ndarray:
    line = np.zeros(len(gains.theirs) + 1, np.int32)
    for i in range(len(gains)):
        line = gains.step(i, line)
    return line


def _in_order(gains, width: int) -> list[tuple[int, int]]:
    """Pairs (i, j) in order whose gains add up to the most, for lists of any length.

    Rows of the table are kept for a stretch of our children at a time and made again for the
    others, so that long lists take time, not memory.
    """
    pairs: list[tuple[int, int]] = []

    def trace(low: int, high: int, first: np.ndarray, j: int) -> int:
        """Walks back from row ``high``, column ``j`` to row ``low``, whose values are ``first``."""
        if high - low > 1 and (high - low) * (j + 1) > CELLS:
            mid, line = (low + high) // 2, first[:j + 1]
            for i in range(low, mid):
                line = gains.step(i, line)
            return trace(low, mid, first, trace(mid, high, line, j))
        best = [first[:j + 1]]
        for i in range(low, high):
            best.append(gains.step(i, best[-1]))
        i = high - low
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((low + i, j))
        return j

    trace(0, len(gains), np.zeros(width + 1, np.int32), width)
    return pairs


def _slots(reference: tuple) -> list[tuple]:
    out, todo = [], [reference]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node[2]))
    return out


def shared_items(page: str, reference: tuple) -> tuple[list[int], list[tuple[int, int]]]:
    """(slots aligned, (slot, code) of items that page and reference share there).

    A page that shares more than half of the reference's kept items is a copy of it and says
    nothing about the template: nothing is returned.
    """
    tree = fold(parse(page))
    found, slots = align(tree, reference), _slots(reference)
    equal, seen, whole = [], 0, 0
    for place, slot in found.items():
        codes = set(slots[place][1])
        same = {_code(t) for t in slot.items} & codes if codes else set()
        equal += [(place, c) for c in same]
        if slot.keep:
            seen, whole = seen + len(same), whole + len(codes)
    if whole and 2 * seen > whole:
        return [], []
    return list(found), equal


def main_text(page: str, reference: tuple | None = None,
              template: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Blocks of the article, one per line: the page's varying slots.

    Inside <article> or <main> if the page has any, else anywhere in its body. Items of the
    template, and blocks beside the article, are left out.
    """
    tree = fold(parse(page))
    constant: dict[int, set[int]] = {}
    if template:
        for place, slot in align(tree, reference).items():
            constant[id(slot)] = {c for p, c in template if p == place}
    blocks: list[tuple[bool, str]] = []

    def walk(slot: Slot) -> None:
        if slot.keep:
            drop = constant.get(id(slot))
            for text in slot.items:
                if not drop or _code(text) not in drop:
                    blocks.append((slot.main, text))
            for child in slot.children:
                walk(child)

    walk(tree)
    inner = [text for main, text in blocks if main]
    return "\n".join(inner or [text for _, text in blocks])


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


class _Known:
    """Unpickled wrappers of the hosts seen last."""

    def __init__(self) -> None:
        self.held: dict[bytes, tuple] = {}

    def __call__(self, blob: bytes | None):
        if blob is None:
            return None
        if blob not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            self.held[blob] = pickle.loads(blob)
        return self.held[blob]


def induce(pages: DataFrame, constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, wrapper) of every host: reference skeleton and template items, pickled.

    The reference is the page of the host with the smallest hash; all pages of the host vote on
    what is template. Tasks add up their votes before they are shuffled, and a vote counts only
    items of the reference, so a host with a third of all pages has no more rows than others.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")) \
        .where("host IS NOT NULL")
    place = F.xxhash64(F.lit(1), "page_id", "url")
    # a written table has a known size: with few hosts it is broadcast and no page is shuffled
    chosen = stored(rows.groupBy("host").agg(F.min(place).alias("place")))
    first = rows.join(chosen.withColumnRenamed("host", "h"),
                      (F.col("host") == F.col("h")) & (place == F.col("place"))) \
        .groupBy("host").agg(F.min("html").alias("html"))

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(
                [pickle.dumps(skeleton(p or "")) for p in batch.column("html").to_pylist()],
                pa.binary())], ["host", "skeleton"])

    references = stored(first.mapInArrow(bare, "host string, skeleton binary"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, votes = _Known(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(votes)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()),
                 pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([k[2] for k in keys], pa.int64()),
                 pa.array(list(votes.values()), pa.int64())], ["host", "slot", "item", "n"])

        for piece in pieces(batches, "html"):
            for host, page, blob in zip(piece.column("host").to_pylist(),
                                        piece.column("html").to_pylist(),
                                        piece.column("skeleton").to_pylist()):
                slots, equal = shared_items(page or "", known(blob))
                votes.update((host, s, None) for s in slots)
                votes.update((host, s, c) for s, c in equal)
            if len(votes) > 200_000:
                yield out()
                votes.clear()
        if votes:
            yield out()

    votes = join_lookup(rows.select("host", "html"), references, ["host"], "inner") \
        .mapInArrow(vote, "host string, slot long, item long, n long")
    votes = votes.groupBy("host", "slot", "item").agg(F.sum("n").alias("n"))
    aligned = votes.where("item IS NULL").select("host", "slot", F.col("n").alias("aligned"))
    template = votes.where("item IS NOT NULL").join(aligned, ["host", "slot"]).where(
        (F.col("n") >= constant * F.col("aligned")) & (F.col("aligned") >= least_pages)) \
        .groupBy("host").agg(F.collect_set(F.struct("slot", "item")).alias("template"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps((pickle.loads(s), frozenset((x["slot"], x["item"]) for x in t or [])))
                     for s, t in zip(batch.column("skeleton").to_pylist(),
                                     batch.column("template").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(found, pa.binary())], ["host", "wrapper"])

    return references.join(template, "host", "left").select("host", "skeleton", "template") \
        .mapInArrow(packed, "host string, wrapper binary")


def extract(pages: DataFrame, wrappers: DataFrame, out: str = "text") -> DataFrame:
    """The other columns of ``pages`` with the main text in place of ``html``.

    A null or empty page has an empty text. A page without a host, or of a host with too few
    pages to tell, is read without a template.
    """
    kept = [c for c in pages.columns if c not in ("html", out, "wrapper", "_host")]
    joined = join_lookup(
        pages.select(*kept, "html", host_of(F.col("url")).alias("_host")),
        wrappers.withColumnRenamed("host", "_host"), ["_host"]).select(*kept, "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for piece in pieces(batches, "html"):
            found = [main_text(page or "", *(known(blob) or ()))
                     for page, blob in zip(piece.column("html").to_pylist(),
                                           piece.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(found, pa.string())], [*kept, out])

    schema = StructType([pages.schema[c] for c in kept] + [StructField(out, StringType(), False)])
    return joined.mapInArrow(run, schema)
