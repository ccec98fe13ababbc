"""Main text of web pages by equivalence classes of template tokens.

Pass 1 reads every page as tokens: structure tokens (the path of an element, whose roles are told
apart by class, id and place among like siblings) and text tokens (a block's whole text in its
path). Each token's occurrence vector over the pages of a host is aggregated as a mergeable
signature (sums of page hashes), so no host is ever gathered. Tokens of one host with equal
vectors form an equivalence class; a class is valid if it is met on at least half of the host's
pages and the parents of its tokens lie in valid classes, which nests the classes into the host's
template. Between its tokens lie the slots. A text that is in the same class as its path belongs to
the template; a slot whose text comes from a small pool that rotates over the pages, or that is
mostly links, is a menu or an advert. The main slot is the article or main element that holds
most of what is left; a host without one keeps every slot that is left.

Pass 2 reads every page against its host's template: the remaining slots are extracted. Names
count as follows: elements that are declared no part of an article (nav, footer, aside, form, ...)
and names that mark menus, adverts or reader comments go; names that may as well be an article's
own (related, notice, share, ...) decide only over a short or linking text, and no name hides an
element that holds the main slot.

Defined cases: null or empty html gives an empty text; a page without ``://`` in its url has the
host ''; a host of fewer than ``MIN_PAGES`` different pages has no template and is read by its own
structure; a page that has nothing but template text keeps it (copies of one page tell no
template); repeated rows weigh as often as they are and give repeated results; nothing is cut from
long pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.url_rules import host_of
from granary.plans.cluster import cut, join_small

_ATTR = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b{_ATTR}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTR})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Element names, and the words in class, id and role that mark boilerplate.
BOXES = frozenset("html body main article nav header footer aside form section div ul ol table figure dialog details noscript template svg iframe select button".split())
BLOCKS = BOXES | frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd dl figcaption hr address summary caption tbody thead center".split())
BOILER_TAGS = frozenset("nav footer aside form dialog noscript template svg iframe select button".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar ad ads advert adverts advertisement advertising sponsored promo cookie cookies consent newsletter subscribe breadcrumb breadcrumbs pagination pager login popup modal toolbar contentinfo complementary".split()
)
READER_WORDS = frozenset("comment comments disqus reply replies".split())
TIE_WORDS = frozenset("banner notice notices alert social share sharing related recommended search widget skip sponsor hidden header".split())
#: Marks of elements: their own declaration, readers' words, a name, a header, a name that only breaks ties.
DECLARED, READERS, NAMED, HEADER, TIED = 1, 2, 3, 4, 5
#: Pages of a host, of different html, that tell a template, and the share of them that a class needs.
MIN_PAGES, MIN_SHARE = 3, 0.5
#: A constant text is told from chance by pages times words: as a whole slot, and amid text that varies.
EVIDENCE, PART_EVIDENCE = 6, 20
#: A slot rotates if its texts are met so often each on average, and so often together.
ROTATION, ROTATION_MET = 5, 20
#: Share of linked characters of a menu; characters of a text that a tying name decides over.
LINKED, SHORT = 0.6, 200


class Block(NamedTuple):
    path: int
    text: str
    links: int  # characters of it in links
    marks: tuple | None  # innermost first: (depth, mark, outer marks)
    roots: tuple[int, int, int]  # depths of the watched element, the article, the main element; 0: not within


class Element(NamedTuple):
    parent: int
    label: str


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def mark_of(name: str, words: list[str], hidden: bool) -> int:
    if name in BOILER_TAGS or hidden:
        return DECLARED
    if name == "header":
        return HEADER
    if name in ("html", "body"):
        return 0
    kinds = ((READERS, READER_WORDS), (NAMED, BOILER_WORDS), (TIED, TIE_WORDS))
    return next((mark for mark, known in kinds if not known.isdisjoint(words)), 0)


def blocks(page: str, elements: dict[int, Element] | None = None, watch: int = 0) -> Iterator[Block]:
    """The text blocks of a page in order; ``elements`` collects its paths, ``watch`` is one of them."""
    stack: list[tuple] = []
    open_: Counter = Counter()
    path, marks, roots, siblings, barred = 0, None, (0, 0, 0), Counter(), False
    parts: list[tuple[str, bool]] = []
    in_link, at = False, 0

    def flush() -> Iterator[Block]:
        text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
        if text:
            linked = sum(len("".join(entities.unescape(t).split())) for t, a in parts if a)
            yield Block(path, text, linked, marks, roots)
        parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        closing, name = bool(m[2] or m[5]), name.lower()
        if name == "a":
            in_link = not closing
        if name in BLOCKS:
            yield from flush()
        elif name in ("br", "img", "input"):
            parts.append((" ", False))
        if name not in BOXES:
            continue
        if closing:
            if open_[name]:
                while True:
                    last, path, marks, roots, siblings, barred = stack.pop()
                    open_[last] -= 1
                    if last == name:
                        break
            continue
        label, words, hidden = [name], [], False
        for a in ATTRIBUTE.finditer(m[4] or m[7] or ""):
            key = a[1].lower()
            if key in ("class", "id", "role"):
                value = a[2] or a[3] or a[4] or ""
                # numbers of an id are often a page's own
                label.append(f"{key[0]}={'.'.join(value.split()[:4]) if key != 'id' else re.sub(r'[0-9]+', '0', value)}")
                words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            hidden |= key == "hidden"
        stack.append((name, path, marks, roots, siblings, barred))
        open_[name] += 1
        own = " ".join(label)
        siblings[own] += 1
        own += f"[{siblings[own]}]" * (siblings[own] > 1)
        parent, path, siblings = path, _signed(xxhash.xxh64_intdigest(own, path & 0xFFFFFFFFFFFFFFFF)), Counter()
        if elements is not None:
            elements.setdefault(path, Element(parent, own))
        if mark := mark_of(name, words, hidden):
            marks = (len(stack), mark, marks)
        depth, barred = len(stack), barred or mark in (DECLARED, READERS)
        head = 0 if barred or mark == NAMED else depth
        roots = (roots[0] or depth * (path == watch), roots[1] or head * (name == "article"), roots[2] or head * (name == "main" or "r=main" in label))
    if at < len(page):
        parts.append((page[at:], in_link))
    yield from flush()


def text_key(path: int, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), path & 0xFFFFFFFFFFFFFFFF))


TOKENS = "host string, path long, text long, parent long, label string, n long, s1 long, s2 long, chars long, links long, words long"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6)


def page_tokens(page: str, page_key: int) -> Iterator[tuple]:
    """path, text (null: a structure token), parent, label, chars, links, words of each token, once a page."""
    elements: dict[int, Element] = {}
    chars, links, texts = Counter(), Counter(), {}
    for b in blocks(page, elements):
        chars[b.path] += len(b.text)
        links[b.path] += b.links
        texts[b.path, text_key(b.path, b.text)] = (len(b.text), b.links, b.text.count(" ") + 1)
    elements.setdefault(0, Element(0, ""))
    for path, e in elements.items():
        yield path, None, e.parent, e.label, chars[path], links[path], 0
    # the page itself as a text of the root tells how many different pages there are
    yield 0, page_key, None, None, 0, 0, 0
    for (path, text), (n, linked, words) in texts.items():
        yield path, text, None, None, n, linked, words


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors, summed up by host and token as far as a batch goes."""
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def out(seen: dict) -> pa.RecordBatch:
        rows = [[*k, *v] for k, v in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names)

    for batch in batches:
        seen: dict[tuple, list] = {}
        for host, page_id, page in zip(batch["host"].to_pylist(), batch["page_id"].to_pylist(), batch["html"].to_pylist()):
            page = page or ""
            page_key = _signed(xxhash.xxh64_intdigest(page.encode("utf-8", "replace")))
            sign = xxhash.xxh64_intdigest(f"{page_id} {page_key}")
            for path, text, parent, label, chars, links, words in page_tokens(page, page_key):
                row = seen.setdefault((host, path, text), [parent, label, 0, 0, 0, 0, 0, words])
                row[2] += 1
                row[3] += sign >> 32
                row[4] += sign & 0xFFFFFFFF
                row[5] += chars
                row[6] += links
            if len(seen) > 100_000:
                yield out(seen)
                seen = {}
        yield out(seen)


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each host with their occurrence vectors: n pages, s1 and s2 the sums of their hashes' halves."""
    rows = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "page_id", "html").mapInArrow(_vectors, TOKENS)
    total = [F.sum(c).alias(c) for c in ("n", "s1", "s2", "chars", "links")]
    return rows.groupBy("host", "path", "text").agg(F.first("parent").alias("parent"), F.first("label").alias("label"), *total, F.min("words").alias("words"))


def templates(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The template of each host.

    host, main (the main slot's path or ''), constant (paths of slots of template text only),
    classes (the valid classes' paths), main_id, dropped and texts (ids of the main slot, of slots
    that are no article's, of template texts).
    """
    found = cut(tokens(pages))
    structure, texts = found.where("text is null"), found.where("text is not null")
    # how many different texts a slot has and how often they are met; those of the root are the pages
    slots = cut(texts.groupBy("host", "path").agg(F.count("*").alias("kinds"), F.sum("n").alias("met")))
    hosts = structure.where("path = 0").select("host", F.col("n").alias("of")).join(slots.where("path = 0").select("host", F.col("kinds").alias("different")), "host").where(F.col("different") >= MIN_PAGES)
    frame = cut(join_small(structure.where(F.col("n") >= MIN_PAGES), cut(hosts), ["host"]).where(F.col("n") >= F.col("of") * min_share))
    same = ["host", "path", "n", "s1", "s2"]
    # equal vectors: the text is met wherever its path is
    constant = texts.where((F.col("n") >= MIN_PAGES) & (F.col("n") * F.col("words") >= EVIDENCE)).join(frame.select(*same), same)
    shared = constant.groupBy("host").agg(F.collect_list(F.struct("path", "text", "n", "chars", "words")).alias("texts"))
    nodes = frame.join(slots, ["host", "path"], "left").groupBy("host").agg(F.collect_list(F.struct("path", "parent", "label", "n", "s1", "s2", "chars", "links", "kinds", "met")).alias("nodes"))
    return nodes.join(shared, "host", "left").mapInArrow(_nest, "host string, main string, constant array<string>, classes array<array<string>>, main_id long, dropped array<long>, texts array<long>")


def nest(nodes: list[dict], texts: list[dict]) -> tuple[str, list[str], list[list[str]], int, list[int], list[int]]:
    """A host's template from its tokens: see ``templates``."""
    by_id = {t["path"]: t for t in nodes}
    classes: dict[tuple[int, int, int], list[dict]] = {}
    for t in nodes:
        classes.setdefault((t["n"], t["s1"], t["s2"]), []).append(t)
    valid: set[int] = {0}
    for members in sorted(classes.values(), key=lambda c: -c[0]["n"]):
        own = {t["path"] for t in members}
        if all(t["parent"] in own or t["parent"] in valid for t in members):
            valid |= own
    name, marks, depth, tags = {0: ""}, {0: ()}, {0: 0}, {0: ""}

    def place(i: int) -> None:
        todo = []
        while i not in name:
            todo.append(i)
            i = by_id[i]["parent"]
        for i in reversed(todo):
            up, label = by_id[i]["parent"], by_id[i]["label"]
            tag, *more = re.sub(r"\[[0-9]+\]$", "", label).split(" ")
            tags[i] = "main" if "r=main" in more else tag
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(x.partition("=")[2] for x in more)).lower())
            name[i], depth[i] = f"{name[up]}/{label}" if up else label, depth[up] + 1
            mark = mark_of(tag, words, False)
            marks[i] = (*marks[up], (depth[i], mark)) if mark not in (0, TIED) else marks[up]

    for i in valid:
        place(i)
    fixed, fixed_chars = Counter(t["path"] for t in texts), Counter()
    slots = [by_id[i] for i in valid if i and by_id[i]["kinds"]]
    constant = {t["path"] for t in slots if fixed[t["path"]] == t["kinds"]}
    known = [t for t in texts if t["path"] in valid and (t["path"] in constant or t["n"] * t["words"] >= PART_EVIDENCE)]
    for t in known:
        fixed_chars[t["path"]] += t["chars"]
    # of the others: those whose texts rotate, and those of links
    rotating = {t["path"] for t in slots if t["met"] >= max(ROTATION_MET, ROTATION * t["kinds"])}
    menus = {t["path"] for t in slots if t["links"] >= LINKED * t["chars"]}
    kept = {t["path"]: t["chars"] - fixed_chars[t["path"]] for t in slots if t["path"] not in rotating}

    def held(root: int) -> int:
        """Characters within the root that nothing below it marks."""
        return sum(n for i, n in kept.items() if _within(i, root, by_id) and all(d <= depth[root] for d, _ in marks[i]))

    heads = [i for i in valid if tags[i] in ("article", "main") and all(mark == NAMED and d < depth[i] for d, mark in marks[i])]
    beside = sum(n for i, n in kept.items() if not marks[i] and i not in menus)
    good = [h for h in heads if (n := held(h)) and n >= beside - sum(x for i, x in kept.items() if not marks[i] and i not in menus and _within(i, h, by_id))]
    main = max(good, key=lambda h: (depth[h], held(h), h), default=0)
    # a list of links within the main slot is the article's own
    dropped = rotating | {i for i in menus if not (main and _within(i, main, by_id))}
    shown = [sorted(name[t["path"]] for t in c if t["path"] in valid and t["path"]) for c in classes.values()]
    return name[main], sorted(name[i] for i in constant), sorted(c for c in shown if c), main, sorted(dropped), sorted(t["text"] for t in known)


def _within(i: int, root: int, by_id: dict[int, dict]) -> bool:
    while i and i != root:
        i = by_id[i]["parent"]
    return i == root


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["main", "constant", "classes", "main_id", "dropped", "texts"]
    for batch in batches:
        out = [nest(n, t or []) for n, t in zip(batch["nodes"].to_pylist(), batch["texts"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["host"], *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], ["host", *names])


def main_text(page: str, main: int = 0, dropped: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """The page's remaining slots: blocks, joined by an empty line."""
    read = list(blocks(page, watch=main))

    def hidden(b: Block, root: int, names: bool) -> bool:
        """Whether an element within the root hides the block; without ``names`` by its own declaration only."""
        marks = b.marks
        while marks and marks[0] > root:
            if marks[1] == DECLARED or names and (marks[1] in (READERS, NAMED) or marks[1] == HEADER and not root or marks[1] == TIED and tied[id(marks)]):
                return True
            marks = marks[2]
        return False

    # what a tying name decides over: the texts within its element
    size, linked, tied = Counter(), Counter(), {}
    for b in read:
        marks = b.marks
        while marks:
            if marks[1] == TIED:
                size[id(marks)] += len(b.text)
                linked[id(marks)] += b.links
            marks = marks[2]
    for k, n in size.items():
        tied[k] = linked[k] >= LINKED * n or (n < SHORT and not main)

    if main and any(b.roots[0] for b in read):
        place = 0
    else:
        # without a template: the article or main element that holds most of what is not hidden
        place = None
        for k in (1, 2):
            own = sum(len(b.text) for b in read if b.roots[k] and not hidden(b, b.roots[k], True))
            if own and own >= sum(len(b.text) for b in read if not b.roots[k] and not hidden(b, 0, True)):
                place = k
                break

    def choose(names: bool, template: bool) -> list[str]:
        out = []
        for b in read:
            root = b.roots[place] if place is not None else 0
            if place is not None and not root or hidden(b, root, names):
                continue
            if template and (b.path in dropped or text_key(b.path, b.text) in texts):
                continue
            out.append(b.text)
        return out

    return "\n\n".join(choose(True, True) or choose(True, False) or choose(False, False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("html", "main_id", "dropped", "texts"))
        texts = [main_text(page or "", main or 0, frozenset(dropped or ()), frozenset(fixed or ())) for page, main, dropped, fixed in zip(*columns)]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id long, url, html, ...) -> page_id, url, text, n_chars."""
    found = cut(templates(pages).select("host", "main_id", "dropped", "texts"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    joined = join_small(rows, found, ["host"], "left")
    return joined.select("page_id", "url", "html", "main_id", "dropped", "texts").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
