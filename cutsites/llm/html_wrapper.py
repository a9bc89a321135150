"""Main text of web pages by wrapper induction.

Pages of a host are folded into a wrapper: a tree in which neighbouring siblings of one kind (tag and class) are one repeated
node. Each page's tree is aligned with it by simple tree matching (the largest set of matched nodes that keeps order and ancestry),
and every wrapper node counts the pages and texts it met. Texts that a node shows on nearly all pages of a host are template;
what varies is content, within the region of the page that holds the article.

All pages of a host take part. A task folds the pages it reads (no shuffle of html), and partial wrappers, a few KB each whatever the
number of pages, merge in two levels. A wrapper has at most ``NODES`` nodes: nodes of pages that are unlike the others count as varying, so
nothing of them is lost. Texts are counted exactly: the pages that show a text at a path of kinds, as an aggregate over (host,
path, text); a path of the wrapper gets the texts of nearly all pages that have it.

Null and empty pages give an empty text. A null or odd url belongs to the host ''. Equal and repeated pages give equal rows. Broken markup
is read like a browser would: unclosed and stray tags, unquoted attributes, missing ends; what elements nested deeper than ``DEPTH`` hold
counts as standing beside them, but for elements that are never part of the article. An empty table gives an empty result.

A host of fewer than ``LEAST_PAGES`` pages has no template: too few pages to tell constant from varying.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.common import ship, written

NODES, DEPTH = 400, 120
CONSTANT, LEAST_PAGES = 0.9, 4

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("caption tbody td tfoot th thead tr option optgroup legend summary head body html dd dt li".split())
SKIPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav footer aside form button select textarea input "
    "datalist dialog menu title".split()
)
# Words of a class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription nav navbar navigation menu menus sidebar breadcrumb breadcrumbs footer masthead "
    "topbar toolbar comment comments reply replies discussion disqus respond share sharing social related recommended recommendations widget widgets "
    "pagination pager login signup signin search skip contentinfo complementary dialog toc byline-share".split()
)
# Words that say nothing beside those: "share-buttons" is off, "market-share" is not.
NEUTRAL = frozenset(
    "area article articles bar bars block blocks bottom box boxes button buttons column container global group head holder icon icons inner item items "
    "left link links list main outer page panel post posts primary right row secondary section site slot stories title top unit wrap wrapper zone".split()
)
OFF = "!off"  # among a node's words: one of its names is of that kind
CONTENT = frozenset("articlebody article-body post-content entry-content article-content story-body post-body".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S,
)
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 14)
def named_off(name: str) -> bool:
    """Whether a whole class, id or role marks what is not the article: itself, or all its words that are not neutral."""
    words = frozenset(w for w in _WORD.split(_CAMEL.sub(" ", name).lower()) if w) - NEUTRAL
    return name.lower() in NOT_ARTICLE or bool(words) and words <= NOT_ARTICLE


class Node:
    """An element: ``kind`` is tag and class, ``parts`` are its children and texts in order."""

    __slots__ = ("tag", "kind", "words", "parts", "hidden")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.parts, self.words, self.kind, self.hidden = tag, [], frozenset(), tag, False
        if attributes:
            marks = []
            for name, *values in _MARKS.findall(attributes):
                value = "".join(values)
                if name.lower() in ("hidden", "aria-hidden"):
                    self.hidden |= value.lower() in ("", "hidden", "true", "until-found")
                else:
                    marks.append(value)
            if marks:
                joined = " ".join(marks)
                self.words = frozenset(_WORD.split(_CAMEL.sub(" ", joined).lower())) | frozenset(joined.lower().split())
                if any(map(named_off, joined.split())):
                    self.words |= {OFF}
                self.kind = f"{tag}.{marks[0].split()[0] if marks[0].split() else ''}"

    @property
    def children(self) -> list["Node"]:
        return [p for p in self.parts if type(p) is Node]

    def off(self, in_article: bool) -> bool:
        """Whether the element is of a kind that is never part of the article."""
        if self.tag in SKIPPED or self.hidden or (self.tag == "header" and not in_article):
            return True
        return OFF in self.words and self.tag not in ("body", "html", "article", "main") or ("header" in self.words and not in_article and self.tag not in ("body", "html", "article", "main"))


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    open_, depth = [root], [0]  # depth: of the tree, at each open element
    at, n = 0, len(page)

    def close(names: Iterable[str], until: frozenset[str] = frozenset()) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                del open_[k:], depth[k:]
                return
            if open_[k].tag in until:
                return

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            open_[-1].parts.append(page[at:])
            break
        if cut > at:
            open_[-1].parts.append(page[at:cut])
        found = _TOKEN.match(page, cut) or _LOOSE.match(page, cut)
        if not found:
            open_[-1].parts.append("<")
            at = cut + 1
            continue
        at = found.end()
        loose = found.re is _LOOSE
        ended, begun = (None, found.group(1)) if loose else found.group(1, 2)
        if ended:
            close((ended.lower(),), frozenset(("table",)) if ended.lower() in ("p", "li") else frozenset())
            if ended.lower() == "br":
                open_[-1].parts.append(Node("br"))
        elif begun:
            tag = begun.lower()
            if tag in CLOSES_P:
                close(("p",), frozenset(("button", "table", "td", "th", "article", "div", "section", "body")))
            if tag == "li":
                close(("li",), frozenset(("ul", "ol", "menu")))
            elif tag in ("dd", "dt"):
                close(("dd", "dt"), frozenset(("dl",)))
            elif tag in ("td", "th"):
                close(("td", "th"), frozenset(("table",)))
            elif tag == "tr":
                close(("tr",), frozenset(("table",)))
            elif tag == "option":
                close(("option",), frozenset(("select", "datalist")))
            attributes = found.group(2 if loose else 3)
            node = Node(tag, attributes)
            open_[-1].parts.append(node)
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(page, at)
                stop = end.start() if end else n
                node.parts.append(page[at:stop])
                rest = page.find(">", stop)
                at = n if not end or rest < 0 else rest + 1
            elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in ("p", "div", "a", "li"):
                if depth[-1] >= DEPTH and not node.off(True):
                    node = Node(tag)
                    node.parts = open_[-1].parts  # what it holds stands beside it
                    open_.append(node), depth.append(depth[-1])
                elif depth[-1] < 2 * DEPTH:  # below that, all is inside what is off
                    open_.append(node), depth.append(depth[-1] + 1)
    return root


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def own_text(node: Node) -> str:
    """Text of a node outside its block children."""
    out: list[str] = []

    def walk(x: Node) -> None:
        for p in x.parts:
            if type(p) is str:
                out.append(p)
            elif p.tag == "br":
                out.append(" ")
            elif p.tag not in BLOCKS and p.tag not in SKIPPED and not p.hidden:
                walk(p)

    walk(node)
    return squeezed("".join(out))


class Slot:
    """A wrapper node: neighbouring siblings of one kind, over all pages folded into it.

    ``texts`` are those of one page, ``shown`` the sum of their numbers over the pages. ``path`` and ``constant`` (page counts of the
    texts that nearly all pages with the node show) are set by ``prepared``.
    """

    __slots__ = ("kind", "tag", "words", "pages", "chars", "links", "shown", "texts", "kids", "instances", "path", "constant")

    def __init__(self, kind: str, tag: str, words: Iterable[str]) -> None:
        self.kind, self.tag, self.words = kind, tag, frozenset(words)
        self.pages = self.chars = self.links = self.shown = self.path = 0
        self.texts: set[str] = set()
        self.constant: dict[int, int] = {}
        self.kids: list[Slot] = []
        self.instances: list[Node] = []

    def state(self) -> list:
        return [self.kind, self.tag, sorted(self.words), self.pages, self.chars, self.links, self.shown, [k.state() for k in self.kids]]

    @staticmethod
    def load(state: list) -> "Slot":
        slot = Slot(*state[:3])
        slot.pages, slot.chars, slot.links, slot.shown = state[3:7]
        slot.kids = [Slot.load(k) for k in state[7]]
        return slot


def _key(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


@lru_cache(1 << 16)
def _below(path: int, kind: str) -> int:
    """The path of a node of a kind below a path."""
    return _key(f"{path}/{kind}")


def shown_text(node: Node) -> str:
    """The text that counts as a node's own."""
    if node.tag in RAW:
        return ""
    return own_text(node) if node.tag in BLOCKS else squeezed("".join(p for p in node.parts if type(p) is str))


def page_texts(root: Node) -> set[tuple[int, int]]:
    """Path and key of every text of a page, once each."""
    found, open_ = set(), [(root, _below(0, root.kind))]
    while open_:
        node, path = open_.pop()
        text = shown_text(node)
        if text:
            found.add((path, _key(text)))
        open_ += [(kid, _below(path, kid.kind)) for kid in node.children]
    return found


def slots_of(nodes: list[Node], inside_link: bool = False) -> Slot:
    """The tree of one page: ``nodes`` are neighbouring siblings of one kind."""
    first = nodes[0]
    slot = Slot(first.kind, first.tag, first.words)
    slot.pages, slot.instances = 1, nodes
    runs: list[list[Node]] = []
    for node in nodes:
        text = shown_text(node)
        if text:
            slot.texts.add(text)
            slot.chars += len(text)
            slot.links += len(text) if inside_link or node.tag == "a" else 0
        kids = node.children
        for k, kid in enumerate(kids):
            if k and kid.kind == kids[k - 1].kind:
                runs[-1].append(kid)
            else:
                runs.append([kid])
    slot.shown = len(slot.texts)
    for run in runs:
        made = slots_of(run, inside_link or first.tag == "a")
        same = next((s for s in slot.kids if s.kind == made.kind), None) if len(nodes) > 1 else None
        if same is None:
            slot.kids.append(made)
        else:  # repeated siblings share their children
            fold(same, made, pages=False)
            same.instances = same.instances + made.instances
    return slot


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[int, int, list]]]:
    """Simple tree matching of trees with equal roots: number of matched nodes, and matched children (with theirs)."""
    x, y = a.kids, b.kids
    if not x or not y:
        return 1, []
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, len(x) + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, len(y) + 1):
            value = above[j] if above[j] >= row[j - 1] else row[j - 1]
            if x[i - 1].kind == y[j - 1].kind:
                pairs[i, j] = found = match(x[i - 1], y[j - 1])
                value = max(value, above[j - 1] + found[0])
            row[j] = value
    out, i, j = [], len(x), len(y)
    while i and j:
        if (i, j) in pairs and best[i][j] == best[i - 1][j - 1] + pairs[i, j][0]:
            out.append((i - 1, j - 1, pairs[i, j][1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], out[::-1]


def size(slot: Slot) -> int:
    return 1 + sum(size(k) for k in slot.kids)


def fold(wrapper: Slot, page: Slot, matched: list | None = None, pages: bool = True, room: list[int] | None = None) -> None:
    """Merge a tree into a wrapper along their alignment; unmatched nodes join behind their left neighbour."""
    if matched is None:
        matched = match(wrapper, page)[1]
    if room is None:
        room = [NODES - size(wrapper)]
    wrapper.pages += page.pages if pages else 0
    wrapper.chars, wrapper.links = wrapper.chars + page.chars, wrapper.links + page.links
    if pages:
        wrapper.shown += page.shown
    else:  # siblings of one page show a text once
        wrapper.texts |= page.texts
        wrapper.shown = len(wrapper.texts)
    partner = {j: (i, inner) for i, j, inner in matched}
    kids, taken = [], 0
    for j, kid in enumerate(page.kids):
        if j in partner:
            i, inner = partner[j]
            kids += wrapper.kids[taken:i]
            fold(wrapper.kids[i], kid, inner, pages, room)
            kids.append(wrapper.kids[i])
            taken = i + 1
        elif (need := size(kid)) <= room[0]:
            room[0] -= need
            kids.append(kid)
    wrapper.kids = kids + wrapper.kids[taken:]


def _off(slot: Slot, in_article: bool) -> bool:
    probe = Node(slot.tag)
    probe.words = slot.words
    return probe.off(in_article)


def content_slot(wrapper: Slot) -> Slot:
    """The node that holds the article: an article or main element, else the densest part of varying text."""
    def weight(slot: Slot, in_article: bool = False) -> float:
        if _off(slot, in_article):
            return 0
        inside = in_article or slot.tag in ("article", "main")
        varying = slot.chars - 2 * slot.links
        constant = slot.pages >= LEAST_PAGES and sum(slot.constant.values()) >= CONSTANT * max(slot.shown, 1)
        return (0 if constant else max(varying, 0)) + sum(weight(k, inside) for k in slot.kids)

    def every(slot: Slot) -> Iterator[Slot]:
        if not _off(slot, True):
            yield slot
            for kid in slot.kids:
                yield from every(kid)

    def named(slot: Slot) -> int:
        if slot.tag == "article" or slot.words & CONTENT:
            return 3
        return 2 if slot.tag == "main" or "main" in slot.words else 1 if slot.tag in ("div", "section") and slot.words & CONTENT_WORDS else 0

    candidates = list(every(wrapper))
    for rank in (3, 2, 1):
        found = [s for s in candidates if named(s) == rank]
        if found:
            best = max(found, key=lambda s: weight(s, True))
            if weight(best, True) > 0:
                return best
    here = wrapper
    while True:  # go down while one child holds nearly all
        total = weight(here)
        heavy = [k for k in here.kids if k.tag in BLOCKS and k.tag not in ("p", "li") and weight(k) >= 0.8 * total > 0]
        if not heavy:
            return here
        here = heavy[0]


def template_texts(slot: Slot, pages: int) -> set[int]:
    """Texts below a node that nearly all pages of the host show, unless they are most of what it shows."""
    if pages < LEAST_PAGES:
        return set()
    found: set[int] = set()
    paths: set[int] = set()
    shown = [0, 0]

    def walk(s: Slot) -> None:
        constant = {t: k for t, k in s.constant.items() if k >= CONSTANT * pages}
        found.update(constant)
        if s.path not in paths:  # counts are those of a path
            paths.add(s.path)
            shown[0] += sum(constant.values())
        shown[1] += s.shown
        for kid in s.kids:
            walk(kid)

    walk(slot)
    return found if shown[0] * 2 <= shown[1] else set()


def blocks(node: Node, in_article: bool, template: set[int]) -> list[str]:
    """Texts of the blocks below a node in page order, without what is off and without template texts."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = squeezed("".join(held))
        held.clear()
        if text and not (template and _key(text) in template):
            out.append(text)

    def walk(x: Node, inside: bool) -> None:
        for p in x.parts:
            if type(p) is str:
                held.append(p)
            elif p.tag == "br":
                held.append(" ")
            elif not p.off(inside):
                block = p.tag in BLOCKS
                if block:
                    end()
                walk(p, inside or p.tag in ("article", "main"))
                if block:
                    end()

    walk(node, in_article)
    end()
    return out


def nodes_for(wrapper: Slot, page: Slot, target: Slot) -> list[Node]:
    """Elements of the page that are aligned with a wrapper node."""
    found: list[Node] = []

    def walk(w: Slot, p: Slot, matched: list) -> None:
        if w is target:
            found.extend(p.instances)
            return
        for i, j, inner in matched:
            walk(w.kids[i], p.kids[j], inner)

    walk(wrapper, page, match(wrapper, page)[1])
    return found


def main_text(page: str | None, host: tuple[Slot, Slot, set[int]] | None) -> str:
    """Text of a page by its host's (wrapper, content node, template texts)."""
    if not page:
        return ""
    tree = slots_of([parse(page)])
    found = nodes_for(host[0], tree, host[1]) if host else []
    template = host[2] if host else set()
    if not found:  # unlike the other pages of its host
        found, template = content_slot(tree).instances, set()
    return "\n".join(b for node in found for b in blocks(node, True if node.tag in ("article", "main") else False, template))


def paths_of(slot: Slot, path: int = 0) -> Iterator[Slot]:
    """All nodes of a wrapper, with their paths set."""
    slot.path = _below(path, slot.kind)
    yield slot
    for kid in slot.kids:
        yield from paths_of(kid, slot.path)


def prepared(state: str | None, constant: Iterable[dict] | None = None) -> tuple[Slot, Slot, set[int]] | None:
    if not state:
        return None
    wrapper = Slot.load(json.loads(state))
    at: dict[int, dict[int, int]] = {}
    for found in constant or ():
        at.setdefault(found["path"], {})[found["key"]] = found["n"]
    for slot in paths_of(wrapper):
        slot.constant = at.get(slot.path, {})
    target = content_slot(wrapper)
    return wrapper, target, template_texts(target, wrapper.pages)


def merged(states: Iterable[str]) -> str:
    """One wrapper out of several; the order does not depend on where they were made."""
    out = None
    for state in sorted(states):
        slot = Slot.load(json.loads(state))
        if out is None:
            out = slot
        else:
            fold(out, slot)
    return json.dumps(out.state())


HOST = "coalesce(lower(regexp_extract(`{url}`, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
SALTS = 64


def _source(pages: DataFrame, url: str, html: str) -> DataFrame:
    return pages.select(F.expr(HOST.format(url=url)).alias("host"), F.col(f"`{html}`").cast("string").alias("html")).where("html <> ''")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON) for every host."""
    ship(pages.sparkSession)
    source = _source(pages, url, html)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, Slot] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = slots_of([parse(page)])
                if host in held:
                    fold(held[host], tree)
                else:
                    held[host] = tree
            states = [json.dumps(s.state()) for s in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(states, pa.string())], names=["host", "wrapper"])

    def merge(table: pa.Table) -> pa.Table:
        host = table.column("host")[0].as_py()
        return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([merged(table.column("wrapper").to_pylist())], pa.string())})

    made = source.mapInArrow(local, "host string, wrapper string").withColumn("salt", F.expr(f"pmod(hash(wrapper), {SALTS})"))
    partly = made.groupBy("host", "salt").applyInArrow(merge, "host string, wrapper string")
    return partly.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def constants(pages: DataFrame, made: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, constant`` for hosts of the wrappers ``made``: ``path, key, n`` of texts that nearly all pages with the path show, n pages each."""
    ship(pages.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((host, *at) for at in page_texts(parse(page)))
            hosts, path, key = zip(*held) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(path, pa.int64()), pa.array(key, pa.int64()), pa.array(held.values(), pa.int64())], names=["host", "path", "key", "n"]
            )

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, path, pages_ = [], [], []
            for host, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                most: dict[int, int] = {}
                for slot in paths_of(Slot.load(json.loads(state))):
                    if slot.pages >= LEAST_PAGES:
                        most[slot.path] = max(most.get(slot.path, 0), slot.pages)
                hosts += [host] * len(most)
                path += most
                pages_ += most.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(path, pa.int64()), pa.array(pages_, pa.int64())], names=["host", "path", "pages"])

    counts = _source(pages, url, html).mapInArrow(texts, "host string, path long, key long, n long").groupBy("host", "path", "key").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= CONSTANT * LEAST_PAGES).join(made.mapInArrow(paths, "host string, path long, pages long"), ["host", "path"])
    return counts.where(F.col("n") >= CONSTANT * F.col("pages")).groupBy("host").agg(F.collect_list(F.struct("path", "key", "n")).alias("constant"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points) to every row; they replace columns of the same names."""
    spark = pages.sparkSession
    ship(spark)
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.expr(HOST.format(url=url)).alias("__host"), F.col(f"`{html}`").cast("string").alias("__html"))
    made = written(wrappers(pages, url, html), "wrappers")
    made = made.join(constants(pages, made, url, html), "host", "left").select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"), F.col("constant").alias("__constant"))
    joined = source.join(made, "__host", "left").select(*[F.col(f"`{c}`") for c in kept], "__host", "__html", "__wrapper", "__constant")
    fields = [*joined.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[str, tuple | None] = OrderedDict()
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = []
                for host, page, k in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), range(batch.num_rows), strict=True):
                    if host not in ready:
                        ready[host] = prepared(batch.column(len(kept) + 2)[k].as_py(), batch.column(len(kept) + 3)[k].as_py())
                        if len(ready) > 256:
                            ready.popitem(last=False)
                    texts.append(main_text(page, ready[host]))
                columns = [batch.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType(fields))
