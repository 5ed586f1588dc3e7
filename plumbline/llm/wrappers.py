"""Main text of web pages by union-free wrappers that are inferred from pages of one host.

A page is a tree of containers (elements that hold blocks, named by element, classes and ids) and text
blocks. Neighbours of one name, and groups of neighbours that repeat side by side, are folded into
repeated groups, innermost first, so that groups nest. A wrapper is such a tree: an element is plain,
optional or repeated, and a text is constant (on all pages that have the element) or a slot. Wrappers
are aligned level by level: what both sides have is merged, texts of one side alone become a slot, what
one side alone has becomes optional, and a group of one side is sought as a single run in the other.
There are no alternatives: that is the union-free case. A host's pages are aligned in parts of bounded
size, then the wrappers of the parts, until one is left, so a host with a third of all pages is no large
group. Pages of a host with the same blocks count once.

The wrapper of a host decides which of its elements hold main text, from all pages of the host. Slots
count, constants don't. Elements whose text is mostly links are menus, unless they stand in an article.
Names of elements (nav, footer, aside, form), classes and ids are evidence against an element. Where
slots in article or main elements hold at least half of the text of the host's slots, only those are main text.
A page is then aligned with its host's wrapper, and gives the texts of the slots that were found to be
main text; what recurs within articles stays, as it is theirs. A page of another shape than most, whose main
slots hold less than half of its slots' text, gives all of its slots; if it has none, the texts of its
article.

Names with digits differ by them alone count as one (post-12, post-13). Beyond LONGEST children of an
element, children of one name become one repeated element; names that one page only has become the
bare element. So nothing is dropped, and a wrapper stays bounded by the names that its host uses.

Defined results: null and empty html give an empty text. A null or odd url belongs to the host "". With
fewer than MIN_PAGES pages of an element nothing counts as constant. Pages are extracted row by row, so
repeated rows and null ids are kept. Extra columns don't matter. Broken markup never fails: unclosed
elements end with their parent, stray ends are passed over, an unclosed script ends with the page. The tree
has DEPTH levels; text of deeper containers belongs to the one at that depth, and is left out where a deeper
one is named like something that isn't main text. Groups of more than WIDEST elements that repeat aren't folded:
their elements stay single, and none of their text is lost.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Pages or wrappers that are aligned in one task.
GROUP = 64
#: Pages that must have an element before its text can be called constant.
MIN_PAGES = 3
#: Children of an element that keep their places; levels of containers; elements of a repeated group.
LONGEST, DEPTH, WIDEST = 400, 60, 8
#: Characters of all wrappers up to which they go to every task; pages of a part of a host beyond that.
SENT, PART = 32_000_000, 2000

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hgroup details summary center".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
NEUTRAL = frozenset("html body header h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Class and id names, and roles, of what is not main text.
NOT_MAIN = frozenset(
    "ad ads adsense adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion recommended related reply replies respond response responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets complementary contentinfo alert login".split()
)

# What may stand beside such names in a longer one, as in site-footer or related-posts.
BESIDE = frozenset("area article articles bar block body bottom box btn button buttons card container form global group inner item items left links list primary post posts reader readers results right row secondary section site slot table text thread top unit user users wrap wrapper".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")


class Node:
    """An element of a wrapper. label: element and marks, "#" for text, "(...)" for a group. texts: lengths of constants by digest. at: numbers of the page's blocks."""

    __slots__ = ("label", "optional", "repeated", "pages", "kids", "texts", "chars", "linked", "at", "role")

    def __init__(self, label: str, kids: list[Node] | None = None, optional: bool = False, repeated: bool = False, pages: int = 1, texts: dict | None = None, chars: int = 0, linked: int = 0, at: list | None = None):
        self.label, self.optional, self.repeated, self.pages = label, optional, repeated, pages
        self.kids, self.texts, self.chars, self.linked, self.at, self.role = kids if kids is not None else [], texts or {}, chars, linked, at or [], None

    def plain(self) -> list:
        out = [self.label, int(self.optional) + 2 * int(self.repeated), self.pages]
        return [*out, self.texts, self.chars, self.linked] if self.label == "#" else [*out, [k.plain() for k in self.kids]]

    @staticmethod
    def of(x: list) -> Node:
        optional, repeated = bool(x[1] & 1), x[1] > 1
        return Node(x[0], None, optional, repeated, x[2], *x[3:6]) if x[0] == "#" else Node(x[0], [Node.of(k) for k in x[3]], optional, repeated, x[2])


def _marks(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    return tuple(sorted({DIGITS.sub("0", p) for m in ATTRIBUTE.finditer(attributes) for p in (m[2] or m[3] or m[4] or "").lower().split()}))


@lru_cache(50_000)
def _telling(mark: str) -> bool:
    """Whether a whole class or id names what is not main text: all its parts do, or stand beside one that does."""
    if mark in NOT_MAIN:
        return True
    parts = set(NAME.findall(mark))
    return not parts.isdisjoint(NOT_MAIN) and parts <= NOT_MAIN | BESIDE


def _hidden(attributes: str) -> bool:
    return bool(attributes) and (HIDDEN.search(QUOTED.sub("", attributes)) is not None or "display:none" in attributes.replace(" ", "").lower())


def _short(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def parsed(page: str | None) -> tuple[Node, list[str]]:
    """The page's tree, not yet folded, and its blocks of visible text."""
    root, texts = Node(""), []
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # element, container of its blocks, whether it is left out
    names: Counter = Counter()
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            _, node, gone = stack[-1]
            if not gone and (text := " ".join(entities.unescape("".join(parts)).split())):
                node.kids.append(Node("#", texts={_short(text): len(text)}, chars=len(text), linked=min(linked, len(text)), at=[len(texts)]))
                texts.append(text)
            parts.clear()
        linked = 0

    def push(name: str, label: str | None, gone: bool) -> None:
        node = stack[-1][1]
        if label is not None and not gone and len(stack) > DEPTH:
            gone = _evidence(label, 0, True)[0] > 0
        elif label is not None and not gone:
            node.kids.append(Node(label))
            node = node.kids[-1]
        stack.append((name, node, gone))
        names[name] += 1

    def pop() -> None:
        names[stack.pop()[0]] -= 1

    for m in TOKEN.finditer(page or ""):
        if (text := m[5]) is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if m[3] is None:
            continue
        name, attributes, end = m[3].lower(), m[4] or "", m[2]
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if end else links + 1
            if end:
                if stack[-1][0] == name:
                    flush()
                    pop()
                continue
            marks = _marks(attributes)
            hidden = _hidden(attributes)
            if hidden or any(map(_telling, marks)):
                flush()
                push(name, " ".join((name, *marks)), stack[-1][2] or hidden)
            elif stack[-1][0] in INLINE:
                push(name, None, stack[-1][2])
            continue
        if name in VOID:
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        flush()
        links = 0
        if end:
            if names[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while stack[-1][0] in INLINE:
            pop()
        if stack[-1][0] in (CLOSED_BY.get(name) or ("p",)):
            pop()
        marks = _marks(attributes)
        push(name, None if name in LEAF and not marks else " ".join((name, *marks)), stack[-1][2] or name in SKIPPED or _hidden(attributes))
        if attributes.rstrip().endswith("/") and name not in LEAF:
            pop()
    flush()
    return root, texts


def _merged(a: Node, b: Node, across: bool) -> Node:
    """a with b; across: of different pages, else two places in one page or wrapper."""
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.chars, a.linked, a.at = a.chars + b.chars, a.linked + b.linked, a.at + b.at
    if across:
        a.pages += b.pages
        a.texts = {x: n for x, n in a.texts.items() if x in b.texts}
    else:
        a.pages = max(a.pages, b.pages)
        a.texts = a.texts | b.texts
    if a.kids or b.kids:
        a.kids = aligned(a.kids, b.kids, across)
    return a


def folded(kids: list[Node]) -> list[Node]:
    """Repeated neighbours and groups of neighbours of one page as repeated elements, innermost first."""
    for k in kids:
        if k.kids:
            k.kids = folded(k.kids)
    before = len(kids) + 1
    while len(kids) < before:
        before = len(kids)
        for size in range(1, min(WIDEST, len(kids) // 2) + 1):
            kids = _swept(kids, size)
    return _bounded(kids, 1)


def _swept(kids: list[Node], size: int) -> list[Node]:
    out: list[Node] = []
    labels: list[str] = []
    for k in kids:
        out.append(k)
        labels.append(k.label)
        if size == 1:
            if len(out) > 1 and labels[-1] == labels[-2]:
                _merged(out[-2], out[-1], False).repeated = True
                del out[-1], labels[-1]
            continue
        while True:  # a group that has just been formed may be the end of another
            run = labels[-size:]
            name = "(" + " ".join(run) + ")"
            if len(out) > size and labels[-size - 1] == name:
                group, n = out[-size - 1], size
            elif len(out) >= 2 * size and labels[-2 * size : -size] == run:
                group, n = Node(name, out[-2 * size : -size], repeated=True), 2 * size
            else:
                break
            for a, b in zip(group.kids, out[-size:]):
                _merged(a, b, False)
            del out[-n:], labels[-n:]
            if n > size:
                out.append(group)
                labels.append(name)
    return out


def _grouped(kids: list[Node], other: list[Node]) -> list[Node]:
    """Runs of kids that are one turn of a group of the other side, as that group."""
    mine = {k.label for k in kids}
    for g in other:
        if g.label[0] == "(" and g.label not in mine and {k.label for k in g.kids} <= mine:
            want, size, i = [k.label for k in g.kids], len(g.kids), 0
            while i + size <= len(kids):
                if [k.label for k in kids[i : i + size]] == want:
                    kids = [*kids[:i], Node(g.label, kids[i : i + size], pages=max(k.pages for k in kids[i : i + size])), *kids[i + size :]]
                i += 1
    return kids


def aligned(a: list[Node], b: list[Node], across: bool = True) -> list[Node]:
    """The children of both: matched ones are merged, others become optional."""
    if any(k.label[:1] == "(" for k in (*a, *b)):
        a, b = _grouped(a, b), _grouped(b, a)
    x, y = [k.label for k in a], [k.label for k in b]
    if x == y:
        return [_merged(p, q, across) for p, q in zip(a, b)]
    out: list[Node] = []
    for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_merged(p, q, across) for p, q in zip(a[i:j], b[k:m])]
        else:
            for node in (*a[i:j], *b[k:m]):
                node.optional = True
                out.append(node)
    return _bounded(out, 2 if across else 1)


def _bounded(kids: list[Node], pages: int) -> list[Node]:
    """Beyond LONGEST children, the tail has one repeated, optional element for each name, and one for each bare element of names that a single page has. A page (pages: 1) has all their texts, a wrapper of more only what all have."""
    if len(kids) <= LONGEST * pages:
        return kids
    tail: dict[str, Node] = {}
    common = Counter(k.label for k in kids[LONGEST:])
    for k in kids[LONGEST:]:
        if pages > 1 and k.pages == 1 and common[k.label] == 1:
            k.label = k.label.split(" ")[0] + " *"
        t = tail.get(k.label)
        if t is None:
            tail[k.label] = k
        else:
            total = t.pages + k.pages
            _merged(t, k, pages > 1).pages = 1 if pages == 1 else total
            t.optional = t.repeated = True
    return kids[:LONGEST] + list(tail.values())


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("")))


def tree(page: str | None) -> tuple[Node, list[str]]:
    """The page as a wrapper of one page, and its blocks."""
    root, texts = parsed(page)
    root.kids = folded(root.kids)
    return root, texts


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"host": b["host"], "wrapper": [json.dumps(tree(p)[0].plain(), separators=(",", ":")) for p in b["html"]]})


def _aligned_part(part: pd.DataFrame) -> pd.DataFrame:
    out: Node | None = None
    for text in sorted(part["wrapper"]):
        node = Node.of(json.loads(text))
        out = node if out is None else _merged(out, node, True)
    return pd.DataFrame({"host": [part["host"].iloc[0]], "key": [int(part["key"].min())], "wrapper": [json.dumps(out.plain(), separators=(",", ":"))]})


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all pages of each host."""
    shape = "host string, key long, wrapper string"
    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(_trees, "host string, wrapper string")
    rows = checkpointed(rows.groupBy("host", F.xxhash64("wrapper").alias("key")).agg(F.first("wrapper").alias("wrapper")))
    while True:
        sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        # only a host of more than one part needs its size
        parts = F.coalesce(F.ceil(F.col("n") / GROUP).cast("int"), F.lit(1))
        large = sizes.where(F.col("n") > GROUP)
        dealt = rows.join(F.broadcast(large) if large.count() <= SENT // 100 else large, "host", "left").withColumn("part", F.pmod(F.xxhash64("key", F.lit(largest)), parts).cast("int"))
        dealt = dealt.repartition("host", "part")  # else a join's dealing by host would do, and a large host's parts meet in one task
        rows = checkpointed(dealt.groupBy("host", "part").applyInPandas(_aligned_part, shape))
        if largest <= GROUP:
            return rows.select("host", "wrapper")


@lru_cache(50_000)
def _evidence(label: str, out: int, main: bool) -> tuple[int, bool]:
    """For what stands in an element: how it is left out (0: not; 1: an article in it isn't; 2: whole), and whether it is in an article. out, main: of where the element stands."""
    if label[:1] == "(":
        return out, main
    name, *marks = label.split(" ")
    inside = main or name in MAIN or "main" in marks or "articlebody" in marks
    if out == 2 or name in OUTSIDE or (name == "header" and not main):
        return 2, inside
    telling = any(map(_telling, marks))
    if name in MAIN:
        return (out if telling else 0), inside
    if out or name in NEUTRAL:
        return out, inside
    return int(telling), inside


def decided(wrapper: Node) -> Node:
    """Gives each text of the wrapper its role (main, slot, or out) and leaves the constants in texts that count as such."""
    leaves: list[tuple[Node, bool]] = []

    def walk(node: Node, out: int, main: bool) -> None:
        for k in node.kids:
            if k.label != "#":
                walk(k, *_evidence(k.label, out, main))
                continue
            k.texts = k.texts if k.pages >= MIN_PAGES and not main else {}  # what recurs in articles is theirs
            slot = k.chars - k.pages * sum(k.texts.values())
            k.role = "out" if out or (2 * k.linked > k.chars and not main) else "slot"
            if k.role == "slot" and slot > 0:
                leaves.append((k, main))
                k.chars = slot

    walk(wrapper, 0, False)
    inside = sum(k.chars for k, main in leaves if main)
    for k, main in leaves:
        k.role = "main" if main or 2 * inside < sum(x.chars for x, _ in leaves) or not inside else "slot"
    return wrapper


def main_text(page: str | None, wrapper: Node) -> str:
    """The page's texts in the slots of its host's decided wrapper."""
    root, texts = tree(page)
    found: list[tuple[int, str]] = []

    def walk(mine: list[Node], theirs: list[Node], out: int, main: bool) -> None:
        if any(k.label[:1] == "(" for k in (*mine, *theirs)):
            mine = _grouped(mine, theirs)
        labels = [k.label for k in theirs]
        if [k.label for k in mine] == labels:
            pairs: list = list(zip(mine, theirs))
        else:
            by_name: dict = {}
            for k in theirs:
                by_name.setdefault(k.label, k)
            matched = {i: j for i, j, n in SequenceMatcher(None, [k.label for k in mine], labels, autojunk=False).get_matching_blocks() for i, j in zip(range(i, i + n), range(j, j + n))}
            pairs = [(k, theirs[matched[i]] if i in matched else by_name.get(k.label) or by_name.get(k.label.split(" ")[0] + " *")) for i, k in enumerate(mine)]
        for k, w in pairs:
            if k.label != "#":
                walk(k.kids, w.kids if w else [], *_evidence(k.label, out, main))
                continue
            role = w.role if w else "out" if out else "slot"
            for i in k.at:
                found.append((i, "out" if role != "out" and w and _short(texts[i]) in w.texts else role))
                if found[-1][1] == "out" and main and not out:
                    found[-1] = (i, "article")

    walk(root.kids, wrapper.kids, 0, False)
    found.sort()
    size = {r: sum(len(texts[i]) for i, role in found if role == r) for r in ("main", "slot")}
    wanted = ("main",) if size["main"] and size["main"] >= size["slot"] else ("main", "slot") if size["main"] or size["slot"] else ("article",)
    return "\n\n".join(texts[i] for i, role in found if role in wanted)


def _extracted(rows, wrapper_of) -> pd.DataFrame:
    out = []
    for page_id, url, of, page in rows:
        text = main_text(page, wrapper_of(of))
        out.append((page_id, url, text, len(text)))
    return pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64", "n_chars": "int64"})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shape, columns = "page_id long, url string, text string, n_chars long", ["page_id", "url", "host", "html"]
    wrappers = infer(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host(F.col("url")))
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= SENT:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})

        def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = lru_cache(2000)(lambda of: decided(Node.of(json.loads(sent.value[of]))))
            for b in batches:
                yield _extracted(b[columns].itertuples(index=False), known)

        return rows.mapInPandas(apart, shape)

    # beyond that, the pages of a host meet its wrapper in parts of bounded size; only hosts of more than one part need their size
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    large = checkpointed(large)
    sized = F.broadcast(large) if large.count() <= SENT // 100 else large
    held = wrappers.join(sized, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select("host", "part", "wrapper")
    dealt = rows.join(sized, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def together(some: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        wrapper = decided(Node.of(json.loads(one["wrapper"].iloc[0])))
        return _extracted(some[columns].itertuples(index=False), lambda of: wrapper)

    return dealt.groupBy("host", "part").cogroup(held.groupBy("host", "part")).applyInPandas(together, shape)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
