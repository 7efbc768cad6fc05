"""Main text of web pages by equivalence-class template deduction.

A page is read once into tokens: a token for each container element, named by its path with classes and ids, and one for each
block of text, named by its container and words. Over the pages of a host, each token has an occurrence vector: how often it
occurs in each page. Tokens with equal vectors form an equivalence class; a class is valid if it occurs on nearly all
pages of the host, has more than one token or is on all pages, and the containers around its tokens are in valid
classes too, so that the classes nest. The valid classes are the host's template: its containers are the frame, its
texts are fixed, and what lies between them are the slots that pages fill.

The slots decide what is kept:

* The main slot is found from the top: as long as one container that each page has once holds ``share_of_slot`` of the free text
  (not fixed, no links) of the one around it, it is gone into. Elements and names weigh in, where texts of like size compete:
  an article or main element counts 6 times, one that is named like a side matter (advert, comments) a tenth; menus, footers, sidebars
  and page headers by their element or role count nothing.
* Of the main slot all is kept, also texts that pages have in common, but for: those elements; containers of the frame with
  nothing but fixed texts in them (notices, labels), unless nearly all of the host's main text is fixed, as it is the same
  article; side matter by name that holds less than half of the text; and, outside article elements, containers of the
  frame that are mostly links. A free h1 over the main slot is kept too.

A name tells of side matter only if all its parts do, so related-work doesn't; names of html, body, main and article tell nothing.
The first page of a host, or one without the host's main slot, is its own template, with no fixed texts.

Occurrence vectors are aggregated as counts and an exclusive-or of hashes of (page, count), combined before the
shuffle: a host with a third of all pages is no larger in the shuffle than its distinct tokens. Templates are made of tokens of
90 % of a host's pages, so of at most 1.12 times the tokens of a page for each host. They are broadcast if all together
have at most ``broadcast_tokens`` tokens, else joined to the pages by host.

Nulls: a null html is an empty page with an empty text; null urls make a host of their own; a null page_id is kept.
Repeated rows each give a row. Hosts of fewer than ``min_pages`` pages have no fixed texts. Broken markup is read as far as
it goes: unclosed elements end with their parents. An empty table gives an empty result. Further columns are ignored.
Lengths and depths are not limited; reading takes time and memory linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?=[\s=/>]|\Z)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_RAW = frozenset("script style textarea title noscript iframe xmp noembed template svg".split())
_CONTAINER = frozenset("html head body nav header footer aside main article section div ul ol li dl table form fieldset dialog figure details menu button select blockquote center".split())
_BLOCK = _CONTAINER | frozenset("p br hr h1 h2 h3 h4 h5 h6 tr td th thead tbody tfoot caption dt dd pre address figcaption summary option legend label hgroup".split())
_NEVER = frozenset("head nav footer aside dialog menu button select".split())
_TELLS_NOTHING = frozenset("html body main article".split())
_SIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored promo promotion promoted banner menu nav navbar navigation navi sidebar aside widget widgets cookie cookies "
    "consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies reply discussion footer masthead topbar breadcrumb breadcrumbs pagination pager copyright legal toolbar skiplink announcement disclaimer".split()
)
#: Parts of names that say nothing themselves.
_NEUTRAL = frozenset("area bar block bottom box button buttons container content form header holder inner item items js left link links list main outer page panel posts right section site slot thread title top unit wrap wrapper".split())
_OWN = frozenset("author byline caption date dateline headline lead meta subtitle summary title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MAIN = frozenset(("article", "main"))

#: What is known of a container from its tag: never main text, page header, article, side matter, own part of an article.
NEVER, HEADER, ARTICLE, SIDE, OWN = 1, 2, 4, 8, 16
ROOT = 0


def _hash(around: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), around & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _kind(name: str, attributes: str) -> tuple[str, int]:
    """The name of a container with its classes and ids, and what the tag tells of it."""
    kind = NEVER if name in _NEVER else HEADER if name == "header" else ARTICLE if name in _MAIN else SIDE if name in ("form", "fieldset") else 0
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role":
            kind |= NEVER if value in _ROLES else ARTICLE if value in _MAIN else 0
        elif key == "hidden" or key == "aria-hidden":
            kind |= NEVER if key == "hidden" or value == "true" else 0
        else:
            names += value.split()
    if name not in _TELLS_NOTHING:
        for n in names:
            parts = [p for p in re.split(r"[^a-z]+", n) if p]
            if any(p in _SIDE for p in parts) and all(p in _SIDE or p in _NEUTRAL for p in parts):
                kind |= SIDE
            elif parts and all(p in _OWN for p in parts):
                kind |= OWN
    return name + "".join(f".{n}" for n in names), kind


class Page:
    """Containers in the order of their start (token, place of the one around it, kind, sizes of all text and of link text in
    them), the first of them the page itself; and blocks of text (container, text, sizes, whether an h1)."""

    __slots__ = ("token", "around", "kind", "size", "linked", "blocks")

    def __init__(self):
        self.token, self.around, self.kind, self.size, self.linked = [ROOT], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str, int, int, bool]] = []

    def close(self) -> Page:
        """Adds up the sizes: containers come after those around them."""
        for c, _, size, linked, _ in self.blocks:
            self.size[c] += size
            self.linked[c] += linked
        for c in range(len(self.token) - 1, 0, -1):
            self.size[self.around[c]] += self.size[c]
            self.linked[self.around[c]] += self.linked[c]
        return self


def read(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked, some, head, links, at, n = 0, False, False, 0, 0, len(html)

    def end_block() -> None:
        nonlocal parts, linked, some
        if some:
            text = " ".join("".join(parts).split())
            page.blocks.append((stack[-1][1], text, len(text), min(linked, len(text)), head))
        parts, linked, some = [], 0, False

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if html[m.start()] != "<" or at - m.start() == 1:
                t = _html.unescape(m[0]) if "&" in m[0] else m[0]
                parts.append(t)
                if not t.isspace():
                    some = True
                    linked += len(t) * (links > 0)
            continue
        name = name.lower()
        if name == "a":
            links = max(0, links + (-1 if m[1] else 1))
            continue
        if name in _RAW and not m[1]:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name not in _BLOCK:
            continue
        end_block()
        head = name == "h1" and not m[1]
        if name not in _CONTAINER:
            continue
        if m[1]:
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
        else:
            if name == "li" and stack[-1][0] == "li" or name == "body" and stack[-1][0] == "head":
                opened[stack.pop()[0]] -= 1
            label, kind = _kind(name, m[3])
            around = stack[-1][1]
            stack.append((name, len(page.token)))
            opened[name] += 1
            page.token.append(_hash(page.token[around], label))
            page.around.append(around)
            page.kind.append(kind)
            page.size.append(0)
            page.linked.append(0)
            links = 0
    end_block()
    return page.close()


def _text_token(page: Page, block: tuple) -> int:
    return _hash(page.token[block[0]], f"\n{block[1]}")


class Node:
    """A container of a template, with figures summed over the pages: in how many it is, how often, its text, its link text, and its
    fixed text (all, and without links)."""

    __slots__ = ("around", "pages", "times", "kind", "size", "linked", "fixed", "fixed_free")

    def __init__(self, around: int, pages: int, times: int, kind: int, size: int, linked: int):
        self.around, self.pages, self.times, self.kind, self.size, self.linked, self.fixed, self.fixed_free = around, pages, times, kind, size, linked, 0, 0

    @property
    def free(self) -> int:
        """Text that pages differ in and that isn't links."""
        return self.size - self.linked - self.fixed_free


def choose(nodes: dict[int, Node], fixed: list[tuple[int, int, int, int]], share_of_slot: float = 0.6) -> tuple[int, set[int], set[int]]:
    """The main slot, the containers in it that are left out, and the fixed texts in the containers around it. ``fixed``: token,
    container, size and size of links of each fixed text."""
    children: dict[int, list[int]] = defaultdict(list)
    for t, x in nodes.items():
        if t != ROOT:
            children[x.around].append(t)
    for _, c, size, linked in fixed:
        while True:
            nodes[c].fixed += size
            nodes[c].fixed_free += size - linked
            if c == ROOT:
                break
            c = nodes[c].around
    if 10 * nodes[ROOT].free < nodes[ROOT].size - nodes[ROOT].linked:  # copies of one page
        for x in nodes.values():
            x.fixed = x.fixed_free = 0
        fixed = []

    def weight(x: Node) -> float:
        return 0 if x.kind & (NEVER | HEADER) else x.free * (0.1 if x.kind & SIDE else 6 if x.kind & ARTICLE else 1)

    main, above, article = ROOT, set(), False
    while True:
        once = [t for t in children[main] if nodes[t].times == nodes[t].pages]
        best = max(once, key=lambda t: (weight(nodes[t]), t), default=None)
        own = max(0, nodes[main].free - sum(nodes[t].free for t in once))
        if best is None or weight(nodes[best]) < share_of_slot * (own + sum(weight(nodes[t]) for t in once)) or weight(nodes[best]) <= 0:
            break
        above.add(main)
        main = best
        article |= bool(nodes[main].kind & ARTICLE)

    left, queue = set(), list(children[main])
    while queue:
        t = queue.pop()
        x = nodes[t]
        only_fixed = x.size > 0 and x.fixed >= x.size and not x.kind & OWN
        if only_fixed or x.kind & SIDE and 2 * x.size < nodes[main].size or not article and 2 * x.linked > x.size:
            left.add(t)
        else:
            queue += children[t]
    return main, left, {t for t, c, _, _ in fixed if c in above}


def own_template(page: Page) -> tuple[int, set[int], set[int]]:
    nodes: dict[int, Node] = {}
    for k, t in enumerate(page.token):
        if t in nodes:
            x = nodes[t]
            x.times, x.size, x.linked = x.times + 1, x.size + page.size[k], x.linked + page.linked[k]
        else:
            nodes[t] = Node(page.token[page.around[k]], 1, 1, page.kind[k], page.size[k], page.linked[k])
    return choose(nodes, [])


def kept_blocks(page: Page, template: tuple[int, set[int], set[int]] | None) -> list[str]:
    """The texts of the page's main slot, in order."""
    if template is None or template[0] not in page.token:
        template = own_template(page)
    main, left, fixed = template
    n = len(page.token)
    inside, out, above = [False] * n, [False] * n, [True] * n
    most = max(s for t, s in zip(page.token, page.size) if t == main)
    for k, t in enumerate(page.token):
        a, kind = page.around[k], page.kind[k]
        inside[k] = t == main or k > 0 and inside[a]
        if inside[k] and t != main:
            out[k] = out[a] or t in left or bool(kind & NEVER) or bool(kind & SIDE) and 2 * page.size[k] < most
        elif not inside[k]:
            out[k] = (k > 0 and out[a]) or bool(kind & (NEVER | HEADER | SIDE))
    return [b[1] for b in page.blocks if not out[b[0]] and (inside[b[0]] or b[4] and page.token[b[0]] in _ancestors(page, main) and _text_token(page, b) not in fixed)]


def _ancestors(page: Page, main: int) -> set[int]:
    k, out = page.token.index(main), set()
    while k:
        k = page.around[k]
        out.add(page.token[k])
    return out


def main_text(html: str, template: tuple[int, set[int], set[int]] | None = None) -> str:
    return " ".join(kept_blocks(read(html), template))


_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("around", pa.int64()), ("text", pa.bool_()), ("kind", pa.int8()), ("times", pa.int64()), ("size", pa.int64()), ("linked", pa.int64())]))
_CONTAINERS = pa.list_(pa.struct([("token", pa.int64()), ("around", pa.int32()), ("kind", pa.int8()), ("size", pa.int64()), ("linked", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("container", pa.int32()), ("text", pa.string()), ("size", pa.int64()), ("linked", pa.int64()), ("head", pa.bool_())]))
_PARSED = (
    "page_id bigint, url string, host string, tokens array<struct<token: bigint, around: bigint, text: boolean, kind: tinyint, times: bigint, size: bigint, linked: bigint>>, "
    "containers array<struct<token: bigint, around: int, kind: tinyint, size: bigint, linked: bigint>>, blocks array<struct<container: int, text: string, size: bigint, linked: bigint, head: boolean>>"
)


def _tokens(page: Page) -> list[dict]:
    found: dict[tuple[int, bool], dict] = {}
    rows = [(t, page.token[page.around[k]], False, page.kind[k], page.size[k], page.linked[k]) for k, t in enumerate(page.token)]
    rows += [(_text_token(page, b), page.token[b[0]], True, 0, b[2], b[3]) for b in page.blocks]
    for t, around, text, kind, size, linked in rows:
        x = found.setdefault((t, text), {"token": t, "around": around, "text": text, "kind": kind, "times": 0, "size": 0, "linked": 0})
        x["times"] += 1
        x["size"] += size
        x["linked"] += linked
    return list(found.values())


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 200):
        tokens, containers, blocks = [], [], []
        for html in b.column(3).to_pylist():
            page = read(html or "")
            tokens.append(_tokens(page))
            containers.append([{"token": t, "around": a, "kind": k, "size": s, "linked": n} for t, a, k, s, n in zip(page.token, page.around, page.kind, page.size, page.linked)])
            blocks.append([dict(zip(("container", "text", "size", "linked", "head"), x)) for x in page.blocks])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tokens, _TOKENS), pa.array(containers, _CONTAINERS), pa.array(blocks, _BLOCKS)], names=["page_id", "url", "host", "tokens", "containers", "blocks"])


def _chosen(share_of_slot: float):
    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 100):
            mains, lefts, fixeds = [], [], []
            for members, many in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                nodes = {m["token"]: Node(m["around"], m["n"], m["times"], m["kind"], m["size"], m["linked"]) for m in members if not m["text"]}
                # nesting: a token stays if the containers around it are all there
                good = {ROOT}
                for t in nodes:
                    path = []
                    while t in nodes and t not in good and t != ROOT:
                        path.append(t)
                        t = nodes[t].around
                    if t in good:
                        good.update(path)
                nodes = {t: x for t, x in nodes.items() if t in good}
                fixed = [(m["token"], m["around"], m["size"], m["linked"]) for m in members if m["text"] and m["around"] in nodes] if many else []
                main, left, above = choose(nodes, fixed, share_of_slot)
                mains.append(main)
                lefts.append(sorted(left))
                fixeds.append(sorted(above))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mains, pa.int64()), pa.array(lefts, pa.list_(pa.int64())), pa.array(fixeds, pa.list_(pa.int64()))], names=["host", "main", "out", "fixed"])

    return apply


def parsed(pages: DataFrame) -> DataFrame:
    """Each page with its host, tokens, containers and blocks."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return only(pages, "page_id", "url", "html").select("page_id", "url", host.alias("host"), "html").mapInArrow(_parse, _PARSED)


def templates(read_pages: DataFrame, share: float = 0.9, min_pages: int = 3, share_of_slot: float = 0.6) -> DataFrame:
    """host, main (token of the main slot), out (containers in it that are left out) and fixed (texts over it), from parsed pages."""
    sizes = read_pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = read_pages.select("host", F.xxhash64("page_id", "url", "tokens").alias("page"), F.inline("tokens"))
    vectors = found.groupBy("host", "token", "text").agg(
        F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.min("around").alias("around"), F.max("kind").alias("kind"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )
    often = vectors.join(sizes, "host").filter(F.col("n") >= share * F.col("pages"))
    member = F.struct("token", "around", "text", "kind", "n", "times", "size", "linked")
    classes = often.groupBy("host", "vector", "n", "times").agg(F.count(F.lit(1)).alias("many"), F.collect_list(member).alias("members"), F.max("pages").alias("pages"))
    valid = classes.filter((F.col("many") > 1) | (F.col("n") == F.col("pages")))
    hosts = valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"), (F.max("pages") >= min_pages).alias("many"))
    return hosts.mapInArrow(_chosen(share_of_slot), "host string, main bigint, out array<bigint>, fixed array<bigint>")


def _page(containers: list[dict], blocks: list[dict]) -> Page:
    page = Page()
    page.token, page.around, page.kind, page.size, page.linked = ([x[c] for x in containers] for c in ("token", "around", "kind", "size", "linked"))
    page.blocks = [(x["container"], x["text"], x["size"], x["linked"], x["head"]) for x in blocks]
    return page


def extract(pages: DataFrame, share: float = 0.9, min_pages: int = 3, share_of_slot: float = 0.6, broadcast_tokens: int = 500_000) -> DataFrame:
    """page_id, url and the main text of each page."""
    docs = materialize(parsed(pages), "parsed-pages")
    found = materialize(templates(docs, share, min_pages, share_of_slot), "templates")
    docs, schema = docs.select("page_id", "url", "host", "containers", "blocks"), "page_id bigint, url string, text string"
    size = found.agg(F.coalesce(F.sum(F.size("out") + F.size("fixed") + 2), F.lit(0)).alias("n")).head().n

    def texts(b: pa.RecordBatch, given: list) -> pa.RecordBatch:
        out = [" ".join(kept_blocks(_page(c, x), t)) for c, x, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), given)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    if size > broadcast_tokens:

        def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 200):
                yield texts(b, [None if m is None else (m, set(o), set(f)) for m, o, f in zip(*(b.column(k).to_pylist() for k in (5, 6, 7)))])

        return docs.join(found, "host", "left").select(*docs.columns, "main", "out", "fixed").mapInArrow(joined, schema)
    sent = pages.sparkSession.sparkContext.broadcast({r.host: (r.main, set(r.out), set(r.fixed)) for r in found.toLocalIterator()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            yield texts(b, [sent.value.get(h) for h in b.column(2).to_pylist()])

    return docs.mapInArrow(run, schema)
