"""Main text of web pages: subtrees that recur across a host's pages are site template and go."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import columns, stored
from visitloom.llm.lookups import joined

#: A subtree is template if it stands on at least MANY different pages of a host; prose, which articles repeat too, on
#: this share of them as well.
MANY, SHARE = 5, 0.2
#: Up to so many template subtrees are sent to all tasks, 8 bytes each; more are joined.
SHARED = 1 << 22

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select canvas audio video".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu head".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th tr tbody li figcaption".split())
#: A paragraph ends where one of these begins; a list item, where the next begins.
CLOSES = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"])}
#: What classes, ids and roles call furniture; and what else stands in the name of a box of it. A name with other words is
#: a hint only, and so is any name of a heading, paragraph or cell: LINKS of its text in links, or form controls, confirm it.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget complementary contentinfo notice notices cookie cookies consent popup modal newsletter subscribe signup share sharing social related comment comments replies disqus respond form search pagination pager toolbar alert".split())
BOXES = frozenset("area bar block body box buttons col column container content footer group header inner item items left links list main outer page panel post right section site thread top bottom user wrap wrapper".split())
LINKS = 0.5
CONTROLS = frozenset("input select textarea button form".split())
WORD = re.compile(r"[a-z0-9]+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")


class Node:
    """An element: its name, whether it is furniture, whether its class hints so, and its children, each a Node or a text."""

    __slots__ = ("name", "furniture", "hinted", "children")

    def __init__(self, name: str, furniture: bool, hinted: bool = False):
        self.name, self.furniture, self.hinted, self.children = name, furniture, hinted, []


def called(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id or role names a box of furniture, and whether it has such a name in it."""
    low = attributes.lower()
    if name in ("html", "body", "main", "article") or not ("class" in low or "id" in low or "role" in low):
        return False, False
    sure = hint = False
    for key, double, single, bare in ATTRIBUTE.findall(low):
        if key in ("class", "id", "role"):
            for token in (double or single or bare).split():
                words = WORD.findall(token)
                if not NAMES.isdisjoint(words):
                    hint = True
                    sure = sure or all(w in NAMES or w in BOXES or w.isdigit() for w in words)
    return sure and name not in PROSE, hint


def confirm(root: Node) -> None:
    """Makes furniture of what is hinted at and holds form controls, or mostly links."""
    sums: dict[int, tuple[int, int, bool]] = {}
    ahead: list[tuple[Node, bool]] = [(root, False)]
    while ahead:
        node, over = ahead.pop()
        if not over:
            ahead.append((node, True))
            ahead += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        size = linked = 0
        controls = node.name in CONTROLS
        for c in node.children:
            if isinstance(c, Node):
                n, k, held = sums.pop(id(c))
                size, linked, controls = size + n, linked + k, controls or held
            else:
                size += len(SPACE.sub(" ", c).strip())
        if node.name == "a":
            linked = size
        if node.hinted and not node.furniture and (controls or (linked and linked >= LINKS * size)):
            node.furniture = True
        sums[id(node)] = size, linked, controls


def parse(page: str) -> Node:
    """A forgiving tree: unclosed elements end with what holds them, a tag that the page breaks off in is dropped."""
    root = Node("html", False)
    path, at = [root], 0
    open_now: dict[str, int] = defaultdict(int)
    n, hints = len(page), False

    def close(k: int) -> None:
        for x in path[k:]:
            open_now[x.name] -= 1
        del path[k:]

    while at < n:
        tag = TOKEN.search(page, at)
        begin = tag.start() if tag else n
        if begin > at:
            path[-1].children.append(page[at:begin])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name or not tag[4]:
            continue
        if tag[1]:
            if open_now[name] > 0:
                close(next(k for k in range(len(path) - 1, 0, -1) if path[k].name == name))
            continue
        # What is open is closed by what can't stand in it; nothing is looked for that isn't open, and what is passed by
        # on the way is below what is opened now, so no element is passed by often.
        if name in BLOCKS and open_now["p"] > 0:
            k = next(k for k in range(len(path) - 1, -1, -1) if path[k].name in BLOCKS or not k)
            if path[k].name == "p":
                close(k)
        if name in CLOSES and any(open_now[x] > 0 for x in CLOSES[name]):
            k = next(k for k in range(len(path) - 1, -1, -1) if path[k].name in CLOSES[name] or path[k].name in ("ul", "ol", "dl", "table") or not k)
            if path[k].name in CLOSES[name]:
                close(k)
        sure, hint = called(name, tag[3]) if tag[3] else (False, False)
        hints = hints or (hint and not sure)
        node = Node(name, name in FURNITURE or sure, hint)
        path[-1].children.append(node)
        if name in RAW:
            ending = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            end = ending.start() if ending else n
            node.furniture, at = True, end
            stop = page.find(">", end)
            at = stop + 1 if ending and stop >= 0 else n
        elif name not in VOID and (name in CLOSES or not tag[3].endswith("/")):
            path.append(node)
            open_now[name] += 1
    if hints:
        confirm(root)
    return root


def main_roots(root: Node) -> list[Node]:
    """The outermost articles; else the main element; else the page."""

    def found(node: Node, name: str) -> list[Node]:
        out, ahead = [], [node]
        while ahead:
            x = ahead.pop()
            for c in reversed(x.children):
                if isinstance(c, Node) and not c.furniture:
                    ahead.append(c)
            if x.name == name:
                out.append(x)
                del ahead[len(ahead) - sum(isinstance(c, Node) and not c.furniture for c in x.children) :]
        return out

    return found(root, "article") or found(root, "main") or [root]


def hashes(root: Node, host: str) -> dict[int, tuple[int, int, bool]]:
    """Of each block element: a hash of host and subtree, the characters of text in it, whether it is prose; by id of the
    Node."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    out: dict[int, tuple[int, int, bool]] = {}
    done: dict[int, tuple[int, int]] = {}
    ahead: list[tuple[Node, bool]] = [(root, False)]
    while ahead:
        node, over = ahead.pop()
        if not over:
            ahead.append((node, True))
            ahead += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        digest, size = xxhash.xxh64(node.name, seed), 0
        for c in node.children:
            if isinstance(c, Node):
                part, inside = done[id(c)]
                digest.update(part.to_bytes(8, "little"))
                size += inside
            else:
                text = SPACE.sub(" ", c).strip()
                digest.update(text.encode("utf-8", "surrogatepass"))
                size += len(text)
        done[id(node)] = digest.intdigest(), size
        if node.name in BLOCKS and node is not root:
            out[id(node)] = *done[id(node)], node.name in PROSE
    return out


def length(root: Node) -> int:
    return sum(len(SPACE.sub(" ", c).strip()) for c in _texts(root))


def candidates(page: str, host: str) -> dict[int, bool]:
    """Hashes of the subtrees with text that may be template: inside the main part, holding less than half of it; whether
    they are prose."""
    out: dict[int, bool] = {}
    for root in main_roots(parse(page)):
        whole = length(root)
        for h, size, prose in hashes(root, host).values():
            if 0 < size * 2 < whole:
                out[h] = out.get(h, True) and prose
    return out


def _texts(node: Node) -> Iterator[str]:
    ahead = [node]
    while ahead:
        for c in ahead.pop().children:
            if isinstance(c, Node):
                ahead.append(c)
            else:
                yield c


def main_text(page: str | None, host: str, template: Container[int]) -> str:
    """The blocks of the main part without furniture and template subtrees, joined by new lines.

    Where template prose makes half of the text or more, the page is one of many copies, and its prose stays.
    """
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if block := SPACE.sub(" ", html.unescape("".join(held))).strip():
            blocks.append(block)
        held.clear()

    def gone(root: Node) -> set[int]:
        """Ids of the nodes that are template."""
        found = {i: x for i, x in hashes(root, host).items() if x[0] in template and x[1]}
        prose = sum(size for _, size, is_prose in found.values() if is_prose)
        return {i for i, x in found.items() if not x[2] or prose * 2 < length(root)}

    for root in main_roots(parse(page or "")):
        template_nodes = gone(root)
        ahead: list[Node | str | None] = [*reversed(root.children)]
        flush()
        while ahead:
            x = ahead.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.furniture or id(x) in template_nodes:
                continue
            elif x.name == "br":
                held.append(" ")
            elif x.name in BLOCKS:
                flush()
                ahead.append(None)
                ahead += reversed(x.children)
            else:
                ahead += reversed(x.children)
        flush()
    return "\n".join(blocks)


def _parts(text: str) -> tuple[str, str]:
    """Host and html of a row's last column."""
    host, _, page = text.partition("\n")
    return host, page


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, int, int, bool]] = []
        for text in columns(batch, "hosted")[0]:
            host, page = _parts(text)
            content = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            rows += [(host, content, h, prose) for h, prose in candidates(page, host).items()]
        hosts, contents, keys, prose = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (contents, keys)), pa.array(prose, pa.bool_())], ["host", "content", "key", "prose"])


def _asked(texts: list[str | None]) -> dict[int, np.ndarray]:
    return {0: np.unique(np.array([h for x in texts for h in candidates(*_parts(x or "")[::-1])], np.uint64))}


def _extracted(batch: pa.RecordBatch, template: Container[int]) -> pa.RecordBatch:
    texts = [main_text(page, host, template) for host, page in map(_parts, batch.column(2).to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_shared(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = frozenset(shared.value.tolist())
        for batch in batches:
            yield _extracted(batch, template)

    return run


def _with_found(found: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
    return _extracted(batch, frozenset(found.column("key").to_numpy().astype(np.int64).view(np.uint64).tolist()))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    The main part of a page is its articles, else its main element, else all of it. Elements that are furniture by name,
    class, id or role go; where the name says other things too, or is that of a heading, paragraph or cell, only with form
    controls or mostly links in it. So do blocks below the main part that hold less than half of its text and whose hash
    (host, names and text of the subtree) stands on MANY different pages of the host; prose (paragraphs, headings, list
    items, cells) only if on SHARE of them as well, and if less than half of a page's text is such prose. What is left is cut
    into blocks: character references are decoded, white space becomes one space, blocks are trimmed and joined by new
    lines; br is a space.

    Null or empty html: empty text. A null url or one without a host counts as the host ''. Repeated rows get a row each
    and count as one page; other columns are ignored. A block on exactly MANY pages, or on exactly SHARE of them, is
    template. No rows: none. Pages of any length are parsed whole.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\n]*@)?([^/?#:\n]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.concat(host, F.lit("\n"), F.coalesce("html", F.lit(""))).alias("hosted"))
    seen = stored(rows.select("hosted").mapInArrow(_subtrees, "host string, content long, key long, prose boolean").distinct())
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    many = seen.groupBy("host", "key").agg(F.count("*").alias("n"), F.min("prose").alias("prose")).where(F.col("n") >= MANY)
    template = stored(many.join(sizes, "host").where(~F.col("prose") | (F.col("n") >= SHARE * F.col("pages"))).select(F.lit(0).alias("kind"), "key"))
    kinds = "page_id long, url string, text string, n_chars long"
    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    if template.count() <= SHARED:
        known = template.select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
        return rows.mapInArrow(_with_shared(pages.sparkSession.sparkContext.broadcast(known)), kinds)
    return joined(rows, template, _asked, _with_found, kinds)
