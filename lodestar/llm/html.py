"""Main text of web pages by removal of site templates.

Every element's subtree is hashed: its tag, class, id and text, and its children's hashes. Spark counts, for each host,
the pages that hold a subtree, where pages of equal text without furniture count once; subtrees that recur on many of a
host's pages are its template and are deleted from each of them. Paragraphs, headings and list items of an article are
never taken for a template, as articles quote and repeat each other; elsewhere a paragraph or heading goes only if most
pages of the host hold it, and what stands inside one goes or stays with it. A subtree that holds most of a page's text or
of its paragraphs is never deleted: the pages that share it are copies, and count once for what it holds. Of what remains,
elements that are furniture by tag or role go as well (a host of few pages shows no template), and if an article or main
element is left, the text is what that holds. A class or id makes furniture only of a container (or, outside of articles, a
paragraph), only if it says nothing else ("ad", "site-footer", but not "with-sidebar"), and not if most of the text stands in
it; readers' comments go if any text is left.

A block is what stands between the bounds of block elements. Character references are decoded, white space inside a block
becomes one space, empty blocks go, and blocks are joined by a line feed in page order.

Defined results: null or empty html gives an empty text; a url without a host, or a null one, counts as the host ""; broken
markup is read as browsers do in the common cases (unclosed paragraphs, items, cells; a stray < is text); an empty table gives an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import in_small_batches, staged

#: A subtree is a template if so many pages, and such a share of the pages, of its host hold it. A page of s subtrees thus gives its host s / LEAST_SHARE templates at most.
LEAST_PAGES = 3
LEAST_SHARE = 0.02
#: The share for paragraphs and headings, which pages also quote from each other.
PARAGRAPH_SHARE = 0.5
#: Hosts, and templates of them all, up to which they are broadcast: about 20 MB.
FEW_HOSTS, FEW_MARKS = 100_000, 2_000_000

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: What an opening tag closes, as far up as the bound.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Text of an article, of whatever kind it is.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption a b i em strong span small sub sup code q cite u s br img hr main article body html".split())
#: Elements that go or stay whole; the lowest bit of a mark tells them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
FURNITURE_TAGS = frozenset("head script style noscript template nav header footer aside form button select input textarea iframe object svg canvas dialog menu title".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar toolbar share sharing social "
    "newsletter subscribe subscription signup login related recommended comment comments commentlist disqus replies reply respond feedback search pagination pager".split()
)

#: Elements that a name can make furniture; what such a name may say besides; and the names of what readers write.
CONTAINERS = frozenset("div section aside nav header footer ul ol dl menu form fieldset article center details li".split())
PLAIN_PARTS = frozenset("site top bottom left right global list box bar wrapper wrap container inner outer area slot unit block".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_HOST = re.compile(r"\A\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)")


class Node:
    """An element: its tag, its named attributes, and its parts, which are texts and elements."""

    __slots__ = ("mark", "names", "paragraphs", "parts", "role", "size", "tag", "whole")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.parts, self.mark = tag, "", "", [], 0
        if "=" in attributes:
            for name, *value in _ATTRIBUTE.findall(attributes):
                value = references.unescape("".join(value)).strip().lower()
                if name.lower() == "role":
                    self.role = value
                else:
                    self.names += f" {value}"

    def is_furniture(self) -> bool:
        return self.tag in FURNITURE_TAGS or self.role in FURNITURE_ROLES

    def told(self, tags: frozenset[str] = CONTAINERS) -> set[str]:
        """The kinds of furniture that a class or id of an element of tags names, if that says nothing else."""
        found: set[str] = set()
        if self.names and self.tag in tags:
            for name in self.names.split():
                parts = set(_NAME_PART.findall(name))
                if parts - PLAIN_PARTS <= FURNITURE_NAMES:
                    found |= parts - PLAIN_PARTS
        return found


def parse(text: str | None) -> Node:
    """The tree of a page."""
    root = Node("")
    stack, at, text = [root], 0, text or ""
    size = len(text)
    while at < size:
        found = _TAG.search(text, at)
        if not found:
            stack[-1].parts.append(text[at:])
            break
        if found.start() > at:
            stack[-1].parts.append(text[at : found.start()])
        at = found.end()
        closing, tag, attributes = found[1] or found[4], found[2] or found[5], found[3] or found[6] or ""
        if not tag:
            continue  # a comment or declaration
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].parts.append(Node(tag))
            continue
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            _close(stack, closed, bound)
            _close(stack, {"p"}, closed | bound)
        elif tag in BLOCK:
            _close(stack, {"p"}, set())
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            node.parts.append(text[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and (tag in BLOCK or tag in CONTENT or not attributes.endswith("/")):
            stack.append(node)  # a slash has a meaning in foreign elements only
    return root


#: Elements at which the search for an open paragraph ends.
_SCOPES = frozenset("article aside body button caption div fieldset footer form header html li main nav object section table td th".split())


def _close(stack: list[Node], tags: set[str], bound: set[str]) -> None:
    """Close the nearest open element of tags, unless one of bound, or for paragraphs a scope, is nearer."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in bound or (tags == {"p"} and stack[k].tag in _SCOPES):
            return


def marked(root: Node) -> list[Node]:
    """All elements, each with the hash of its subtree as mark: a signed number of 64 bits, odd for paragraphs."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):
        h = blake2b(f"{node.tag}|{node.names}|".encode(), digest_size=8)
        for part in node.parts:
            h.update(part.mark.to_bytes(8, "big", signed=True) if isinstance(part, Node) else b"|" + " ".join(part.split()).encode("utf-8", "replace"))
        node.mark = int.from_bytes(h.digest(), "big", signed=True) & ~1 | (node.tag in PARAGRAPHS)
    return order


def _mains(root: Node, gone: set[int] | frozenset[int]) -> list[Node]:
    """The outermost article elements that are no furniture; without any, the outermost main elements.

    An element that its name makes furniture is looked into only if there are none elsewhere.
    """
    for tag in ("article", "main"):
        for inner in (False, True):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.tag == tag or (tag == "main" and node.role == "main"):
                    if not node.told():  # as a reader's comment is
                        found.append(node)
                elif node.mark not in gone and not node.is_furniture() and (inner or not node.told()):
                    todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
            if found:
                return found
    return []


def candidates(root: Node) -> set[int]:
    """The marks of the subtrees of a page that may be a template: all but the text of its main part, what holds a main part, what stands in a paragraph, and empty ones."""
    mains = _mains(root, frozenset())
    inside, holders = set(), {id(m) for m in mains}
    todo = list(mains)
    while todo:
        node = todo.pop()
        inside.add(id(node))
        todo += [p for p in node.parts if isinstance(p, Node)]

    found: set[int] = set()
    quoted: set[int] = set()
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        below = [p for p in node.parts if isinstance(p, Node)]
        if node.tag in PARAGRAPHS or id(node) in quoted:
            quoted.update(map(id, below))
        todo += below
    filled: set[int] = set()
    for node in reversed(order):  # children before parents
        if any(isinstance(p, Node) and id(p) in holders for p in node.parts):
            holders.add(id(node))
        if any(id(p) in filled if isinstance(p, Node) else not p.isspace() for p in node.parts):
            filled.add(id(node))
            if id(node) not in holders and id(node) not in quoted and node.tag and node.tag not in ("html", "body") and not (id(node) in inside and node.tag in CONTENT):
                found.add(node.mark)
    return found


def _weigh(root: Node) -> None:
    """Each element's size, the characters of its words, and its paragraphs, both without furniture inside it; whole is the size without regard to names."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):
        node.size = node.whole = node.paragraphs = 0
        for part in node.parts:
            if isinstance(part, str):
                n = sum(map(len, part.split()))
                node.size += n
                node.whole += n
            elif not part.is_furniture():
                node.whole += part.whole
                if not part.told():
                    node.size += part.size
                    node.paragraphs += part.paragraphs
        if node.tag == "p" and node.size:
            node.paragraphs += 1


def main_text(root: Node, gone: dict[int, int] | frozenset[int]) -> str:
    """The text of a marked page without the subtrees whose marks are in gone, which tells how many pages hold each."""
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        if current:
            words = references.unescape("".join(current)).split()
            if words:
                blocks.append(" ".join(words))
            current.clear()

    mains = _mains(root, gone)
    tops = mains or [root]
    _weigh(root)
    size, whole, paragraphs = (sum(getattr(t, name) for t in tops) for name in ("size", "whole", "paragraphs"))
    nameable = CONTAINERS if mains else CONTAINERS | {"p"}

    def named(node: Node) -> bool:
        """Whether furniture by its name."""
        told = node.told(nameable)
        return bool(told) and (node.whole < whole if told & COMMENT_NAMES else 2 * node.whole <= whole)

    def spare(node: Node) -> bool:
        """Whether a template; the pages that share what holds most of this one count once."""
        if node.mark not in gone or (mains and node.tag in CONTENT):
            return False
        if 2 * node.size > size or 2 * node.paragraphs > paragraphs:
            copies.append(max(gone[node.mark], copies[-1]))
            todo.append(copies)  # met again after what the subtree holds
            return False
        return gone[node.mark] - copies[-1] + 1 >= LEAST_PAGES

    for top in tops:
        todo: list = [top]
        copies = [1]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                current.append(part)
            elif part is None:
                end()
            elif part is copies:
                copies.pop()
            elif part is top or not (part.is_furniture() or named(part) or spare(part)):
                if part.tag in BLOCK:
                    end()
                    todo.append(None)
                elif part.tag in ("br", "td", "th"):
                    current.append(" ")
                todo += reversed(part.parts)
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    """The host of a url in lower case, without user and port; "" if it has none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _slices(batches, size: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _subtrees(batches):
    """(host, body, marks): of every page the hash of its text without furniture, and its subtrees."""
    for part in _slices(batches, 1024):
        found: dict[tuple[str, int], list[int]] = {}
        for url, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            root = parse(text)
            marked(root)
            body = blake2b(main_text(root, frozenset()).encode("utf-8", "replace"), digest_size=8).digest()
            key, marks = (host_of(url), int.from_bytes(body, "big", signed=True)), sorted(candidates(root))
            found[key] = min(found.get(key, marks), marks)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["host", "body", "marks"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, marks, n): the subtrees that recur on many pages of a host, and on how many; their number is bounded by LEAST_SHARE."""
    bodies = in_small_batches(pages).select("url", "html").mapInArrow(_subtrees, "host string, body long, marks array<long>")
    bodies = staged(bodies.groupBy("host", "body").agg(F.min("marks").alias("marks")), "bodies")
    pages_of = bodies.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_pages"))
    counts = bodies.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    share = F.when(F.col("mark") % 2 == 0, LEAST_SHARE).otherwise(PARAGRAPH_SHARE)
    often = counts.join(pages_of, F.col("host") == F.col("_host")).where(F.col("n") >= F.col("_pages") * share)
    often = often.groupBy("host").agg(F.collect_list(F.struct("mark", "n")).alias("found"))
    return often.select("host", F.col("found.mark").alias("marks"), F.col("found.n").alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        sets: dict[str, dict[int, int]] = {}
        for part in _slices(batches):
            texts = []
            for host, text, marks, n in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("marks"), part.column("n"), strict=True):
                if host not in sets:
                    if len(sets) >= 1_000:
                        sets.clear()
                    sets[host] = dict(zip(marks.as_py() or (), n.as_py() or (), strict=True))
                root = parse(text)
                marked(root)
                texts.append(main_text(root, sets[host]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    host = F.pandas_udf(lambda url: url.map(host_of), "string")
    found = staged(templates(pages), "templates").select(F.col("host").alias("_host"), "marks", "n")
    hosts, marks = found.agg(F.count("*"), F.sum(F.size("marks"))).first()
    if hosts <= FEW_HOSTS and (marks or 0) <= FEW_MARKS:
        found = F.broadcast(found)
    rows = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    rows = rows.join(found, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "host", "marks", "n")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
