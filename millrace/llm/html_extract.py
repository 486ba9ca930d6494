"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

1. Each page becomes a stream of tokens: block elements keyed by tag, role and class, inline markup dropped, texts
   as digests. Equal neighbours under one element fold into a repeated group, so a page's form is short.
2. The forms of a host are aligned one after another. Where two forms differ, the side that has more becomes
   an optional group; equal elements in a row become a repeated group; texts that are equal stay constant, others
   become slots, with their length. The result is the host's wrapper: a union-free expression with constants,
   slots, repeated (+) and optional (?) groups, and the containers whose whole text is equal on all pages. Forms
   meet within their input partition first and then in salted steps, so hosts with very many pages are no hot spot.
3. The wrapper says which element holds the main text: of article and main elements the one with most text (an
   inner one that holds `MOST` of it wins), else the deepest element that holds `MOST` of the varying text, leaving
   out navigation and other page furniture.
4. Each page is read with the wrapper of its host: text of the main element, by blocks in page order. Containers
   whose text is equal on all pages of the host are template and left out; below an article or main element only
   those of `NOTICE` letters and more, and of hosts with `PAGES` pages and more. A host whose pages are equal but
   for less than `LEAST_VARYING` of the text tells nothing: there all but furniture is kept.

Furniture is known by element (nav, header, footer, aside, form, dialog ...), role or class and id words (menu,
sidebar, cookie, advert, comments ...). Articles below furniture are furniture, and so are articles within an
article: by HTML's rules those are its comments. Headings inside a header of the main element stay. Words never
make a heading furniture; below a main element a class or id counts only if it is made of such words as a whole,
and `GENERIC` words, which name sections of texts as well, don't count alone.

Character references are decoded as HTML5 does; white space within a block becomes one space; blocks are joined
by one newline. Null html is an empty page and gives the empty text; null or odd URLs form one host each by
their text. Pages are read in time linear in their length, however long, deeply nested or broken: a form counts
elements below `DEPTH` as part of their ancestor, and of lists of more than `MANY` different elements those with
equal tag and role as one group. Repeated rows give repeated rows; other columns, also such with the names of
results, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Parts into which a host's forms are dealt before they meet.
SALTS = 256
#: Hosts with most pages, whose wrappers are broadcast.
HOT_HOSTS = 20_000
#: Depth from which on a form tells elements apart no more.
DEPTH = 60
#: Pages of a host and letters of a container from which on constant text below a main element is template.
PAGES, NOTICE = 3, 20
#: Share of a host's varying text that the main element holds where no element is marked as such.
MOST = 0.8
#: Share of a host's text that has to vary; below, its pages are near copies and tell nothing.
LEAST_VARYING = 0.2
#: Children of an element from which on they are told apart by tag and role only.
MANY = 64
#: Hosts whose forms a task holds at once.
HOSTS = 256
#: Elements that are left out as a whole if their text is constant.
CONTAINERS = frozenset("div section ul ol dl table td center details address".split())
#: Elements that can be the main one.
DIVISIONS = frozenset("html body div section table tbody tr td center".split())

#: Elements by kind.
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form dialog head button select fieldset menu canvas audio video".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center hr "
    "nav header footer aside form dialog head fieldset menu".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_ROLES = frozenset("main article".split())
#: Words of classes and ids that mark furniture.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead footer foot topbar bottombar sidebar side rail aside widget widgets related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments respond reply replies disqus discussion share sharing social follow tags copyright legal skip".split()
)
#: Those that name sections of articles, too.
GENERIC = frozenset("discussion side legal notice notices notification alert header masthead foot footer copyright skip reply respond rail overlay".split())
#: Words that say nothing beside one of WORDS.
COMPANIONS = frozenset(
    "post posts article articles story stories link links box boxes bar bars button buttons block blocks container wrapper wrap list item items area unit slot module panel "
    "icon icons form inner outer top bottom left right inline page site widget section content".split()
)
#: Words of classes and ids of article elements that are not the page's article.
NOT_THE_ARTICLE = frozenset("ad ads advert advertisement sponsored promoted related recommended comment comments reply replies teaser".split())
#: Elements that an opening tag of the named kind closes.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_VALUE = re.compile(r"=\s*\Z")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


def _tag_end(page: str, at: int, loose: bool) -> int:
    """Where the tag ends whose attributes begin at a place: its > outside of quoted values; -1 if nowhere."""
    if loose:
        return page.find(">", at)
    while True:
        mark = _MARK.search(page, at)
        if not mark:
            return -1
        if mark[0] == ">":
            return mark.start()
        at = mark.end()
        if _VALUE.search(page, max(0, at - 9), at - 1):  # quotes count after an equals sign only
            at = page.find(mark[0], at) + 1
            if not at:
                return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ('text', '', text), ('open', tag, attributes) or ('close', tag, '')."""
    at, begin, last, loose = 0, 0, page.rfind(">"), False
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            break
        found = _NAME.match(page, at + 1)
        if not found and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1  # a mere <
            continue
        if at > begin:
            yield "text", "", page[begin:at]
        if not found:
            close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(close, at + (4 if close == "-->" else 2))
            if close == "]]>":
                yield "text", "", page[at + 9 : end if end >= 0 else len(page)]
            at = begin = end + len(close) if end >= 0 else len(page)
            continue
        end = _tag_end(page, found.end(), loose)
        if end < 0:  # an unclosed quote; from here on quotes don't count
            loose = True
            end = page.find(">", found.end())
        tag, rest = found[2].lower(), page[found.end() : end]
        at = begin = end + 1
        if found[1]:
            yield "close", tag, ""
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = begin = stop.end() if stop else len(page)
        else:
            yield "open", tag, rest
            if rest.endswith("/") and tag not in BLOCK and tag not in VOID:
                yield "close", tag, ""
    if begin < len(page):
        yield "text", "", page[begin:]


def role_of(tag: str, attributes: str, within: bool = False) -> str:
    """'main', 'furniture' or '' of an element; within tells whether it is below a main element."""
    found: dict[str, str] = {}
    if attributes:
        for m in _ATTR.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    named = f"{found.get('class', '')} {found.get('id', '')}"
    roles = set(found.get("role", "").split())
    if tag in ("html", "body"):
        return ""
    if tag == "main" or tag == "article" and NOT_THE_ARTICLE.isdisjoint(_WORD.findall(named)):
        return "main"
    if roles & MAIN_ROLES:
        return "main"
    if tag in FURNITURE or roles & ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return "furniture"
    if tag not in HEADINGS and (any(map(_furniture_name, named.split())) if within else not WORDS.isdisjoint(_WORD.findall(named))):
        return "furniture"
    return ""


def _furniture_name(name: str) -> bool:
    """Whether a class or id as a whole names furniture."""
    words = set(_WORD.findall(name))
    return words <= WORDS | COMPANIONS and not words.isdisjoint(WORDS - GENERIC)


class Node:
    """An element of a form: key, children in order, whether it repeats or may be missing, and its own text.

    slots is 1 if it has text of its own, text the digest of it while it is constant, else 0, and size its length.
    The root has the number of pages, and the digests of the containers with constant text once a page with text
    was met.
    """

    __slots__ = ("key", "children", "plus", "optional", "slots", "text", "size", "same", "pages")

    def __init__(self, key: str, children=None, plus=False, optional=False, slots=0, text=0, size=0, same=None, pages=0):
        self.key, self.children, self.plus, self.optional, self.slots = key, children or [], plus, optional, slots
        self.text, self.size, self.same, self.pages = text, size, same, pages

    def pack(self):
        return [self.key, int(self.plus) + 2 * int(self.optional), self.slots, self.text, self.size, self.pages, None if self.same is None else sorted(self.same), [c.pack() for c in self.children]]

    @classmethod
    def unpack(cls, raw) -> Node:
        key, flags, slots, text, size, pages, same, children = raw
        return cls(key, [cls.unpack(c) for c in children], bool(flags & 1), bool(flags & 2), slots, text, size, None if same is None else set(same), pages)

    def expression(self) -> str:
        """The union-free expression as text."""
        inner = ("#" if self.slots else "") + "".join(c.expression() for c in self.children)
        mark = ("+" if self.plus else "") + ("?" if self.optional else "")
        key = plain(self.key)
        body = f"<{key}>{inner}</{key}>"
        return f"({body}){mark}" if mark else body


def key_of(tag: str, role: str, attributes: str = "") -> str:
    """tag#class.role; long numbers in classes, as of single posts, count as 0."""
    key = tag
    if attributes and not role and tag in CONTAINERS:
        named = next((m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes) if m[1].lower() == "class"), "")
        name = "-".join(sorted(named.lower().replace(".", "-").split()))
        if name:
            key = f"{tag}#{re.sub('[0-9]{3,}', '0', name)}"
    return f"{key}.{role}" if role else key


def plain(key: str) -> str:
    """A key without its class."""
    return key.partition("#")[0]


def digest(*parts) -> int:
    """Number other than 0 that stands for a text."""
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big") or 1


def merge(a: Node, b: Node) -> Node:
    """The least general element that matches what a or b match."""
    text = a.text if not b.slots else b.text if not a.slots or a.text == b.text else 0
    same = a.same if b.same is None else b.same if a.same is None else a.same & b.same
    return Node(a.key, align(a.children, b.children), a.plus or b.plus, a.optional or b.optional, max(a.slots, b.slots), text, max(a.size, b.size), same, a.pages + b.pages)


def join(a: Node, b: Node) -> Node:
    """Neighbours of one page as a group: their texts in a row are the text of the group."""
    both = merge(a, b)
    if a.slots and b.slots:
        both.text = digest(a.text, b.text) if a.text and b.text else 0
        both.size = a.size + b.size
    if len(a.children) == len(b.children):
        both.children = [join(x, y) for x, y in zip(a.children, b.children)] if [x.key for x in a.children] == [x.key for x in b.children] else both.children
    return both


def fold(items: list[Node], join=join) -> list[Node]:
    """Equal neighbours become a repeated group; of A B A each of the two becomes one."""
    out: list[Node] = []
    for x in items:
        if out and out[-1].key == x.key:
            out[-1] = join(out[-1], x)
            out[-1].plus = True
        elif len(out) >= 2 and out[-2].key == x.key:
            out[-2] = join(out[-2], x)
            out[-2].plus = True
            out[-1].plus = True
        else:
            out.append(x)
    return out


def gather(items: list[Node], join=join) -> list[Node]:
    """Of a long list the elements with equal tag and role become one group."""
    if len(items) <= MANY // 2:
        return items
    out: dict[str, Node] = {}
    for x in items:
        x.key = plain(x.key)
        if x.key in out:
            out[x.key] = join(out[x.key], x)
            out[x.key].plus = True
        else:
            out[x.key] = x
    return list(out.values())


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Alignment of two child lists by longest common subsequence of keys; the rest becomes optional."""
    if [x.key for x in a] == [x.key for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    if len(a) + len(b) > MANY:
        a, b = gather(a, merge), gather(b, merge)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            if j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
                x, i = a[i], i + 1
            else:
                x, j = b[j], j + 1
            out.append(Node(x.key, x.children, x.plus, True, x.slots, x.text, x.size))
    return fold(out, merge)


class _Walk:
    """Open elements while a page is read."""

    def __init__(self):
        self.open: list[str] = []
        self.times: dict[str, int] = {}

    def enter(self, tag: str) -> None:
        self.open.append(tag)
        self.times[tag] = self.times.get(tag, 0) + 1

    def _leave(self) -> str:
        tag = self.open.pop()
        self.times[tag] -= 1
        return tag

    def before(self, tag: str) -> int:
        """Elements that end where a tag opens; a paragraph ends at the next block."""
        ends, n = CLOSED_BY.get(tag, _PARAGRAPH), 0
        while self.open and self.open[-1] in ends:
            self._leave()
            n += 1
        return n

    def close(self, tag: str) -> int:
        """Elements that end with a closing tag."""
        if not self.times.get(tag):
            return 0
        n = 1
        while self._leave() != tag:
            n += 1
        return n


_PARAGRAPH = {"p"}


def form(page: str) -> Node:
    """The form of a page: its block elements with equal neighbours folded."""
    root = Node("", pages=1)
    # of the open elements, down to DEPTH: node, digests and lengths of their texts, letters in all, whether below a main one
    path, texts, letters_in, main = [root], [[]], [0], [False]
    walk, same, some = _Walk(), set(), False

    def leave(n: int) -> None:
        # elements beyond DEPTH are not on the path
        for _ in range(n - max(0, len(walk.open) + n - max(len(walk.open), DEPTH))):
            done, own, size, within = path.pop(), texts.pop(), letters_in.pop(), main.pop()
            done.children = fold(done.children)
            if len(done.children) > MANY:
                done.children = gather(done.children)
            if not own:
                continue
            whole = digest(*(d for d, _ in own))
            if plain(done.key) in CONTAINERS and (not within or size >= NOTICE):
                same.add(whole)
            done.size = sum(n for _, n in own)
            if done.size:
                done.slots, done.text = 1, digest(*(d for d, n in own if n))
            if texts:
                texts[-1].append((whole, 0))
                letters_in[-1] += size

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if rest.strip():
                found = letters(rest)
                texts[-1].append(found)
                letters_in[-1] += found[1]
                some = True
        elif kind == "open":
            if tag in BLOCK and tag not in VOID:
                leave(walk.before(tag))
                walk.enter(tag)
                if len(walk.open) <= DEPTH:
                    node = Node(key_of(tag, role_of(tag, rest, main[-1]), rest))
                    path[-1].children.append(node)
                    path.append(node)
                    texts.append([])
                    letters_in.append(0)
                    main.append(main[-1] or node.key.endswith(".main"))
        elif tag in BLOCK:
            leave(walk.close(tag))
    for _ in range(len(walk.open)):
        walk.open.pop()
        leave(1)
    leave(1)
    root.same = same if some else None
    return root


def letters(text: str) -> tuple[int, int]:
    """Digest and length of a text without white space."""
    text = "".join(text.split())
    return digest(text), len(text)


def varying(x: Node, constant: bool = False) -> int:
    """Length of the text below an element that is not the same on all pages (or of all), without furniture."""
    if x.key.endswith(".furniture"):
        return 0
    return (x.size if constant or not x.text else 0) + sum(varying(c, constant) for c in x.children)


def tells(wrapper: Node) -> bool:
    """Whether enough text varies to tell content from the host's constant text."""
    return varying(wrapper) > LEAST_VARYING * varying(wrapper, True)


def main_path(wrapper: Node) -> list[str]:
    """Keys from the root to the element that holds the main text."""
    best: list[tuple[int, Node, list[str]]] = []

    def weight(x: Node) -> int:
        if x.key.endswith(".furniture"):
            return 0
        own = (3 if x.plus else 1) if x.slots else 0
        return own + sum(weight(c) for c in x.children)

    def visit(x: Node, path: list[str]) -> None:
        if x.key.endswith(".furniture"):
            return
        if x.key.endswith(".main"):
            best.append((varying(x, True), x, path))
        for c in x.children:
            visit(c, [*path, c.key])

    visit(wrapper, [])
    if best:
        top, x, path = max(best, key=lambda b: b[0])
        for inner, y, to in best:  # in page order, so outer elements first
            if len(to) > len(path) and to[: len(path)] == path and not y.plus and inner >= MOST * top:
                x, path, top = y, to, inner
        return path
    # no article: go down while one child holds nearly all varying text
    path, x = [], wrapper
    if tells(wrapper):
        while True:
            most = max(x.children, key=varying, default=None)
            if most is None or plain(most.key) not in DIVISIONS or varying(most) < MOST * varying(x) or sum(c.key == most.key for c in x.children) > 1:
                return path
            x = most
            path.append(x.key)
    while True:
        inner = [c for c in x.children if weight(c)]
        if len(inner) == 1 and not inner[0].plus and not x.slots and inner[0].children:
            x = inner[0]
            path.append(x.key)
        else:
            return path


def constants(wrapper: Node, path: list[str]) -> list[int]:
    """Digests of the containers that hold no text of the page itself; none if too little varies."""
    marked = any(k.endswith(".main") for k in path)
    return sorted(wrapper.same or ()) if wrapper.pages >= (PAGES if marked else 2) and tells(wrapper) else []


def extract(page: str, path: list[str], same: list[int] = ()) -> str:
    """Text of the main element at a path of keys; of all but furniture where a page lacks the element."""
    tries = [(path, sum(k.endswith(".main") for k in path)), (path, 1), (None, 0)] if path else [(None, 0)]
    for where, mains in tries:
        text = _blocks(page, where, mains, frozenset(same))
        if text is not None:
            return text
    return ""


#: Whether text of an element shows: yes, no, or headings only.
SHOWN, HIDDEN, HEADLINES = 0, 1, 2


def _blocks(page: str, path: list[str] | None, mains: int, same: frozenset[int]) -> str | None:
    """Text of the elements at path, or like its last one below as many main elements; None if there are none."""
    walk, out, now = _Walk(), [], []
    # of the open elements: key, depth to which the keys follow the path, whether text shows, articles, blocks before, digests
    keys, along, shows, articles, begun = [""], [0], [SHOWN], [0], [(0, [])]
    inside = 0 if path is None else -1  # open elements above the main one; -1: not met
    seen = path is None
    inline: list[str] = []  # furniture elements that are inline

    def flush() -> None:
        if now:
            text = _SPACES.sub(" ", entities.unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    def leave(n: int) -> None:
        nonlocal inside
        for _ in range(n):
            key = keys.pop()
            along.pop(), shows.pop(), articles.pop()
            first, parts = begun.pop()
            if parts:
                whole = digest(*parts)
                if whole in same and plain(key) in CONTAINERS:
                    del out[first:]
                begun[-1][1].append(whole)
        if path is not None and len(keys) <= inside:
            inside = -1

    def enter(tag: str, rest: str) -> None:
        nonlocal inside, seen
        key = key_of(tag, role_of(tag, rest, articles[-1] > 0), rest)
        step = along[-1]
        on = path is not None and step == len(keys) - 1 < len(path) and (key == path[step] or plain(key) == path[step])
        state = shows[-1]
        if state == HEADLINES:
            state = SHOWN if tag in HEADINGS else HEADLINES
        elif state == SHOWN and key.endswith(".furniture"):
            state = HEADLINES if key == "header.furniture" and inside > 0 else HIDDEN
        elif state == SHOWN and tag == "article" and walk.times.get("article") and inside != -1:
            state = HIDDEN  # an article's comments
        walk.enter(tag)
        keys.append(key)
        along.append(step + on)
        shows.append(state)
        articles.append(articles[-1] + key.endswith(".main"))
        begun.append((len(out), []))
        if path and inside < 0 and state == SHOWN and (on and step + 1 == len(path) or key == path[-1] and key.endswith(".main") and articles[-1] >= mains):
            inside, seen = len(keys) - 1, True

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if same and rest.strip():
                begun[-1][1].append(letters(rest)[0])
            if inside >= 0 and not inline and shows[-1] == SHOWN:
                now.append(rest)
        elif kind == "open":
            if tag in BLOCK:
                flush()
                if tag not in VOID:
                    leave(walk.before(tag))
                    enter(tag, rest)
            elif tag == "br":
                now.append(" ")
            elif tag not in VOID and (tag in FURNITURE or rest and role_of(tag, rest, articles[-1] > 0) == "furniture"):
                inline.append(tag)
        elif tag in BLOCK:
            flush()
            leave(walk.close(tag))
            inline.clear()
        elif inline and inline[-1] == tag:
            inline.pop()
    flush()
    leave(len(keys) - 1)
    return "\n".join(out) if seen else None


def host_of(url):
    """Column: host of a URL in lower case, or the URL itself where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host).otherwise(F.coalesce(url, F.lit("")))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host one form that matches its pages of a partition; several if a task meets many hosts."""
    held: dict[str, Node] = {}

    def give():
        packed = [json.dumps(x.pack(), separators=(",", ":")) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(packed, pa.string())], ["host", "form"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one = form(page or "")
            held[host] = merge(held[host], one) if host in held else one
            if len(held) >= HOSTS:
                yield give()
                held.clear()
    yield give()


def _fold_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One form that matches all forms of a group; holds two at a time."""
    host, whole = None, None
    for batch in batches:
        for h, f in zip(batch.column("host").to_pylist(), batch.column("form").to_pylist()):
            one = Node.unpack(json.loads(f))
            host, whole = h, one if whole is None else merge(whole, one)
    yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(whole.pack(), separators=(",", ":"))], pa.string())], ["host", "form"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, form): the wrapper of each host."""
    forms = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_forms, "host string, form string").withColumn("salt", F.pmod(F.hash("form"), F.lit(SALTS)))
    part = forms.groupBy("host", "salt").applyInArrow(_fold_forms, "host string, form string")
    return part.groupBy("host").applyInArrow(_fold_forms, "host string, form string")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""

    def paths(batches):
        for batch in batches:
            forms = [Node.unpack(json.loads(f)) for f in batch.column(1).to_pylist()]
            found = [json.dumps([path := main_path(x), constants(x, path)]) for x in forms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array([x.pages for x in forms], pa.int64())], ["host", "path", "n"])

    def read(batches):
        for batch in batches:
            texts = [extract(h or "", *json.loads(p)) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rule = common.materialize(wrappers(pages).mapInArrow(paths, "host string, path string, n long"), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    return common.join_hot(rows, rule, "host", HOT_HOSTS).select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string, n_chars long")
