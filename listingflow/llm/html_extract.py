"""Main text of web pages by deduction of their hosts' templates.

Pages of one host are compared in blocks.  Tokens, which are tags with their
path and runs of text with theirs, fall into equivalence classes by the vector
of how often they occur in each page of the block.  A token that comes n times on all
pages that have it stands for n tokens.  A class is valid if its tokens come in one
order on all its pages, and if it nests with the larger classes already taken.  The
valid classes that nearly all pages have are the template, copies of a page counted
once.  What lies between two template tokens is a slot.

Names (elements, roles and classes such as ``nav``) tell menus, notices, comments and the like.  The slots choose
the main region: of all the template's elements that hold most of what varies elsewhere and isn't a
link, named or not, the one with the most of it less the links and the template's text among it; of equals the
inner one.  If a named one (``article``, ``main``) of them holds half as much or more, it is
taken instead.  In the region, an element that never holds anything but template text
is a notice of the site and is left out, unless it is a heading; a line that stands among others that
vary is the article's, however many pages repeat it.  A page without another to compare it with has no
template; names alone decide there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import staged
from listingflow.llm.url_filters import host_of

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'=]""")
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript", "noembed", "noframes", "template", "svg", "math")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - {"option", "optgroup", "caption", "head", "html", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an opening tag closes, up to the elements in the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = set("nav header footer aside form button select datalist dialog menu head script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Parts of class names and ids of what is not the article.
MARKS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr notice notices notification banner alert popup modal overlay newsletter subscribe signup login search share sharing social "
    "comment comments commentlist respond reply replies disqus discussion related recommended recommendations widget toolbar pagination pager skip legal disclaimer".split()
)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Parts that may follow such a name without changing what it means.
FILLERS = set("site page top bottom left right inner outer wrap wrapper container content box block bar area list items item section links link slot unit panel module holder region row col group inline mobile desktop sticky fixed text body title form button buttons posts".split())
#: Of the pages of a block that have a template's token; of the text that copies share; of the varying text that the main region holds.
FIXED_SHARE, COPY_SHARE, MAIN_SHARE = 0.9, 0.8, 0.5


class Paths:
    """Numbers of paths of elements, the same for all pages of a block; a path is its last step and the number of the rest."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.up: list[int] = []
        self.name: list[str] = []
        self.main: list[bool] = []

    def of(self, up: int, step: str, name: str, main: bool) -> int:
        found = self.number.setdefault((up, step), len(self.up))
        if found == len(self.up):
            self.up.append(up)
            self.name.append(name)
            self.main.append(main)
        return found


class Page:
    """The elements of a page, its runs of text, and its tokens in order."""

    def __init__(self, html: str, paths: Paths | None = None):
        self.paths = paths or Paths()
        self.name, self.path, self.up, self.dropped, self.link, self.heading, self.main, self.end = [], [], [], [], [], [], [], []
        self.opened: Counter = Counter()
        self.runs: list[list] = []  # text, element, block
        self.tokens: list[tuple] = []
        self.block = 0
        self.stack: list[int] = []
        self._open("#page", "")
        at = 0
        while m := MARKUP.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            elif name in RAW and not m[3].endswith("/"):
                end = RAW[name].search(html, at)
                at = end.end() if end else len(html)
            else:
                self._start(name, m[3])
        self._text(html[at:])
        while self.stack:
            self._pop()

    def _open(self, name: str, attributes: str) -> None:
        up = self.stack[-1] if self.stack else -1
        k = len(self.name)
        found = {key.lower(): value.strip("\"'") for key, value in reversed(ATTRIBUTE.findall(attributes)) if key} if attributes and not attributes.isspace() else {}
        named, role = f"{found.get('class', '')} {found.get('id', '')}".split(), found.get("role", "").strip().lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        main = name in ("article", "main") or role in ("main", "article")
        marked = not main and name not in ("html", "body", "#page") and any(self._mark(n) for n in named)
        out = name in DROPPED or role in ROLES or hidden or marked or (main and any(self._mark(n) for n in named))
        self.name.append(name)
        self.up.append(up)
        self.path.append(self.paths.of(self.path[up] if up >= 0 else -1, ".".join([name, *named]), name, main))
        self.dropped.append(k if out else self.dropped[up] if up >= 0 else -1)
        self.link.append(name == "a" or (up >= 0 and self.link[up]))
        self.heading.append(name in HEADINGS or (up >= 0 and self.heading[up]))
        self.main.append(main)
        self.end.append(0)
        self.stack.append(k)
        self.opened[name] += 1
        self.tokens.append((self.path[k], k, -1))

    @staticmethod
    def _mark(name: str) -> bool:
        parts = [p.lower() for p in NAME_PART.findall(name)]
        return bool(parts) and parts[0] not in ("has", "no", "with", "without", "not") and (parts[-1] in MARKS or (parts[0] in MARKS and all(p in MARKS or p in FILLERS for p in parts[1:])))

    def _pop(self) -> None:
        k = self.stack.pop()
        self.opened[self.name[k]] -= 1
        self.end[k] = len(self.name)
        if self.name[k] in BLOCKS:
            self.block += 1

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self._unwind({"p"}, BLOCKS - {"p"})
        if name in CLOSES:
            self._unwind(*CLOSES[name])
        if name in BLOCKS:
            self.block += 1
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        self._open(name, attributes)
        if attributes.endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "span", "em", "strong"):
            self._pop()

    def _unwind(self, names: set, limits: set) -> None:
        """Close up to the outermost of ``names`` that is open within the innermost of ``limits``."""
        found = None
        for i in range(len(self.stack) - 1, 0, -1) if any(self.opened[n] for n in names) else ():
            name = self.name[self.stack[i]]
            if name in names:
                found = i
            elif name in limits:
                break
        while found is not None and len(self.stack) > found:
            self._pop()

    def _close(self, name: str) -> None:
        if name in BLOCKS and (self.opened[name] or name == "p"):  # other ends without a start mean nothing
            self.block += 1
        if name in ("body", "html"):
            return
        if self.opened[name]:
            while self.name[self.stack[-1]] != name:
                self._pop()
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            k = self.stack[-1]
            self.runs.append([unescape(text) if "&" in text else text, k, self.block])
            if not text.isspace():
                self.tokens.append(((self.path[k], " ".join(text.split())), k, len(self.runs) - 1))


def template(pages: list[Page], least: int) -> list[set]:
    """For each page the indices of its tokens that are in the template; its classes come in ``least`` pages or more."""
    where: list[dict] = []
    vector: dict = defaultdict(list)
    for i, page in enumerate(pages):
        places: dict = defaultdict(list)
        for at, (token, *_) in enumerate(page.tokens):
            places[token].append(at)
        where.append(places)
        for token, at in places.items():
            vector[token].append((i, len(at)))
    classes: dict[tuple, list] = defaultdict(list)
    for token, v in vector.items():
        if len(v) >= least and len({n for _, n in v}) == 1:
            classes[tuple(i for i, _ in v)] += [(token, j) for j in range(v[0][1])]
    taken: list[set] = [set() for _ in pages]
    order: list[list] = [[] for _ in pages]
    for own, tokens in sorted(classes.items(), key=lambda x: (-len(x[0]), -len(x[1]), x[0])):
        line = sorted(tokens, key=lambda t: where[own[0]][t[0]][t[1]])
        while line:
            found = {i: [where[i][t][j] for t, j in line] for i in own}
            wrong = {k for p in found.values() for k in range(1, len(line)) if p[k - 1] > p[k]}
            if not wrong:
                break
            # tokens that change places aren't of one class with the rest
            line = [t for k, t in enumerate(line) if k not in wrong and k + 1 not in wrong]
        if line and _nests(own, found, order):
            for i in own:
                taken[i].update(found[i])
                order[i].append(found[i])
    return taken


def _nests(own: tuple, found: dict, order: list) -> bool:
    """Whether the class lies, in all its pages alike, in the same slots of every class taken before."""
    for n in range(min(len(order[i]) for i in own)):
        slots = None
        for i in own:
            at = tuple(bisect(order[i][n], x) for x in found[i])
            if slots is not None and len(order[i][n]) == size and at != slots:
                return False
            slots, size = at, len(order[i][n])
    return True


def _apart(pages: list[Page]) -> list[Page]:
    """``pages`` without copies: pages that share COPY_SHARE of their text with one before."""
    found: list[tuple] = []
    for page in pages:
        own: Counter = Counter()
        for text, k, _ in page.runs:
            if page.dropped[k] < 0 and (x := " ".join(text.split())):
                own[x] += len(x)
        size = own.total()
        if not any((own & other).total() >= COPY_SHARE * max(size, n) for other, n, _ in found):
            found.append((own, size, page))
    return [page for *_, page in found]


class Template:
    """The template of a block: its elements, its text, the elements that are notices, and the element whose slots are the main region."""

    def __init__(self, pages: list[Page]):
        self.apart = _apart(pages)
        self.elements, self.texts, self.notices, self.root = set(), set(), set(), None
        if len(self.apart) < 2:
            return
        for p, tokens in zip(self.apart, template(self.apart, max(2, math.ceil(FIXED_SHARE * len(self.apart))))):
            for token, _, r in map(p.tokens.__getitem__, tokens):
                (self.texts if r >= 0 else self.elements).add(token)
        self._weigh()

    def fixed(self, page: Page) -> set:
        """The runs of ``page`` that are text of the template."""
        return {r for token, _, r in page.tokens if r >= 0 and token in self.texts}

    def _weigh(self) -> None:
        """What each path's slots hold, and what is the template's or a link there, choose the region."""
        paths = self.apart[0].paths
        held, other, chrome = ([0] * len(paths.up) for _ in range(3))
        for page in self.apart:
            fixed = self.fixed(page)
            inside = {r for r, _ in varying(page, fixed)}
            for r, (text, k, _) in enumerate(page.runs):
                if text.isspace():
                    continue
                if r not in fixed:
                    other[page.path[k]] += 1
                if page.dropped[k] < 0:
                    (held if r in inside else chrome)[page.path[k]] += len(text)
        for path in range(len(held) - 1, 0, -1):  # a path has a greater number than those it goes on from
            if (up := paths.up[path]) >= 0:
                held[up] += held[path]
                other[up] += other[path]
                chrome[up] += chrome[path] if other[path] else 0  # what only ever holds template text is left out anyway
        self.notices = {p for p in self.elements if not other[p]}
        most = [p for p in self.elements if held[p] > MAIN_SHARE * held[0]]
        best = max(most, key=lambda p: (held[p] - chrome[p], p), default=None)
        named = [p for p in most if paths.main[p] and held[p] > MAIN_SHARE * held[best]]
        named = [p for p in named if paths.name[p] == "article"] or named
        self.root = max(named, key=lambda p: (held[p], -p), default=best)


def varying(page: Page, fixed: set) -> list:
    """The runs that aren't of the template, nor links (but for headings), nor in parts left out by name."""
    return [(r, run) for r, run in enumerate(page.runs) if r not in fixed and page.dropped[run[1]] < 0 and not run[0].isspace() and (not page.link[run[1]] or page.heading[run[1]])]


def _outermost(page: Page, elements: list[int]) -> list[int]:
    outer: list[int] = []
    for k in elements:
        if not outer or k >= page.end[outer[-1]]:
            outer.append(k)
    return outer


def _by_name(page: Page) -> list[int]:
    roots = [k for k in range(len(page.name)) if page.main[k] and page.dropped[k] < 0]
    return _outermost(page, [k for k in roots if page.name[k] == "article"] or roots)


def extract_block(pages: list[Page]) -> list[str]:
    """The main text of each page of one host's block, whose pages number their paths together."""
    deduced = Template(pages)
    out = []
    for page in pages:
        held = varying(page, deduced.fixed(page))
        roots = [k for k in range(len(page.name)) if page.path[k] == deduced.root and page.dropped[k] < 0]
        if not roots:  # nothing to compare with, or a page unlike the others: names, if they hold most of what varies here
            roots = _by_name(page)
            inside = sum(len(run[0]) for _, run in held if any(c <= run[1] < page.end[c] for c in roots))
            roots = roots if len(deduced.apart) < 2 or inside > MAIN_SHARE * sum(len(run[0]) for _, run in held) else []
        roots = _outermost(page, roots)
        plain = not any(page.main[k] for k in roots)
        within = [b for _, (_, k, b) in held if not roots or any(c <= k < page.end[c] for c in roots)]
        first, end = (min(within), max(within)) if plain and within else (0, page.block)
        starts = roots = roots or [0]
        notice = [False] * len(page.name)  # within an element of only template text
        for k, path in enumerate(page.path):
            notice[k] = (path in deduced.notices and not page.heading[k]) or (page.up[k] >= 0 and notice[page.up[k]])
        blocks, last = [], None
        for r, (text, k, b) in enumerate(page.runs):
            at = bisect(starts, k) - 1
            root = roots[at] if at >= 0 and k < page.end[roots[at]] else None
            if root is None or notice[k] or not first <= b <= end or page.dropped[k] > root or (plain and page.dropped[k] >= 0):
                continue
            if b != last:
                blocks.append([])
                last = b
            blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n".join(x for x in lines if x))
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = 32, block_chars: int = 16 << 20) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of every page.

    The text is that of the block's main region (see the module), less menus, headers, footers, asides, forms, adverts,
    notices and comments within it, by element, role or name, and less the elements that hold only the
    template's own text on all pages, but for headings.  A region that isn't named reaches from its first to its last
    varying block.  Of equal regions the inner one counts, unless one of them is named.  Two pages are
    compared like two hundred.  Only pages without any other, and copies of one page, take their region by names alone.
    Character references are decoded; white space within a block is one space; blocks are
    joined by a line feed.

    Null and empty pages give an empty text; an empty table gives no rows.  A null URL is
    a host of its own.  Repeated rows stay.  Other columns of ``pages`` are not read, whatever
    their names.  Very long, deep and broken pages are read whole, in time and memory that grow with their length.

    A host's pages are dealt by hash into blocks of about ``block`` pages and ``block_chars``
    characters, however many it has; rows repeated in id and URL are spread over all of them.
    """
    slim = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    slim = slim.withColumn("host", host_of(F.col("url"))).withColumn("h", F.xxhash64("key", "url"))
    # written first, so that both sides of the join are plain exchanges, which can be split at a hot host
    blocks = F.ceil(F.greatest(F.lit(1), F.count("*") / block, F.sum(F.coalesce(F.length("html"), F.lit(0))) / block_chars)).cast("int")
    sizes = staged(slim.groupBy("host").agg(blocks.alias("blocks")), "html-hosts")
    repeats = staged(slim.groupBy("h").count().where("count > 1").select(F.col("h").alias("again")), "html-repeats")
    if repeats.isEmpty():
        salt = F.col("h")
    else:
        slim = slim.withColumn("row", F.monotonically_increasing_id()).join(repeats, F.col("h") == F.col("again"), "left")
        salt = F.when(F.col("again").isNotNull(), F.xxhash64("h", "row")).otherwise(F.col("h"))
    dealt = slim.withColumn("h", salt).join(sizes, "host")
    dealt = dealt.withColumn("block", F.concat_ws("#", "host", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("string")))

    def run(group: pa.Table) -> pa.Table:
        group, paths = group.combine_chunks(), Paths()
        texts = extract_block([Page(h or "", paths) for h in group["html"].to_pylist()])
        return pa.table({"key": group["key"], "url": group["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    kind = slim.schema["key"].dataType.simpleString()
    out = dealt.select("key", "url", "html", "block").groupBy("block").applyInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"key": id_col, "url": url_col})
