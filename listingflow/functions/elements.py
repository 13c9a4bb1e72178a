"""Fields of pages by selectors over a tree of elements, all of a page's in one pass.

A page is read once into elements with their place in the page's text; selectors are compiled once for each task and
look candidates up by class or tag.  A selector is a list, separated by commas, of chains of ``tag.class[class*=part]:contains(text)``
joined by a space (within), ``>`` (child of) or ``~`` (after, of the same parent); ``[name]`` asks for an attribute.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'=]""")
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends, and what that doesn't reach beyond.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDS |= dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"button", "td", "th", "li", "div", "section", "article"}))
COMPOUND = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<classes>(?:\.[\w-]+)*)(?:\[class\*=(?P<part>[\w-]+)\])?(?:\[(?P<has>[\w-]+)\])?(?::contains\((?P<text>[^)]*)\))?")


class Tree:
    """The elements of a page in order: name, attributes, parent, children, and where their text lies."""

    def __init__(self, html: str):
        self.names, self.attributes, self.parents, self.children, self.ends, self.spans, self.first = [], [], [], [], [], [], []
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.by_class: dict[str, list[int]] = defaultdict(list)
        self.text, self.length, at = [], 0, 0
        self.stack = [self._add("#page", {}, -1)]
        while m := MARKUP.search(html, at):
            self._put(html[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW and self.names[self.stack[-1]] == name:
                end = RAW[name].search(html, at)
                self._put(html[at : end.start() if end else len(html)], raw=name in ("script", "style"))
                at = end.end() if end else len(html)
                self._close(name)
        self._put(html[at:])
        while self.stack:
            self._pop()
        self.whole = "".join(self.text)

    def _add(self, name: str, attributes: dict, parent: int) -> int:
        k = len(self.names)
        for values, value in ((self.names, name), (self.attributes, attributes), (self.parents, parent), (self.children, []), (self.ends, 0), (self.spans, [self.length, 0]), (self.first, None)):
            values.append(value)
        if parent >= 0:
            self.children[parent].append(k)
        self.by_tag[name].append(k)
        for c in set(attributes.get("class", "").split()):
            self.by_class[c].append(k)
        return k

    def _open(self, name: str, source: str) -> None:
        if name in ENDS:
            ended, limits = ENDS[name]
            for i in range(len(self.stack) - 1, 0, -1):
                own = self.names[self.stack[i]]
                if own in ended:
                    while len(self.stack) > i:
                        self._pop()
                    break
                if own in limits:
                    break
        found = {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(source)) if k}
        self.stack.append(self._add(name, found, self.stack[-1]))
        if name in VOID or source.endswith("/"):
            self._pop()

    def _close(self, name: str) -> None:
        if any(self.names[k] == name for k in reversed(self.stack)):
            while self.names[self.stack[-1]] != name:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        k = self.stack.pop()
        self.ends[k], self.spans[k][1] = len(self.names), self.length

    def _put(self, text: str, raw: bool = False) -> None:
        if text:
            text = text if raw or "&" not in text else unescape(text)
            own = self.stack[-1]
            if self.first[own] is None:
                self.first[own] = (self.length, self.length + len(text))
            self.text.append(text)
            self.length += len(text)


@dataclass(frozen=True)
class Step:
    """One element of a chain and how it stands to the one before."""

    joined: str
    tag: str | None
    classes: tuple[str, ...]
    part: str | None
    has: str | None
    text: str | None

    def fits(self, tree: Tree, k: int) -> bool:
        if k == 0 or (self.tag and tree.names[k] != self.tag):
            return False
        own = tree.attributes[k].get("class", "")
        if self.classes and not set(self.classes) <= set(own.split()) or self.part and self.part not in own or self.has and self.has not in tree.attributes[k]:
            return False
        return not self.text or (tree.first[k] is not None and self.text in tree.whole[slice(*tree.first[k])])


def compiled(selector: str) -> list[list[Step]]:
    chains = []
    for chain in selector.split(","):
        steps, joined = [], " "
        for word in re.findall(r"[>~]|(?:[^\s>~(]|\([^)]*\))+", chain):
            if word in ">~":
                joined = word
                continue
            m = COMPOUND.fullmatch(word)
            if not m:
                raise ValueError(f"not a selector: {word}")
            tag = m["tag"] if m["tag"] != "*" else None
            steps.append(Step(joined, tag and tag.lower(), tuple(m["classes"].split(".")[1:]), m["part"], m["has"], m["text"]))
            joined = " "
        if not steps:
            raise ValueError(f"not a selector: {selector}")
        chains.append(steps)
    return chains


def _matches(tree: Tree, steps: list[Step], at: int, k: int) -> bool:
    if not steps[at].fits(tree, k):
        return False
    if at == 0:
        return True
    up = tree.parents[k]
    if steps[at].joined == ">":
        return up >= 0 and _matches(tree, steps, at - 1, up)
    if steps[at].joined == "~":
        return any(_matches(tree, steps, at - 1, s) for s in tree.children[up] if s < k)
    while up >= 0:
        if _matches(tree, steps, at - 1, up):
            return True
        up = tree.parents[up]
    return False


def first(tree: Tree, chains: list[list[Step]], root: int = 0) -> int | None:
    """The first element below ``root`` that one of the chains leads to."""
    found = []
    for steps in chains:
        last = steps[-1]
        candidates = tree.by_class.get(last.classes[0], []) if last.classes else tree.by_tag.get(last.tag, []) if last.tag else range(len(tree.names))
        found.append(next((k for k in candidates if root < k < tree.ends[root] and _matches(tree, steps, len(steps) - 1, k)), None))
    return min((k for k in found if k is not None), default=None)


class Fields:
    """A table of fields: name, selectors in the order they are tried, and what is taken (``text``, ``own`` for the first text directly in it, or an attribute)."""

    def __init__(self, table: dict[str, tuple[tuple[str, ...], str]]):
        self.names = list(table)
        self.rules = [([compiled(s) for s in selectors], take) for selectors, take in table.values()]

    def take(self, tree: Tree, root: int = 0) -> list[str]:
        """A value for each field: of the first selector that leads to an element, trimmed; empty without one."""
        out = []
        for selectors, take in self.rules:
            k = next((k for k in (first(tree, c, root) for c in selectors) if k is not None), None)
            if k is None:
                out.append("")
            elif take in ("text", "own"):
                span = tree.spans[k] if take == "text" else tree.first[k]
                out.append(tree.whole[span[0] : span[1]].strip() if span else "")
            else:
                out.append(tree.attributes[k].get(take, ""))
        return out


def select_fields(html: Column, table: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """A struct of the fields of each page, all from one pass over it; all empty for a null page."""
    kind = "struct<" + ",".join(f"`{n}`:string" for n in table) + ">"

    @F.pandas_udf(kind)
    def select(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fields = Fields(table)
        for batch in pages:
            yield pd.DataFrame([fields.take(Tree(h or "")) for h in batch], columns=fields.names)

    return select(html)


def select_each(html: Column, items: str, holding: str, table: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """An array of structs: the fields of each outermost element of ``items`` that holds an element of ``holding``; empty for a null page."""
    kind = "array<struct<" + ",".join(f"`{n}`:string" for n in table) + ">>"

    @F.pandas_udf(kind)
    def select(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fields, wanted, held = Fields(table), compiled(items), compiled(holding)
        for batch in pages:
            out = []
            for page in batch:
                tree, rows, end = Tree(page or ""), [], 0
                for k in sorted({k for steps in wanted for k in range(1, len(tree.names)) if _matches(tree, steps, len(steps) - 1, k)}):
                    if k >= end:
                        end = tree.ends[k]
                        if first(tree, held, k) is not None:
                            rows.append(dict(zip(fields.names, fields.take(tree, k))))
                out.append(rows)
            yield pd.Series(out)

    return select(html)
