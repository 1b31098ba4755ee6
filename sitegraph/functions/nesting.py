"""Which open elements a tag closes: the nesting rules, and the small per-page
helper that applies them to a page's token codes.

Only token heads travel to Python (``<name`` or ``</name``, nothing for a text);
texts and attributes stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc


@dataclass(frozen=True)
class Dialect:
    """``nestable`` maps a name to the names that stop the search for an earlier
    element to close; ``reset`` names stop each other when they are not nestable."""

    void: frozenset[str] = frozenset()
    nestable: dict[str, frozenset[str]] = field(default_factory=dict)
    reset: frozenset[str] = frozenset()
    literal: frozenset[str] = frozenset()
    keep_blank: frozenset[str] = frozenset()
    child_attributes: bool = False


def _free(*names: str) -> dict[str, frozenset[str]]:
    return {name: frozenset() for name in names}


# fixed values: element groups and what interrupts their nesting
_INLINE = _free("span", "font", "q", "object", "bdo", "sub", "sup", "center")
_BLOCK = _free("blockquote", "div", "fieldset", "ins", "del")
_LISTS = {
    **_free("ol", "ul", "dl"),
    "li": frozenset({"ul", "ol"}),
    "dd": frozenset({"dl"}),
    "dt": frozenset({"dl"}),
}
_TABLES = {
    **_free("table"),
    "tr": frozenset({"table", "tbody", "tfoot", "thead"}),
    "td": frozenset({"tr"}),
    "th": frozenset({"tr"}),
    "thead": frozenset({"table"}),
    "tbody": frozenset({"table"}),
    "tfoot": frozenset({"table"}),
}
_SINGLE = {"address", "form", "p", "pre", "noscript"}
_OFTEN_NESTED = _free(
    "em", "big", "i", "small", "tt", "abbr", "acronym", "strong", "cite", "code", "dfn",
    "kbd", "samp", "var", "b", "noscript",
)
_VOID = frozenset(
    {"br", "hr", "input", "img", "meta", "spacer", "link", "frame", "base", "col"}
)

HTML = Dialect(
    void=_VOID,
    nestable={**_INLINE, **_BLOCK, **_LISTS, **_TABLES},
    reset=frozenset({*_BLOCK, *_LISTS, *_TABLES, *_SINGLE}),
    literal=frozenset({"script", "textarea"}),
    keep_blank=frozenset({"pre", "textarea"}),
)
DIALECTS = {
    "html": HTML,
    "nestable_inline": replace(HTML, nestable={**HTML.nestable, **_OFTEN_NESTED}),
    "minimal": replace(HTML, nestable={}, reset=frozenset()),
    "xml": Dialect(),
    "soap": Dialect(child_attributes=True),
}


#: what a token does: nothing, end an element, stand as a string, start an element
_NOTHING, _END, _STRING, _START = range(4)
_TAG = re.compile(r"[a-zA-Z][-_.:a-zA-Z0-9]*")
#: what does, the name that nests, the names that stop the search, whether an earlier one of its
#: name closes, no content, a literal body follows, the name of the node
_Reading = tuple[int, str, Collection[str], bool, bool, bool, str | None]


def _read(head: str, rules: Dialect) -> _Reading:
    second = head[1:2]
    if second == "/":
        return _END, head[2:].strip().lower(), (), False, False, False, None
    if not second.isalpha():
        return _NOTHING if head in ("<![", "<!>") else _STRING, "", (), False, False, False, None
    tag = head[1:].lower()
    name = tag.rstrip("/> \t\r\n\f")
    literal = name in rules.literal
    leaf = name in rules.void or (tag[-1] == "/" and not literal)
    triggers = rules.nestable.get(name)
    alone = triggers is None
    if alone:
        triggers = rules.reset if name in rules.reset else ()
    known = _TAG.match(tag)
    return _START, name, triggers, alone, leaf, literal and tag == name, known.group() if known else name


def _place(pieces: Iterable[_Reading], keep_blank: Collection[str]) -> tuple[list, ...]:
    """The nodes of a page by columns: those of ``_COLUMNS``, and the names of elements."""
    tokens, raws, posts, depths, parents, numbers, keeps, shown = [-1], [False], [0], [0], [None], [0], [False], [None]
    children, blank, n = [0], 0, 1
    # open elements, and per name the positions where it is open
    pres, names, where = [0], [""], {}
    for token, (what, name, triggers, alone, leaf, body, known) in enumerate(pieces):
        if what == _NOTHING:
            continue
        at = 0
        if what == _END:
            same = where.get(name)
            at = same[-1] if same else 0
        elif what == _START and not leaf:
            same = where.get(name) if alone else None
            for t in triggers:
                there = where.get(t)
                if there and there[-1] > at:
                    at = there[-1]
            if same and same[-1] >= at:
                at = same[-1]
            elif at:
                at += 1
        if at:
            while len(pres) > at:
                closed = names.pop()
                posts[pres.pop()] = n - 1
                where[closed].pop()
                blank -= closed in keep_blank
        if what == _END:
            continue
        parent = pres[-1]
        for raw in (False, True) if body else (False,):
            if raw:
                parent = n - 1
            tokens.append(token)
            raws.append(raw)
            posts.append(n)
            depths.append(len(pres))
            parents.append(parent)
            numbers.append(children[parent])
            keeps.append(blank > 0)
            shown.append(None if raw else known)
            children[parent] += 1
            children.append(0)
            n += 1
            if what == _START and not leaf and not raw:
                where.setdefault(name, []).append(len(pres))
                pres.append(n - 1)
                names.append(name)
                blank += name in keep_blank
    for pre in pres:
        posts[pre] = n - 1
    return tokens, raws, posts, depths, parents, numbers, keeps, shown


def assign_structure(heads: list[str], rules: Dialect) -> list[list]:
    """Node rows ``[token, raw, post, depth, parent, sib_no, keep_blank]`` in
    document order, from the heads of a page's tokens.

    Heads: ``<name`` opens, ``</name`` closes, ``<![`` and ``<!>`` make no node,
    anything else is a string node. A literal element's token holds its body too:
    the body becomes a ``raw`` string child, unless a character after the name in
    the head tells that it is empty. A head ending in ``/`` has no content.
    """
    return [list(row) for row in zip(*_place([_read(h, rules) for h in heads], rules.keep_blank)[:7], strict=True)]


_COLUMNS = (
    ("token", pa.int32()), ("raw", pa.bool_()), ("post", pa.int32()), ("depth", pa.int32()),
    ("parent_pre", pa.int32()), ("sib_no", pa.int32()), ("keep_blank", pa.bool_()),
)
STRUCTURE = (
    "token ARRAY<INT>, raw ARRAY<BOOLEAN>, post ARRAY<INT>, depth ARRAY<INT>, "
    "parent_pre ARRAY<INT>, sib_no ARRAY<INT>, keep_blank ARRAY<BOOLEAN>"
)
#: of elements asked for by name: a string that is an only child is told by its token
_NAMED = (
    *_COLUMNS, ("name", pa.string()), ("pre", pa.int32()),
    ("child_token", pa.int32()), ("child_raw", pa.bool_()), ("child_keep", pa.bool_()),
)
NAMED_STRUCTURE = STRUCTURE + ", name ARRAY<STRING>, pre ARRAY<INT>, child_token ARRAY<INT>, child_raw ARRAY<BOOLEAN>, child_keep ARRAY<BOOLEAN>"


def _named(columns: tuple[list, ...], names: Collection[str]) -> list[list]:
    """The root and the elements of these names, with their numbers and only strings."""
    tokens, raws, posts, keeps, shown = columns[0], columns[1], columns[2], columns[6], columns[7]
    pres = [pre for pre, name in enumerate(shown) if name in names or not pre]
    # an only child has the next number, and its parent ends with it
    child = [pre + 1 if posts[pre] == pre + 1 and shown[pre + 1] is None else None for pre in pres]
    own = [[None if c is None else column[c] for c in child] for column in (tokens, raws, keeps)]
    return [*([column[pre] for pre in pres] for column in columns), pres, *own]


def structure_batch(pages: pa.Array, rules: Dialect, names: Collection[str] | None = None) -> pa.Array:
    """One Arrow batch of token-head lists to parallel node arrays; with ``names`` only of the
    root and of elements with these names. Equal heads of a batch are read once."""
    heads = pages.flatten().dictionary_encode()
    read = [_read(h, rules) for h in heads.dictionary.to_pylist()]
    pieces = [read[i] for i in heads.indices.to_numpy().tolist()]
    kinds = _COLUMNS if names is None else _NAMED
    offsets, columns, first = [0], [[] for _ in kinds], 0
    for size in pc.fill_null(pc.list_value_length(pages), 0).to_numpy().tolist():
        rows = _place(pieces[first:first + size], rules.keep_blank)
        first += size
        rows = rows[:len(kinds)] if names is None else _named(rows, names)
        offsets.append(offsets[-1] + len(rows[0]))
        for column, values in zip(columns, rows, strict=True):
            column.extend(values)
    lists = [
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(column, kind))
        for column, (_, kind) in zip(columns, kinds, strict=True)
    ]
    return pa.StructArray.from_arrays(lists, [name for name, _ in kinds])
