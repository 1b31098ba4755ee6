"""Node selectors: search criteria as one boolean Column over a node row."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Matcher = None | bool | str | re.Pattern | list | tuple | set | dict | Callable[[Column], Column]


def matches(value: Column, against: Matcher) -> Column:
    """``None``: absent; ``True``: present; text: equal; list or dict: one of its
    members; compiled pattern: found anywhere; function: its Column result."""
    if against is None:
        return value.isNull()
    if against is True:
        return value.isNotNull()
    if isinstance(against, re.Pattern):
        return F.coalesce(value.rlike(inline_flags(against)), F.lit(False))
    if callable(against):
        return F.coalesce(against(value), F.lit(False))
    if isinstance(against, (list, tuple, set, dict)):
        return F.coalesce(value.isin(*[str(x) for x in against]), F.lit(False))
    return F.coalesce(value == F.lit(str(against)), F.lit(False))


def inline_flags(pattern: re.Pattern) -> str:
    flags = "".join(
        letter
        for letter, flag in (("i", re.I), ("s", re.S), ("m", re.M))
        if pattern.flags & flag
    )
    return (f"(?{flags})" if flags else "") + pattern.pattern


def css_class(value: Column, name: str) -> Column:
    """One blank-separated token of the ``class`` value equals ``name``."""
    return F.coalesce(F.array_contains(F.split(value, r"\s+"), name), F.lit(False))


@dataclass(frozen=True)
class Selector:
    """``name`` and ``attrs`` select elements, ``text`` selects strings.

    ``attrs`` given as text is a CSS class. ``where`` is any further predicate
    over the node columns.
    """

    name: Matcher = None
    attrs: Mapping[str, Matcher] | str | None = None
    text: Matcher = None
    where: Callable[[Callable[[str], Column]], Column] | None = None

    def on(self, row: Callable[[str], Column] = F.col) -> Column:
        """Predicate; ``row`` maps a node column name to a Column."""
        if self.text is not None:
            found = (row("kind") != "tag") & (row("text") != "") & matches(row("text"), self.text)
        else:
            found = row("kind") == "tag"
            if self.name is not None and self.name is not False:
                found = found & matches(row("name"), self.name)
            if isinstance(self.attrs, str):
                found = found & css_class(row("attr")["class"], self.attrs)
            for key, against in (self.attrs if isinstance(self.attrs, Mapping) else {}).items():
                found = found & matches(row("attr")[key], against)
        if self.where is not None:
            found = found & self.where(row)
        return found


# no criteria: every element (strings need a ``text`` criterion)
ANY = Selector()


def sel(name: Matcher = None, attrs: Mapping[str, Matcher] | str | None = None,
        text: Matcher = None, **kw: Matcher) -> Selector:
    """Shorthand; further keywords are attribute conditions (``class_`` for class)."""
    if kw:
        more = {key.rstrip("_"): value for key, value in kw.items()}
        if isinstance(attrs, str):
            attrs = {"class": lambda v, c=attrs: css_class(v, c)}
        attrs = {**(attrs or {}), **more}
    return Selector(name, attrs, text)


def attr_get(attr: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(attr[key], F.lit(default))


def attr_has(attr: Column, key: str) -> Column:
    return F.map_contains_key(attr, key)
