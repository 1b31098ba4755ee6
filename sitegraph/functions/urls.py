"""URL resolution (RFC 3986, section 5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# the reference-splitting pattern of RFC 3986, appendix B
_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments away; never climbs above the root."""
    absolute = path.startswith("/")
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    ends_in_dots = path.rlike(r"(^|/)\.\.?$")
    tail = F.when(ends_in_dots & (folded != ""), F.lit("/")).otherwise(F.lit(""))
    head = F.when(absolute, F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, folded, tail)).otherwise(path)


def _folder(base: Column) -> Column:
    path = _part(base, 5)
    return F.when(
        (path == "") & (_part(base, 3) != ""), F.lit("/")
    ).otherwise(F.regexp_replace(path, "[^/]*$", ""))


def base_folder(base: Column) -> Column:
    """What a bare name found on the page at ``base`` is put behind; null where dot segments are to
    be folded first."""
    folder = _folder(base)
    whole = F.concat(_part(base, 1), _part(base, 3), folder)
    return F.when(~folder.rlike(r"(^|/)\.\.?(/|$)"), whole)


def resolve_url(base: Column, href: Column, folder: Column | None = None) -> Column:
    """Absolute form of ``href`` found on the page at ``base``.

    An empty reference is the page itself; one with its own scheme is returned
    unchanged. With the ``base_folder`` of the page, which its links share, bare
    names need not be taken to parts.
    """
    if folder is not None:
        bare = href.rlike(r"^[^:/?#.][^:/?#]*+\z") & folder.isNotNull()
        return F.when(bare, F.concat(folder, href)).otherwise(resolve_url(base, href))
    path, query, fragment = _part(href, 5), _part(href, 6), _part(href, 7)
    base_path, base_query = _part(base, 5), _part(base, 6)
    root = F.concat(_part(base, 1), _part(base, 3))
    folder = _folder(base)
    return (
        F.when(href == "", base)
        .when(_part(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(_part(base, 1), href))
        .when(path.startswith("/"), F.concat(root, remove_dot_segments(path), query, fragment))
        .when(
            path == "",
            F.concat(root, base_path, F.when(query != "", query).otherwise(base_query), fragment),
        )
        .otherwise(
            F.concat(root, remove_dot_segments(F.concat(folder, path)), query, fragment)
        )
    )
