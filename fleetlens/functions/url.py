"""URL and path expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

ORIGIN = r"^(?i)https?://[^/?#]*"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip_fragment(col: Column) -> Column:
    return F.regexp_replace(col, r"#.*$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def rooted(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?!/)", "/")


def relative_path(url: Column) -> Column:
    """Path plus query, always starting with '/'; '' and null become '/'."""
    bare = strip_fragment(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), ORIGIN, ""))
    return rooted(bare)


def _split_query(bare: Column) -> tuple[Column, Column]:
    path = F.regexp_extract(bare, r"^[^?]*", 0)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    return path, query


def _sorted_query(query: Column) -> Column:
    return F.concat_ws("&", F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")))


def compare_path(url: Column) -> Column:
    """Host and fragment dropped, trailing slashes stripped, query parameters sorted."""
    text = F.trim(F.coalesce(url, F.lit("")))
    bare = strip_fragment(F.regexp_replace(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""))
    path, query = _split_query(bare)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"^$", "/")
    full = F.regexp_replace(F.concat(path, F.lit("?"), _sorted_query(query)), r"\?$", "")
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit("")).otherwise(full)


def percent_decode(col: Column) -> Column:
    """Percent-decoding that keeps '+' and keeps the text when it is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def nfc(col: Column) -> Column:
    """Unicode NFC; Spark has no builtin for it, so an Arrow batch goes through Python."""

    def normalize(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return F.pandas_udf(normalize, "string")(col)


def _local(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"(?s)^https?://[^/?#]*([^#]*).*$", "$1")


def decoded_path(url: Column) -> Column:
    """The path of a URL, percent-decoded; '' without one."""
    return let(F.regexp_extract(_local(url), r"^[^?]*", 0), percent_decode)


def match_path(url: Column, unicode_form: bool = False, path: Column | None = None) -> Column:
    """Key used to match redirects: decoded, lower-case, one trailing slash stripped, query sorted.

    `unicode_form` adds NFC through a Python worker, row by row; tables compose their
    few other paths with `operators.redirects.composed` and hand them in as `path`.
    """
    path = decoded_path(url) if path is None else path
    query = F.regexp_extract(_local(url), r"^[^?]*\?([^?]*)", 1)
    if unicode_form:
        path = nfc(path)
    path = rooted(F.regexp_replace(F.lower(path), r"(?s)^(.+)/$", "$1"))
    # Parameters sort by name only and keep their order within one name.
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"),
                              F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")),
    )
    params = F.concat_ws("&", F.transform(F.array_sort(pairs), lambda s: s["p"]))
    full = F.regexp_replace(F.concat(path, F.lit("?"), params), r"\?$", "")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(full)


#: The parts of a URL reference: scheme, authority, path, query. A backslash counts as a slash.
REFERENCE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?([/\\\\]{2}[^/\\\\?#]*)?([^?#]*)(\?[^#]*)?"
#: Printable characters that a path or query may not hold as they are.
ESCAPED = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D"}


def _reference(text: Column) -> Column:
    """struct<scheme, authority, path, query> of a reference; what is not there is ''."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    part = lambda t, k: F.regexp_extract(t, REFERENCE, k)
    return let(bare, lambda t: F.named_struct(
        F.lit("scheme"), F.lower(part(t, 1)), F.lit("authority"), F.translate(part(t, 2), "\\", "/"),
        F.lit("path"), F.translate(part(t, 3), "\\", "/"), F.lit("query"), part(t, 4)))


def without_dots(path: Column) -> Column:
    """A path that starts with '/', its `.` and `..` segments carried out; `..` stops at the root."""
    is_dot = lambda s, *dots: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")).isin(*dots)

    def walked(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(
            is_dot(s, ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(is_dot(s, "."), done).otherwise(
            F.array_append(done, s)))
        open_end = F.when(is_dot(F.element_at(segments, -1), ".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))

    dotted = path.rlike(r"(?i)/(\.|%2e)")
    return F.when(dotted, let(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), walked)).otherwise(path)


def escaped(text: Column) -> Column:
    """A path or query with blanks, quotes, brackets and all that is not printable ASCII as UTF-8 percent escapes."""
    for char, code in ESCAPED.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    pieces = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[!-~]+|[^!-~]+"), F.lit(0)),
                                   lambda s: F.when(s.rlike("^[!-~]"), s).otherwise(F.url_encode(s)))
    return let(text, lambda t: F.when(t.rlike("[^!-~]"), F.array_join(pieces(t), "")).otherwise(t))


def resolve(base: Column, reference: Column) -> Column:
    """The absolute http(s) URL, without fragment, that a reference on the page `base` stands for; null for others.

    Paths are merged with the base's and their dot segments carried out; hosts become
    lower case, default ports go, an empty path becomes '/'. An empty reference is the page itself.
    Null when the outcome is not http(s) or names no host (`mailto:`, `data:`, a
    relative reference on a relative base). Host names outside ASCII stay as written.
    """
    def joined(b: Column, r: Column) -> Column:
        own = (r["scheme"] != "") & (r["scheme"] != b["scheme"])
        placed = own | (r["authority"] != "")
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        merged = (F.when(placed | r["path"].startswith("/"), r["path"]).when(r["path"] == "", b["path"])
                  .otherwise(F.concat(rooted(F.regexp_extract(b["path"], r"(?s)^(.*/)?", 0)), r["path"])))
        query = F.when(placed | (r["path"] != "") | (r["query"] != ""), r["query"]).otherwise(b["query"])
        authority = F.substr(F.when(placed, r["authority"]).otherwise(b["authority"]), F.lit(3))
        user, place = F.regexp_extract(authority, r"^(.*@)?", 0), F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))
        port = F.when(scheme == "http", F.regexp_replace(place, r":(80)?$", "")).otherwise(F.regexp_replace(place, r":(443)?$", ""))
        known = scheme.isin("http", "https") & (place != "")
        return F.when(known, F.concat(scheme, F.lit("://"), user, port, escaped(let(rooted(merged), without_dots)), escaped(query)))

    return let(_reference(base), lambda b: let(_reference(reference), lambda r: joined(b, r)))


def crawl_url(url: Column) -> Column:
    """Fragment dropped, host lower-cased, empty path kept as is."""
    bare = strip_fragment(F.trim(url))
    scheme = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    netloc = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when(
        scheme != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(netloc), rest)
    ).otherwise(bare)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def host(target: Column) -> Column:
    """Host of a URL or of a bare host[:port][/path]; lower-case, no port."""
    rest = F.regexp_replace(F.trim(target), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    netloc = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")
    return F.lower(F.regexp_replace(netloc, r":\d+$", ""))


def registered_domain(host_col: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host_col, ".", -2)


def cert_name_matches(pattern: Column, host_col: Column) -> Column:
    """Exact name, or '*.' standing for exactly one label."""
    p, h = F.regexp_replace(F.lower(pattern), r"^dns:", ""), F.lower(host_col)
    wild = p.startswith("*.") & (F.regexp_replace(h, r"^[^.]+", "") == F.substr(p, F.lit(2)))
    return (p == h) | (wild & h.rlike(r"^[^.]+\."))


def slug(url: Column) -> Column:
    """Last path segment, lower-case, without its extension."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^https?://[^/?#]*([^?#]*).*$", "$1")
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1)), r"\.[^/.]+$", "")


def title_from_url(url: Column) -> Column:
    """Slug with separators as spaces and each word's first letter upper-cased."""
    words = F.split(F.regexp_replace(slug(url), r"[-_]", " "), r"\b")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""
    )


def page_slug(path: Column) -> Column:
    """File-safe slug of a path: each segment cleaned, '/' is 'index'."""
    bare = F.regexp_extract(relative_path(path), r"^[^?]*", 0)
    clean = lambda s: F.regexp_replace(
        F.regexp_replace(F.lower(s), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", ""
    )
    parts = F.filter(F.transform(F.split(bare, "/"), clean), lambda s: s != "")
    return F.regexp_replace(F.array_join(parts, "/"), r"^$", "index")


def upload_path(url: Column, bases: tuple[str, ...] = ()) -> Column:
    """Path of an upload below the uploads folder; decoded, no query, no leading slash."""
    text = let(F.trim(F.coalesce(url, F.lit(""))), percent_decode)
    for base in bases:
        text = F.regexp_replace(text, rf"^\Q{base}\E", "")
    text = F.regexp_replace(text, r"(?s)^.*?wp-content/uploads/", "")
    text = F.regexp_replace(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(text, r"^[^?#]*", 0), r"^/+", "")


SIZE_SUFFIX = r"-(\d+x\d+)((?:\.[a-zA-Z0-9]{2,5})+)$"


def image_parent(path: Column) -> Column:
    """'a-150x150.jpg' -> 'a.jpg'; other paths unchanged."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), SIZE_SUFFIX, "$2")


def image_size(path: Column) -> Column:
    """'a-150x150.jpg' -> '150x150'; null when there is no size suffix."""
    return blank_to_null(F.regexp_extract(path, SIZE_SUFFIX, 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """'a/b/c.txt' -> ['.', 'a', 'a/b']; '.' and '' have none."""
    parts = F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda p: p != "")

    def prefixes(p: Column) -> Column:
        return F.when(
            F.size(p) > 0,
            F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")),
        ).otherwise(F.array().cast("array<string>"))

    full = F.array_distinct(F.concat(F.array(F.lit(".")), let(parts, prefixes)))
    return F.when((path == ".") | (path == ""), F.array().cast("array<string>")).otherwise(full)
