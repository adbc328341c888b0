"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what routes in scripts look like, and the hosts of the own machine
JS_ROUTE = r"""["'](/[A-Za-z0-9_\-/]{1,80}(?:\?[^"']*)?)["']"""
LOOPBACK_HOSTS = ("127.0.0.1", "localhost", "::1")


def query_names(url: Column) -> Column:
    """The sorted names of a URL's parameters."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.split(x, "=")[0])
    return F.array_sort(names)


def normal_route(url: Column) -> Column:
    """Without fragment, with sorted parameter names instead of values: a route's shape."""
    base, names = F.regexp_replace(url, r"[?#].*$", ""), query_names(url)
    return F.when(F.size(names) > 0, F.concat(base, F.lit("?"), F.array_join(names, "&"))).otherwise(base)


def js_routes(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(JS_ROUTE), F.lit(1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-cased, without user, password, port and brackets."""
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    bare = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(place, ":.*$", ""))
    return F.lower(bare)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_loopback(host: Column) -> Column:
    return F.lower(host).isin(*LOOPBACK_HOSTS)


def under(path: Column, base: str) -> Column:
    """True for the base itself and what lies below it, by whole segments."""
    base = base.rstrip("/")
    return F.lit(True) if not base else (path == base) | path.startswith(base + "/")


def resolved(path: Column) -> Column:
    """The path from its root, without dot segments and empty ones; a slash at its end stays."""
    step = lambda seen, part: F.when(part.isin("", "."), seen).when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, part))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(path.endswith("/") & (F.size(parts) > 0), "/").otherwise(""))


def decoded(path: Column, rounds: int = 5) -> Column:
    """Percent-decoding repeated; a sign without two hexadecimal digits, and a plus, stay as they are."""
    for _ in range(rounds):
        safe = F.regexp_replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        path = F.coalesce(F.try_url_decode(safe), path)
    return path


def path_variants(path: Column) -> Column:
    """What a browser or server may take a path for: as sent and wholly decoded, both resolved, backslashes as slashes in the latter."""
    return F.array(resolved(path), resolved(F.translate(decoded(path), "\\", "/")))


def any_of(tests: list[Column]) -> Column:
    """True if one of the tests holds; false without any."""
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def in_scope(url: Column, hosts: tuple[str, ...], domains: tuple[str, ...], excluded: tuple[str, ...] = (), allowed: tuple[str, ...] = (), external: bool = False) -> Column:
    """ok and the first reason that speaks against it.

    No variant of the path may begin as an excluded one, and all must lie under an allowed prefix, if there are any. Hosts
    other than the own machine need ``external``. A null url is out of scope.
    """
    h = host(url)
    known = h.isin(*hosts) | any_of([(h == d) | h.endswith("." + d) for d in domains])
    variants = path_variants(path(url))
    roots = [resolved(F.lit(x)) for x in excluded]
    bad = F.exists(variants, lambda v: any_of([v.startswith(x) for x in roots]))
    inside = F.forall(variants, lambda v: any_of([under(v, x) for x in allowed])) if allowed else F.lit(True)
    of = lambda ok, why: F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("reason"))
    found = F.when(url.isNull() | ~scheme(url).isin("http", "https"), of(False, "scheme")).when(~known, of(False, "host"))
    if not external:
        found = found.when(~is_loopback(h), of(False, "external host"))
    return found.when(bad, of(False, "excluded path")).when(~inside, of(False, "outside allowed prefixes")).otherwise(of(True, "in_scope"))


# fixed values: a reference's scheme, authority, path, query and fragment, and what an anchor's and a base's address look like
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
ANCHOR = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
BASE = r"""(?is)<base(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def without_dots(path: Column) -> Column:
    """A path without its dot segments; empty segments stay, and a dot segment at the end leaves a slash."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    steps = F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i == last).alias("last")))

    def step(seen: Column, s: Column) -> Column:
        # the first segment, empty for a path from the root, is never taken away
        fewer = F.when((s["x"] == "..") & (F.size(seen) > 1), F.slice(seen, F.lit(1), F.size(seen) - 1)).otherwise(seen)
        ended = F.when(s["last"], F.array_append(fewer, F.lit(""))).otherwise(fewer)
        return F.when(s["x"].isin(".", ".."), ended).otherwise(F.array_append(seen, s["x"]))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def joined(base: Column, reference: Column) -> Column:
    """A reference resolved against an absolute base URL with a host; null if either is null."""
    b, r = ([F.regexp_extract(u, REFERENCE, k) for k in range(1, 6)] for u in (base, reference))
    folder = F.when((b[1] != "") & (b[2] == ""), F.lit("/")).otherwise(F.regexp_extract(b[2], r"(?s)^(.*/)?", 0))
    with_host = F.concat(b[0], F.lit(":"), b[1])
    tail = F.concat(r[3], r[4])
    return (
        F.when(r[0] != "", F.concat(r[0], F.lit(":"), r[1], without_dots(r[2]), tail))
        .when(r[1] != "", F.concat(b[0], F.lit(":"), r[1], without_dots(r[2]), tail))
        .when(r[2] == "", F.concat(with_host, b[2], F.when(r[3] != "", r[3]).otherwise(b[3]), r[4]))
        .when(r[2].startswith("/"), F.concat(with_host, without_dots(r[2]), tail))
        .otherwise(F.concat(with_host, without_dots(F.concat(folder, r[2])), tail))
    )


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def anchors(html: Column) -> Column:
    """The addresses of all anchors, quoted in either way or not at all, whatever other attributes they have."""
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), lambda x: F.btrim(unquoted(x)))


def base_of(url: Column, html: Column) -> Column:
    """What a page's references are resolved against: its first base element, itself resolved, or else its URL."""
    own = F.btrim(unquoted(F.regexp_extract(html, BASE, 1)))
    return F.when(own != "", joined(url, own)).otherwise(url)
