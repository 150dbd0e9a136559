"""URL expressions. Built on RFC 3986 splitting, because ``parse_url`` rejects URLs that carry blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.text import let, strip

_AUTHORITY = r"\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(c: Column) -> Column:
    """Lower-cased authority of an absolute URL, else an empty string."""
    return F.lower(F.regexp_extract(c, _AUTHORITY, 2))


def bare_host(c: Column) -> Column:
    return F.regexp_replace(host(c), r"\Awww\.", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(c, r"\A[^?#]*\?([^#]*)", 1)


def canonical_url(c: Column) -> Column:
    """Key for URL equality: lower-case scheme and host, no fragment, no ``;params``, no trailing slash."""


    def rebuilt(raw: Column) -> Column:
        u = F.translate(raw, "\t\r\n", "")
        p = let(
            F.regexp_replace(path(u), r";[^/]*\z", ""),
            lambda x: F.when(x.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(x, r"/+\z", "")),
        )
        q = F.nullif(query(u), F.lit(""))
        origin = F.nullif(F.lower(F.regexp_extract(u, _AUTHORITY, 0)), F.lit(""))
        return F.coalesce(F.concat(origin, p, F.coalesce(F.concat(F.lit("?"), q), F.lit(""))), raw)

    return let(strip(c), rebuilt)


def strip_query_keys(c: Column, keys) -> Column:
    """Drop the named query keys. Order, repeats and encoding of the others stay as they are."""
    q = query(c)
    kept = F.array_join(F.filter(F.split(q, "&"), lambda x: (x != "") & ~F.split_part(x, F.lit("="), F.lit(1)).isin(*keys)), "&")
    base = F.regexp_extract(c, r"\A([^?#]*)", 1)
    return F.when(q == "", c).otherwise(F.concat(base, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def _fold_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    return let(F.split(F.regexp_replace(p, r"\A/", ""), "/"), _folded)


def _folded(segs: Column) -> Column:
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segs,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    ends_in_dots = F.element_at(segs, -1).isin(".", "..")
    return F.when(ends_in_dots, let(joined, lambda j: F.concat(F.regexp_replace(j, r"/\z", ""), F.lit("/")))).otherwise(joined)


def resolve_href(base: Column, href: Column) -> Column:
    """Reference resolution of RFC 3986 section 5.2 for http-like bases."""
    return let(strip(href), lambda h: _resolved(base, h))


def _resolved(base: Column, h: Column) -> Column:
    origin = F.regexp_extract(base, _AUTHORITY, 0)
    folder = F.coalesce(F.nullif(F.regexp_replace(path(base), r"[^/]*\z", ""), F.lit("")), F.lit("/"))
    rel_path = F.regexp_extract(h, r"\A([^?#]*)", 1)
    rest = F.regexp_extract(h, r"\A[^?#]*(.*)", 1)
    merged = let(
        F.when(F.startswith(rel_path, F.lit("/")), rel_path).otherwise(F.concat(folder, rel_path)),
        lambda m: F.when(F.contains(m, F.lit("/.")), _fold_dots(m)).otherwise(m),
    )
    return (
        F.when(h == "", base)
        .when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(base, r"\A([^#]*)", 1), h))
        .when(F.startswith(h, F.lit("?")), F.concat(F.regexp_extract(base, r"\A([^?#]*)", 1), h))
        .otherwise(F.concat(origin, merged, rest))
    )


def date_from_url(c: Column) -> Column:
    """A dd-mm-yyyy last path segment as it stands, else a /yyyy/mm/dd/ path prefix as ISO date, else NULL."""
    tail = F.regexp_extract(path(c), r"/([0-9]{2}-[0-9]{2}-[0-9]{4})/?\z", 1)
    ymd = r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/"
    iso = F.concat_ws("-", *[F.regexp_extract(c, ymd, i) for i in (1, 2, 3)])
    return F.coalesce(F.nullif(tail, F.lit("")), F.nullif(iso, F.lit("--")))


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded; malformed ones and ``+`` stay as they are."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), c)


def url_segments(c: Column) -> Column:
    """Non-empty path segments; a leading run of ``index.php`` front-controller segments does not count."""
    p = F.regexp_replace(path(c), r"(?i)\A(/index\.php)+/", "/")
    return F.filter(F.split(p, "/"), lambda s: s != "")


def canonical_detail_url(c: Column, site: str, stop_slugs, home: str = "home", langs=("ur", "en")) -> Column:
    """Rebuilt detail URL ``https://site/home/<lang>/<slug>/<number>``, NULL when the URL has another form."""

    def rebuilt(seg: Column) -> Column:
        part = [F.get(seg, F.lit(i)) for i in range(4)]
        ok = (
            (F.size(seg) == 4)
            & (part[0] == home)
            & part[1].isin(*langs)
            & ~part[2].isin(*stop_slugs)
            & part[3].rlike(r"\A[0-9]+\z")
        )
        return F.when(ok, F.concat(F.lit(f"https://{site}/"), F.array_join(seg, "/")))

    return let(canonical_url(c), lambda u: F.when(bare_host(u) == site, let(url_segments(u), rebuilt)))


def url_variants(c: Column, site: str | None = None) -> Column:
    """Equivalent addresses in order: apex and www host, each plain and under /index.php; repeats dropped."""

    def hosts(u: Column) -> Column:
        own = host(u) != "" if site is None else bare_host(u) == site
        rest = F.regexp_extract(u, r"\A[^:]*://[^/?#]*(.*)", 1)
        forms = [F.concat(scheme(u), F.lit("://" + www), bare_host(u), rest) for www in ("", "www.")]
        return F.when(own, F.array(*forms)).otherwise(F.array(u))

    def mirror(x: Column) -> Column:
        with_front = canonical_url(F.concat(F.regexp_extract(x, _AUTHORITY, 0), F.lit("/index.php"), F.regexp_extract(x, r"\A[^:]*://[^/?#]*(.*)", 1)))
        return F.when(F.contains(F.lower(path(x)), F.lit("index.php")) | (host(x) == ""), F.array(x)).otherwise(F.array(x, with_front))

    return F.array_distinct(F.flatten(F.transform(let(canonical_url(c), hosts), mirror)))


def post_url(c: Column) -> Column:
    """A dated permalink path, or a query with a numeric ``p`` or ``page_id``."""
    first = [F.regexp_extract(F.concat(F.lit("&"), query(c)), rf"&{k}=([^&]+)", 1) for k in ("p", "page_id")]
    dated = path(c).rlike(r"\A/[0-9]{4}/[0-9]{2}/[0-9]{2}/[^/]+/?\z")
    return dated | first[0].rlike(r"\A[0-9]+\z") | first[1].rlike(r"\A[0-9]+\z")


def homepage_url(c: Column, base: str, suffixes=("/default.aspx", "/index.aspx", "/home.aspx")) -> Column:
    u = strip(F.coalesce(c, F.lit("")))
    low = F.lower(u)
    hit = u.isin("", "/", base, base + "/")
    for s in suffixes:
        hit = hit | F.endswith(low, F.lit(s))
    return hit
