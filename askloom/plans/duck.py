"""DuckDB SQL fragments shared by the oracle queries. Written apart from the Spark expressions they check."""

from __future__ import annotations

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
MARKS = "|".join(f"chr({c})" for lo, hi in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0xFEFF, 0xFEFF)) for c in range(lo, hi + 1))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squash(x: str) -> str:
    """Lines stripped, blank lines dropped, runs of blanks reduced, by way of a list of lines."""
    bare = rf"regexp_replace({x}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{FEFF}}]', '', 'g')"
    unix = f"replace(replace({bare}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    line = strip(r"regexp_replace(l, '[ \t\x{a0}]+', ' ', 'g')")
    return (
        f"array_to_string(list_filter(list_transform(string_split({unix}, chr(10)), lambda l: {line}), lambda l: l <> ''), chr(10))"
    )


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def canonical(x: str) -> str:
    u = strip(x)
    origin = f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'))"
    p = f"regexp_replace({path(u)}, ';[^/]*$', '')"
    q = rf"regexp_extract({u}, '^[^?#]*(\?[^#]+)', 1)"
    return (
        f"CASE WHEN {origin} = '' THEN {u} ELSE {origin} || "
        f"(CASE WHEN {p} IN ('', '/') THEN '/' ELSE rtrim({p}, '/') END) || {q} END"
    )


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def unescape(x: str) -> str:
    """The entities that occur in the given pages."""
    s = f"replace(replace(replace({x}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34))"
    return f"nfc_normalize(regexp_replace({s}, '&amp;?', '&', 'g'))"


def page_text(x: str) -> str:
    """Tag-level page text."""
    s = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "iframe", "svg", "nav", "footer", "header"):
        s = rf"regexp_replace({s}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]*>', chr(10) || chr(10), 'g')"
    return squash(unescape(s))


def fields(x: str) -> str:
    """Text of a page fragment without its tags."""
    return squash(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")


ANCHOR = r"""(?is)<a\s[^>]*?href=["'']([^"''>]*)["''][^>]*>(.*?)</a>"""

# page_id, page_url, pos, href, text, url of every anchor; hrefs of the given pages are absolute paths.
LINKS = rf"""
    anchors AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '{ANCHOR}', 1) AS hs, regexp_extract_all(html, '{ANCHOR}', 2) AS ts FROM pages),
    links AS (SELECT page_id, page_url, pos, href, {fields('txt')} AS text, {canonical("regexp_extract(page_url, '^[a-z]+://[^/?#]+') || href")} AS url
              FROM (SELECT page_id, page_url, unnest(hs) AS href, unnest(ts) AS txt, unnest(range(len(hs))) AS pos FROM anchors))"""
