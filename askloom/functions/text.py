"""Text expressions. All are native except HTML unescaping and NFC, which have no Spark built-in."""

from __future__ import annotations

import functools
import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values -----------------------------------------------------------------
# Zero-width and bidirectional marks that are deleted: U+200B-200F, U+202A-202E, U+2066-2069, U+FEFF.
INVISIBLE = "".join(
    chr(c) for lo, hi in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0xFEFF, 0xFEFF)) for c in range(lo, hi + 1)
)
# The characters that a Unicode-aware strip removes; written so that Java and RE2 read it alike.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
# Characters of the Arabic script blocks, and of the base Arabic block only.
ARABIC_SCRIPT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}]"
LATIN = "[A-Za-z]"
# Phrases of anti-bot interstitial pages.
BLOCK_PHRASES = (
    "Verify you are human",
    "Just a moment",
    "cf-browser-verification",
    "needs to review the security of your connection",
)
# Words that carry no topic in keyword extraction, and punctuation cut off word ends.
STOP_WORDS = ("کیا", "کیسے", "کب", "کہاں", "ہے", "ہیں", "کا", "کی", "کے")
WORD_PUNCT = ".,:;!?()[]{}\"'"
# Closing phrases of an answer, tried in this order.
CLOSING_PHRASES = ("واللہ تعالیٰ اعلم", "واللہ اعلم")
QUESTION_LABEL = "سوال"
# ------------------------------------------------------------------------------

# Text that contains neither "&" nor a character outside these ranges is already unescaped and in NFC:
# no member of the ranges is a combining mark or decomposes under NFC.
_PLAIN = (
    r"[\x{0}-\x{25}\x{27}-\x{2FF}\x{600}-\x{60F}\x{61B}-\x{64A}\x{660}-\x{66F}\x{671}-\x{6D5}\x{6EE}-\x{6FF}"
    r"\x{2010}-\x{2027}\x{2030}-\x{2065}]"
)


@F.pandas_udf(StringType())
def _unescape_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", html.unescape(t)), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities decoded, nothing else; only values with an ampersand travel to Python."""
    return F.coalesce(_unescape(let(c, lambda x: F.when(F.contains(x, F.lit("&")), x))), c)


def unescape_nfc(c: Column) -> Column:
    """HTML entities decoded, then NFC. Only values that can change travel to Python; others go as NULL."""

    def only_if_needed(x: Column) -> Column:
        return F.when(~x.rlike(r"\A" + _PLAIN + r"*+\z"), x)

    return F.coalesce(_unescape_nfc(let(c, only_if_needed)), c)


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def bound(f):
    """Decorator: the first argument of ``f`` is evaluated once.

    Filters are pushed through projections by substitution, so an argument that is mentioned many times would
    be computed many times, however it was named before.
    """

    @functools.wraps(f)
    def wrapper(c: Column, *args, **kwargs) -> Column:
        def body(x):
            return f(x, *args, **kwargs)

        return let(c, body)

    return wrapper


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def squash(c: Column) -> Column:
    """Native part of :func:`normalize_text`: marks, line ends, blank runs, blank lines.

    ``WS*\\nWS*`` swallows the blank lines around a line break together with the blanks at line ends, so the
    text never has to be split into an array of lines.
    """
    c = F.translate(F.coalesce(c, F.lit("")), INVISIBLE, "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x{a0}]+", " ")
    c = F.regexp_replace(c, rf"{WS}*\n{WS}*", "\n")
    return strip(c)


def normalize_text(c: Column) -> Column:
    return squash(unescape_nfc(c))


def lines_of(c: Column) -> Column:
    """Stripped, non-empty lines as an array."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def dedupe_lines(c: Column) -> Column:
    return F.array_join(F.array_distinct(lines_of(F.coalesce(c, F.lit("")))), "\n")


def content_hash(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat(question, F.lit("\n"), answer), 256)


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only, so that both sides of a literal search fold alike on every backend."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_literal(c: Column, needle: str) -> Column:
    """Literal, ASCII-case-insensitive containment: ``%``, ``_`` and ``\\`` in the needle mean themselves.

    Java's ``(?i)`` folds ASCII letters only, which saves folding the whole text.
    """
    quoted = r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
    return c.rlike("(?i)" + quoted)


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


@bound
def preview(c: Column, n: int = 200) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def cut(c: Column, n: int | None) -> Column:
    """The first ``n`` characters; all of them by default."""
    return c if n is None else F.substring(c, 1, n)


def blank_to_null(c: Column, n: int | None = None) -> Column:
    return cut(F.nullif(strip(c), F.lit("")), n)


def script_counts(c: Column, script: str = ARABIC_SCRIPT) -> Column:
    return F.struct(
        F.regexp_count(c, F.lit(script)).cast("long").alias("script_chars"),
        F.regexp_count(c, F.lit(LATIN)).cast("long").alias("latin_chars"),
    )


def readable_script(
    c: Column, script: str = ARABIC_SCRIPT, min_len: int = 30, min_script: int = 40, min_share: float = 0.45
) -> Column:
    """True when the text is long enough and mostly written in ``script`` rather than in Latin letters."""

    def verdict(body: Column) -> Column:
        native = F.regexp_count(body, F.lit(script))
        latin = F.regexp_count(body, F.lit(LATIN))
        share = let(F.struct(native.alias("n"), latin.alias("l")), lambda k: (
            (k["n"] >= min_script) & (k["n"] / F.nullif(k["n"] + k["l"], F.lit(0)) >= min_share) & (k["l"] <= k["n"])
        ))
        return (F.length(body) >= min_len) & share

    return let(strip(c), verdict)


def blocked_page(c: Column, phrases=BLOCK_PHRASES, head: int | None = None) -> Column:
    """Interstitial test: an empty page, or one that holds a phrase, anywhere or within its first ``head`` characters."""
    return (F.coalesce(c, F.lit("")) == "") | contains_any(cut(c, head), phrases)


def keywords(c: Column, stop=STOP_WORDS, k: int = 3, min_len: int = 4) -> Column:
    """First ``k`` distinct words of at least ``min_len`` characters that are no stop words."""
    ends = "[" + "".join("\\" + ch for ch in WORD_PUNCT) + "]"
    words = F.transform(F.split(strip(c), f"{WS}+"), lambda w: F.regexp_replace(w, rf"\A{ends}+|{ends}+\z", ""))
    kept = F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, k)


def strip_prefix_label(c: Column, label: str = QUESTION_LABEL, marks: str = ":：۔") -> Column:
    return F.regexp_replace(c, rf"\A{WS}*{label}{WS}*[{marks}]?{WS}*", "")


@bound
def trim_signature(c: Column, phrases=CLOSING_PHRASES) -> Column:
    """Text before the first closing phrase (phrases in list order) and whether one was found."""
    where = F.coalesce(*[F.nullif(F.instr(c, p), F.lit(0)) for p in phrases])
    return let(
        where,
        lambda w: F.struct(
            strip(F.when(w.isNull(), c).otherwise(F.left(c, w - 1))).alias("body"), w.isNotNull().alias("stopped")
        ),
    )


def record_number(c: Column, label: str) -> Column:
    """Digits and slashes after a label with a colon or blanks, or an empty string."""
    return F.regexp_extract(c, rf"{label}[:\s]+([0-9/]+)", 1)


@bound
def title_trim(c: Column, seps=(" | ", " - "), first_only: bool = False) -> Column:
    """Title without its site suffix. ``first_only`` stops after the first separator that occurs."""
    if first_only:
        cut = F.coalesce(*[F.when(F.contains(c, F.lit(s)), F.substring_index(c, s, 1)) for s in seps], c)
        return strip(cut)

    def cut_at(sep: str):
        return lambda x: F.when(F.contains(x, F.lit(sep)), strip(F.substring_index(x, sep, 1))).otherwise(x)

    for s in seps:
        c = let(c, cut_at(s))
    return c


def category_join(a: Column, b: Column, n: int | None = None) -> Column:
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    both = F.when(a != b, F.concat(a, F.lit(" — "), b))
    return cut(F.coalesce(both, a, b), n)


def meaningful_category(c: Column, generic=("home", "index", "main", "صفحہ اول", "خانہ"), min_len: int = 4) -> Column:
    t = strip(c)
    return F.coalesce((F.length(t) >= min_len) & ~F.lower(t).isin(*generic), F.lit(False))


# A word is a run of letters, digits or private-use characters; accents on Latin letters do not count.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _accent_pairs() -> tuple[str, str]:
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _accent_pairs()
_COMBINING = r"[\x{300}-\x{331}]"


_FOLDED = str.maketrans(_ACCENTED, _BASE)


def fold(word: str) -> str:
    """What :func:`tokens` makes of one of :func:`words`."""
    return word.translate(_FOLDED)


def words(c: Column) -> Column:
    """:func:`tokens` whose accents are not yet folded, for callers that fold a word once for all texts that hold it."""
    text = let(F.lower(F.coalesce(c, F.lit(""))), lambda x: F.when(x.rlike(_COMBINING), F.regexp_replace(x, _COMBINING, "")).otherwise(x))
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def tokens(c: Column) -> Column:
    """Search tokens of a text in order: lower case, Latin accents folded.

    Accents are folded per token and only where a token is not plain ASCII; folding the whole text character by
    character would cost more than the rest.
    """
    return F.transform(words(c), lambda w: F.when(w.rlike(r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]"), F.translate(w, _ACCENTED, _BASE)).otherwise(w))


DROPPED_BLOCKS = ("script", "style", "noscript", "iframe", "svg", "nav", "footer", "header")
# The optional attribute part keeps <header> apart from <head>; one pass removes comments and all blocks.
_NOISE = rf"(?is)<!--.*?-->|<({'|'.join(DROPPED_BLOCKS)})(?:\s[^>]*)?>.*?</\1\s*>"


def html_to_text(c: Column) -> Column:
    """Visible text of a page by tag-level removal. Class and id rules need the element array."""
    return normalize_text(F.regexp_replace(F.regexp_replace(c, _NOISE, ""), r"(?s)<[^>]*>", "\n\n"))


def date_in_text(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]{2}[-/][0-9]{2}[-/][0-9]{4}|[0-9]{4}[-/][0-9]{2}[-/][0-9]{2})", 1)


def month_bounds(month: Column) -> Column:
    """``YYYY-MM`` to its half-open interval; NULL bounds for anything else."""
    start = F.to_timestamp_ntz(F.when(month.rlike(r"\A[0-9]{4}-(0[1-9]|1[0-2])\z"), F.concat(month, F.lit("-01 00:00:00"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    end = F.add_months(start, 1).cast("timestamp_ntz")
    return F.struct(start.alias("month_start"), end.alias("month_end"))
