"""Field extraction from node arrays by rules: noise removal, first matching field, question and answer rules.

All functions work on the ``nodes`` array of one page (see :mod:`askloom.sources.html_nodes`), so extraction runs in
the scan stage. Rules are data: small tuples of :class:`Sel`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import qa as Q
from askloom.functions import text as T
from askloom.functions import urls as U
from askloom.functions.text import let
from askloom.operators.crawlset import document_of
from askloom.operators.ingest import quality_gate
from askloom.sources.html_nodes import TEXT, html_nodes


@dataclass(frozen=True)
class Sel:
    """One selector form: tag, classes, id, attribute tests (name, pattern) and an enclosing selector."""

    tag: tuple[str, ...] = ()
    cls: tuple[str, ...] = ()
    cls_like: str = ""
    id: str = ""
    id_like: str = ""
    attr: tuple[tuple[str, str], ...] = ()
    within: Sel | None = None

    def own(self, n: Column) -> Column:
        tests = [n["tag"] != TEXT, n["tag"] != ""]
        if self.tag:
            tests.append(n["tag"].isin(*self.tag))
        tests += [F.array_contains(n["classes"], c) for c in self.cls]
        if self.cls_like:
            tests.append(F.exists(n["classes"], lambda c: c.rlike(self.cls_like)))
        if self.id:
            tests.append(n["id"] == self.id)
        if self.id_like:
            tests.append(F.coalesce(n["id"].rlike(self.id_like), F.lit(False)))
        tests += [F.coalesce(n["attrs"][name].rlike(pattern), F.lit(False)) for name, pattern in self.attr]
        return reduce(lambda a, b: a & b, tests)


def _tags(*names: str) -> Sel:
    return Sel(tag=names)


def _inside(n: Column, e: Column) -> Column:
    return (n["idx"] > e["idx"]) & (n["idx"] <= e["last"])


def select(nodes: Column, sels: Sequence[Sel], scope: Column | None = None) -> Column:
    """Nodes that match any selector, in document order, below ``scope`` if given."""
    # A node's position is its index, so a scope is a slice: nothing outside it is looked at.
    domain = nodes if scope is None else F.slice(nodes, scope["idx"] + 1, scope["last"] - scope["idx"])
    plain = [s for s in sels if s.within is None]
    parts = []
    if plain:
        parts.append(F.filter(domain, lambda n: reduce(lambda a, b: a | b, [s.own(n) for s in plain])))

    def nested(s: Sel) -> Column:
        return let(select(nodes, [s.within]), lambda r: F.filter(domain, lambda n: s.own(n) & F.exists(r, lambda e: _inside(n, e))))

    parts += [nested(s) for s in sels if s.within is not None]
    if len(parts) == 1:
        return parts[0]
    union = reduce(F.array_union, [F.transform(p, lambda n: n["idx"]) for p in parts])
    return F.transform(F.array_sort(union), lambda i: F.get(nodes, i - 1))


def select_one(nodes: Column, sels: Sequence[Sel], scope: Column | None = None) -> Column:
    return F.get(select(nodes, sels, scope), F.lit(0))


def strip_noise(nodes: Column, sels: Sequence[Sel]) -> Column:
    """Nodes with the matching subtrees blanked. Positions stay, so the intervals of the rest remain true."""

    def blank(n: Column) -> Column:
        return F.struct(
            n["idx"].alias("idx"),
            n["parent"].alias("parent"),
            n["last"].alias("last"),
            F.lit("").alias("tag"),
            F.lit(None).cast("string").alias("id"),
            F.array().cast("array<string>").alias("classes"),
            F.create_map().cast("map<string,string>").alias("attrs"),
            F.lit(None).cast("string").alias("text"),
        )

    def blanked(roots: Column) -> Column:
        covered = lambda n: F.exists(roots, lambda r: (n["idx"] >= r["idx"]) & (n["idx"] <= r["last"]))
        return F.when(F.size(roots) == 0, nodes).otherwise(F.transform(nodes, lambda n: F.when(covered(n), blank(n)).otherwise(n)))

    return let(select(nodes, sels), blanked)


def text_of(nodes: Column, e: Column, sep: str = "") -> Column:
    """Normalized text below an element; NULL for a missing element."""
    parts = F.filter(F.slice(nodes, e["idx"], e["last"] - e["idx"] + 1), lambda n: n["tag"] == TEXT)
    return T.squash(F.array_join(F.transform(parts, lambda n: n["text"]), sep))


def page_text(nodes: Column, sep: str = "\n\n") -> Column:
    texts = F.transform(F.filter(nodes, lambda n: n["tag"] == TEXT), lambda n: n["text"])
    return T.squash(F.array_join(texts, sep))


# What plain page text leaves out.
PAGE_NOISE = (
    Sel(tag=("script", "style", "noscript", "iframe", "svg", "nav", "footer", "header")),
    Sel(cls_like=r"(?i)(ad-|ads|advert|cookie|banner|social|share|comment)"),
    Sel(id_like=r"(?i)(ad|ads|cookie|banner|nav)"),
)


def clean_text(nodes: Column) -> Column:
    return page_text(strip_noise(nodes, PAGE_NOISE))


def readable_text(nodes: Column, min_len: int = 120) -> Column:
    """Text of the block with the most text outside links, or the plain page text when that block is short.

    A block is scored by the paragraphs directly in it; the first of equally good blocks is taken.
    """

    def best_text(kept: Column) -> Column:
        paras = select(kept, [_tags("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3")])
        links = select(kept, [_tags("a")])

        def weigh(p: Column) -> Column:
            linked = F.aggregate(F.filter(links, lambda a: _inside(a, p)), F.lit(0), lambda s, a: s + F.length(text_of(kept, a)))
            return F.struct(p["parent"].alias("parent"), (F.length(text_of(kept, p)) - linked).alias("w"))

        def choose(weights: Column) -> Column:
            parents = F.array_distinct(F.transform(weights, lambda w: w["parent"]))
            score = lambda i: F.aggregate(
                F.filter(weights, lambda w: w["parent"] == i), F.lit(0), lambda s, w: s + w["w"]
            )
            scored = F.transform(parents, lambda i: F.struct(score(i).alias("s"), (-i).alias("i")))
            best = F.array_max(scored)
            return let(best, lambda b: F.when(b["i"] < 0, text_of(kept, F.get(kept, -b["i"] - 1), "\n")))

        return let(F.transform(paras, weigh), choose)

    def pick(kept: Column) -> Column:
        return let(best_text(kept), lambda t: F.when(F.coalesce(F.length(t), F.lit(0)) > min_len, t).otherwise(page_text(kept)))

    return let(strip_noise(nodes, PAGE_NOISE), pick)


@dataclass(frozen=True)
class Rule:
    """One attempt at a field: first element of the selector, with at least ``min_len`` characters."""

    sels: tuple[Sel, ...]
    min_len: int = 1
    sep: str = ""
    attr: str = ""
    any_of: Callable[[Column], Column] | None = field(default=None)


def first_match_field(nodes: Column, rules: Sequence[Rule], scope: Column | None = None) -> Column:
    """Text by the first rule that yields enough, else an empty string."""

    def attempt(r: Rule) -> Column:
        def value(e: Column) -> Column:
            return T.squash(e["attrs"][r.attr]) if r.attr else text_of(nodes, e, r.sep)

        if r.any_of is not None:
            texts = F.transform(select(nodes, r.sels, scope), value)
            return F.get(F.filter(texts, lambda t: (F.length(t) >= r.min_len) & r.any_of(t)), F.lit(0))
        first = let(select_one(nodes, r.sels, scope), lambda e: F.when(e.isNotNull(), value(e)))
        return let(first, lambda t: F.when(F.length(t) >= r.min_len, t))

    return F.coalesce(*[attempt(r) for r in rules], F.lit(""))


# Siblings and stop rules --------------------------------------------------------------------------------------

# Words of the heading template, lines that are no answer, elements that carry answer text.
ANSWER_HEAD, QUESTION_HEAD, TITLE_HEAD = "جواب", "سوال", "عنوان"
NUMBER_LABEL = r"\s*سوال\s*نمبر\s*[:：]?"
INVOCATIONS = ("بسم الله الرحمن الرحيم", "بسم اللہ الرحمن الرحیم")
REFERENCE_LINE = r"(?i)\AFatwa\s*:\s*\S"
PUBLISHED_LABEL = "تاریخ اشاعت"
ANSWER_TAGS = ("p", "div", "span", "section", "blockquote", "ul", "li", "article")
HEADING_CLASS = "Fatwa-peshaniE"


def siblings_after(nodes: Column, e: Column, tags: Sequence[str]) -> Column:
    end = F.coalesce(F.get(nodes, e["parent"] - 1)["last"], F.size(nodes))
    rest = F.slice(nodes, e["last"] + 1, F.greatest(end - e["last"], F.lit(0)))
    return F.filter(rest, lambda n: (n["parent"] == e["parent"]) & n["tag"].isin(*tags))


def answer_chunks(texts: Column, closing: Sequence[str] = T.CLOSING_PHRASES) -> Column:
    """Answer text of blocks in order: cut at the first closing phrase, without short and formal blocks."""
    trimmed = F.transform(texts, lambda t: T.trim_signature(t, closing))

    def joined(parts: Column) -> Column:
        stop = F.array_position(F.transform(parts, lambda p: p["stopped"]), True).cast("int")
        upto = let(stop, lambda s: F.when(s > 0, F.slice(parts, 1, s)).otherwise(parts))
        kept = F.filter(
            F.transform(upto, lambda p: p["body"]),
            lambda b: (F.length(b) > 5) & ~b.rlike(REFERENCE_LINE) & ~b.isin(*INVOCATIONS),
        )
        return F.array_join(kept, "\n\n")

    return let(trimmed, joined)


def _enough(c: Column, n: int) -> Column:
    return let(c, lambda t: F.when(F.length(t) >= n, t))


def split_qa_label(
    nodes: Column, scope: Column | None, q_label: str = QUESTION_HEAD, a_label: str = ANSWER_HEAD,
    para: Sel = Sel(tag=("p",), cls=("UrduTextNafeesPara",)), bold: Sel = Sel(tag=("b",), cls=("text-danger",)),
) -> Column:
    """Question and answer paragraphs marked by a bold label; the answer takes the following paragraphs along."""
    labels = F.transform(
        select(nodes, [para], scope), lambda p: F.struct(p.alias("p"), select_one(nodes, [bold], p).alias("b"))
    )
    labelled = F.filter(labels, lambda x: x["b"].isNotNull())

    def rest(x: Column) -> Column:
        p, b = x["p"], x["b"]
        own = F.filter(
            F.slice(nodes, p["idx"], p["last"] - p["idx"] + 1),
            lambda n: (n["tag"] == TEXT) & ~((n["idx"] > b["idx"]) & (n["idx"] <= b["last"])),
        )
        return T.squash(F.array_join(F.transform(own, lambda n: n["text"]), ""))

    def picked(xs: Column) -> Column:
        has = lambda x, word: F.contains(text_of(nodes, x["b"]), F.lit(word))
        q = F.get(F.filter(xs, lambda x: has(x, q_label)), F.lit(0))
        a = F.get(F.filter(xs, lambda x: has(x, a_label) & ~has(x, q_label)), F.lit(0))

        def answer(x: Column) -> Column:
            more = F.transform(siblings_after(nodes, x["p"], ["p"]), lambda p: text_of(nodes, p))
            parts = F.concat(F.array(rest(x)), F.filter(more, lambda t: F.length(t) > 5))
            return F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")

        return Q.qa(
            let(q, lambda x: F.when(x.isNotNull(), rest(x)).otherwise(F.lit(""))),
            let(a, lambda x: F.when(x.isNotNull(), answer(x)).otherwise(F.lit(""))),
        )

    return let(labelled, picked)


def question_rules(nodes: Column, c: Column) -> Column:
    """Question of the heading template inside container ``c``, by nine fallbacks in order."""

    def body(t: Column) -> Column:
        return T.strip_prefix_label(t)

    def is_question(t: Column) -> Column:
        return ~F.contains(t, F.lit(ANSWER_HEAD)) & (F.contains(t, F.lit(QUESTION_HEAD)) | t.rlike(r"(?i)\bquestion\b"))

    def inner(h: Column, n: int = 10) -> Column:
        p = select_one(nodes, [_tags("p")], h)
        return let(p, lambda e: F.when(~F.array_contains(e["classes"], HEADING_CLASS), _enough(text_of(nodes, e), n)))

    def has_title(h: Column) -> Column:
        p = select_one(nodes, [_tags("p")], h)
        return F.coalesce(F.array_contains(p["classes"], HEADING_CLASS), F.lit(False))

    def next_p(h: Column, n: int = 10) -> Column:
        return let(F.get(siblings_after(nodes, h, ["p"]), F.lit(0)), lambda e: _enough(text_of(nodes, e), n))

    def next_block(h: Column) -> Column:
        texts = F.transform(siblings_after(nodes, h, ["p", "div", "section"]), lambda e: text_of(nodes, e))
        return F.get(F.filter(texts, lambda t: F.length(t) >= 10), F.lit(0))

    def first_of(hs: Column, value: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(F.transform(hs, value), lambda v: v.isNotNull()), F.lit(0))

    def heads(tag: str, keep: Callable[[Column], Column]) -> Column:
        return F.filter(select(nodes, [_tags(tag)], c), lambda h: let(text_of(nodes, h), keep))

    block = let(
        select_one(nodes, [Sel(tag=("div",), cls=("question",)), Sel(tag=("div",), cls=("fatwa_question",)), Sel(cls=("question-text",))], c),
        lambda e: _enough(body(text_of(nodes, e, "\n")), 10),
    )
    asked = first_of(
        heads("h2", is_question), lambda h: F.when(~has_title(h), F.coalesce(inner(h), next_p(h), next_block(h)))
    )
    second = let(
        F.get(select(nodes, [_tags("h2")], c), F.lit(1)),
        lambda h: F.when(~F.contains(text_of(nodes, h), F.lit(ANSWER_HEAD)), F.coalesce(inner(h), next_p(h))),
    )
    third = first_of(
        heads("h3", is_question), lambda h: let(select_one(nodes, [_tags("p")], h), lambda e: _enough(text_of(nodes, e), 10))
    )
    titled = first_of(
        heads("h2", lambda t: F.contains(t, F.lit(TITLE_HEAD)) | t.rlike(r"(?i)\btitle\b")), lambda h: next_p(h, 15)
    )
    numbered = let(
        select_one(nodes, [Sel(tag=("p",), cls=("quesid",))], c),
        lambda e: F.get(
            F.filter(
                F.transform(siblings_after(nodes, e, ["p"]), lambda p: text_of(nodes, p)),
                lambda t: (F.length(t) >= 15) & ~t.rlike(NUMBER_LABEL) & ~F.contains(t, F.lit(ANSWER_HEAD)),
            ),
            F.lit(0),
        ),
    )
    headline = let(select_one(nodes, [Sel(tag=("p",), cls=(HEADING_CLASS,))], c), lambda e: _enough(text_of(nodes, e), 10))
    any_p = F.get(
        F.filter(
            F.transform(select(nodes, [_tags("p")], c), lambda p: text_of(nodes, p)),
            lambda t: F.contains(t, F.lit(QUESTION_HEAD)) & (F.length(t) > 25),
        ),
        F.lit(0),
    )
    # The block keeps its own length test after the label is cut; the others are cut after the test.
    return F.coalesce(block, body(F.coalesce(asked, second, third, titled, numbered, headline, any_p)), F.lit(""))


def answer_rules(nodes: Column, c: Column, markers: Sequence[str] = Q.EARLIEST_MARKERS) -> Column:
    """Answer of the heading template inside container ``c``, by five fallbacks in order."""

    def walk(anchor: Column) -> Column:
        return answer_chunks(F.transform(siblings_after(nodes, anchor, ANSWER_TAGS), lambda e: text_of(nodes, e)))

    item = F.when(c["tag"] == "li", c).otherwise(
        select_one(nodes, [Sel(tag=("li",), within=Sel(tag=("ul",), cls=("answer_detail",)))], c)
    )

    def after_reference(li: Column) -> Column:
        texts = F.transform(select(nodes, [_tags("p")], li), lambda p: text_of(nodes, p))

        def tail(ts: Column) -> Column:
            at = F.array_position(F.transform(ts, lambda t: t.rlike(REFERENCE_LINE)), True).cast("int")
            return let(at, lambda i: F.when(i > 0, answer_chunks(F.slice(ts, i + 1, F.size(ts)))))

        return F.when(li.isNotNull(), let(texts, tail))

    anchored = F.coalesce(
        select_one(nodes, [Sel(tag=("p",), cls=("fatwa_answer",))], c),
        select_one(nodes, [Sel(tag=("div",), cls=("fatwa_answer",))], c),
        select_one(nodes, [Sel(cls=("fatwa_answer",))], c),
    )
    h2s = select(nodes, [_tags("h2")], c)
    answer_heads = F.filter(h2s, lambda h: let(text_of(nodes, h), lambda t: F.contains(t, F.lit(ANSWER_HEAD)) | t.rlike(r"(?i)\banswer\b")))
    by_heads = F.get(F.filter(F.transform(F.reverse(answer_heads), walk), lambda t: F.length(t) >= 30), F.lit(0))

    def after_marker(text: Column) -> Column:
        def lines(marker: str) -> Column:
            tail = F.filter(
                T.lines_of(F.substring(text, F.instr(text, marker) + len(marker), F.length(text))),
                lambda ln: ~ln.rlike(REFERENCE_LINE) & ~(F.contains(ln, F.lit(PUBLISHED_LABEL)) & (F.length(ln) < 80)),
            )
            cut = F.transform(tail, lambda ln: T.trim_signature(ln))

            def upto(ps: Column) -> Column:
                stop = F.array_position(F.transform(ps, lambda p: p["stopped"]), True).cast("int")
                kept = let(stop, lambda s: F.when(s > 0, F.slice(ps, 1, s)).otherwise(ps))
                return F.array_join(F.filter(F.transform(kept, lambda p: p["body"]), lambda b: b != ""), "\n")

            return F.when(F.contains(text, F.lit(marker)), _enough(let(cut, upto), 30))

        return F.coalesce(*[lines(m) for m in markers])

    return F.coalesce(
        _enough(let(item, after_reference), 30),
        let(anchored, lambda e: F.when(e.isNotNull(), _enough(walk(e), 30))),
        by_heads,
        let(F.get(h2s, F.size(h2s) - 1), lambda h: F.when(h.isNotNull(), _enough(walk(h), 30))),
        let(text_of(nodes, c, "\n"), after_marker),
        F.lit(""),
    )


# Category chain -----------------------------------------------------------------------------------------------


def category_chain(*fields: Column, width: int | None = None) -> Column:
    """First non-empty field."""
    return T.cut(F.coalesce(*[F.nullif(f, F.lit("")) for f in fields]), width)


# Page templates -----------------------------------------------------------------------------------------------


# Parts of each page template that carry no text, and where the heading template keeps its text.
DIVS_NOISE = (
    Sel(tag=("div",), cls=("sidebar",)),
    Sel(tag=("div",), cls=("social-icons",)),
    Sel(tag=("div",), cls=("share-buttons",)),
    Sel(tag=("div",), cls=("related-questions",)),
    Sel(tag=("aside", "header", "footer", "nav", "script", "style", "noscript", "iframe")),
)
POSTS_NOISE = (
    Sel(tag=("header", "footer", "nav", "script", "style", "noscript")),
    Sel(id="sidebar"),
    *(Sel(cls=(c,)) for c in ("sidebar", "social-share", "share-buttons", "post-navigation", "related-posts", "comments-area")),
)
BOLD_NOISE = (Sel(cls=("hidden-print",)), Sel(tag=("footer", "header", "nav", "script", "style", "noscript")))
LINKED_NOISE = (
    Sel(tag=("header", "footer", "nav", "script", "style", "noscript")),
    Sel(cls=("_m_widget",)),
    Sel(tag=("div",), cls=("grid", "grid-cols-1", "md:grid-cols-2")),
)
WALK_NOISE_LIGHT = (Sel(tag=("header", "footer", "nav", "script", "style", "noscript", "aside", "iframe", "svg")),)
WALK_NOISE_STRICT = (*WALK_NOISE_LIGHT, Sel(cls=("sidebar",)), Sel(cls=("social-share",)))
CONTAINERS = (
    (Sel(tag=("li",), within=Sel(tag=("ul",), cls=("answer_detail",))),),
    (Sel(cls=("answer_detail",)),),
    (Sel(cls=("fata_detail",)),),
    (_tags("article"),),
    (Sel(cls=("main_content",)),),
    (_tags("main"),),
    (Sel(id="content"),),
    (Sel(cls=("content",)),),
    (Sel(cls=("row",), within=Sel(cls=("container",))),),
    (_tags("body"),),
)


def _dedupe_pair(q: Column, a: Column) -> Column:
    return Q.qa(T.dedupe_lines(q), T.dedupe_lines(a))


def labelled_divs(nodes: Column, url: Column) -> Column:
    """Template with question and answer blocks; line markers, title and longest paragraph fill gaps."""
    def fields(n: Column) -> Column:
        whole = F.struct(F.lit(0).alias("idx"), F.size(n).alias("last"))
        box = select_one(n, [Sel(tag=("div",), cls=("question-details",))])
        scope = let(box, lambda b: F.when(b.isNotNull(), F.struct(b["idx"].alias("idx"), b["last"].alias("last"))).otherwise(whole))

        def in_scope(c: Column) -> Column:
            texts = F.filter(n, lambda x: (x["tag"] == TEXT) & _inside(x, c))
            walked = Q.split_qa_lines(F.array_join(F.transform(texts, lambda x: x["text"]), "\n"))
            q = first_match_field(n, [Rule((Sel(tag=("div",), cls=("question-text",)),), sep="\n")], c)
            a = first_match_field(n, [Rule((Sel(tag=("div",), cls=("answer-text",)),), sep="\n")], c)
            title = T.title_trim(first_match_field(n, [Rule((_tags("title"),))]))
            paras = F.transform(select(n, [_tags("p")], c), lambda p: text_of(n, p))
            longest = F.aggregate(paras, F.lit(""), lambda b, p: F.when(F.length(p) > F.length(b), p).otherwise(b))
            category = category_chain(
                first_match_field(n, [Rule((Sel(tag=("span",), cls=("category",), within=Sel(tag=("div",), cls=("question-info",))),))], c),
                first_match_field(n, [Rule((Sel(tag=("a",), within=Sel(cls=("cat-links",))),))], c),
                first_match_field(n, [Rule((Sel(tag=("a",), attr=(("href", "/questions/"),)),), any_of=lambda t: F.length(t) < 200)]),
            )
            date = F.coalesce(
                F.nullif(first_match_field(n, [Rule((Sel(tag=("span",), cls=("date",), within=Sel(tag=("div",), cls=("question-info",))),))], c), F.lit("")),
                U.date_from_url(url),
            )
            filled = let(
                F.struct(q.alias("q"), a.alias("a"), walked.alias("w")),
                lambda s: F.struct(
                    F.coalesce(F.nullif(s["q"], F.lit("")), F.nullif(s["w"]["question"], F.lit("")), title).alias("q"),
                    F.coalesce(F.nullif(s["a"], F.lit("")), s["w"]["answer"]).alias("a"),
                ),
            )
            pair = let(
                F.struct(filled.alias("f"), longest.alias("l")),
                lambda s: _dedupe_pair(
                    s["f"]["q"],
                    F.when((F.length(s["f"]["a"]) < 20) & (F.length(s["l"]) > F.length(s["f"]["a"])), s["l"]).otherwise(s["f"]["a"]),
                ),
            )
            return F.struct(pair.alias("qa"), category.alias("category"), date.alias("date"))

        return let(scope, in_scope)

    return let(strip_noise(nodes, DIVS_NOISE), fields)


def marker_posts(nodes: Column, url: Column) -> Column:
    """Blog template: one content block, split at an answer marker, else walked block by block."""
    def fields(n: Column) -> Column:
        entry = Sel(cls=("entry-content",))
        boxes = select(n, [entry])
        first_div = F.get(
            F.filter(n, lambda x: (x["tag"] == "div") & F.exists(boxes, lambda b: x["parent"] == b["idx"])), F.lit(0)
        )
        content = F.coalesce(first_div, F.get(boxes, F.lit(0)))

        def parsed(c: Column) -> Column:
            text = text_of(n, c, "\n")
            by_marker = F.when(c.isNotNull(), Q.split_qa_priority(text))
            blocks = F.transform(select(n, [_tags("h2", "h3", "h4", "h5", "p", "div", "li", "td")], c), lambda e: text_of(n, e))
            walked = F.when(c.isNotNull(), Q.split_qa_state(blocks))
            tidy = lambda s: _dedupe_pair(T.strip_prefix_label(s["question"], marks=":："), s["answer"])
            thin = lambda p: (F.length(p["question"]) < 20) | (F.length(p["answer"]) < 50)
            title = first_match_field(n, [Rule((_tags("h1"),))])
            pair = let(
                F.struct(let(by_marker, tidy).alias("m"), let(walked, tidy).alias("w")),
                lambda s: F.when(thin(s["m"]) & ~thin(s["w"]), s["w"]).otherwise(s["m"]),
            )
            return let(pair, lambda p: Q.qa(F.coalesce(F.nullif(p["question"], F.lit("")), title), p["answer"]))

        table = let(
            select_one(n, [Sel(tag=("tr",), within=Sel(tag=("figure",), cls=("wp-block-table",)))]),
            lambda r: F.transform(F.filter(n, lambda x: (x["tag"] == "td") & (x["parent"] == r["idx"])), lambda e: text_of(n, e)),
        )
        author = first_match_field(n, [Rule((Sel(cls=("author",)), Sel(cls=("written-by",))))])
        category = category_chain(
            let(table, lambda t: T.category_join(F.coalesce(F.get(t, F.lit(1)), F.lit("")), F.coalesce(F.get(t, F.lit(2)), F.lit("")))),
            first_match_field(n, [Rule((Sel(tag=("a",), attr=(("rel", "^category tag$"),)), Sel(tag=("a",), within=Sel(cls=("cat-links",))), Sel(tag=("a",), attr=(("href", "/category/"),))), any_of=lambda t: t != "")]),
            let(author, lambda a: F.when(a != "", F.concat(F.lit("Author: "), a))),
        )
        meta = select_one(n, [Sel(tag=("meta",), attr=(("property", "^article:published_time$"),))])["attrs"]["content"]
        stamp = select_one(n, [Sel(tag=("time",), attr=(("datetime", ""),))])["attrs"]["datetime"]
        day = lambda v: let(v, lambda x: F.when(F.length(x) >= 10, F.substring(x, 1, 10)))
        return F.struct(let(content, parsed).alias("qa"), category.alias("category"), F.coalesce(day(meta), day(stamp), U.date_from_url(url)).alias("date"))

    return let(strip_noise(nodes, POSTS_NOISE), fields)


def bold_labels(nodes: Column, url: Column) -> Column:
    """Template with bold question and answer labels; generic selectors and headings fill gaps."""
    crumbs = select(nodes, [Sel(tag=("a",), within=Sel(cls=("breadcrumb",)))])
    last_crumb = let(crumbs, lambda cs: F.get(cs, F.size(cs) - 1))
    breadcrumb = let(last_crumb, lambda e: F.when(e.isNotNull(), text_of(nodes, e)))

    def fields(n: Column) -> Column:
        whole = F.struct(F.lit(0).alias("idx"), F.size(n).alias("last"))
        span = lambda e: F.when(e.isNotNull(), F.struct(e["idx"].alias("idx"), e["last"].alias("last")))
        box = F.coalesce(
            let(select_one(n, [Sel(id="printthis")]), span),
            let(select_one(n, [Sel(cls=("section-to-print",))]), span),
            let(select_one(n, [Sel(cls=("col-md-8", "minHeight"))]), span),
            whole,
        )

        def in_scope(c: Column) -> Column:
            q_rules = [Rule((Sel(cls=("question",)),)), Rule((Sel(id="question"),)), Rule((Sel(cls=("sawal",)),)), Rule((Sel(cls_like="question"),))]
            a_rules = [Rule((Sel(cls=("answer",)),)), Rule((Sel(id="answer"),)), Rule((Sel(cls=("jawab",)),)), Rule((Sel(cls_like="answer"),))]
            heading = first_match_field(n, [Rule((_tags("h1", "h2", "h3"),))])
            plain = let(
                strip_noise(n, PAGE_NOISE),
                lambda k: T.squash(F.array_join(F.transform(F.filter(k, lambda x: (x["tag"] == TEXT) & _inside(x, c)), lambda x: x["text"]), "\n\n")),
            )
            filled = let(
                split_qa_label(n, c),
                lambda s: _dedupe_pair(
                    F.coalesce(F.nullif(s["question"], F.lit("")), F.nullif(first_match_field(n, q_rules, c), F.lit("")), heading),
                    F.coalesce(F.nullif(s["answer"], F.lit("")), F.nullif(first_match_field(n, a_rules, c), F.lit("")), plain),
                ),
            )
            return filled

        return F.struct(let(box, in_scope).alias("qa"))

    pair = let(strip_noise(nodes, BOLD_NOISE), fields)
    category = let(breadcrumb, lambda b: F.when(T.meaningful_category(b), b))
    return F.struct(pair["qa"].alias("qa"), category.alias("category"), F.lit(None).cast("string").alias("date"))


def linked_documents(nodes: Column, url: Column) -> Column:
    """Template whose answer is a linked document: question, category, date and the document's address."""
    def fields(n: Column) -> Column:
        main = _tags("main")
        q = first_match_field(
            n,
            [
                Rule((Sel(tag=("h1",), cls=("text-lg", "font-bold")),), 10),
                Rule((_tags("h1"),), 10),
                Rule((Sel(tag=("div",), cls=("text-lg", "font-bold", "leading-relaxed")),), 10),
                Rule((Sel(tag=("div",), cls=("text-lg", "font-bold"), within=main),), 10),
                Rule((_tags("h4"),), 10),
                Rule((Sel(tag=("meta",), attr=(("property", "^og:title$"),)),), 1, attr="content"),
            ],
        )
        category = category_chain(
            first_match_field(n, [Rule((Sel(tag=("meta",), attr=(("property", "^article:section$"),)),), attr="content")]),
            first_match_field(n, [Rule((Sel(tag=("a",), attr=(("href", "/d/"),), within=main),), 4)]),
        )
        dated = first_match_field(n, [Rule((Sel(tag=("span",), within=main),), any_of=lambda t: T.date_in_text(t) != "")])
        published = first_match_field(n, [Rule((Sel(tag=("meta",), attr=(("property", "^article:published_time$"),)),), attr="content")])
        pdf = select_one(n, [Sel(tag=("a",), attr=(("href", r"\.pdf"),))])["attrs"]["href"]
        frames = F.transform(F.filter(n, lambda x: x["tag"] == "iframe"), lambda x: F.coalesce(x["attrs"]["src"], F.lit("")))
        doc = document_of(url, pdf, frames)
        return F.struct(
            T.dedupe_lines(q).alias("question"),
            category.alias("category"),
            F.nullif(F.coalesce(F.nullif(published, F.lit("")), dated), F.lit("")).alias("date"),
            doc.alias("doc_url"),
        )

    return let(strip_noise(nodes, LINKED_NOISE), fields)


def linked_records(pages: DataFrame, documents: DataFrame, label: str, script: str = T.ARABIC_SCRIPT, min_share: float = 0.45) -> DataFrame:
    """Records whose answer text comes from ``documents`` (``doc_url, body``), joined on the document's address."""
    fields = html_nodes(pages).select("page_id", "url", linked_documents(F.col("nodes"), F.col("url")).alias("f"))
    asked = fields.select("page_id", "url", "f.question", "f.category", "f.date", "f.doc_url")
    joined = asked.join(documents.select("doc_url", T.dedupe_lines(F.col("body")).alias("answer")), "doc_url", "left")
    gated = quality_gate(joined, 10, 30, False)
    unreadable = F.col("reason").isNull() & ~T.readable_script(F.coalesce("answer", F.lit("")), script, min_share=min_share)
    return gated.withColumn("reason", F.when(unreadable, F.lit("answer not readable")).otherwise(F.col("reason"))).withColumn("source", F.lit(label))


def multi_pass_choice(nodes: Column, url: Column, fallback: Column, containers=CONTAINERS) -> Column:
    """Heading template: light, then strict noise removal; containers in order; rules, then a coarse split.

    The first pair with a question of 10 and an answer of 30 characters wins; the result is NULL when none does.
    """

    def fits(x: Column) -> Column:
        return (F.length(x["question"]) >= 10) & (F.length(x["answer"]) >= 30)

    def attempt(n: Column) -> Column:
        found = F.flatten(F.array(*[select(n, list(c)) for c in containers]))

        def candidates(c: Column) -> Column:
            q = let(question_rules(n, c), lambda t: F.when((F.length(t) < 10) & (fallback != ""), fallback).otherwise(t))
            label = let(
                select_one(n, [Sel(cls=("cate_sec",)), Sel(cls=("category_name",))], c),
                lambda e: F.regexp_replace(T.strip(F.get(F.split(text_of(n, e), NUMBER_LABEL, 2), F.lit(0))), r"\s*>>\s*", " — "),
            )
            coarse = let(
                F.coalesce(select_one(n, [_tags("main", "article"), Sel(id="content"), Sel(cls=("main_content",))], c), c),
                lambda r: Q.split_qa_earliest(text_of(n, r, "\n")),
            )
            seg = U.url_segments(url)
            from_url = let(seg, lambda s: F.when(F.size(s) >= 2, F.get(s, F.size(s) - 2)))
            category = category_chain(label, from_url)
            if_fits = lambda p: F.when(fits(p), p)
            by_rule = let(_dedupe_pair(q, answer_rules(n, c)), if_fits)
            by_cut = let(let(coarse, lambda s: _dedupe_pair(s["question"], s["answer"])), if_fits)
            return let(
                F.coalesce(by_rule, by_cut), lambda b: F.when(b.isNotNull(), F.struct(b.alias("qa"), category.alias("category")))
            )

        # Later containers are not looked at once one has given a pair.
        none = F.lit(None).cast("struct<qa:struct<question:string,answer:string>,category:string>")
        return F.aggregate(found, none, lambda best, c: F.coalesce(best, candidates(c)))

    none = F.lit(None).cast("struct<qa:struct<question:string,answer:string>,category:string>")
    passes = F.array(strip_noise(nodes, WALK_NOISE_LIGHT), strip_noise(nodes, WALK_NOISE_STRICT))
    both = F.aggregate(passes, none, lambda best, n: F.coalesce(best, attempt(n)))
    return let(both, lambda b: F.struct(b["qa"].alias("qa"), b["category"].alias("category"), F.lit(None).cast("string").alias("date")))


def heading_walk(nodes: Column, url: Column) -> Column:
    meta = select_one(nodes, [Sel(tag=("meta",), attr=(("name", "^description$"),))])["attrs"]["content"]
    title = first_match_field(nodes, [Rule((_tags("title"),))])
    described = let(T.squash(F.coalesce(meta, F.lit(""))), lambda d: F.when(F.length(d) >= 12, d))
    fallback = F.coalesce(described, let(title, lambda t: F.when(F.length(t) >= 12, t)), F.lit(""))
    return let(fallback, lambda f: multi_pass_choice(nodes, url, f))


# Template -> field expression, and the limits of its gate (question, answer, must differ).
TEMPLATES: dict[str, tuple[Callable[[Column, Column], Column], tuple[int, int, bool]]] = {
    "labelled_divs": (labelled_divs, (20, 50, True)),
    "marker_posts": (marker_posts, (20, 50, True)),
    "bold_labels": (bold_labels, (20, 50, True)),
    "heading_walk": (heading_walk, (10, 30, False)),
}


def extract_records(pages: DataFrame, template: str, label: str) -> DataFrame:
    """Records of one page template with ``reason`` NULL for those that pass its gate."""
    fields, (min_q, min_a, distinct) = TEMPLATES[template]
    found = html_nodes(pages).select("page_id", "url", fields(F.col("nodes"), F.col("url")).alias("f"))
    flat = found.select(
        "page_id",
        U.canonical_url(F.col("url")).alias("url"),
        F.lit(label).alias("source"),
        F.coalesce("f.qa.question", F.lit("")).alias("question"),
        F.coalesce("f.qa.answer", F.lit("")).alias("answer"),
        F.col("f.category").alias("category"),
        F.col("f.date").alias("date"),
    )
    return quality_gate(flat, min_q, min_a, distinct)
