"""Question/answer splitting as column expressions over one text.

Every splitter works inside the row: the lines of a text form an array, marker positions are array
positions, and no line ever leaves its row. That keeps the extraction free of shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.text import bound, contains_any, cut, let, lines_of, squash, strip

# Marker words of the page templates ------------------------------
ANSWER_WORD = "جواب"
QUESTION_WORD = "سوال"
PRIORITY_MARKERS = ("اَلجَوَابْ بِاسْمِ مُلْہِمِ الصَّوَابْ", "اَلجَوَابُ", "الجواب", "جواب", "اَلجَوَابْ")
EARLIEST_MARKERS = ("جواب نمبر", "الجواب", "جواب:", "Detailed Answer", "Answer:")
FOOTER_MARKERS = ("دارالافتاء", "فتویٰ نمبر", "صفحہ پرنٹ", "سوال پوچھیں", "واللہ اعلم", "فقط")
WALK_QUESTION_PREFIXES = ("سوال نمبر", "سوال:", "سوال")
WALK_ANSWER_ANYWHERE = ("الجواب حامداً", "الجواب")
WALK_ANSWER_PREFIXES = ("جواب:", "جواب")
WALK_END_MARKERS = ("واللہ اعلم", "والله أعلم")
# ------------------------------------------------------------------------------


def qa(question: Column, answer: Column) -> Column:
    return F.struct(question.alias("question"), answer.alias("answer"))


@bound
def split_qa_marker(c: Column, marker: str = ANSWER_WORD, width: int | None = None, line_width: int | None = None) -> Column:
    """At the answer marker; without one the first line is the question. Widths cut the question of either form if given."""

    def parts(at: Column) -> Column:
        end = F.instr(c, "\n")
        head = F.when(at > 0, cut(strip(F.left(c, at - 1)), width)).otherwise(cut(F.substring_index(c, "\n", 1), line_width))
        tail = F.when(at > 0, F.substring(c, at, F.length(c))).when(end > 0, F.substring(c, end + 1, F.length(c))).otherwise(c)
        return qa(squash(head), squash(tail))

    return let(F.instr(c, marker), parts)


@bound
def split_qa_priority(c: Column, markers=PRIORITY_MARKERS, head: int = 500) -> Column:
    """At the first marker of the list that occurs; the answer keeps the marker."""
    at = F.coalesce(*[F.nullif(F.instr(c, m), F.lit(0)) for m in markers], F.lit(head + 1))
    return let(at, lambda p: qa(squash(F.left(c, p - 1)), squash(F.substring(c, p, F.length(c)))))


@bound
def split_qa_earliest(c: Column, markers=EARLIEST_MARKERS, after: int = 20, min_tail: int = 25, min_q: int = 10, min_a: int = 30) -> Column:
    """At the earliest marker beyond ``after`` characters; empty strings when a part is too short."""
    hits = F.filter(F.array(*[F.instr(c, m) - 1 for m in markers]), lambda p: p > after)

    def long_enough(p: Column) -> Column:
        ok = (F.length(p["question"]) >= min_q) & (F.length(p["answer"]) >= min_a)
        return F.when(ok, p).otherwise(qa(F.lit(""), F.lit("")))

    def parts(cut: Column) -> Column:
        fits = F.coalesce(cut < F.length(c) - min_tail, F.lit(False))
        both = qa(strip(F.left(c, cut)), strip(F.substring(c, cut + 1, F.length(c))))
        return F.when(fits, let(both, long_enough)).otherwise(qa(F.lit(""), F.lit("")))

    return let(F.array_min(hits), parts)


def _first(flags: Column) -> Column:
    return F.array_position(flags, F.lit(True)).cast("int")


def _from(arr: Column, start: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, start, F.greatest(n, F.lit(0)))


def split_qa_lines(c: Column, q_word: str = QUESTION_WORD, a_word: str = ANSWER_WORD, footers=FOOTER_MARKERS, colons: str = ":：", reach: int | None = None) -> Column:
    """Line walk: the first question line and the first answer line decide, even when they yield nothing.

    The question goes on to the line that names the answer, or for ``reach`` lines at most if given.
    """

    def is_alone(word: str, x: Column) -> Column:
        return x.rlike(rf"\A{word}\s*[{colons}]?\s*\z")

    def located(word: str, lines: Column) -> Column:
        return _first(F.transform(lines, lambda x: is_alone(word, x) | x.rlike(rf"{word}\s*[{colons}]")))

    def inline(word: str, x: Column) -> Column:
        rest = strip(F.regexp_extract(x, rf"(?s)\A.*?{word}\s*[{colons}](.*)\z", 1))
        return let(rest, lambda r: F.when(F.length(r) > 10, r))

    def question(lines: Column, at: Column) -> Column:
        def block(window: Column) -> Column:
            stop = _first(F.transform(window, lambda x: F.contains(x, F.lit(a_word))))
            return let(stop, lambda s: F.when(s > 0, _from(window, F.lit(1), s - 1)).otherwise(window))

        body = F.filter(let(_from(lines, at + 1, F.size(lines) if reach is None else reach), block), lambda x: F.length(x) > 10)
        line = F.get(lines, at - 1)
        return F.when(at > 0, F.when(is_alone(q_word, line), F.array_join(body, "\n")).otherwise(inline(q_word, line)))

    def answer(lines: Column, at: Column) -> Column:
        def block(rest: Column) -> Column:
            end = _first(F.transform(rest, lambda x: contains_any(x, footers)))
            # The footer line belongs to the answer whatever its length.
            return let(
                end,
                lambda e: F.when(
                    e > 0,
                    F.concat(F.filter(_from(rest, F.lit(1), e - 1), lambda x: F.length(x) > 5), F.slice(rest, e, F.lit(1))),
                ).otherwise(F.filter(rest, lambda x: F.length(x) > 5)),
            )

        line = F.get(lines, at - 1)
        body = F.array_join(let(_from(lines, at + 1, F.size(lines)), block), "\n")
        return F.when(at > 0, F.when(is_alone(a_word, line), body).otherwise(inline(a_word, line)))

    return let(
        lines_of(c),
        lambda lines: qa(
            squash(let(located(q_word, lines), lambda at: question(lines, at))),
            squash(let(located(a_word, lines), lambda at: answer(lines, at))),
        ),
    )


def split_qa_state(
    blocks: Column,
    q_prefixes=WALK_QUESTION_PREFIXES,
    a_anywhere=WALK_ANSWER_ANYWHERE,
    a_prefixes=WALK_ANSWER_PREFIXES,
    end_markers=WALK_END_MARKERS,
) -> Column:
    """Two-mode walk over an array of block texts: markers switch the mode, an end marker closes the answer."""

    def any_prefix(x: Column, words) -> Column:
        return reduce(lambda a, b: a | b, [F.startswith(x, F.lit(w)) for w in words])

    strings = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("mode"), F.lit(False).alias("closed"), strings.alias("q"), strings.alias("a"))

    def step(s: Column, x: Column) -> Column:
        is_q = any_prefix(x, q_prefixes)
        is_a = ~is_q & (contains_any(x, a_anywhere) | any_prefix(x, a_prefixes))
        ends = contains_any(x, end_markers)
        mode = F.when(is_q, F.lit("q")).when(is_a, F.lit("a")).otherwise(s["mode"])
        was_open = is_a | ~s["closed"]
        to_q = F.when(is_q, F.length(x) > 10).otherwise(~is_a & (mode == "q"))
        to_a = F.when(is_a, F.length(x) > 20).otherwise(~is_q & (mode == "a") & was_open)
        closed = F.when(is_q, F.lit(False)).otherwise(~was_open | (to_a & ends))
        return F.struct(
            mode.alias("mode"),
            closed.alias("closed"),
            F.when(to_q, F.array_append(s["q"], x)).otherwise(s["q"]).alias("q"),
            F.when(to_a, F.array_append(s["a"], x)).otherwise(s["a"]).alias("a"),
        )

    return F.aggregate(
        F.filter(blocks, lambda b: b != ""),
        start,
        step,
        lambda s: qa(squash(F.array_join(s["q"], "\n")), squash(F.array_join(s["a"], "\n"))),
    )
