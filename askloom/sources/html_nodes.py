"""Pages to node arrays: the one step of the extraction that needs a parser.

A page becomes an array of nodes in document order. A node knows its own position ``idx`` (1-based), its
parent and the position ``last`` of its last descendant, so "inside" is an interval test and the text of an element
is a slice. Everything after this step is column expressions on the array.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

NODE = "struct<idx:int,parent:int,last:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string>"
TEXT = "#text"

# Fixed values of HTML: elements without content, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
FENCES = frozenset("ul ol table td th div article section body html select dl".split())
UNREAD = frozenset(("script", "style", "template"))


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _close_from(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.rows[i - 1][2] = len(self.rows)
        del self.open[depth:]

    def _end_implied(self, tag: str) -> None:
        if tag in BLOCKS:
            names = [self.rows[i - 1][3] for i in self.open]
            if "p" in names:
                self._close_from(len(names) - 1 - names[::-1].index("p"))
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[depth] - 1][3]
            if name in ENDS.get(tag, ()):
                self._close_from(depth)
            elif name in FENCES:
                break

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        known = {k: (v or "") for k, v in reversed(attrs)}
        idx = len(self.rows) + 1
        parent = self.open[-1] if self.open else 0
        self.rows.append([idx, parent, idx, tag, known.get("id"), known.get("class", "").split(), list(known.items()), None])
        if tag not in VOID:
            self.open.append(idx)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth] - 1][3] == tag:
                self._close_from(depth)
                return

    def handle_data(self, data):
        parent = self.open[-1] if self.open else 0
        if parent and self.rows[parent - 1][3] in UNREAD:
            return
        idx = len(self.rows) + 1
        self.rows.append([idx, parent, idx, TEXT, None, [], [], unicodedata.normalize("NFC", html.unescape(data))])

    def finish(self) -> list[list]:
        self.close()
        self._close_from(0)
        return self.rows


_STRUCT = [
    pa.field("idx", pa.int32()),
    pa.field("parent", pa.int32()),
    pa.field("last", pa.int32()),
    pa.field("tag", pa.string()),
    pa.field("id", pa.string()),
    pa.field("classes", pa.list_(pa.string())),
    pa.field("attrs", pa.map_(pa.string(), pa.string())),
    pa.field("text", pa.string()),
]


PAGES_PER_BATCH = 64  # bounds what a task holds as nodes at one time


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_PER_BATCH):
            yield _parse_slice(whole.slice(start, PAGES_PER_BATCH))


def _parse_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("html")
    columns: list[list] = [[] for _ in _STRUCT]
    offsets = [0]
    for page in batch.column(at).to_pylist():
        parser = _Nodes()
        parser.feed(page or "")
        for row in parser.finish():
            for values, value in zip(columns, row):
                values.append(value)
        offsets.append(len(columns[0]))
    arrays = [pa.array(values, type=f.type) for values, f in zip(columns, _STRUCT)]
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=_STRUCT))
    kept = [i for i in range(batch.num_columns) if i != at]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), nodes], names=[*(batch.schema.field(i).name for i in kept), "nodes"]
    )


def html_nodes(pages: DataFrame) -> DataFrame:
    """``pages`` with ``nodes`` in place of ``html``. No shuffle; one page is parsed at a time."""
    kept = [f"`{n}` {t}" for n, t in pages.dtypes if n != "html"]
    return pages.mapInArrow(_parse, ", ".join([*kept, f"nodes array<{NODE}>"]))
