"""Whole-document transforms that no built-in expresses: token windows, HTML to Markdown.

All run in Arrow batches, a document at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SENTENCE_END = re.compile(r"[.!?][\"')\]]*(?=\s)")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Tokens as stretches without blanks; the default where no tokenizer is given."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def windows(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start char, end char, tokens) of windows of at most ``size`` tokens.

    A window that isn't the last ends with a sentence, if one ends among its last ``overlap``
    tokens; the next begins ``overlap`` tokens before the end of this one.
    """
    first, n = 0, len(spans)
    while first < n:
        last = min(first + size, n)
        if last < n:
            lo = spans[max(last - overlap, first + 1)][0]
            ends = [m.end() for m in _SENTENCE_END.finditer(text, lo, spans[last - 1][1] + 1)]
            if ends:
                cut = next((k for k in range(last, first, -1) if spans[k - 1][1] <= ends[-1]), last)
                last = max(cut, first + 1)
        yield spans[first][0], spans[last - 1][1], last - first
        if last >= n:
            return
        first = max(last - overlap, first + 1)


def token_windows(
    docs: DataFrame, doc_id: str, text: str, size: int = 1024, overlap: int = 128,
    spans: Callable[[str], list[tuple[int, int]]] = word_spans,
) -> DataFrame:
    """(doc_id, chunk, start_char, end_char, start_line, n_tokens, content) of overlapping windows.

    ``content`` is the text from start_char to end_char, lines count from 1. Null, empty and blank
    texts have none.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                breaks = [m.start() for m in re.finditer("\n", t)]
                for k, (a, z, n) in enumerate(windows(t, spans(t), size, overlap)):
                    at.append(i)
                    rows.append((k, a, z, bisect_right(breaks, a - 1) + 1 if a else 1, n, t[a:z]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32()] * 5 + [pa.string()]
            names = ["chunk", "start_char", "end_char", "start_line", "n_tokens", "content"]
            yield pa.record_batch({doc_id: b.column(0).take(pa.array(at, pa.int64()))} | {n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds)})

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, chunk int, start_char int, end_char int, start_line int, n_tokens int, content string")


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, lists, tables, paragraphs; hidden XBRL, scripts and styles dropped."""

    SKIP = {"script", "style", "head", "ix:header", "noscript"}
    BLOCK = {"p", "div", "section", "article", "br", "hr", "tr", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.lists: list[list] = []

    def handle_starttag(self, tag, attrs):
        style = (dict(attrs).get("style") or "").replace(" ", "")
        if self.skip or tag in self.SKIP or (tag in ("div", "span") and "display:none" in style):
            self.skip += tag not in ("br", "hr", "img", "meta", "link", "input")
            return
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "-" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag in self.BLOCK and self.cell is None:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= 1
            return
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.tables:
            rows = [join_money(r) for r in self.tables.pop()]
            text = _table(rows)
            if self.cell is not None:
                self.cell.append(" ".join(" ".join(r) for r in rows))
            elif text:
                self.out.append("\n\n" + text + "\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif re.fullmatch("h[1-6]", tag) or (tag in self.BLOCK and self.cell is None):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif not self.tables or data.strip():
            self.out.append(re.sub(r"\s+", " ", data))


def join_money(cells: list[str]) -> list[str]:
    """A row without its empty cells, signs put to their numbers: "$" "(5" ")" "%" as "$(5)%"."""
    out: list[str] = []
    for c in cells:
        if not c:
            continue
        if out and (re.fullmatch(r"[$€£¥(]+", out[-1]) or re.fullmatch(r"[)%]+", c)):
            out[-1] += c
        else:
            out.append(c)
    return out


def _table(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    if wide == 1:  # a table that only lays out text
        return "\n\n".join(r[0] for r in rows)
    full = [r + [""] * (wide - len(r)) for r in rows]
    esc = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([esc(full[0]), "|" + " --- |" * wide, *map(esc, full[1:])])


_PAGE = re.compile(r"(?m)^\s*(?:page\s+)?(?:[fF]-)?\d{1,3}(?:\s+of\s+\d{1,3})?\s*$|^\s*table of contents\s*$", re.I)


def to_markdown(html: str | None) -> str | None:
    """Markdown of an HTML page; page numbers and repeated "Table of Contents" lines go."""
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    lines = _PAGE.sub("", "".join(p.out))
    lines = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![-\d ])", "\n", lines))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def markdown(docs: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, markdown) of HTML pages; a null page stays null."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({doc_id: b.column(0), "markdown": pa.array([to_markdown(h) for h in b.column(1).to_pylist()], pa.string())})

    return docs.select(doc_id, html).mapInArrow(run, f"{doc_id} {kind}, markdown string")


def classify(c: Column, kinds: list[tuple[str, str]], other: str | None = None) -> Column:
    """The first kind whose pattern the text has, in any case; order is precedence."""
    out = F.lit(other)
    for name, pattern in reversed(kinds):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


# Titles that stand anywhere in a name and say nothing about who it is.
TITLES = ["mr", "mrs", "ms", "dr", "hon", "honorable"]


def person_name(c: Column) -> Column:
    """A person's name with single blanks, without titles and without words said twice in a row.

    Initials, suffixes and the order of words stay, also an initial said twice: two people may
    differ in just those.
    """
    bare = lambda w: F.rtrim(w, F.lit("."))
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: (w != "") & ~F.lower(bare(w)).isin(TITLES))
    again = lambda w, i: (i > 0) & (F.lower(w) == F.lower(F.get(words, i - 1))) & ~bare(w).rlike(r"^\p{L}$")
    return F.array_join(F.filter(words, lambda w, i: ~F.coalesce(again(w, i), F.lit(False))), " ")


def excerpts(chunks: DataFrame, doc_id: str, start: str, content: str, rank: str) -> DataFrame:
    """(doc_id, best_rank, context): each document's excerpts, all of them, in reading order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(start, content))), lambda x: x[content])
    return chunks.groupBy(doc_id).agg(F.min(rank).alias("best_rank"), F.array_join(parts, "\n...\n").alias("context"))
