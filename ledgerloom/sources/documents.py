"""Filing documents: tables, text blocks, embedded facts, contexts and mentions, all from one Arrow job over the corpus."""

from __future__ import annotations

import re
from functools import cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.sources.payloads import read_archive, read_payloads
from ledgerloom.sources.scratch import settings, written

BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div", "span")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


#: Fixed values of HTML: headings; elements whose start ends an open paragraph; elements beyond which an end tag or an implied end
#: doesn't reach; and those beyond which a list item doesn't end another.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS_PARAGRAPH = (*HEADINGS, "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul")
BOUNDS = ("table", "td", "th", "caption", "button", "object", "template", "html")
_ENDS_PARAGRAPH = frozenset(ENDS_PARAGRAPH)
#: Tags whose start does more than to open an element.
_STRUCTURE = frozenset((*ENDS_PARAGRAPH, *BLOCKS, *VOID, "td", "th", "tr", "caption"))
LIST_BOUNDS = (*BOUNDS, *HEADINGS, "ul", "ol", "article", "aside", "blockquote", "center", "details", "dl", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "pre", "section", "body")


class _Document(HTMLParser):
    """Cells of every table (of nested tables also in the outer one) and text of every block element, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.blocks: list[list] = []
        self.stack: list[tuple[str, list[list[str]]]] = []
        self.open: dict[str, int] = {}  # how many elements of the stack are of each tag

    def _start(self, tag: str, attrs: list) -> list[list[str]]:
        sinks: list[list[str]] = []
        if tag == "table":
            self.open_tables.append({"rows": [], "caption": None})
            self.tables.append(self.open_tables[-1])
        elif tag == "tr":
            for t in self.open_tables:
                t["rows"].append([])
        elif tag in ("td", "th"):
            span = dict(attrs).get("colspan") or ""
            for t in self.open_tables:
                if t["rows"]:
                    text: list[str] = []
                    t["rows"][-1].append((text, int(span) if span.isascii() and span.isdigit() and int(span) > 0 else 1))
                    sinks.append(text)
        elif tag == "caption" and self.open_tables and self.open_tables[-1]["caption"] is None:
            self.open_tables[-1]["caption"] = text = []
            sinks.append(text)
        if tag in BLOCKS:
            text = []
            self.blocks.append([tag, text])
            sinks.append(text)
        return sinks

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_PARAGRAPH:
            self._close(("p",), BOUNDS)
        if tag == "li":
            self._close(("li",), LIST_BOUNDS)
        elif tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._cut(len(self.stack) - 1)
        elif tag in ("td", "th"):
            self._close(("td", "th"), ("table",))
        elif tag == "tr":
            self._close(("tr",), ("table",))
        sinks = self._start(tag, attrs)
        if tag not in VOID:
            self.stack.append((tag, sinks))
            self.open[tag] = self.open.get(tag, 0) + 1

    def _cut(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def _close(self, tags, bounds) -> bool:
        """Ends the innermost open element of one of the tags, and all within it, unless one of bounds stands before it."""
        for tag in tags:
            if self.open.get(tag):
                break
        else:
            return False
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self._cut(k)
                return True
            if self.stack[k][0] in bounds:
                return False
        return False

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self._close((tag,), ("table",))
        elif tag in HEADINGS:
            self._close(HEADINGS, BOUNDS)
        elif tag != "table":
            if not self._close((tag,), (*BOUNDS, "ul", "ol") if tag == "li" else BOUNDS) and tag == "p":
                self.blocks.append(["p", []])  # an end without a start is an empty paragraph
        elif self._close(("table",), ()) and self.open_tables:
            self.open_tables.pop()

    def handle_data(self, data):
        if data.isspace() or self.open.get("script") or self.open.get("style"):  # spaces alone add nothing to a cleaned text
            return
        for _, sinks in self.stack:
            for s in sinks:
                s.append(data)

    def read(self, page: str) -> None:
        """Feeds a whole page. One whose tags are all plain (see plain_tags) is cut at them; any other goes through HTMLParser."""
        pieces = page.split("<")
        tags = plain_tags(pieces)
        if tags is None:
            self.feed(page)
            self.close()
            return
        if pieces[0]:
            self.handle_data(unescape(pieces[0]))
        stack, opened = self.stack, self.open
        for (end, tag, attrs, empty, size), piece in zip(tags, pieces[1:], strict=True):
            if end:
                if stack and stack[-1][0] == tag and tag != "table":  # the innermost element, so nothing stands before it
                    stack.pop()
                    opened[tag] -= 1
                else:
                    self.handle_endtag(tag)
            elif tag not in _STRUCTURE and not empty:
                stack.append((tag, ()))
                opened[tag] = opened.get(tag, 0) + 1
            else:
                self.handle_starttag(tag, attrs)
                if empty:
                    self.handle_endtag(tag)
            if len(piece) > size:
                text = piece[size:]
                self.handle_data(unescape(text) if "&" in text else text)


#: A tag that HTMLParser can read in one way only: a name, and attributes with values that are quoted or plain words, without references.
_PLAIN = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9:_.-]*)((?:[ \t\n\r\f]+[a-zA-Z_:][a-zA-Z0-9:_.-]*=(?:"[^"&]*"|'[^'&]*'|[a-zA-Z0-9%#.-]+))*)[ \t\n\r\f]*(/?)""")
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][a-zA-Z0-9:_.-]*)=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9%#.-]+))""")
#: Fixed values of HTML: elements whose content may hold markup as text; pages with these are left to HTMLParser.
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))
#: Tags without attributes, by their text; at most KNOWN of them.
KNOWN, _known = 4096, {}


def _plain_tag(head: str) -> tuple | None:
    """(end, name, attributes, empty, length with its >) of what stands between < and >; None if it isn't plain."""
    m = _PLAIN.fullmatch(head)
    if m is None:
        return None
    end, tag, written_attributes, empty = m.group(1) == "/", m.group(2).lower(), m.group(3), m.group(4) == "/"
    if tag in RAW or (end and head != "/" + m.group(2)):
        return None
    attrs = [(a.group(1).lower(), next(v for v in a.groups()[1:] if v is not None)) for a in _PLAIN_ATTRIBUTE.finditer(written_attributes)] if tag in ("td", "th") else []
    return end, tag, attrs, empty, len(head) + 1


def plain_tags(pieces: list[str]) -> list[tuple] | None:
    """The tags at which a page was cut (what follows each <); None if any isn't plain, or if it has comments or raw text."""
    out = []
    for k in range(1, len(pieces)):
        piece = pieces[k]
        stop = piece.find(">")
        if stop < 0:
            return None
        head = piece[:stop]
        tag = _known.get(head)
        if tag is None:
            tag = _plain_tag(head)
            if tag is None:
                return None
            if stop <= 24 and len(_known) < KNOWN:
                _known[head] = tag
        out.append(tag)
    return out


def clean(parts: list[str] | None) -> str | None:
    return None if parts is None else " ".join(" ".join(parts).split())


#: Pages whose rows are made before they go back to Spark.
PAGES = 64
#: What a parsed document gives, by kind; see parse_documents.
ROW = "struct<cells: array<struct<text: string, col_start: int, col_end: int>>>"
FIELDS = {"kind": "string", "no": "int", "tag": "string", "text": "string", "ref": "string", "unit": "string", "scale": "string", "starts": "string", "ends": "string", "members": "array<struct<dimension: string, member: string>>", "rows": f"array<{ROW}>"}
#: Month names in dates of prose.
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"

_MEMBER = re.compile(r'(?s)<xbrldi:explicitMember ([^>]*dimension="[^"]*"[^>]*)>(.*?)</xbrldi:explicitMember>')
_MARKUP = re.compile("(?s)<[^>]*>")
_DATE = re.compile(rf"(?=((?:{MONTH_NAMES}) [0-9]{{1,2}} [0-9]{{4}}|[0-9]{{4}} [0-9]{{2}} [0-9]{{2}}))")


def between(text: str, start: str, end: str):
    """(head, body) of each element of a page: what stands up to the end of its start tag, and up to its end tag. The page is read
    once from left to right; a start without an end is the last one looked at."""
    at = text.find(start)
    while at >= 0:
        head = text.find(">", at)
        stop = text.find(end, head + 1) if head >= 0 else -1
        if stop < 0:
            return
        yield text[at : head + 1], text[head + 1 : stop]
        at = text.find(start, stop + len(end))


def _within(text: str, tag: str) -> str | None:
    return next((body.strip(" ") for _, body in between(text, f"<{tag}>", f"</{tag}>")), None)


@cache
def _attribute_pattern(name: str) -> re.Pattern:
    return re.compile(rf'{name}="([^"]*)"')


def _attribute(head: str, name: str) -> str | None:
    found = _attribute_pattern(name).search(head)
    return found.group(1) if found else None


def page_facts(page: str):
    """(number, name, context, unit, scale, value) of each embedded number that has a name and a context; markup is stripped."""
    for no, (head, body) in enumerate(between(page, "<ix:nonFraction ", "</ix:nonFraction>")):
        name, ref = _attribute(head, " name"), _attribute(head, "contextRef")
        if name and ref:
            value = _MARKUP.sub("", body.replace("&nbsp;", " ")).strip(" ")
            yield no, name, ref, _attribute(head, "unitRef") or None, _attribute(head, "scale") or None, value


def page_contexts(page: str) -> dict[str, tuple]:
    """By id: 'instant' or 'duration', dates as written, and (dimension, member) pairs. The last of equal ids wins."""
    out = {}
    for head, body in between(page, '<xbrli:context id="', "</xbrli:context>"):
        members = [{"dimension": _attribute(m.group(1), "dimension"), "member": m.group(2).strip(" ")} for m in _MEMBER.finditer(body)]
        instant = "<xbrli:instant>" in body
        out[_attribute(head, "id")] = ("instant", None, _within(body, "xbrli:instant"), members) if instant else ("duration", _within(body, "xbrli:startDate"), _within(body, "xbrli:endDate"), members)
    return out


def _without(low: str, tag: str) -> str:
    """A lower-cased page without the elements of a tag; one that isn't ended stays. Read once from left to right."""
    out, done, at = [], 0, low.find(f"<{tag}")
    while at >= 0:
        stop = low.find(f"</{tag}>", at)
        if stop < 0:
            break
        if low[at + len(tag) + 1 : at + len(tag) + 2] in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
            out.append(low[done:at])
            done = stop + len(tag) + 3
        at = low.find(f"<{tag}", max(done, at + 1))
    return " ".join([*out, low[done:]])


def facility_mention(page: str) -> str | None:
    """What a page without markup, scripts and styles says of an undrawn credit facility: that, and its dates; null if nothing."""
    low = page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z only
    if "undrawn" not in low or "credit" not in low:
        return None
    bare = _without(_without(low, "script"), "style")
    text = re.sub("[^a-z0-9]+", " ", re.sub("<[^<>]*>", " ", bare))
    if "credit facility" not in text or "undrawn" not in text:
        return None
    return "; ".join(["credit facility", "undrawn", *dict.fromkeys(f"at {m.group(1)} then" for m in _DATE.finditer(text))])


def _embedded_rows(page: str) -> list[dict]:
    facts = [{"kind": "fact", "no": no, "tag": name, "ref": ref, "unit": unit, "scale": scale, "text": value} for no, name, ref, unit, scale, value in page_facts(page)]
    return facts + [{"kind": "context", "ref": ref, "tag": kind, "starts": s, "ends": e, "members": members} for ref, (kind, s, e, members) in page_contexts(page).items()]


#: What the parser has to meet in a page to fail on it: declarations, processing instructions, and numbers of any length.
_MAY_FAIL = re.compile(r"<[!?]|&#|[0-9]{1000}")


def page_rows(page: str, embedded: bool = False) -> list[dict]:
    """All rows of one page: one reading each by the parser and by the scanners of facts, contexts and prose. embedded: those of
    facts and contexts only, which need no parser; a page that may fail is parsed all the same, to give its error instead."""
    if embedded and not _MAY_FAIL.search(page):
        return _embedded_rows(page)
    doc = _Document()
    try:
        doc.read(page)
    except Exception as e:  # noqa: BLE001 - one bad document must not end the job
        return [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
    if embedded:
        return _embedded_rows(page)
    out: list[dict] = []
    for no, table in enumerate(doc.tables):
        rows = []
        for row in table["rows"]:
            at, cells = 0, []
            for text, span in row:
                cells.append({"text": clean(text), "col_start": at, "col_end": at + span - 1})
                at += span
            rows.append({"cells": cells})
        out.append({"kind": "table", "no": no, "text": clean(table["caption"]), "rows": rows})
    out += [{"kind": "block", "no": no, "tag": tag, "text": clean(text)} for no, (tag, text) in enumerate(doc.blocks)]
    out += _embedded_rows(page)
    mention = facility_mention(page)
    return out + ([{"kind": "mention", "text": mention}] if mention else [])


def parse_documents(documents: DataFrame, key: str = "accession", html: str = "html", embedded: bool = False) -> DataFrame:
    """All that is read from documents, in one job; nothing after it needs the pages. Rows by kind:

    table     no, text (caption), rows (cells with text, col_start, the sum of the spans before it in its row, and col_end)
    block     no, tag, text of a heading, paragraph, list item, div or span
    fact      no, tag (name), ref (context), unit, scale, text of an embedded number
    context   ref, tag (instant or duration), starts and ends as written, members
    mention   text: an undrawn credit facility and the dates of the page
    error     text: why the page could not be parsed

    A document that is null gives nothing; one that can't be parsed gives one row of kind 'error' and nothing else.
    embedded: rows of embedded numbers, their contexts and errors only.
    """
    source = documents.select(F.col(key), F.col(html).cast("string").alias("html"))
    out = T.StructType([source.schema[key], *[T.StructField(n, T._parse_datatype_string(kind)) for n, kind in FIELDS.items()]])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = [{key: k} | row for k, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if page is not None for row in page_rows(page, embedded)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(out.names, kinds, strict=True)], names=out.names)

    return source.mapInArrow(run, out)


def parsed_once(documents: DataFrame, key: str = "accession", html: str = "html", held: list[str] | None = None, embedded: bool = False) -> DataFrame:
    """parse_documents as a written table with a folder for each kind, so a reader of one kind reads nothing else."""
    return written(parse_documents(documents, key, html, embedded), "parsed", ["kind"], held)


def accession_of(path: Column) -> Column:
    """The accession in a path: <cik>/<accession without dashes>/<name>, or a file named by its accession; null without."""
    pattern = r"([0-9]{10})-?([0-9]{2})-?([0-9]{6})(?:/[^/]*|[^/0-9][^/]*)?$"
    parts = [F.regexp_extract(path, pattern, k) for k in range(4)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts[1:]))


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, accession of the files under a folder (or a glob), without reading any."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select("path", "length", accession_of(F.col("path")).alias("accession"))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """accession, html, path of a folder of filing documents, one a file: see accession_of."""
    return read_payloads(spark, path).select(accession_of(F.col("path")).alias("accession"), F.col("payload").alias("html"), "path")


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """accession, html of an archive of filing documents: see accession_of for their names."""
    return read_archive(spark, path).select(accession_of(F.col("path")).alias("accession"), F.col("payload").alias("html"))


def scan_listed(listed: DataFrame) -> DataFrame | None:
    """accession, html of list_documents rows; None for none. Only these files are opened. Their paths pass through the driver, as
    those of any file scan do; pages don't meet a shuffle."""
    paths = [r.path for r in listed.select("path").distinct().toLocalIterator()]
    if not paths:
        return None
    read = listed.sparkSession.read.text(paths, wholetext=True)
    return read.select(accession_of(F.col("_metadata.file_path")).alias("accession"), F.col("value").alias("html"))


#: Bytes of pages that one task parses (a larger page is a task by itself), and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 8 << 20, 64 << 10


def parsed_files(spark: SparkSession, path: str, filings: DataFrame, held: list[str] | None = None) -> DataFrame:
    """The parse of those documents under a folder that belong to filings(accession, ..), written as by parsed_once.

    Files of other filings are listed and not opened. Files are dealt to tasks by their length, largest first, up to TASK_BYTES a
    task: a small multiple of what parsing a page takes, so one large filing holds up one task and not the pages beside it.
    """
    wanted = list_documents(spark, path).join(filings.select("accession").distinct(), "accession", "left_semi")
    pages = scan_listed(wanted)
    if pages is None:
        pages = spark.createDataFrame([], "accession string, html string")
    with settings(spark, spark__sql__files__maxPartitionBytes=str(TASK_BYTES), spark__sql__files__openCostInBytes=str(OPEN_BYTES)):
        return parsed_once(pages, held=held)


def document_tables(parsed: DataFrame, key: str = "accession") -> DataFrame:
    """One row per table: table_no, caption, rows with their cells, as they were parsed. A cell spans the display columns from col_start
    to col_end."""
    return parsed.where("kind = 'table'").select(key, F.col("no").alias("table_no"), F.col("text").alias("caption"), "rows")


def table_cells(parsed: DataFrame, key: str = "accession") -> DataFrame:
    """Cells with the display columns they span: col_start to col_end."""
    rows = document_tables(parsed, key).select(key, "table_no", "caption", F.posexplode("rows").alias("row_no", "r"))
    return rows.select(key, "table_no", "row_no", "caption", F.posexplode("r.cells").alias("cell_no", "c")).select(key, "table_no", "row_no", "cell_no", "c.*", "caption")


def heading_blocks(parsed: DataFrame, key: str = "accession") -> DataFrame:
    return parsed.where("kind = 'block'").select(key, F.col("no").alias("block_no"), "tag", "text")


def inline_facts(parsed: DataFrame, key: str = "accession") -> DataFrame:
    """Embedded numbers: name, local_name, context_ref, unit_ref, scale_attr, value (markup stripped)."""
    out = parsed.where("kind = 'fact'").select(key, F.col("no").alias("pos"), F.col("tag").alias("name"), F.col("ref").alias("context_ref"), F.col("unit").alias("unit_ref"), F.col("scale").alias("scale_attr"), F.col("text").alias("value"))
    return out.withColumn("local_name", F.element_at(F.split("name", ":"), -1))


def inline_contexts(parsed: DataFrame, key: str = "accession") -> DataFrame:
    """Contexts of embedded numbers: context_id, period_start, period_end, members (dimension, member)."""
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    start, end, instant = day("starts"), day("ends"), F.col("tag") == "instant"
    whole = start.isNotNull() & end.isNotNull()
    return parsed.where("kind = 'context'").select(key, F.col("ref").alias("context_id"), F.when(~instant & whole, start).alias("period_start"), F.when(instant | whole, end).alias("period_end"), "members")


def facility_mentions(parsed: DataFrame, key: str = "accession") -> DataFrame:
    """Texts (key, text) of pages that name an undrawn credit facility: that, and the pages' dates."""
    return parsed.where("kind = 'mention'").select(key, "text")


def period_from_context_id(context_ref: Column) -> Column:
    """Date of an id that ends in _I<date>; ids of durations are not read (their dates' own dashes come in the way)."""
    suffix = F.element_at(F.split(context_ref, "_"), -1)
    return F.when(suffix.startswith("I"), F.try_to_date(F.substring(suffix, 2, 10), "yyyy-MM-dd"))
