"""Line dedup by a log-template tree, in DataFrame operations only.

A line is parsed into a tree of fixed depth: token count, then its first LEAD tokens, where a token with a digit is a variable
field. Below a leaf stand templates: the whole line with its variable fields masked, and for lines of at least GENERAL tokens
also four generalised ones, each of which leaves one quarter of the line open (never the leading tokens), so that lines that
differ in names or words of one field meet. A template that occurs in at least `min_docs` documents recurs; its lines are
dropped everywhere but in the document of smallest id, so no text is lost.

Templates are 96-bit hashes (two of different kinds): what is shuffled is a hash and an id for each line and template,
pre-aggregated for counting. Were 10**9 of 10**12 different lines recurring, about one in 10**8 corpora would lose a line to a
collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import fresh, materialize

LEAD, GENERAL = 2, 8
#: Lines of so many tokens are passages: see without_repeated_passages.
PASSAGE = 20
#: White space within a line.
BLANK = r"[ \t\r\f\x0B]"


def _tokens(line: Column) -> Column:
    """The line's tokens, those with a digit masked; one empty token for a blank line. Linear in the line's length: a run of
    characters is only looked at from its start, and without going back."""
    trimmed = F.btrim(line, F.lit(" \t\r\f\x0b"))
    masked = F.regexp_replace(trimmed, r"(?<![^ \t\r\f\x0B])[^ \t\r\f\x0B0-9]*+[0-9][^ \t\r\f\x0B]*+", "<*>")
    return F.split(masked, rf"{BLANK}+")


def _hashed(templates: Column) -> Column:
    """Two hashes of each text of an array; a lambda's variable is evaluated once."""
    return F.transform(templates, lambda t: F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("c")))


def _whole(tokens: Column) -> Column:
    return F.concat_ws("|", F.size(tokens).cast("string"), F.lit("-1"), F.array_join(tokens, " "))


NONE = "cast(array() as array<string>)"


def _templates(tokens: Column) -> Column:
    """A line's templates as texts; none for a blank line."""
    n = F.size(tokens)
    join = lambda lo, k: F.array_join(F.slice(tokens, lo, k), " ")
    open_ = []
    for j in range(4):
        lo = F.floor(n * j / 4).cast("int") if j else F.lit(LEAD)
        hi = F.floor(n * (j + 1) / 4).cast("int")
        open_.append(F.when(hi > lo, F.concat_ws("|", n.cast("string"), F.lit(str(j)), join(F.lit(1), lo), join(hi + 1, n - hi))))
    blank = (n == 1) & (tokens[0] == "")
    return F.when(blank, F.expr(NONE)).when(n < GENERAL, F.array(_whole(tokens))).otherwise(F.array_compact(F.array(_whole(tokens), *open_)))


def _passages(tokens: Column) -> Column:
    """A long line as a whole, with its variable fields masked; none for other lines."""
    return F.when(F.size(tokens) >= PASSAGE, F.array(_whole(tokens))).otherwise(F.expr(NONE))


def _line_templates(text: Column, of_line=_templates) -> Column:
    return F.transform(F.transform(F.transform(F.split(text, "\n"), _tokens), of_line), _hashed)


def parse_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of_line=_templates) -> DataFrame:
    """Written table (id, mark, templates): a row for each of docs with a hash of its text and the templates of its lines.
    Texts are parsed once; counting and flagging read hashes only."""
    return materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _line_templates(F.col(text_col), of_line).alias("templates")), "templates")


def recurring(parsed: DataFrame, min_docs: int = 5) -> DataFrame:
    """(template, n_docs, first_id): templates found in at least min_docs rows of parse_lines; a row counts once for each."""
    once = F.transform(F.array(F.sort_array(F.flatten("templates"))), lambda a: F.filter(a, lambda t, i: (i == 0) | (t != F.get(a, i - 1))))[0]
    each = parsed.select("id", F.explode(once).alias("template"))  # array_distinct compares structs pair by pair
    return each.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, of_line=_templates, among: DataFrame | None = None) -> DataFrame:
    """docs with recurring lines dropped from text_col, and two columns more: n_lines and n_dropped (numbered further if docs
    has such names: then with leading underscores).

    Null texts stay null with 0 lines, empty texts stay empty with 1. A blank line is never dropped. The first document of a
    template (smallest id) keeps its lines; rows that share that id all do; with null ids only, all do. Rows that repeat both
    id and text are treated alike. A line of any length is one line. Text is shuffled once, to meet its dropped line numbers.
    among: a table of ids and xxhash64 of texts (its first two columns); other rows of docs are left out and count for nothing.
    """
    total, gone, mark, of_id, of_mark, at = fresh(docs, "n_lines", "n_dropped", "line_mark", "line_id", "of_mark", "line_at")
    parsed = parse_lines(docs, id_col, text_col, of_line)
    if among is not None:
        wanted = among.select(F.col(among.columns[0]).alias("wanted"), F.col(among.columns[1]).alias("wanted_mark"))
        parsed = parsed.join(wanted, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("mark") == F.col("wanted_mark")), "left_semi")
    known = recurring(parsed, min_docs).select("template", "first_id")
    lines = parsed.select("id", "mark", F.posexplode("templates").alias("line_no", "templates"))
    flagged = lines.select("id", "mark", "line_no", F.explode("templates").alias("template")).join(known, "template").where(~F.col("id").eqNullSafe(F.col("first_id")))
    dropped = flagged.groupBy(F.col("id").alias(of_id), F.col("mark").alias(of_mark)).agg(F.collect_set("line_no").alias(at))
    if among is not None:
        rows = parsed.select("id", "mark").distinct()
        dropped = rows.join(dropped, F.col("id").eqNullSafe(F.col(of_id)) & (F.col("mark") == F.col(of_mark)), "left").select(F.col("id").alias(of_id), F.col("mark").alias(of_mark), at)
    joined = docs.withColumn(mark, F.xxhash64(text_col)).join(dropped, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(mark) == F.col(of_mark)), "left" if among is None else "inner")
    text = F.split(F.col(text_col), "\n")
    kept = F.transform(F.array(text), lambda t: F.transform(F.array_except(F.sequence(F.lit(0), F.size(t) - 1), F.col(at)), lambda i: F.get(t, i)))[0]
    return joined.select(
        *[F.when(F.col(at).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(text)).cast("long").alias(total),
        F.coalesce(F.array_size(F.col(at)), F.lit(0)).cast("long").alias(gone),
    )


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, of_line=_templates, among: DataFrame | None = None) -> DataFrame:
    """The documents after dedup_lines, without those that had lines and lost all of them; columns as in docs, n_chars counted anew."""
    cleaned = dedup_lines(docs, id_col, text_col, min_docs, of_line, among)
    total, gone = cleaned.columns[-2:]
    kept = cleaned.where((F.col(gone) == 0) | (F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.drop(total, gone)


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """As without_recurring_lines, for lines of at least PASSAGE tokens that stand in two documents or more, whole and with numbers
    masked. For documents without near copies: those would be left with the lines in which they differ."""
    return without_recurring_lines(docs, id_col, text_col, 2, _passages, among)
