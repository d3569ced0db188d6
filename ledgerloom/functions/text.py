"""Scalar functions of labels, numbers, dates, forms and units as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MONTHS = "january february march april may june july august september october november december".split()
#: What both Spark and other engines read as a plain number.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SCALES = {"raw": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9}


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def has_any(x: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])


# identifiers and forms


def normalize_cik(x: Column) -> Column:
    """Digits only, left-padded to 10; a longer one stays."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits)


def normalize_ticker(x: Column) -> Column:
    return F.upper(F.trim(x))


def classify_form(x: Column) -> Column:
    return F.when(x.isin("10-K", "10-K/A"), "10-K").when(x.isin("10-Q", "10-Q/A"), "10-Q").when(x.isin("20-F", "20-F/A"), "20-F").otherwise(x)


def is_amendment(x: Column) -> Column:
    return x.endswith("/A")


def fiscal_year(period_end: Column) -> Column:
    return F.year(period_end)


def fiscal_quarter(form_type: Column, period_end: Column) -> Column:
    """10-K: Q4; 10-Q: the calendar quarter of the report date; other forms and unknown dates: null."""
    quarter = F.when(form_type == "10-K", "Q4").when(form_type == "10-Q", F.concat(F.lit("Q"), F.quarter(period_end).cast("string")))
    return F.when(period_end.isNotNull(), quarter)


ARCHIVES, DATA, SUBMISSIONS = "https://www.sec.gov/Archives", "https://data.sec.gov", "https://data.sec.gov/submissions"


def directory_url(cik: Column, accession: Column, base: str = ARCHIVES) -> Column:
    return F.concat(F.lit(f"{base}/edgar/data/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))


def submissions_url(cik: Column, base: str = SUBMISSIONS) -> Column:
    return F.concat(F.lit(f"{base}/CIK"), cik, F.lit(".json"))


def company_facts_url(cik: Column, base: str = DATA) -> Column:
    return F.concat(F.lit(f"{base}/api/xbrl/companyfacts/CIK"), cik, F.lit(".json"))


def file_name_from_url(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def document_format(url: Column) -> Column:
    low = ascii_lower(url)
    ends = lambda *s: reduce(lambda a, b: a | b, [low.endswith(x) for x in s])
    return F.when(ends(".htm", ".html"), "html").when(ends(".txt"), "text").when(ends(".xml", ".xsd"), "xml").when(ends(".json"), "json").otherwise("unknown")


def directory_entry_kind(name: Column) -> Column:
    """struct(kind, source_type, source_method, priority) of a file in a filing's folder."""
    low = ascii_lower(name)
    of = lambda kind, source, method, priority: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source_type"), F.lit(method).alias("source_method"), F.lit(priority).alias("priority"))
    xml = low.endswith(".xml")
    return (
        F.when(xml & F.contains(low, F.lit("_pre")), of("xbrl_presentation", "xbrl", "filing_html", "preferred"))
        .when(xml & F.contains(low, F.lit("_cal")), of("xbrl_calculation", "xbrl", "filing_html", "preferred"))
        .when(xml & F.contains(low, F.lit("_lab")), of("xbrl_label", "xbrl", "filing_html", "preferred"))
        .when((xml & F.contains(low, F.lit(".xsd"))) | low.endswith(".xsd"), of("xbrl_schema", "xbrl", "filing_html", "optional"))
        .when(xml, of("xbrl_instance", "xbrl", "filing_html", "preferred"))
        .when(low.endswith(".txt"), of("filing_text", "text", "filing_text", "preferred"))
        .when(low.endswith(".htm") | low.endswith(".html"), of("exhibit", "html", "filing_html", "optional"))
        .otherwise(of("unknown", "html", "filing_html", "optional"))
    )


# structured facts


def fact_unit_kind(unit: Column) -> Column:
    return (
        F.when(unit == "USD", "currency")
        .when(unit.isin("USD/shares", "shares/USD", "USD/share", "usd/shares", "pure"), "ratio")
        .when(unit == "shares", "shares")
        .when(unit.isin("percent", "percentage"), "percentage")
        .when(F.upper(unit).startswith("USD"), "currency")
        .otherwise("other")
    )


def fact_fiscal_quarter(fp: Column) -> Column:
    return F.when(fp == "FY", "Q4").when(fp.isin("Q1", "Q2", "Q3", "Q4"), fp)


def humanize_member(member: Column) -> Column:
    """ConsumerSegmentMember: Consumer Segment."""
    return F.ltrim(F.regexp_replace(F.regexp_replace(member, "Member$", ""), "([A-Z])", " $1"))


def segment_from_frame(frame: Column) -> Column:
    """The first ...Member token after the first ...segment...Axis token that has one after it; null without."""
    tokens = F.split(frame, "_")
    axis = lambda t: F.contains(ascii_lower(t), F.lit("segment")) & t.endswith("Axis")
    first = F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(axis(t), i)), lambda i: i.isNotNull()))
    member = F.get(F.filter(tokens, lambda t, i: (i > first) & t.endswith("Member")), 0)
    return F.when(first.isNotNull(), humanize_member(member))


def period_key(start: Column, end: Column) -> Column:
    return F.coalesce(F.concat(start.cast("string"), F.lit("_to_"), end.cast("string")), end.cast("string"))


def canonical_segment(name: Column) -> Column:
    fixed = F.replace(F.replace(F.replace(name, F.lit("Healthc Care"), F.lit("Healthcare")), F.lit("healthc care"), F.lit("healthcare")), F.lit("&"), F.lit(" and "))
    words = F.split(normalize_label(fixed), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("reportable", "member", "segment", "")), " ")


def segment_display_name(name: Column) -> Column:
    fixed = F.replace(F.replace(F.replace(name, F.lit("Healthc Care"), F.lit("Healthcare")), F.lit("healthc care"), F.lit("Healthcare")), F.lit("Reportable Segment"), F.lit("Segment"))
    return F.trim(F.regexp_replace(fixed, r"\s+", " "))


# document tables


def normalize_label(x: Column) -> Column:
    """Lower-cased words of A-Z, a-z and 0-9: what else there is goes first, so lower() meets ASCII only."""
    return F.trim(F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")))


def let(value: Column, steps) -> Column:
    """Evaluates value once for an expression that names it often; inside array functions nothing else does."""
    return F.transform(F.array(value), steps)[0]


def parse_number(x: Column) -> Column:
    """(x) is negative; commas, dollar and percent signs and no-break spaces go; null if no plain number is left."""
    def number(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\(+", ""), r"\)+$", ""), "[,$%]", ""), r"^[\s ]+|[\s ]+$", "")
        sign = F.when(t.startswith("(") & t.endswith(")"), -1.0).otherwise(1.0)
        return let(bare, lambda b: F.when(b.rlike(NUMBER), sign * b.try_cast("double")))

    return F.when(x.rlike("[0-9]"), let(F.trim(F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), number))


def infer_scale(context: Column) -> Column:
    n = normalize_label(context)
    return F.when(F.contains(n, F.lit("in billions")), "billions").when(F.contains(n, F.lit("in millions")), "millions").when(F.contains(n, F.lit("in thousands")), "thousands").otherwise("raw")


def scaled_amount(amount: Column, scale: Column) -> Column:
    factor = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return amount * factor[scale]


def unit_from_hint(hint: Column) -> Column:
    return F.when(hint.isNull() | (hint == "USD"), "currency").when(hint.isin("shares", "ratio", "percentage", "text"), hint).otherwise("other")


def looks_like_percentage(x: Column) -> Column:
    return F.contains(x, F.lit("%"))


def is_plausible(metric_id: Column, amount: Column) -> Column:
    return (metric_id != "debt_and_credit.interest_rate") | (F.abs(amount) <= 100)


def label_is_usable(normalized: Column) -> Column:
    """4 to 140 characters, not only digits, no period or unit header."""
    header = reduce(lambda a, b: a | b, [normalized.startswith(f"{x} ended") for x in ("year", "three months", "six months", "nine months", "twelve months")])
    header = header | has_any(normalized, "in millions", "in thousands", "except per share", "unaudited")
    return F.length(normalized).between(4, 140) & ~normalized.rlike("^[0-9]+$") & ~header


def duration_months(normalized: Column) -> Column:
    out = F.lit(None).cast("int")
    for words, n in reversed([("year ended", 12), ("three months ended", 3), ("six months ended", 6), ("nine months ended", 9), ("twelve months ended", 12)]):
        out = F.when(F.contains(normalized, F.lit(words)), n).otherwise(out)
    return out


def duration_start(end: Column, months: Column) -> Column:
    """First day of the first of `months` months that end with `end`; null unless end is the last day of a month."""
    return F.when(end == F.last_day(end), F.trunc(F.add_months(end, 1 - months), "MM"))


def header_end_date(header: Column) -> Column:
    """The first valid `month day year` triple; a month followed by anything but two numbers ends the search without a date."""
    short = {name: k + 1 for k, full in enumerate(MONTHS) for name in (full, full[:3])} | {"sept": 9}
    month = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    small = lambda x, n: x.rlike(f"^[0-9]{{1,{n}}}$")

    def triples(tokens: Column) -> Column:
        at = lambda i: F.get(tokens, i)
        found = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(tokens) - 3, F.lit(0))),
            lambda i: F.when(
                month[at(i)].isNotNull() & at(i + 2).isNotNull(),
                F.struct(
                    (small(at(i + 1), 3) & (at(i + 1).try_cast("int") <= 255) & small(at(i + 2), 9)).alias("read"),
                    F.try_to_date(F.concat_ws("-", at(i + 2), month[at(i)].cast("string"), at(i + 1)), "y-M-d").alias("day"),
                ),
            ),
        )
        return F.filter(found, lambda x: x.isNotNull() & (~x["read"] | x["day"].isNotNull()))

    first = let(F.split(normalize_label(header), " "), lambda tokens: F.get(triples(tokens), 0))
    return let(first, lambda f: F.when(f["read"], f["day"]))


ANNUAL_CONTEXTS = tuple(f"{s} of {x}" for x in ("income", "operations", "earnings", "financial position", "cash flows", "shareholders equity", "stockholders equity") for s in ("statement", "statements")) + ("balance sheet",)


def allows_bare_years(context: Column) -> Column:
    return has_any(normalize_label(context), *ANNUAL_CONTEXTS)


def bare_year_date(header: Column, form_type: Column, period_end: Column, allowed: Column) -> Column:
    n = normalize_label(header)
    ok = F.coalesce(allowed, F.lit(False)) & form_type.isin("10-K", "20-F", "40-F") & n.rlike("^[0-9]{4}$") & period_end.isNotNull()
    return F.when(ok, F.try_to_date(F.concat(n, F.date_format(period_end, "-MM-dd")), "yyyy-MM-dd"))


def header_period(header: Column, form_type: Column, period_end: Column, allowed: Column) -> Column:
    """struct(start, end) of a column header, or null; a duration that doesn't end with a month has none."""
    def whole(end: Column) -> Column:
        months = let(normalize_label(header), duration_months)
        dated = lambda m: let(duration_start(end, m), lambda start: F.when(m.isNull() | start.isNotNull(), F.struct(start.alias("start"), end.alias("end"))))
        return F.when(end.isNotNull(), let(months, dated))

    return let(F.coalesce(header_end_date(header), bare_year_date(header, form_type, period_end, allowed)), whole)


def is_reference_header(header: Column) -> Column:
    return F.contains(normalize_label(header), F.lit("reference"))


# embedded facts


def inline_unit(unit_ref: Column) -> Column:
    return F.when(unit_ref == "shares", "shares").when(unit_ref == "pure", "ratio").when(unit_ref.isNull() | F.contains(ascii_lower(unit_ref), F.lit("usd")), "currency").otherwise("other")


def inline_scale(scale: Column) -> Column:
    return F.when(scale == "9", "billions").when(scale == "6", "millions").when(scale == "3", "thousands").otherwise("raw")


# narrative


def truncate_bytes(x: Column, most: int = 32_767) -> Column:
    """x cut to at most `most` UTF-8 bytes at a character boundary."""
    cut = F.substring(x.cast("binary"), 1, most)
    whole = F.try_validate_utf8(cut.cast("string"))
    shorter = [F.try_validate_utf8(F.substring(cut, F.lit(1), F.octet_length(cut) - k).cast("string")) for k in (1, 2, 3)]
    return F.when(F.octet_length(x) <= most, x).otherwise(F.coalesce(whole, *shorter))
