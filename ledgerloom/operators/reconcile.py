"""Source reconciliation: one primary value per company, metric, period and segment, with every other value kept.

Every rule is a window over the group's key, so a chain of rules costs one shuffle. Groups are the values of one metric of one
company in one period, a few dozen at most, whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

GROUP = ["cik", "metric_id", "period_key", "segment_key"]
FAIR = ("assets and liabilities measured at fair value", "fair value hierarchy", "derivative netting adjustments")
AVERAGES = ("average balance sheets", "interest and rates", "interest income")
PARTIAL_YEAR = ("three months ended", "six months ended", "nine months ended", "table continued on next page", "1q", "2q", "3q", "4q")
STATEMENT_STYLE = ("year quarter", "millions, except per-share amounts", "statement of income", "statement of operations", "statement of earnings")
COGS, DEBT, RATE, NOTES = "income_statement.cost_of_goods_sold", "balance_sheet.long_term_debt", "debt_and_credit.interest_rate", "debt_and_credit.notes_and_bonds"
OTHER_FUNDS, GAIN_LOSS, REVENUE = "debt_and_credit.detail_other_borrowed_funds", "derivatives_and_securities.derivative_gain_loss", "income_statement.revenue"
TOLERANCE = 1e-4


def metric_is(*ids: str) -> Column:
    return F.col("metric_id").isin(*ids)


def is_segment() -> Column:
    return F.col("metric_id").startswith("segment_data.")


def is_detail() -> Column:
    return F.col("metric_id").startswith("debt_and_credit.detail_")


def context(*phrases: str) -> Column:
    section = F.coalesce(F.lower("section_name"), F.lit(""))
    table = F.coalesce(F.lower("table_name"), F.lit(""))
    return X.has_any(section, *phrases) | X.has_any(table, *phrases)


def over_group(*more: str):
    return Window.partitionBy(*GROUP, *more)


def drop_covered_html(xbrl: DataFrame, html: DataFrame, segment_aware: bool = False) -> DataFrame:
    """Document values without those of a metric and period (end; start and end for durations) that structured facts have."""
    key = ["cik", "metric_id", "period_start", "period_end"] + (["segment_name"] if segment_aware else [])
    covered = xbrl.select(*key).distinct()
    on = [html[k].eqNullSafe(covered[k]) if k in ("period_start", "segment_name") else html[k] == covered[k] for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return html.join(covered, condition, "left_anti")


def with_section(values: DataFrame) -> DataFrame:
    """values with a section_name, the table's name where they have none."""
    if "section_name" in values.columns:
        return values
    return values.withColumn("section_name", F.col("table_name") if "table_name" in values.columns else F.lit(None).cast("string"))


def with_group_key(values: DataFrame) -> DataFrame:
    """Adds period_key and segment_key; document rows of segment metrics need a segment name."""
    out = with_section(values).withColumn("period_key", X.period_key(F.col("period_start"), F.col("period_end")))
    named = X.canonical_segment(F.col("segment_name"))
    out = out.withColumn("segment_key", F.when(is_segment(), F.when(F.col("segment_name").isNull(), "unassigned_segment").otherwise(named)).otherwise(F.lit("")))
    return out.where(~(is_segment() & (F.col("source") == "html") & F.col("segment_name").isNull()))


def preferred_segment_name(values: DataFrame) -> DataFrame:
    """Writes to each segment row the group's best display name: without 'reportable' and company prefixes, shortest, first."""
    name = X.segment_display_name(F.col("segment_name"))
    low = F.lower(name)
    rank = X.has_any(low, "reportable").cast("int") + (low.startswith("boeing ") | low.startswith("g e ")).cast("int")
    best = F.min(F.when(is_segment() & F.col("segment_name").isNotNull(), F.struct(rank.alias("rank"), F.length(name).alias("size"), name.alias("name")))).over(over_group())
    return values.withColumn("segment_name", F.coalesce(best["name"], "segment_name"))


def _keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(F.coalesce(condition, F.lit(True)))


#: Bits of what the table and section of a document value say; see with_marks.
PERCENT, QUARTER, LONGER, CONTINUED, STATEMENT, ODD, FAIR_VALUE, PLAIN, UNFAIR = (1 << k for k in range(9))


def with_marks(values: DataFrame) -> DataFrame:
    """Adds _marks, read once from the texts and only for the metrics whose rules ask; no rule after it needs these texts."""
    continued, fair, odd = context("(continued)"), context(*FAIR), context(*AVERAGES) | context(*PARTIAL_YEAR)
    bits = {PERCENT: context("percent of net sales"), QUARTER: context("three months ended") & ~continued, LONGER: context("six months ended", "nine months ended"), CONTINUED: continued, STATEMENT: context(*STATEMENT_STYLE) & ~continued, ODD: odd, FAIR_VALUE: fair, PLAIN: ~(odd | fair), UNFAIR: ~fair}
    marks = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, bit).otherwise(0) for bit, c in bits.items()])
    return values.withColumn("_marks", F.when((F.col("source") == "html") & metric_is(COGS, DEBT, RATE), marks).otherwise(0))


def marked(column: str, mark: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(mark)) != 0


def prune_context(values: DataFrame) -> DataFrame:
    """Document values without those that the context of better ones in their group rules out; values of facts all stay."""
    v = values if "_marks" in values.columns else with_marks(values)
    cogs, debt, rate = metric_is(COGS), metric_is(DEBT), metric_is(RATE)
    v = _keep(v, ~(cogs & marked("_marks", PERCENT)))
    g = over_group("source")
    v = v.withColumns({"_all": F.bit_or("_marks").over(g), "_n": F.count(F.lit(1)).over(g)})
    several = F.col("_n") >= 2
    quarter = marked("_all", QUARTER) & several  # longer and continued ones go; without a quarter, those continued beside a statement
    drop = cogs & ((quarter & marked("_marks", LONGER | CONTINUED)) | (marked("_all", STATEMENT) & several & marked("_marks", CONTINUED)))
    drop = drop | (debt & marked("_all", PLAIN) & marked("_marks", ODD)) | ((debt | rate) & marked("_all", UNFAIR) & marked("_marks", FAIR_VALUE))
    return _keep(v, ~drop).drop("_marks", "_all", "_n")


def amount_clusters(values: DataFrame, *within: str) -> DataFrame:
    """Numbers amounts within the group so that neighbours within the tolerance share a number. Equal amounts are counted together,
    so their order is nobody's concern and no shuffle carries what would tell it."""
    w = Window.partitionBy(*GROUP, *within).orderBy("amount")
    step = F.coalesce((F.col("amount") - F.lag("amount").over(w) > TOLERANCE).cast("int"), F.lit(0))
    return values.withColumn("_step", step).withColumn("cluster", F.sum("_step").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def prune_outliers(values: DataFrame) -> DataFrame:
    """Of document values: context rules, then small values beside large ones, quarter fragments beside a year, and small ones
    beside an equal pair. Values of facts all stay."""
    g, size, html = over_group("source"), F.abs("amount"), F.col("source") == "html"
    v = prune_context(values)
    v = v.withColumns({"_n3": F.count(F.lit(1)).over(g) >= 3, "_max": F.max(size).over(g)})
    v = _keep(v, ~(html & F.col("_n3") & (F.col("_max") >= 1000) & (size < 1000) & (size < F.col("_max") * 0.25)))  # keeps the largest
    v = amount_clusters(v, "source")
    same = F.count(F.lit(1)).over(over_group("source", "cluster", "unit_kind", "unit_code", "scale"))
    v = v.withColumn("_same", (same > 1) & (size >= 10))
    v = v.withColumns({
        "_n": F.count(F.lit(1)).over(g),
        "_pair": F.max(F.col("_same").cast("int")).over(g) == 1,
        "_annual": F.min(((F.col("form_type") == "10-K") & F.col("period_start").isNull()).cast("int")).over(g) == 1,
        "_rest": F.max(F.when(size < F.col("_max"), size)).over(g),
    })
    checked = html & F.col("_n3") & (F.col("_n") >= 3)
    fragments = checked & metric_is(COGS) & F.col("_annual") & (F.col("_max") >= 1000) & (F.col("_rest") <= F.col("_max") * 0.4)
    v = _keep(v, ~(fragments & (size < F.col("_max"))))
    v = _keep(v, ~(checked & F.col("_pair") & (size < 10)))
    return v.drop("_n", "_max", "_same", "_n3", "_pair", "_annual", "_rest", "cluster")


def source_rank() -> Column:
    label = F.lower(F.coalesce("row_label", F.lit("")))
    rate = F.when(X.has_any(label, "weighted average"), 1).when(X.has_any(label, "fixed rate debt", "fixed-rate debt", "floating rate debt", "floating-rate debt", "current portion of long term debt", "short term borrowings"), 2).when(X.has_any(label, "note", "bond", "debenture"), 3).otherwise(4)
    debt = F.when(context("selected consolidated balance sheets", "balance sheets data", "balance sheet"), 1).when(context(*PARTIAL_YEAR), 4).when(context(*AVERAGES), 5).when(context(*FAIR), 6).otherwise(3)
    total = label.startswith("total ") | label.startswith("net cash ")
    html = F.when(metric_is(COGS) & context("percent of net sales"), 5).when(metric_is(RATE), rate).when(metric_is(DEBT), debt).when(total | (metric_is(COGS) & context(*STATEMENT_STYLE)), 1).otherwise(2)
    return F.when(F.col("source") == "xbrl", 0).otherwise(html)


def filing_year(accession: Column) -> Column:
    """2000 + the two digits after the first dash; null if there are none."""
    return 2000 + F.get(F.split(accession, "-"), 1).try_cast("int")


def year_delta() -> Column:
    report = F.year("period_end")
    return F.abs(F.coalesce(filing_year(F.col("accession")), report) - report)


def place_keys(values: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Values with segment_total and what ranks them, and the keys by which those of one group and source are ranked: promoted
    totals, source rank, history, then what the metric prefers. With _history, what only the best filing's derivative values have
    in common with _best_history."""
    part, own = over_group("source"), over_group("source", "accession")
    html = F.col("source") == "html"
    v = with_history(values if "source_rank" in values.columns else with_ranks(values))
    v = v.withColumns({"_n": F.count(F.lit(1)).over(part), "_one": F.min("accession").over(part) == F.max("accession").over(part)})
    mine = lambda column: F.when(F.col("_inline"), column)
    v = v.withColumn("segment_total", F.col("_inline") & (F.count(mine(F.lit(1))).over(own) >= 3) & (F.col("amount") == F.max(mine(F.col("amount"))).over(own)) & (F.abs(F.sum(mine(F.col("amount")).cast("decimal(24,4)")).over(own).cast("double") - 2 * F.col("amount")) <= TOLERANCE))
    several = F.col("_n") >= 2
    size, label = F.abs("amount"), F.coalesce("row_label", F.lit(""))
    notes, together = html & metric_is(NOTES) & several, html & several & F.col("_one")
    keys = {
        "k0": (~(html & F.col("segment_total"))).cast("int"),
        "k1": F.when(together & is_detail(), (~F.lower(label).startswith("total ")).cast("int")).otherwise(0),
        "k2": F.when((together & metric_is(DEBT)) | (together & is_detail()) | (html & metric_is(OTHER_FUNDS) & (F.col("_n") == 2) & F.col("_one")), -size).otherwise(0),
        "k3": F.when(notes, 0).otherwise(F.col("source_rank")),
        "k4": F.when(is_segment() | metric_is(NOTES), F.col("history_delta")).otherwise(0),
        "k5": F.col("accession"),
        "k6": F.when(notes, -size).otherwise(0),
        "k7": label,
        "k8": F.col("pos"),
    }
    return v, keys


#: Columns of place_keys and with_ranks that nothing after ranking reads.
PLACE = ["_inline", "_n", "_one", "_history", "_best_history"]


def with_ranks(values: DataFrame) -> DataFrame:
    """Adds source_rank and history_delta, and whether a value is an embedded segment fact: what ranking reads from texts."""
    inline = is_segment() & (F.col("section_name") == "inline_xbrl_segment") & (F.col("table_name") == "inline_xbrl_segment")
    return values.withColumns({"source_rank": source_rank(), "history_delta": F.when(is_segment() | metric_is(NOTES, DEBT), year_delta()).otherwise(0), "_inline": F.coalesce(inline, F.lit(False))})


def rank_values(values: DataFrame) -> DataFrame:
    """Adds value_rank, 1 the best of its group and source; see place_keys."""
    v, keys = place_keys(values)
    return v.withColumn("value_rank", F.row_number().over(over_group("source").orderBy(*keys.values())).cast("int"))


def _history() -> Column:
    """What of derivative gains and losses makes a filing the best: year distance, form that fits the period, accession."""
    year = (F.month("period_start") == 1) & (F.dayofmonth("period_start") == 1) & (F.month("period_end") == 12) & (F.dayofmonth("period_end") == 31)
    fits = F.col("period_start").isNotNull() & (((F.col("form_type") == "10-K") & year) | ((F.col("form_type") == "10-Q") & ~year))
    return F.struct(year_delta().alias("delta"), F.when(fits, 0).otherwise(1).alias("misfit"), F.col("accession").alias("accession"))


def with_history(values: DataFrame) -> DataFrame:
    """Adds _history to derivative gains and losses, and _best_history of their group; see of_best_history."""
    v = values.withColumn("_history", F.when((F.col("source") == "html") & metric_is(GAIN_LOSS), _history()))
    return v.withColumn("_best_history", F.min("_history").over(over_group("source")))


def of_best_history(ranked: DataFrame) -> DataFrame:
    """Of derivative gains and losses only the best filing's values."""
    return ranked.where(F.col("_history").isNull() | (F.col("_history") == F.col("_best_history")))


#: Besides group and source, what equal values of one accession have in common.
ALIKE = ["accession", "cluster", "unit_kind", "unit_code", "scale", "segment_name"]


def collapse_same_accession(ranked: DataFrame) -> DataFrame:
    """Of equal values (amount within the tolerance, unit, scale, segment) of one accession the best ranked, with n_alike, how many
    they are."""
    v, alike = amount_clusters(ranked, "source", "accession"), over_group("source", *ALIKE)
    v = v.withColumns({"_best": F.min("value_rank").over(alike), "n_alike": F.count(F.lit(1)).over(alike)})
    return v.where("value_rank = _best").drop("_best", "cluster")


#: Values that one task ranks: each of some seven sorts holds the task's rows, a few hundred bytes each.
TASK_VALUES = 120_000


def dealt(candidates: DataFrame, n_values: int | None = None, uncovered: bool = False) -> DataFrame:
    """Values with their group's key, and what rules read from texts. With their number given, companies' metrics are dealt to so
    many tasks that none has to spill, each sorted once for all rules on groups; without it, to as many as any shuffle has.

    uncovered: without document values of a metric and period that facts have, as drop_covered_html, but within this one shuffle."""
    keyed = with_ranks(with_marks(with_section(candidates)))
    if n_values is not None:  # keys are made after the shuffle
        keyed = with_group_key(keyed.repartition(n_values // TASK_VALUES + 1, "cik", "metric_id")).sortWithinPartitions(*GROUP, "source")
    else:
        keyed = with_group_key(keyed)
    if uncovered:
        facts = F.max(F.col("source") != "html").over(Window.partitionBy("cik", "metric_id", "period_key"))
        known = F.col("cik").isNotNull() & F.col("metric_id").isNotNull() & F.col("period_end").isNotNull()
        keyed = keyed.withColumn("_covered", facts & known).where((F.col("source") != "html") | ~F.col("_covered")).drop("_covered")
    return keyed


def ranked_values(candidates: DataFrame, n_values: int | None = None, uncovered: bool = False, counted: bool = False) -> DataFrame:
    """Pruned (document side only), ranked and collapsed values of all groups; see dealt for the number of values. counted: with
    n_alike, the values that each stands for."""
    keyed = preferred_segment_name(dealt(candidates, n_values, uncovered))
    return collapse_same_accession(of_best_history(rank_values(prune_outliers(keyed)))).drop(*PLACE, *[] if counted else ["n_alike"])


def _n_collapsed() -> Column:
    """How many values of a group and source, with their clusters, collapse_same_accession leaves."""
    return F.count_distinct(F.struct(*ALIKE)).alias("n")


def group_counts(candidates: DataFrame, n_values: int | None = None, uncovered: bool = False) -> DataFrame:
    """GROUP, source, n, the number of values that ranked_values gives, and selected_as_primary, whether the primary value is of this
    source (of several that are no facts: that of the first by name). Nothing is ranked, and no text beyond the keys is dealt."""
    keyed = preferred_segment_name(dealt(candidates, n_values, uncovered))
    v = amount_clusters(of_best_history(with_history(prune_outliers(keyed))), "source", "accession")
    return with_selected(v.groupBy(*GROUP, "source").agg(_n_collapsed()))


def with_selected(groups: DataFrame) -> DataFrame:
    """Rows of groups and sources with selected_as_primary, as primary_of selects."""
    order = F.struct(F.when(F.col("source") == "xbrl", 0).otherwise(1).alias("other"), *[c for c in ("accession", "pos") if c in groups.columns], "source")
    return groups.withColumn("_order", order).withColumn("selected_as_primary", F.col("_order") == F.min("_order").over(over_group())).drop("_order")


def best_values(candidates: DataFrame, n_values: int | None = None, uncovered: bool = False, columns: list[str] | None = None, counted: bool = False) -> DataFrame:
    """The best value of each group and source, what ranked_values gives the lowest value_rank: GROUP, source, accession, pos,
    amount and columns. No value is numbered and none collapsed, as neither changes which is the best; values meet the rules without
    what nobody asks for. counted: with n and selected_as_primary, as group_counts."""
    more = [c for c in columns or [] if c not in [*GROUP, "source", "accession", "pos", "amount"]]
    keyed = dealt(candidates, n_values, uncovered)
    keyed = preferred_segment_name(keyed) if counted or "segment_name" in more else keyed
    v, keys = place_keys(prune_outliers(keyed))
    v = amount_clusters(of_best_history(v), "source", "accession") if counted else of_best_history(v)
    best = v.groupBy(*GROUP, "source").agg(F.min(F.struct(*[k.alias(n) for n, k in keys.items()], *["accession", "pos", "amount", *more])).alias("b"), *[_n_collapsed()] if counted else [])
    best = best.select(*GROUP, "source", *[F.col(f"b.{c}") for c in ("accession", "pos", "amount", *more)], *["n"] if counted else [])
    return with_selected(best) if counted else best


def primary_of(best: DataFrame) -> DataFrame:
    """The selected value of each group of best_values, with its decision: the structured fact, or else the first."""
    rest = [c for c in best.columns if c not in GROUP]
    order = F.struct(F.when(F.col("source") == "xbrl", 0).otherwise(1).alias("other"), F.col("accession").alias("k1"), F.col("pos").alias("k2"), *rest)
    g = best.groupBy(*GROUP).agg(F.min(order).alias("b"), (F.min("source") != F.max("source")).alias("both"))
    decision = F.when(F.col("both"), "prefer_xbrl_keep_html_alternative").when(F.col("b.other") == 0, "xbrl_only").otherwise("html_only")
    return g.select(*GROUP, *[F.col(f"b.{c}") for c in rest], decision.alias("decision"))


def choose_primary(ranked: DataFrame) -> DataFrame:
    """Every value with its place: selected_as_primary, decision, review_note."""
    g, own = over_group(), over_group("source")
    order = F.struct(F.when(F.col("source") == "xbrl", 0).otherwise(1).alias("other"), "value_rank", "accession", "pos", "source")
    v = ranked.withColumns({"_order": order, "_first": F.col("value_rank") == F.min("value_rank").over(own)})
    v = v.withColumns({"_least": F.min("_order").over(g), "_both": F.min("source").over(g) != F.max("source").over(g)})
    decision = F.when(F.col("_both"), "prefer_xbrl_keep_html_alternative").when(F.col("_least.other") == 0, "xbrl_only").otherwise("html_only")
    selected = F.col("_order") == F.col("_least")
    note = F.when(selected, "selected primary value").when(F.col("_first") & F.col("_both"), "retained alternative source value").otherwise("retained duplicate source value for review")
    return v.withColumns({"selected_as_primary": selected, "decision": decision, "review_note": note}).drop("_order", "_first", "_least", "_both")


def with_alternatives(source_values: DataFrame) -> DataFrame:
    """Adds alternative_amount, the best value of the group's other source."""
    alternative = F.max(F.when(F.col("review_note") == "retained alternative source value", F.col("amount"))).over(over_group())
    return source_values.withColumn("alternative_amount", alternative)


def primary_values(source_values: DataFrame) -> DataFrame:
    """One row per group: the selected value, and the other source's best as alternative_amount."""
    return with_alternatives(source_values).where("selected_as_primary")


def normalize(xbrl: DataFrame, html: DataFrame, html_policy: str = "fallback_only") -> DataFrame:
    """source_values of both sides. 'fallback_only' drops document values that facts cover before they are compared."""
    html = drop_covered_html(xbrl, html) if html_policy == "fallback_only" else html
    return choose_primary(ranked_values(xbrl.unionByName(html, allowMissingColumns=True)))
