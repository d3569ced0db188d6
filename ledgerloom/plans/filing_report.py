"""The whole program over many companies: discover, extract, reconcile, derive, review, report."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.registry import known_tags
from ledgerloom.functions.text import normalize_cik
from ledgerloom.operators import derive, discovery, document_values, facts, reconcile, report, review
from ledgerloom.sources import payloads, views
from ledgerloom.sources.documents import parsed_files, parsed_once, scan_archive
from ledgerloom.sources.scratch import discard, scratch_path, written


class FilingReport:
    """Tables of one run, each built lazily from its inputs: issuers, filings, facts, and documents(accession, html) or ready
    document-side candidates.

    What several tables read is written once to the shared folder: the parse of the documents, candidates of both sides, and
    ranked values. A lost executor loses nothing of it, and nothing stays in memory after a run. close(), or leaving a `with`,
    deletes these tables.

    keep says what of ranked values is written: 'all' source values, for runs that read many tables; 'groups', a row for each group
    and source with the best of its values and their number, for runs that list none of the others; 'issues', as 'groups' and which
    have duplicates to be reviewed; 'primary' values with few columns, for runs that read nothing else; None, nothing, for one table
    that is read once. more: columns that primary values are to have besides PRIMARY. only: metrics to reconcile, all by
    default; a metric's values never depend on another's. n_values: about how many values both sides have; counted if not given.
    """

    #: Columns of primary values that are kept without source values.
    PRIMARY = ["cik", "metric_id", "period_key", "segment_key", "segment_name", "period_start", "period_end", "source", "accession", "amount"]

    def __init__(self, issuers: DataFrame, filings: DataFrame, fact_rows: DataFrame, html: DataFrame | None = None, years: int = 10, html_policy: str = "fallback_only", treasury_yield: float = 0.04, documents: DataFrame | None = None, document_folder: str | None = None, keep: str | None = "all", only: list[str] | None = None, n_values: int | None = None, more: list[str] | None = None) -> None:
        if sum(x is not None for x in (html, documents, document_folder)) != 1:
            raise ValueError("give one of documents, a folder of them, and document-side candidates")
        if keep not in ("all", "groups", "issues", "primary", None):
            raise ValueError("keep is 'all', 'groups', 'issues', 'primary' or None")
        self.keep, self.only, self.n_values, self.more = keep, only, n_values, more or []
        self.held: list[str] = []
        self.document_folder = document_folder
        self.issuers, self.all_filings, self.fact_rows, self.documents = issuers, filings, fact_rows, documents
        if html is not None:
            self.html = html
        self.years, self.html_policy, self.treasury_yield = years, html_policy, treasury_yield

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, **how) -> FilingReport:
        lines = views.read(spark, sf_dir, "lineitem").count()  # each gives a fact and a document value; no job reads rows for it
        return cls(views.issuers(spark, sf_dir), discovery.describe_filings(views.filings(spark, sf_dir)), views.facts(spark, sf_dir), views.html_candidates(spark, sf_dir), n_values=2 * lines, **how)

    @classmethod
    def from_folders(cls, spark: SparkSession, submissions: str, company_facts: str, documents: str, history: str | None = None, years: int = 10, currency: str = "USD", archived: bool = False, **how) -> FilingReport:
        """A run over files: submission payloads, company fact payloads, filing documents, and history payloads in a folder.

        History is read in a second scan, and only of companies whose recent list doesn't span `years`: their files (their names
        hold CIK) are opened by name, others aren't. Payloads are read once into written tables, so a file that changes meanwhile can't split a run.

        archived: the four paths are archives (payloads.read_archive) instead of folders of files. History payloads then meet the
        list of those wanted by name, and documents their filings by accession, in joins: no list passes through the driver.
        """
        held: list[str] = []
        read_all = payloads.read_archive if archived else payloads.read_payloads
        read = written(read_all(spark, submissions), "submissions", held=held)
        headers = payloads.submission_headers(read)
        recent = payloads.scan_submissions(read).where("status = 'ok'").drop("status")
        all_filings, opened = recent, []
        if history is not None:
            files = payloads.history_files(headers)
            coverage = discovery.history_coverage(discovery.original_filings(discovery.describe_filings(recent)), years)
            listed = discovery.historical_files_to_fetch(coverage, files)
            if archived:
                named = payloads.read_archive(spark, history).withColumnRenamed("path", "name")
            else:
                names = [r.name for r in listed.select("name").distinct().toLocalIterator()]
                opened = [f"{history.rstrip('/')}/{name}" for name in names]
                of_file = F.regexp_extract("path", r"/([^/]*CIK[^/]*)(?:/[^/]*)?$", 1)  # a file, or a folder of one
                named = payloads.read_files(spark, opened).withColumn("name", of_file)
            lists = named.join(listed, "name")
            older = payloads.scan_historical_submissions(lists).where("status = 'ok'").drop("status")
            all_filings = written(discovery.merge_filings(recent, older), "filings", held=held)
        identity = discovery.company_identity(headers).withColumns({"cik": normalize_cik(F.col("cik")), "reported_currency": F.lit(currency)})
        facts_of = written(payloads.scan_company_facts(read_all(spark, company_facts), tags=known_tags()), "facts", held=held)
        pages = {"documents": scan_archive(spark, documents)} if archived else {"document_folder": documents}
        run = cls(identity.select("cik", "ticker", "issuer_name", "exchange", "reported_currency"), discovery.describe_filings(all_filings), facts_of, years=years, **pages, **how)
        run.held, run.history_opened = held, opened
        return run

    def close(self) -> None:
        """Deletes what the run has written; nothing of it can be read afterwards."""
        discard(self.issuers.sparkSession, self.held)

    def __enter__(self) -> FilingReport:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def filings(self) -> DataFrame:
        return discovery.limit_years(discovery.original_filings(self.all_filings), self.years)

    @cached_property
    def candidates(self) -> DataFrame:
        found = facts.extract_facts(self.fact_rows, self.filings, metrics=self.only)
        return written(found, "candidates", held=self.held) if self.keep == "all" else found

    @cached_property
    def parsed(self) -> DataFrame:
        if self.document_folder is not None:
            return parsed_files(self.issuers.sparkSession, self.document_folder, self.filings, self.held)
        return parsed_once(self.documents.join(self.filings.select("accession"), "accession", "left_semi"), held=self.held)

    @cached_property
    def html(self) -> DataFrame:
        return document_values.written_values(self.parsed, self.filings, self.held)

    @cached_property
    def narratives(self) -> DataFrame | None:
        return None if self.documents is None and self.document_folder is None else document_values.document_narratives(self.parsed, self.filings)

    @cached_property
    def both_sides(self) -> DataFrame:
        html = self.html if self.only is None else self.html.where(F.col("metric_id").isin(self.only))
        return self.candidates.unionByName(html, allowMissingColumns=True)

    def _deal(self) -> dict:
        n_values = self.candidates.count() + self.html.count() if self.n_values is None else self.n_values
        return {"n_values": n_values, "uncovered": self.html_policy == "fallback_only"}

    @cached_property
    def reconciled(self) -> DataFrame:
        """Source values with alternative_amount: ranking and choosing are windows over the same groups, so they cost one shuffle
        together, also telling which document values facts cover. Written, if all is kept: what reads them then needs no shuffle."""
        if self.keep not in ("all", None):
            raise ValueError("the run keeps no source values")
        ranked = reconcile.ranked_values(self.both_sides, **self._deal())
        chosen = reconcile.with_alternatives(reconcile.choose_primary(ranked))
        return written(chosen, "reconciled", held=self.held) if self.keep == "all" else chosen

    def _columns(self) -> list[str]:
        return [c for c in [*self.PRIMARY, "source_type", *self.more] if c in self.both_sides.columns or c in reconcile.GROUP]

    @cached_property
    def best(self) -> DataFrame:
        """The best value of each group and source, without its rivals (of runs that don't keep all)."""
        return reconcile.best_values(self.both_sides, **self._deal(), columns=self._columns())

    @cached_property
    def groups(self) -> DataFrame:
        """A row for each group and source: the best value, how many there are (n), and selected_as_primary; of runs that keep issues
        also duplicate_flags and n_given. Of runs that write nothing only the numbers. What is counted of source values can be counted
        of these rows."""
        if self.keep is None:
            return reconcile.group_counts(self.both_sides, **self._deal())
        if self.keep == "issues":
            best = [c for c in dict.fromkeys([*self._columns(), "accession", "pos", "amount"]) if c not in (*reconcile.GROUP, "source", "segment_name")]
            flags = review.duplicate_flags(reconcile.ranked_values(self.both_sides, **self._deal(), counted=True), best)
            found = flags.select(*reconcile.GROUP, "source", "segment_name", *best, "n", "n_given", "identical", "suppressed", "selected_as_primary")
        else:
            found = reconcile.best_values(self.both_sides, **self._deal(), columns=self._columns(), counted=True)
        return written(found, "groups", held=self.held)

    @cached_property
    def ranked(self) -> DataFrame:
        return self.source_values.drop("selected_as_primary", "decision", "review_note")

    @cached_property
    def source_values(self) -> DataFrame:
        return self.reconciled.drop("alternative_amount")

    @cached_property
    def provenance(self) -> DataFrame:
        """Provenance of all source values, written so that a lookup of a metric opens that metric's files only."""
        self.held.append(path := scratch_path(self.issuers.sparkSession, "provenance"))
        return report.write_provenance(report.provenance_records(self.source_values, self.filings), path)

    @cached_property
    def primary(self) -> DataFrame:
        if self.keep == "all":
            return self.reconciled.where("selected_as_primary")
        if self.keep in ("groups", "issues"):
            return self.groups.where("selected_as_primary")
        chosen = reconcile.primary_of(self.best)
        return chosen if self.keep is None else written(chosen, "primary", held=self.held)

    @cached_property
    def metrics(self) -> DataFrame:
        """Primary values and derived ones: cik, metric_id, period_key, period_start, period_end, amount."""
        columns = ["cik", "metric_id", "period_key", "period_start", "period_end", "amount"]
        own = self.primary.select(*columns)
        return own.unionByName(derive.derive_gross_profit(own).select(*columns)).unionByName(derive.derive_share_change(own).select(*columns))

    @cached_property
    def reported_values(self) -> DataFrame:
        """Source values and derived ones, which are primary by themselves: what sheets and coverage count. Of runs that keep groups,
        these in place of their values."""
        derived = self.metrics.join(self.primary.select("cik", "metric_id", "period_key").distinct(), ["cik", "metric_id", "period_key"], "left_anti")
        derived = derived.withColumns({"segment_key": F.lit(""), "source": F.lit("derived"), "selected_as_primary": F.lit(True)})
        out = (self.groups if self.keep in ("groups", "issues") else self.source_values).unionByName(derived, allowMissingColumns=True)
        if self.narratives is None:
            return out
        prose = self.narratives.select("cik", "accession", "metric_id", "period_key").withColumns({"segment_key": F.lit(""), "source": F.lit("html"), "selected_as_primary": F.lit(True)})
        return out.unionByName(prose, allowMissingColumns=True)

    @cached_property
    def formulas(self) -> DataFrame:
        return derive.compute_formulas(self.metrics, self.treasury_yield)

    @cached_property
    def duplicates(self) -> DataFrame:
        return (review.duplicate_issues(self.groups) if self.keep == "issues" else review.duplicate_values(self.ranked)).drop("source")

    @cached_property
    def issues(self) -> DataFrame:
        if self.keep == "issues":
            differing = [self.duplicates, review.value_conflicts(self.groups.withColumn("value_rank", F.lit(1)))]
        else:
            differing = [self.duplicates, review.value_conflicts(self.ranked)]
        parts = [*differing, review.critical_metric_missing(self.issuers, self.primary), review.critical_metric_html_only(self.primary), review.formulas_skipped(self.issuers, self.formulas)]
        if self.narratives is not None:
            parts.append(review.documents_skipped(self.parsed, self.filings))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def headers(self) -> DataFrame:
        """Column heads of wide sheets: every period of each company that any value or formula has."""
        of_formulas = self.formulas.where("status = 'ok'").select("cik", "period_key")
        heads = report.period_headers(self.reported_values.unionByName(of_formulas, allowMissingColumns=True))
        return written(heads, "period-headers", held=self.held)

    def tables(self, periods: list[str] | None = None) -> dict[str, DataFrame]:
        """All report sheets. Wide sheets have a column for each of `periods`, or, without them, as many as the company with most
        periods has; period_headers then says what each stands for."""
        spark = self.issuers.sparkSession
        width = len(periods) if periods is not None else self.headers.agg(F.coalesce(F.max("position"), F.lit(0)).alias("n")).first().n
        wide = lambda d: report.domain_pivot(rows, d, periods) if periods is not None else report.domain_positions(rows, d, self.headers, width)
        records = report.provenance_records(self.source_values, self.filings)
        covered = report.with_notes(report.coverage(self.issuers, self.reported_values, self.formulas))
        rows = report.metric_rows(self.reported_values.where("selected_as_primary and amount is not null"), self.formulas, self.narratives)
        return {
            "schema": report.schema_sheet(spark, width),
            "company_overview": report.company_overview(self.issuers),
            "filing_index": report.filing_index(self.filings),
            **{d: wide(d) for d in report.DOMAIN_SHEETS},
            "provenance": records,
            "duplicate_candidates": report.duplicate_candidates(records),
            "review_warnings": self.issues,
            "coverage_summary": covered,
            "missing_metrics": report.missing_metrics(covered),
            "formula_inputs": report.formula_input_records(self.formulas, self.primary),
            **({} if periods is not None else {report.HEADERS: self.headers}),
        }


def owners_earnings_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company and period with both formulas: the flagship query."""
    run = FilingReport.over(spark, sf_dir, keep="primary", only=derive.FORMULA_METRICS)
    wide = derive.adjusted_earnings_ratio(derive.owners_earnings(derive.formula_inputs(run.metrics)))
    return wide.select("cik", "period_key", "net_income", "owners_status", F.round("owners_earnings", 2).alias("owners_earnings"), "ratio_status", F.round("earnings_ratio", 6).alias("earnings_ratio"))
