"""Display columns of cells come from the parse: no reader of tables computes them again."""

from ledgerloom.sources import documents


def test_tables_are_read_as_they_were_parsed(spark):
    page = "<table><tr><td>a</td><td colspan=3>b</td></tr></table>"
    grid = documents.document_tables(documents.parse_documents(spark.createDataFrame([("x", page)], "accession string, html string")))
    assert [(c.text, c.col_start, c.col_end) for r in grid.first().rows for c in r.cells] == [("a", 0, 0), ("b", 1, 3)]
    assert "transform" not in grid._jdf.queryExecution().optimizedPlan().toString()
