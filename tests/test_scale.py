"""What grows with the tables is exchanged, not sent to the driver."""

from __future__ import annotations

import pytest

from gridmill.plans import catalog

PAGED = "display_classes extraction_prompt guide_line md_export move_columns move_rows next_flagged ocr_scores review_worklist source_box table_text trust tooltips delete_rows remove_empty pad_grid token_to_cell llm_scores reverse_lookup word_bands nearest_like".split()


@pytest.mark.parametrize("name", PAGED)
def test_tables_of_pages_are_not_broadcast(spark, sf, name):
    """A few megabytes of parts make gigabytes of words, which Spark can't know beforehand."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
