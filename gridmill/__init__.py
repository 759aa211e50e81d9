"""Document tables on Spark: layout, parsing, provenance, confidence, edits, search and export."""
