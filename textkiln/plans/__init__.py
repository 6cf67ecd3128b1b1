"""End-to-end plans (corpus rows, chat rows, held-out evaluation) and their
DuckDB twins used as correctness oracles."""
