"""Plain-SQL statements that recompute registered queries in DuckDB."""
