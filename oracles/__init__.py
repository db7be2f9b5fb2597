"""DuckDB SQL that recomputes each registered query from the raw tables."""
