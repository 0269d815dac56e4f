"""Loading and writing: CSV, typed loads, table writes, exports."""
