"""Sources and sinks: CSV with value-driven types, Parquet, rule-made sample data, CSV export."""
