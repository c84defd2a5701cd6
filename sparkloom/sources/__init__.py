"""Where rows come from and go: Parquet folders, described tables, the snapshot store, and schema changes."""
