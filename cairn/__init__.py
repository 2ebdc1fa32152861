"""cairn: content-addressed data as DataFrames."""
