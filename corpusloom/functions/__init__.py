"""Column-level building blocks: everything here maps Columns to Columns and never runs a job."""
