"""Stream operators on DataFrames with a value column and a sequence column."""
