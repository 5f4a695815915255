"""Electronic-invoice documents as Spark DataFrames: mapping files compiled to columns, diagnostics, analysis."""
