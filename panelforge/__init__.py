"""panelforge: point-in-time factor research on Spark DataFrames."""
