"""Ready-made check patterns: functions from DataFrames to result DataFrames."""
