"""Training-data operators: text cleaning, deduplication, scoring, mixing and tokenising.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns a DataFrame; work is dealt to tasks by Spark and no table passes whole
through the driver, one task or one group.
"""
