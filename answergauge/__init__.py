"""answergauge: evaluation of question-answering output as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame. Column names and
thresholds are arguments; nothing is collected and nothing is hard-wired to one
table.
"""

__version__ = "0.1.0"
