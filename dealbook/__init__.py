"""dealbook: sales and P&L analytics on Spark DataFrames.

Every public function takes DataFrames (or a session plus a data directory)
and returns a lazy DataFrame; nothing is collected inside an operator.
"""

__all__ = ["session", "fixtures", "functions", "operators", "sources", "plans", "streaming"]
