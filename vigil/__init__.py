"""vigil: Spark-native jobs for channel health, model monitoring, bid
analysis, text preparation and classifier evaluation.

Every public job takes DataFrames (or a session plus a data directory)
and returns a lazy DataFrame. No job reads the clock or collects rows.
"""

__version__ = "0.1.0"
