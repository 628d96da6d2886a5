"""casebook — categorical outcome analytics on Spark DataFrames.

Every public function takes a DataFrame (plus configuration) and returns a
DataFrame built from native Spark expressions, so Catalyst can prune, push
down and fuse the whole plan.
"""

__version__ = "0.1.0"
