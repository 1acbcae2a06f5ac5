"""Financial-table analytics on Spark DataFrames.

Every public function takes DataFrames or Columns and returns the same; nothing
is collected.  See README.md for the map from capability to module.
"""
