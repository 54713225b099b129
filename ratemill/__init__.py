"""Rating-evaluation analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is computed until the caller runs an action, except where a
docstring says otherwise.
"""
