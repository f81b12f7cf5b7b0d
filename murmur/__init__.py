"""Social-chatter analytics over traded entities, expressed as Spark DataFrame operators.

Every operator takes DataFrames plus plain parameters (the clock is always an
explicit ``now``) and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
