"""tidetrace: trace narratives through large collections of short texts on Spark.

Every public function takes and returns DataFrames; no action runs inside a
transform except where stated (model fitting, sinks, size checks on small sides).
"""

__version__ = "0.1.0"
