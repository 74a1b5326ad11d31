"""quotalake: usage, cost and quota analytics for metered model invocations on Spark.

Every operator is a function ``f(DataFrame, ...) -> DataFrame`` built from
Spark SQL / DataFrame expressions so Catalyst can prune, push down and
codegen the whole plan.  See README.md for the operator inventory.
"""

__version__ = "0.1.0"
