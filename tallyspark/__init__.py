"""tallyspark — spend and subscription analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function that runs distributed, keys all grouping by ``account_id`` and is
deterministic under any input row order.
"""

__version__ = "0.1.0"
