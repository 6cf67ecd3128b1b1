"""textkiln: language-model data preparation and evaluation as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is built
from Catalyst expressions, higher-order functions, shuffles and windows; Arrow
batched Python appears only where a tokenizer or a numeric kernel is needed.
"""

from textkiln.constants import EOT, IGNORE, SEQ_LEN  # noqa: F401

__all__ = ["EOT", "IGNORE", "SEQ_LEN"]
