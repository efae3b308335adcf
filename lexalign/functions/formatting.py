"""Text formatting that Spark's built-ins do not reproduce.

``format_string('%.6g', x)`` follows Java and keeps trailing zeros
(``0.500000``); the vector files use C/Python ``%.6g`` (``0.5``).  The
formatter is an Arrow-batched pandas UDF over whole vectors (one call per
batch, not per value).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def format_vec_g6(vecs: pd.Series) -> pd.Series:
    return vecs.map(lambda v: " ".join("%.6g" % x for x in v) if v is not None else None)


def percent(c: Column, digits: int = 2, width: int = 7) -> Column:
    """Right-aligned percentage text of a share in [0, 1]: ``  7.20%``."""
    from pyspark.sql import functions as F
    return F.format_string(f"%{width}s", F.concat(F.format_string(f"%.{digits}f", c * 100.0), F.lit("%")))
