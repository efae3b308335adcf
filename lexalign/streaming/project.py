"""The stateless vector operators on streaming DataFrames.

Unit normalisation, per-row centring and a fitted linear map are row-local
projections, so a ``readStream`` of vectors can be aligned as it arrives:
column statistics (``center``, ``unitdim``) and the model are fitted in batch
and applied as literals / task-side matrices.  No state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexalign.functions import vector as V
from lexalign.operators import mapping as M
from lexalign.operators.fit import Model


def align_stream(stream: DataFrame, model: Model, lang: str, vec: str = "vec",
                 mean: list[float] | None = None, unit_first: bool = True,
                 unit_after: bool = True) -> DataFrame:
    """``unit -> (minus fitted mean) -> x·U·B^{1/2} -> unit`` on a streaming DataFrame."""
    from pyspark.sql import functions as F
    out = stream.withColumn(vec, F.col(vec).cast("array<double>"))
    if unit_first:
        out = out.withColumn(vec, V.unit(vec))
    if mean is not None:
        out = out.withColumn(vec, V.sub(vec, F.array(*[F.lit(float(x)) for x in mean])))
    out = M.to_latent(out, model, lang, vec)
    if unit_after:
        out = out.withColumn(vec, V.unit(vec))
    return out


def start(aligned: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Write the aligned stream as parquet (append) with its own checkpoint location."""
    w = aligned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()
