"""Column-level helpers: vector expressions, global ranks, text formatting."""

from lexalign.functions import vector  # noqa: F401
