"""The multi-modal data set: a handful of DataFrames sharing one cell table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.schemas import require_columns


@dataclass(frozen=True)
class Multiome:
    """Long non-zero counts per modality plus per-cell and per-feature tables.

    Operators return a new container; nothing is changed in place.
    """

    counts: DataFrame
    cells: DataFrame
    features: DataFrame
    embeddings: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def modality(self, name: str) -> DataFrame:
        """Counts of one modality; partition pruning applies on stored data."""
        require_columns(self.counts, "modality", "cell_id", "feature_id", "value", what="counts")
        return self.counts.where(F.col("modality") == name).drop("modality")

    def with_cells(self, cells: DataFrame) -> "Multiome":
        return replace(self, cells=cells)

    def restrict_to(self, cell_ids: DataFrame) -> "Multiome":
        """Keep only the given cells in every table."""
        keep = cell_ids.select("cell_id")
        return replace(
            self,
            counts=self.counts.join(keep, "cell_id", "left_semi"),
            cells=self.cells.join(keep, "cell_id", "left_semi"),
            embeddings=None
            if self.embeddings is None
            else self.embeddings.join(keep, "cell_id", "left_semi"),
        )
