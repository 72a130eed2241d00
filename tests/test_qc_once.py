"""Quality control computes the counts that it is given only once."""

import pytest

from nucleoflow.operators import qc

LIMITS = qc.QcLimits(min_features=1, min_cells_per_gene=2, min_cells_per_peak=2, max_pct_mt=100.0, exclude_genes=["^BAD"])


@pytest.mark.parametrize("sync_first", [False, True])
def test_counts_computed_once(spark, sync_first):
    rna_rows = [(c, f, float(c + f)) for c in range(1, 7) for f in range(1, 4)] + [(9, 1, 0.0)]
    atac_rows = [(c, f, 1.0) for c in range(3, 9) for f in (1, 2)] + [(8, 3, 1.0), (5, 3, None)]

    def counted(rows):
        read = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                read.add(len(batch))
                yield batch

        schema = "cell_id bigint, feature_id bigint, value double"
        return spark.createDataFrame(rows, schema).mapInPandas(run, schema), read

    rna, rna_read = counted(rna_rows)
    atac, atac_read = counted(atac_rows)
    genes = spark.createDataFrame([(1, "A"), (2, "BAD1"), (3, "C")], "feature_id bigint, symbol string")
    peaks = spark.createDataFrame([(1, "chr1:1-2"), (2, "scaffold:1-2"), (3, "chrX:5-9")], "feature_id bigint, name string")
    found = qc.quality_control(rna, atac, genes, peaks, LIMITS, sync_first=sync_first).collect()
    assert (rna_read.value, atac_read.value) == (len(rna_rows), len(atac_rows))
    want = [("rna", c, f, float(c + f)) for c in (3, 4, 5, 6) for f in (1, 3)] + [("atac", c, 1, 1.0) for c in (3, 4, 5, 6)]
    assert sorted((r.modality, r.cell_id, r.feature_id, r.value) for r in found) == sorted(want)
