import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleoflow.container import Multiome
from nucleoflow.functions import strings as S
from nucleoflow.functions import tails
from nucleoflow.functions import vectors as V
from nucleoflow.operators import annotate, consensus, graph, grn, linking, motif, qc, trajectory
from nucleoflow.sources import readers, sinks
from nucleoflow.streaming import incremental


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_edge_weights(spark):
    rows = [("a", "g1", 1, 0.5), ("a", "g2", 1, -0.5), ("a", "g3", 3, 0.2), ("a", "g4", 0, 0.9)]
    out = grn.add_edge_weights(spark.createDataFrame(rows, "tf string, gene string, n_peaks int, correlation double"))
    got = {r.gene: (r.motif_score, r.edge_weight) for r in out.collect()}
    assert got["g1"] == (0.5, 0.25) and got["g2"] == (0.5, 0.25) and got["g4"] == (0, 0)
    assert got["g3"][0] == 1 and math.isclose(got["g3"][1], 0.2)
    with pytest.raises(ValueError):
        grn.add_edge_weights(spark.createDataFrame([("a", "b", 0.1)], "tf string, gene string, correlation double"))


@pytest.mark.parametrize("n,kept", [(10, 0), (20, 1), (30, 2), (100, 9)])
def test_variance_budget(spark, n, kept):
    df = spark.createDataFrame([(i, [0.0, float(i + 1)]) for i in range(n)], "feature_id int, vec array<double>")
    out = sorted(r.feature_id for r in trajectory.variance_cutoff(df, 0.9).collect())
    assert out == list(range(n - kept, n))


def test_bins(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0.0, 0.5, 1.0, 1.0001, 100.0])], "cell_id int, trajectory double")
    assert {r.cell_id: r.bin for r in trajectory.assign_bins(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 100}
    with pytest.raises(ValueError):
        trajectory.check_range(spark.createDataFrame([(1, 101.0)], "cell_id int, trajectory double"))


def test_band_is_inclusive(spark):
    peaks = spark.createDataFrame([(f"p{c}", "chr1", int(c * 2) - 1000, 1000) for c in (500, 499.5, 1500, 1500.5)], "peak string, chr string, start bigint, end bigint")
    genes = spark.createDataFrame([("g", "chr1", 1000, 5000, "+"), ("h", "chr1", 1000, 5000, "-")], "gene string, chr string, start bigint, end bigint, strand string")
    got = {(r.peak, r.gene) for r in linking.band_join(peaks, genes, 500).collect()}
    assert got == {("p500", "g"), ("p1500", "g")}
    plan = linking.band_join(peaks, genes, 500)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_network_assembly(spark):
    m = spark.createDataFrame([("p1", "T1", 1.0), ("p2", "T1", 1.0), ("p2", "T2", 2.0), ("p9", "T2", 0.0)], "peak string, tf string, score double")
    links = spark.createDataFrame([("p1", "g1"), ("p2", "g1"), ("p2", "g2")], "peak string, gene string")
    cor = spark.createDataFrame([("T1", "g1", 0.5), ("T2", "g2", -0.8)], "tf string, gene string, correlation double")
    full = {(r.tf, r.gene): (r.n_peaks, r.correlation) for r in grn.infer_grn(m, cor, links).collect()}
    assert full == {("T1", "g1"): (2, 0.5), ("T1", "g2"): (1, None), ("T2", "g1"): (1, None), ("T2", "g2"): (1, -0.8)}
    assert [(r.tf, r.gene) for r in grn.infer_grn(m, cor, links, 0.6).collect()] == [("T2", "g2")]
    with pytest.raises(ValueError):
        grn.infer_grn(m.drop("tf"), cor, links)


def test_candidate_score(spark):
    q = spark.createDataFrame([(1, "liver", ["A", "B", "C"]), (2, None, ["A2"]), (3, None, []), (4, None, ["Z"])], "query_id int, tissue string, genes array<string>")
    rows = [("Liver", "X", g, a, 4, "Normal") for g, a in (("A", None), ("B", "A2"))] + [("Lung", "X", g, None, 4, "Normal") for g in "AB"]
    mk = spark.createDataFrame(rows, "tissue string, cell_type string, gene string, alias string, total_markers int, cancer_type string")
    got = {(r.query_id, r.tissue): r for r in annotate.candidates(q, mk).collect()}
    assert got[1, "Liver"].weighted_jaccard == 0.6 and got[1, "Lung"].weighted_jaccard == 0.4 and got[1, "Liver"].recall == 0.5
    assert got[2, "Liver"].hits == 1
    status = {r.query_id: r.status for r in annotate.batch_annotate(q, mk).collect()}
    assert status == {1: "(API not called)", 2: "(API not called)", 3: "null value", 4: "No candidate found"}


def test_annotator_callback(spark):
    df = spark.createDataFrame([("x",), ("bad",)], "prompt string")

    def call(text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    assert {r.prompt: r.answer for r in annotate.annotate_with(df, call).collect()} == {"x": "X", "bad": "ERROR: no"}


def test_annotator_waits(spark, tmp_path):
    """A prompt that fails twice is answered at the third attempt, after two waits; null isn't sent."""
    log = str(tmp_path / "calls")

    def call(text):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        if len(open(log).readlines()) < 3:
            raise RuntimeError("busy")
        return text

    df = spark.createDataFrame([("x",), (None,)], "prompt string").coalesce(1)
    got = {r.prompt: r.answer for r in annotate.annotate_with(df, call, back_off=(0.1, 0.2)).collect()}
    at = [float(x) for x in open(log)]
    assert got == {"x": "x", None: None} and len(at) == 3 and at[1] - at[0] >= 0.1 and at[2] - at[1] >= 0.2
    assert annotate.BACK_OFF == (1.0, 2.0, 4.0)


def test_factor_importance(spark):
    rows = [("a", 0.1, 0.0), ("b", 0.2, 1.0), ("c", 0.4, 0.5), ("g", 9.0, 9.0)]
    measures = spark.createDataFrame(rows, "node string, pagerank double, betweenness double")
    factors = spark.createDataFrame([("a",), ("b",), ("c",), ("absent",)], "name string")
    got = {r.node: r.importance for r in graph.node_importance(measures, factors).collect()}
    x = np.array([r[1:] for r in rows[:3]])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.sqrt(((z - z.min(0)) ** 2).sum(1))
    assert list(sorted(got)) == ["a", "b", "c"] and np.allclose([got[k] for k in "abc"], want)
    assert graph.node_importance(measures).count() == 4


def test_factor_symbols(spark):
    rng = np.random.default_rng(3)
    up = np.linspace(0, 1, 20)
    act = {"T1": up, "T2": up[::-1]}
    expr = {"id1": up + 0.01 * rng.random(20), "id2": up, "id3": rng.random(20)}
    frame = lambda d: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in d.items()], "feature_id string, vec array<double>")
    symbols = spark.createDataFrame([("id1", "T1"), ("id2", "T2"), ("id3", "T1")], "name string, symbol string")
    out = {r.tf: r for r in grn.select_tfs(frame(act), frame(expr), n_bins=20, symbols=symbols).collect()}
    assert set(out) == {"T1", "T2"} and out["T1"].correlation > 0.99 and out["T2"].correlation < -0.99
    assert out["T1"].selected and not out["T2"].selected
    with pytest.raises(ValueError, match="common"):
        grn.select_tfs(frame(act), frame(expr), n_bins=20, symbols=symbols.where("symbol = 'X'"))
    with pytest.raises(ValueError, match="no factor"):
        grn.select_tfs(frame({"T2": act["T2"]}), frame({"T2": up}), n_bins=20, require=True)


def test_tails(spark):
    t = tails.pearson_t(F.lit(0.5), F.lit(100))
    assert abs(one(spark, t) - 5.715476) < 1e-6
    assert abs(one(spark, tails.t_two_sided_p(t, F.lit(98))) / 1.1805e-7 - 1) < 1e-4
    assert abs(one(spark, tails.t_two_sided_p(tails.pearson_t(F.lit(0.3), F.lit(12)), F.lit(10))) - 0.343439) < 1e-6
    assert abs(one(spark, tails.normal_two_sided_p(F.lit(1.7457))) - 0.0808556) < 1e-5
    assert tails.regularized_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_agreement(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 0, 1, 2])), "true_label int, pred_label int")
    assert consensus.agreement(consensus.contingency(df)).first().ari == pytest.approx(4 / 7)


def test_gene_stability(spark):
    df = spark.createDataFrame([(0, "g", 0.2), (2, "g", 0.6)], "iter int, gene string, score double")
    r = consensus.gene_stability(df, 4).first()
    assert (r.max_score, r.min_score, r.median_score, r.freq_detected, r.detection_rate) == (0.6, 0.2, 0.4, 2, 50)
    assert math.isclose(r.cumulative_score, 0.8) and math.isclose(r.mean_score_when_detected, 0.4)


def test_scaling_and_negative_guard(spark):
    cells = spark.createDataFrame([(1, 50.0)], "cell_id int, trajectory double")
    c = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0)], "cell_id int, feature_id string, value double")
    got = {r.feature_id: r.vec for r in trajectory.profiles(c, cells, window=0).collect()}
    assert got["a"][49] == pytest.approx(math.log2(2501)) and got["b"][49] == pytest.approx(math.log2(7501)) and got["a"][0] == 0
    neg = c.withColumn("value", F.when(F.col("feature_id") == "a", -1.0).otherwise(F.col("value")))
    assert {r.feature_id: r.vec[49] for r in trajectory.profiles(neg, cells, window=0).collect()} == {"a": -1.0, "b": 3.0}


def test_text_rules(spark):
    f = lambda rule, text: one(spark, rule(F.lit(text)))
    assert [f(S.factor_name, t) for t in ("Gata1(var.2)", "JUN(var.10)", "FOS::JUN")] == ["GATA1", "JUN", "FOS::JUN"]
    names = ["chr1:1-2", "chr22-1-2", "chrX:1-2", "chrUn_KI270742v1:1-2", "GL000194.1:1-2", "1:1-2"]
    assert [f(S.is_standard_chromosome, t) for t in names] == [True] * 3 + [False] * 3
    assert [f(S.parse_peak, t)["valid"] for t in ("chr1:100-200", "chr1-100-200", "chr1:200-100", "1:1-2")] == [True, True, False, False]
    assert f(S.tissue_key, " bone MARROW") == "Bone marrow" and f(S.marker_alias, "cd3 (Alt)") == "ALT" and f(S.marker_main, "cd3") == "CD3"


def test_label_fallback(spark):
    names = spark.createDataFrame([("AAA-1",), ("BBB-1",), ("CCC-1",)], "name string")
    meta = spark.createDataFrame([("AAA-1", "T"), ("BBB", "B")], "barcode string, celltype string")
    got = {r.name: r.celltype for r in annotate.label_with_fallback(names, meta, "barcode", "celltype").collect()}
    assert got == {"AAA-1": "T", "BBB-1": "B", "CCC-1": "Unknown"}


def test_filtering_never_adds_and_limits_are_checked(spark):
    c = spark.createDataFrame([(1, "MT-1", 1.0), (1, "b", 1.0), (2, "b", 5.0)], "cell_id int, feature_id string, value double")
    names = c.select("feature_id", F.col("feature_id").alias("symbol")).distinct()
    out = qc.filter_rna(c, names, qc.QcLimits(min_features=1, max_pct_mt=20)).collect()
    assert [(r.cell_id, r.feature_id) for r in out] == [(2, "b")]
    with pytest.raises(ValueError):
        qc.QcLimits(min_features=-1)
    with pytest.raises(ValueError):
        qc.require_shared(qc.shared_cells(c, c.where("cell_id > 9")))


def test_unit_rows(spark):
    df = spark.sql("SELECT array(1D, 1D) a, array(1D, 3D) b")
    r = df.select(V.unit(F.col("a")), V.unit(F.col("b"))).first()
    assert r[0] == [0, 0] and np.allclose(r[1], [-(0.5**0.5), 0.5**0.5])


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% note\n2 3 2\n1 3 5\n2 1 7\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\nc3\n")
    (tmp_path / "f.tsv").write_text("g1\tx\ng2\ty\n")
    m = readers.read_matrix_market(spark, str(tmp_path / "m.mtx"), str(tmp_path / "b.tsv"), str(tmp_path / "f.tsv"), "rna")
    assert sorted((r.cell_id, r.feature_id, r.value) for r in m.collect()) == [("c1", "g2", 7), ("c3", "g1", 5)]
    (tmp_path / "l.csv").write_text("cell_name,final_label\n a ,1\nb,-1\n")
    (tmp_path / "n.csv").write_text("a,1\nb,2\n")
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("a", "1"), ("b", "-1")]
    assert readers.read_labels(spark, str(tmp_path / "n.csv")).count() == 2
    (tmp_path / "frag.tsv").write_text("# c\nchr1\t1\t5\tAA-1\t2\nchr1\t1\n")
    assert [r.barcode for r in readers.read_fragments(spark, str(tmp_path / "frag.tsv")).collect()] == ["AA-1"]
    kb = {"tissue": "Liver", "gene_index": {"A (B)": ["X"]}, "cell_metadata": {"X": {"total_markers": 3, "cancer_type": "Normal"}}}
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    assert tuple(readers.read_knowledge_base(spark, str(tmp_path / "kb.json")).first()) == ("Liver", "X", "A", "B", 3, "Normal")
    keyed = {"Liver": {k: kb[k] for k in ("gene_index", "cell_metadata")}, "Lung": {"gene_index": {"C": ["Y", "Z"]}, "cell_metadata": {}}, "Skin": {"gene_index": {}}}
    (tmp_path / "keyed.json").write_text(json.dumps(keyed, indent=2))
    rows = sorted(tuple(r) for r in readers.read_keyed_knowledge_base(spark, str(tmp_path / "keyed.json")).collect())
    assert rows == [("Liver", "X", "A", "B", 3, "Normal"), ("Lung", "Y", "C", None, 0, "Unknown"), ("Lung", "Z", "C", None, 0, "Unknown")]
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.h5ad")


def test_small_files(spark, tmp_path):
    """Manifest, parameters and newest match go through the cluster's file system, with or without a scheme."""
    folder = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1,), (2,)], "x int")
    want = sinks.write_bundle({"a": df}, folder, {"title": "é"})
    assert readers.read_parameters(f"{folder}/manifest.json", ("rows", "title")) == want and want["rows"] == {"a": 2}
    assert readers.read_parameters(str(tmp_path / "out" / "manifest.json"))["title"] == "é"
    sinks.write_bundle({}, folder, {"title": "b"})
    assert readers.read_parameters(f"{folder}/manifest.json")["title"] == "b"
    with pytest.raises(ValueError, match="lacks"):
        readers.read_parameters(f"{folder}/manifest.json", ("absent",))
    for i, name in enumerate(("net_2.csv", "net_1.csv", "other.csv")):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert readers.newest(f"file://{tmp_path}", "net_*.csv").endswith("/net_1.csv")
    assert readers.newest(str(tmp_path), "*.csv").endswith("/other.csv")
    with pytest.raises(FileNotFoundError):
        readers.newest(str(tmp_path), "*.none")
    sinks.write_multiome(Multiome(*[spark.createDataFrame([("rna", 1)], "modality string, x int")] * 3), f"{folder}/m")
    assert readers.read_any(spark, f"{folder}/m").cells.count() == 1


def test_bundle_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(0, "a")], "iter int, x string")
    assert sinks.write_bundle({"a b": df}, str(tmp_path / "out"))["rows"] == {"a b": 1}
    todo = spark.range(2).select(F.col("id").cast("int").alias("iter"))
    path = str(tmp_path / "it")
    assert sinks.unfinished(todo, path).count() == 2
    sinks.append_iteration(df, path)
    assert [r.iter for r in sinks.unfinished(todo, path).collect()] == [1]


def test_arrivals_are_annotated_once(spark, tmp_path):
    mk = spark.createDataFrame([("Liver", "X", "A", None, 4, "Normal")], "tissue string, cell_type string, gene string, alias string, total_markers int, cancer_type string")
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"query_id": i, "genes": ["A"]}))
        incremental.annotate_arrivals(spark, str(src), mk, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_motif_scan_both_strands(spark):
    pwm = spark.createDataFrame([("M", i, *[0.97 if c == b else 0.01 for b in "ACGT"]) for i, c in enumerate("AACCGGTA")], "tf string, pos int, A double, C double, G double, T double")
    seqs = spark.createDataFrame([("fwd", "TTTAACCGGTATTT"), ("rev", "CCTACCGGTTCC"), ("none", "TTTTTTTTTTTT"), ("short", "AAC")], "peak string, seq string")
    assert sorted(r.peak for r in motif.scan(seqs, pwm).collect()) == ["fwd", "rev"]
