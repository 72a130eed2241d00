"""Building blocks of the SQL checks: shared CTEs in DuckDB's dialect."""

from __future__ import annotations


def r6(x: str) -> str:
    """Six decimals, with tiny values folded to zero so no sign of zero is left."""
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0::DOUBLE ELSE round(({x})::DOUBLE, 6) END"


CTES: dict[str, tuple[list[str], str]] = {
    "obs": ([], """SELECT o_custkey AS cell_id, l_partkey AS feature_id, l_suppkey AS tf, l_quantity,
        l_discount, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "rna": (["obs"], "SELECT cell_id, feature_id, sum(l_quantity) AS value FROM obs GROUP BY 1, 2"),
    "atac": (["obs"], "SELECT cell_id, feature_id, count(*)::DOUBLE AS value FROM obs GROUP BY 1, 2"),
    "act": (["obs"], """SELECT cell_id, tf AS feature_id, sum(l_quantity * (round(l_discount * 100) - 5)) AS value
        FROM obs GROUP BY 1, 2"""),
    "cells": ([], """SELECT c_custkey AS cell_id, c_name AS name, c_mktsegment AS cell_type, c_acctbal,
        100 * (floor(rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0)
        / count(*) OVER ()) AS trajectory FROM customer"""),
    "features": ([], """SELECT p_partkey AS feature_id, p_name AS symbol, p_brand AS chr,
        p_size::BIGINT * 1000 + p_partkey AS start, p_size::BIGINT * 1000 + p_partkey + 100 AS "end",
        CASE WHEN p_type IN ('SMALL', 'PROMO') THEN '-' ELSE '+' END AS strand, p_type AS kind, p_size FROM part"""),
    "peak_names": (["features"], """SELECT feature_id, 'chr' || p_size || (CASE WHEN kind IN ('LARGE', 'MEDIUM')
        THEN '-' ELSE ':' END) || start || '-' || "end" AS name FROM features"""),
    "motif": ([], "SELECT l_partkey AS peak, l_suppkey AS tf, count(*)::DOUBLE AS score FROM lineitem GROUP BY 1, 2"),
    "bins": (["cells"], """SELECT cell_id, ceil(trajectory)::INT AS bin FROM cells
        WHERE trajectory > 0 AND trajectory <= 100"""),
    "bin_n": (["bins"], "SELECT bin, count(*) AS n FROM bins GROUP BY 1"),
    "grid": ([], "SELECT unnest(range(1, 101))::INT AS bin"),
}


def _raw(name: str, source: str) -> None:
    CTES[f"{name}_m"] = (["bins", "bin_n", source], f"""SELECT feature_id, bin, sum(value) / any_value(n) AS m
        FROM {source} JOIN bins USING (cell_id) JOIN bin_n USING (bin) GROUP BY 1, 2""")
    CTES[f"{name}_raw"] = ([f"{name}_m", "grid"], f"""SELECT f.feature_id, g.bin, coalesce(m.m, 0) AS v
        FROM (SELECT DISTINCT feature_id FROM {name}_m) f CROSS JOIN grid g
        LEFT JOIN {name}_m m ON m.feature_id = f.feature_id AND m.bin = g.bin""")
    CTES[f"{name}_log"] = ([f"{name}_raw"], f"""SELECT feature_id, bin, CASE WHEN (SELECT min(v) FROM {name}_raw) < 0
        THEN v ELSE log2(v / (CASE WHEN t = 0 THEN 1 ELSE t END) * 10000 + 1) END AS v
        FROM (SELECT *, sum(v) OVER (PARTITION BY bin) AS t FROM {name}_raw)""")
    for k in (7, 11):
        left, right = (k - 1) // 2, k - 1 - (k - 1) // 2
        # Interior rows use the full window; border rows copy the nearest full one.
        CTES[f"{name}_s{k}"] = ([f"{name}_log"], f"""SELECT a.feature_id, a.bin, b.w AS v FROM {name}_log a JOIN (
            SELECT feature_id, bin, avg(v) OVER (PARTITION BY feature_id ORDER BY bin
            ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) AS w FROM {name}_log) b
            ON b.feature_id = a.feature_id AND b.bin = greatest({left + 1}, least({100 - right}, a.bin))""")


for _name, _source in (("rna", "rna"), ("atac", "atac"), ("act", "act")):
    _raw(_name, _source)


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: list[str], body: str) -> str:
    """A full statement with every CTE the body depends on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"
