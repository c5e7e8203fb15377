import os

import pytest

from tallymark.operators import blocking, solver
from tallymark.plans import registry
from tallymark.plans.recon_queries import base

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_solver_queries_cover_every_payout(spark, tmp_path):
    # whole suppliers' lines, all years
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey % 10 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders, payouts = base(spark, str(tmp_path))
    credits = {r.settlement_id: (r.net_paise, r.settled_on.year) for r in payouts.collect()}
    assert len({year for _, year in credits.values()}) > 5
    pools = {}
    for r in blocking.pools(payouts, orders).collect():
        pools.setdefault(r.settlement_id, []).append((-r.net_paise, r.order_id))
    want = {}
    for i, (credit, _) in credits.items():
        nets = [-n for n, _ in sorted(pools.get(i, []))]
        if len(nets) <= 12:  # all subsets
            fits = sum(0 <= credit - sum(n for k, n in enumerate(nets) if m >> k & 1) <= m.bit_count() for m in range(1, 1 << len(nets)))
            want[i] = "CONTRADICTED" if not fits else "PROVEN" if fits == 1 else "AMBIGUOUS"
        else:
            want[i] = solver.explain(nets, credit)[0]
    got = {r.settlement_id: r.verdict for r in QUERIES["solver_findings"](spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(r.n for r in QUERIES["findings_with_solver"](spark, str(tmp_path)).collect()) == len(credits)
    assert sorted(r.settlement_id for r in QUERIES["reconcile_cascade"](spark, str(tmp_path)).select("settlement_id").collect()) == sorted(credits)
