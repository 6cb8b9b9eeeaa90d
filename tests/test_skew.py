"""Hot keys: one customer / part / score holding a third of the rows.

The star tables of sf0.001 are copied with a third of the orders moved to one
customer and a third of the line items to one part; the derived customer
table, preparation and responder contrast must still equal the SQL oracle.
Ranking metrics are checked with a third of all scores tied, on the
range-partitioned path.
"""

from __future__ import annotations

import os
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from reachlab.functions.ordered import running_totals
from reachlab.operators import evaluate as E
from reachlab.sources.tables import TABLES
from scripts.oracle_check import _rows

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def skewed_dir():
    out = tempfile.mkdtemp(prefix="reachlab-skew-", dir="/tmp")
    con = duckdb.connect()
    for t in TABLES:
        df = con.execute(f"SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')").df()
        if t == "orders":
            hot = df["o_custkey"].iloc[0]
            df.loc[df.index % 3 == 0, "o_custkey"] = hot
        if t == "lineitem":
            hot = df["l_partkey"].iloc[0]
            df.loc[df.index % 3 == 0, "l_partkey"] = hot
        df.to_parquet(os.path.join(out, f"{t}.parquet"), index=False)
    return out


@pytest.mark.parametrize("name", ["load_campaign", "prep_full", "responder_contrast", "profile_describe",
                                  "roc_auc", "threshold_sweep", "decile_lift", "stratified_split"])
def test_hot_keys_match_oracle(spark, skewed_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    sdf = entry.queries()[name](spark, skewed_dir)
    cur = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(d_cols, cur.fetchall())


def test_hot_customer_is_aggregated(spark, skewed_dir):
    raw = entry.queries()["load_campaign"](spark, skewed_dir)
    assert raw.count() == raw.select("ID").distinct().count()


def test_tied_third_of_scores_on_range_path(spark):
    rng = np.random.default_rng(4)
    n = 6000
    p = np.round(rng.random(n), 3)
    p[: n // 3] = 0.5                                       # a third of all scores tied
    y = (rng.random(n) < 0.2 + 0.5 * p).astype(int)
    pdf = pd.DataFrame({"model": "m", "id": np.arange(n), "label": y, "p": p})
    s = spark.createDataFrame(pdf)
    counts = E.score_counts(s)
    fast = running_totals(counts, ["model"], "p", ["pos", "neg"]).orderBy("p").toPandas()
    ranged = running_totals(counts, ["model"], "p", ["pos", "neg"], rows_per_task=40).orderBy("p").toPandas()
    assert (fast[["cum_pos", "cum_neg"]].to_numpy() == ranged[["cum_pos", "cum_neg"]].to_numpy()).all()
    auc = E.roc_auc(s).first()["roc_auc"]
    pos, neg = p[y == 1], p[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute, abs=1e-6)
