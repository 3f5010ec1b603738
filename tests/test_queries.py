"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ("role_distribution", "node_degree_features", "clustering_ego", "community_features", "behaviour_features", "burt_constraint", "edge_split", "negative_samples", "edge_shards", "noisy_relations", "relations_view", "incidents_view", "events_tumbling", "betweenness", "load_centrality", "closeness", "eigenvector", "core_numbers", "bridges", "feature_table", "mo_score_v1", "removal_orders", "cv_folds", "separability", "link_auc", "enclosing_subgraphs")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
