"""A fast subset of the registered queries against their DuckDB oracles."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF001

import __spark_entry__ as E
from oracle_check import compare, duck

FAST = ["select_cluster_cosine", "assemble_triples", "cosine_margin", "rank_in_cluster", "bonus_quota_median",
        "smoothed_quota", "sample_exact", "subsets", "bm25_pairs_corpus", "bm25_margin", "clean_text",
        "take_by_index", "mean_pairwise_cosine", "accept_bulk", "accept_stall", "markov_step", "export_runs",
        "maxsim", "retrieval_report"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert info["ok"], info


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert E.entry(spark).count() >= 0
