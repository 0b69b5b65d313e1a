"""Registered queries against DuckDB, and the exceptions run."""

import glob
import math
import os

import duckdb
import pytest

from pairspin.plans.queries import ORACLE_SQL, QUERIES

SOME = ["score_di", "filtersim", "subsample_msa", "tempering_swap", "dde", "nsim", "sumsim_weighted", "phylo_weights", "gen_uniform", "tile_seed", "coupling_tensor", "bimarg", "bicounts_weighted", "pc_unijmix", "pre_regularize", "nsim_weighted", "histsim", "minsim", "phylo_neff", "gauge_fieldless_even", "potts_energy", "potts_energy_join", "xijab", "score_fbwsi", "score_rdde", "alphamap_bimarg", "repeat_seqs", "concat_buffers", "reverse_alphamap_j", "best_merge", "unseen_letters", "gen_indep", "subseq_logfreq", "spearman", "reg_l1z", "reg_scadx", "reg_scaddde", "msa_load"]


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_matches_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert mine == sorted(tuple(shown(r[k]) for k in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["reduce_alphabet", "metropolis"])
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("sets, backgrounds", [(4096, 16_384), (9, 70)])
def test_subsequence_logfreq_of_every_row(spark, sf, duck, monkeypatch, sets, backgrounds):
    from pairspin.operators import sampling

    for name, v in (("SETS", sets), ("BACKGROUNDS", backgrounds), ("HELD", 500)):
        monkeypatch.setattr(sampling, name, v)  # one cell, and many
    test_matches_duckdb(spark, sf, duck, "subseq_logfreq")
    got = QUERIES["subseq_logfreq"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() and got.where("logfreq is null").count() == 0


def test_subsequences_that_are_all_different(spark):
    """Twelve marked positions: each set is a row of its own."""
    import numpy as np

    from pairspin.operators import sampling

    rng = np.random.default_rng(2)
    s, j = rng.integers(0, 5, (60, 15)), rng.normal(size=(15, 15, 5, 5)) / 4
    j = (j + j.transpose(1, 0, 3, 2)) / 2
    marked = [0, 1, 2, 3, 5, 6, 8, 9, 10, 12, 13, 14]
    m = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(s)] + [(60, s[0].tolist())], "seq_id long, seq array<int>")
    energy = lambda v: sum(j[x, y, v[x], v[y]] for x in range(15) for y in range(x + 1, 15))
    got = {r.seq_id: r.logfreq for r in sampling.subsequence_logfreq(m, m, marked, j).collect()}
    for k in (0, 7, 59, 60):
        total = 0.0
        for b in [*s, s[0]]:
            changed = b.copy()
            changed[marked] = s[k % 60][marked]
            total += np.exp(energy(b) - energy(changed))
        assert abs(got[k] - np.log(total)) < 1e-9
    assert {r.logfreq for r in sampling.subsequence_logfreq(m, m.limit(0), marked, j).collect()} == {None}


def test_best_merge_of_equal_rounded_costs(spark, tmp_path):
    """Of costs that are equal to six decimals, the SQL takes the smaller letters, not the least last digits."""
    import numpy as np

    spark.createDataFrame([(k, x) for k, x in enumerate((np.random.default_rng(0).normal(size=(20_000, 64)) / 8).tolist())], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    costs = c.execute(ORACLE_SQL["merge_costs"]).fetchall()
    assert sum(x[2] == min(y[2] for y in costs) for x in costs) > 1
    assert [tuple(x) for x in QUERIES["best_merge"](spark, str(tmp_path)).select("a", "b", "cost").collect()] == c.execute(ORACLE_SQL["best_merge"]).fetchall()


def test_every_query_reads_a_table(spark, sf):
    """No plan of a query, before anything runs, is of made-up rows alone (those that run jobs first read tables there)."""
    for name in ("gauge_zeroj", "gauge_zero", "gauge_fieldless", "gauge_fieldless_dist", "gauge_fieldless_even", "gauge_zeroj_fields", "unpack_couplings", "coupling_tensor", "dde", "rdde", "score_fb", "score_rdde"):
        assert QUERIES[name](spark, sf).inputFiles(), name


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
