"""Registered queries of the reference's operators, each with the same result in DuckDB SQL where SQL can say it.

Alignment A is ``lineitem`` (6 columns, many equal rows), B is ``embeddings`` (12 columns, few equal rows); see ``sources.fixtures``.
Integers are compared exactly, other numbers to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import rounded as r6
from ..functions.numerics import spearman
from ..functions.storage import scratch
from ..operators import filters, gauge, marginals, mutants, newton, profiling, reduction, sampling, scores, similarity
from ..sources import fixtures as fx
from ..sources import msa as msa_io
from ..streaming.bicounts import streaming_bicounts
from . import infer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
L, Q = fx.B_LENGTH, fx.B_Q
KEY = ["i", "j", "a", "b"]

# ---- shared parts of the SQL side: one WITH list, of which a query names what it needs

_A_LIST = ", ".join(fx.A_LETTERS)
_B_LIST = ", ".join(fx.b_letter(p, "embedding[{} + 1]") for p in range(L))
PARTS: dict[str, tuple[str, list[str]]] = {
    "ma": (f"SELECT [{_A_LIST}] AS seq, count(*) AS mult FROM lineitem GROUP BY ALL", []),
    "mb": (f"SELECT vec_id AS seq_id, [{_B_LIST}] AS seq, (vec_id % 4 + 1) / CAST(4.0 AS DOUBLE) AS w FROM embeddings", []),
    "pa": ("SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j FROM range(6) x(i), range(6) y(j) WHERE x.i < y.j", []),
    "pb": ("SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j FROM range(12) x(i), range(12) y(j) WHERE x.i < y.j", []),
    "lt": ("SELECT CAST(x AS INT) AS x FROM range(4) t(x)", []),
    "ga": ("SELECT i, j, s.x AS a, t.x AS b FROM pa, lt s, lt t", ["pa", "lt"]),
    "gb": ("SELECT i, j, s.x AS a, t.x AS b FROM pb, lt s, lt t", ["pb", "lt"]),
    "ca": ("SELECT i, j, a, b, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ga LEFT JOIN (SELECT i, j, seq[i+1] AS a, seq[j+1] AS b, sum(mult) AS n FROM ma, pa GROUP BY ALL) USING (i, j, a, b)", ["ga", "ma", "pa"]),
    "cb": ("SELECT i, j, a, b, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(w, 0) AS w FROM gb LEFT JOIN (SELECT i, j, seq[i+1] AS a, seq[j+1] AS b, count(*) AS n, sum(w) AS w FROM mb, pb GROUP BY ALL) USING (i, j, a, b)", ["gb", "mb", "pb"]),
    "ffa": ("SELECT i, j, a, b, n / CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS f FROM ca", ["ca"]),
    "ff": ("SELECT i, j, a, b, n / CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS f FROM cb", ["cb"]),
    "fw": ("SELECT i, j, a, b, w / sum(w) OVER (PARTITION BY i, j) AS f FROM cb", ["cb"]),
    "sides": ("SELECT *, sum(f) OVER (PARTITION BY i, j, a) AS fa, sum(f) OVER (PARTITION BY i, j, b) AS fb FROM ff", ["ff"]),
    "sidesa": ("SELECT *, sum(f) OVER (PARTITION BY i, j, a) AS fa, sum(f) OVER (PARTITION BY i, j, b) AS fb FROM ffa", ["ffa"]),
    "jj": ("SELECT i, j, a, b, -(x * t - u * v) * pow(CAST(2 AS DOUBLE), -ceil(log2(t) * 1.5 + 0.1)) AS cpl FROM (SELECT i, j, a, b, CAST(n AS DOUBLE) AS x, CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY i, j, a) AS DOUBLE) AS u, CAST(sum(n) OVER (PARTITION BY i, j, b) AS DOUBLE) AS v FROM cb)", ["cb"]),
    "pos": ("SELECT CAST(p AS INT) AS pos FROM range(12) t(p)", []),
    "cu": ("SELECT pos, x AS res, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM pos CROSS JOIN lt LEFT JOIN (SELECT pos, seq[pos+1] AS x, count(*) AS n FROM mb, pos GROUP BY ALL) USING (pos, x)", ["pos", "lt", "mb"]),
    "hh": ("SELECT pos, res, (t - 4 * n) * pow(CAST(2 AS DOUBLE), -ceil(log2(t) * 0.5 + 0.1)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY pos) AS t FROM cu)", ["cu"]),
    "uni": ("SELECT pos, x AS res, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY pos) AS DOUBLE) AS f FROM pos CROSS JOIN lt LEFT JOIN (SELECT pos, seq[pos+1] AS x, count(*) AS n FROM mb, pos GROUP BY ALL) USING (pos, x)", ["pos", "lt", "mb"]),
    "en": ("SELECT seq_id, sum(cpl) AS e FROM (SELECT seq_id, i, j, seq[i+1] AS a, seq[j+1] AS b FROM mb, pb) JOIN jj USING (i, j, a, b) GROUP BY seq_id", ["mb", "pb", "jj"]),
    "jm": ("SELECT *, avg(cpl) OVER (PARTITION BY i, j, a) AS ma, avg(cpl) OVER (PARTITION BY i, j, b) AS mb_, avg(cpl) OVER (PARTITION BY i, j) AS mm FROM jj", ["jj"]),
    "j0": ("SELECT i, j, a, b, cpl - ma - mb_ + mm AS cpl FROM jm", ["jm"]),
    "hz": ("SELECT pos, res, sum(h) AS h FROM (SELECT pos, res, h FROM hh UNION ALL SELECT i, a, ma FROM jm WHERE b = 0 UNION ALL SELECT j, b, mb_ FROM jm WHERE a = 0 UNION ALL SELECT pos, res, -(SELECT sum(mm) FROM jm WHERE a = 0 AND b = 0) / 12 FROM hh) GROUP BY pos, res", ["hh", "jm"]),
    "hc": ("SELECT pos, res, h - avg(h) OVER (PARTITION BY pos) AS h FROM hz", ["hz"]),
    "xx": ("SELECT *, f - fa * fb AS c, -sum(fa * fb * cpl) OVER (PARTITION BY i, j) + sum(fb * cpl) OVER (PARTITION BY i, j, a) + sum(fa * cpl) OVER (PARTITION BY i, j, b) - cpl AS xab FROM sides JOIN jj USING (i, j, a, b)", ["sides", "jj"]),
    "simb": ("SELECT s.seq_id AS x, t.seq_id AS y, s.w AS wx, t.w AS wy, CAST(list_sum(list_transform(range(1, 13), lambda k: CAST(s.seq[k] = t.seq[k] AS INT))) AS BIGINT) AS sim FROM mb s, mb t", ["mb"]),
    "cyc": ("SELECT p.i, p.j, p.a, p.b, -p.cpl + r.cpl + s.cpl - t.cpl AS dde FROM jj p JOIN jj r ON p.i = r.i AND p.j = r.j AND p.a = r.a AND p.b <> r.b JOIN jj s ON p.i = s.i AND p.j = s.j AND p.b = s.b AND p.a <> s.a JOIN jj t ON p.i = t.i AND p.j = t.j AND t.a = s.a AND t.b = r.b", ["jj"]),
    # a Newton step: model marginals ff, target fw, change 0 after one update
    "st": ("SELECT ff.i, ff.j, ff.a, ff.b, ff.f, jj.cpl, -CAST(0.01 AS DOUBLE) * (fw.f - ff.f) / (ff.f + CAST(0.001 AS DOUBLE)) AS dj FROM ff JOIN fw USING (i, j, a, b) JOIN jj USING (i, j, a, b)", ["ff", "fw", "jj"]),
    "sz": ("SELECT *, v - avg(v) OVER (PARTITION BY i, j, a) - avg(v) OVER (PARTITION BY i, j, b) + avg(v) OVER (PARTITION BY i, j) AS z, CAST(0.01 AS DOUBLE) / (f + CAST(0.001 AS DOUBLE)) AS k FROM (SELECT *, cpl + dj AS v FROM st)", ["st"]),
    "sx": ("""SELECT *, sum(v * c) OVER (PARTITION BY i, j) AS x, sum(c * c / (f + CAST(0.001 AS DOUBLE))) OVER (PARTITION BY i, j) AS nx,
      sum(v * fa * fb) OVER (PARTITION BY i, j) - sum(v * fb) OVER (PARTITION BY i, j, a) - sum(v * fa) OVER (PARTITION BY i, j, b) + v AS xab FROM (
      SELECT *, f - fa * fb AS c FROM (SELECT *, sum(f) OVER (PARTITION BY i, j, a) AS fa, sum(f) OVER (PARTITION BY i, j, b) AS fb FROM sz))""", ["sz"]),
    "scy": ("SELECT p.i, p.j, p.a, p.b, p.v - r.v - s.v + t.v AS dde FROM sz p JOIN sz r ON p.i = r.i AND p.j = r.j AND p.a = r.a AND p.b <> r.b JOIN sz s ON p.i = s.i AND p.j = s.j AND p.b = s.b AND p.a <> s.a JOIN sz t ON p.i = t.i AND p.j = t.j AND t.a = s.a AND t.b = r.b", ["sz"]),
}


def sql(body: str, *needs: str) -> str:
    """``body`` under a WITH list of the named parts and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][1]:
            add(other)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][0]})" for n in order) + "\n" + body


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def values(df: DataFrame, *columns: str) -> DataFrame:
    """Key columns as they are, ``columns`` to six decimals."""
    return df.select(*(r6(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def r(e: str) -> str:
    return f"round(({e}) * CAST(1.000000001 AS DOUBLE), 6) + 0.0"


def msa_b(s: SparkSession, d: str) -> DataFrame:
    return fx.msa_b(s, d)


def ff_b(s: SparkSession, d: str) -> DataFrame:
    return marginals.bimarg(fx.msa_b(s, d), L, Q, compress=False)


def fw_b(s: SparkSession, d: str) -> DataFrame:
    return marginals.bimarg(fx.msa_b(s, d), L, Q, "w", compress=False)


def ff_a(s: SparkSession, d: str) -> DataFrame:
    return marginals.bimarg(fx.msa_a(s, d), fx.A_LENGTH, fx.A_Q)


def jj(s: SparkSession, d: str) -> DataFrame:
    """Couplings of B's covariances."""
    return fx.table_couplings(marginals.bicounts(msa_b(s, d), L, Q, compress=False))


def hh(s: SparkSession, d: str) -> DataFrame:
    """Fields of B's counts."""
    return fx.table_fields(marginals.unicounts(msa_b(s, d), L, Q))


# ---- counts and marginals

query("bicounts", sql("SELECT i, j, a, b, n FROM ca", "ca"))(lambda s, d: marginals.bicounts(fx.msa_a(s, d), fx.A_LENGTH, fx.A_Q))
query("bimarg", sql(f"SELECT i, j, a, b, {r('f')} AS f FROM ffa", "ffa"))(lambda s, d: values(ff_a(s, d), "f"))
query("bicounts_b", sql("SELECT i, j, a, b, n FROM cb", "cb"))(lambda s, d: marginals.bicounts(msa_b(s, d), L, Q, compress=False))
query("bimarg_weighted", sql(f"SELECT i, j, a, b, {r('f')} AS f FROM fw", "fw"))(lambda s, d: values(fw_b(s, d), "f"))
query("bicounts_weighted", sql(f"SELECT i, j, a, b, {r('w')} AS n FROM cb", "cb"))(lambda s, d: values(marginals.bicounts(msa_b(s, d), L, Q, "w", False), "n"))
query("unimarg", sql(f"SELECT pos, res, {r('f')} AS f FROM uni", "uni"))(lambda s, d: values(marginals.unimarg(msa_b(s, d), L, Q), "f"))
query("unicounts", sql("SELECT CAST(pos AS INT) AS pos, x AS res, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT pos, x FROM pos, lt WHERE pos < 6) LEFT JOIN (SELECT pos, seq[pos+1] AS x, sum(mult) AS n FROM ma, pos WHERE pos < 6 GROUP BY ALL) USING (pos, x)", "pos", "lt", "ma"))(
    lambda s, d: marginals.unicounts(fx.msa_a(s, d), fx.A_LENGTH, fx.A_Q)
)
query("unimarg_weighted", sql(f"SELECT pos, x AS res, {r('coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY pos)')} AS f FROM (SELECT pos, x FROM pos, lt) LEFT JOIN (SELECT pos, seq[pos+1] AS x, sum(w) AS w FROM mb, pos GROUP BY ALL) USING (pos, x)", "pos", "lt", "mb"))(
    lambda s, d: values(marginals.unimarg(msa_b(s, d), L, Q, "w"), "f")
)
query("bimarg_to_unimarg", sql(f"SELECT 0 AS pos, a AS res, {r('sum(f)')} AS f FROM ffa WHERE i = 0 AND j = 1 GROUP BY a UNION ALL SELECT j, b, {r('sum(f)')} FROM ffa WHERE i = 0 GROUP BY j, b", "ffa"))(lambda s, d: values(marginals.to_unimarg(ff_a(s, d)), "f"))
query("indep_bimarg", sql(f"SELECT i, j, a, b, {r('fa * fb')} AS f FROM sidesa", "sidesa"))(lambda s, d: values(marginals.independent(ff_a(s, d)), "f"))
query("cov_rho", sql(f"SELECT i, j, a, b, {r('f - fa * fb')} AS c, CASE WHEN fa * (1 - fa) * fb * (1 - fb) > 1e-12 THEN {r('(f - fa * fb) / sqrt(fa * (1 - fa) * fb * (1 - fb))')} END AS rho FROM sides", "sides"))(lambda s, d: values(marginals.covariance(ff_b(s, d)), "c", "rho"))
query("merge_bicounts", sql("SELECT i, j, a, b, 2 * n AS n FROM ca", "ca"))(lambda s, d: (lambda c: marginals.merge_bicounts(c, c))(marginals.bicounts(fx.msa_a(s, d), fx.A_LENGTH, fx.A_Q)))
query("merge_bimargs", sql(f"SELECT i, j, a, b, {r('(ff.f + fw.f) / 2')} AS f FROM ff JOIN fw USING (i, j, a, b)", "ff", "fw"))(lambda s, d: values(marginals.merge_bimargs(ff_b(s, d), fw_b(s, d)), "f"))
query("validate_bimarg", sql("SELECT CAST(0 AS BIGINT) AS out_of_range, CAST(count(*) FILTER (f = 0) AS BIGINT) AS zeros, CAST(0 AS BIGINT) AS bad_pairs, CAST(0 AS DOUBLE) AS max_diff, true AS consistent FROM ffa", "ffa"))(lambda s, d: values(marginals.validation(ff_a(s, d)), "max_diff"))
query("square_matrix", sql(f"SELECT i, j, {r('c')} AS score FROM (SELECT i, j, sum(abs(f - fa * fb)) / 2 AS c FROM sides GROUP BY i, j) UNION ALL SELECT j, i, {r('c')} FROM (SELECT i, j, sum(abs(f - fa * fb)) / 2 AS c FROM sides GROUP BY i, j) UNION ALL SELECT pos, pos, CAST(0 AS DOUBLE) FROM pos", "sides", "pos"))(
    lambda s, d: values(marginals.square(scores.score("TVDC", ff_b(s, d), None, Q), L), "score")
)
query("kl", sql(f"SELECT {r('sum(CASE WHEN ff.f > 0 THEN ff.f * ln(ff.f / fw.f) ELSE 0 END)')} AS kl FROM ff JOIN fw USING (i, j, a, b)", "ff", "fw"))(lambda s, d: values(marginals.kl(ff_b(s, d), fw_b(s, d)), "kl"))
query("neff_kish", sql(f"SELECT {r('sum(w)')} AS sum_w, {r('sum(w * w)')} AS sum_w2, {r('sum(w) * sum(w) / sum(w * w)')} AS neff FROM mb", "mb"))(lambda s, d: values(marginals.effective_size(msa_b(s, d)), "sum_w", "sum_w2", "neff"))
query("bimarg_stats", sql(f"SELECT {r('avg(CASE WHEN t.f > 0.01 THEN abs(t.f - m.f) / t.f END)')} AS ferr, {r('sum((t.f - m.f) * (t.f - m.f))')} AS ssr, {r('max(abs(t.f - m.f))')} AS max_diff FROM fw t JOIN ff m USING (i, j, a, b)", "fw", "ff"))(
    lambda s, d: values(marginals.fit_stats(fw_b(s, d), ff_b(s, d)), "ferr", "ssr", "max_diff")
)
query("expected_error", sql(f"SELECT {r('sum(f * (1 - f) / 1000.0)')} AS ssr, {r('avg(CASE WHEN f > 0.01 THEN sqrt(2 / pi()) * sqrt(f * (1 - f) / 1000.0) / f END)')} AS ferr FROM ff", "ff"))(lambda s, d: values(marginals.expected_error(ff_b(s, d), 1000.0), "ssr", "ferr"))

# ---- pseudocounts

MU = {"jeffreys": "(4 / (2 * CAST(500.0 AS DOUBLE) + 4))", "bayes": "(4 / (CAST(500.0 AS DOUBLE) + 4))"}
for _mode, _mu in MU.items():
    _g = f"((1 - {_mu}) * (1 - {_mu}) * f + (1 - {_mu}) * {_mu} * (fa + fb) / 4 + ({_mu} / 4) * ({_mu} / 4))"
    query(f"pc_{_mode}", sql(f"SELECT i, j, a, b, {r(f'{_g} / sum({_g}) OVER (PARTITION BY i, j)')} AS f FROM sidesa", "sidesa"))(lambda s, d, m=_mode: values(marginals.pc_mutation(ff_a(s, d), 500.0, 4, m), "f"))
query("pc_constant", sql(f"SELECT i, j, a, b, {r('(f + 0.01) / sum(f + 0.01) OVER (PARTITION BY i, j)')} AS f FROM ffa", "ffa"))(lambda s, d: values(marginals.pc_constant(ff_a(s, d), 0.01), "f"))
_u = "(0.75 * f + 0.25 * ((fa + 0.01) / 1.04) * ((fb + 0.01) / 1.04))"
query("pc_unijmix", sql(f"SELECT i, j, a, b, {r(f'{_u} / sum({_u}) OVER (PARTITION BY i, j)')} AS f FROM sidesa", "sidesa"))(lambda s, d: values(marginals.pc_unijmix(ff_a(s, d), 0.01, 0.25, 4), "f"))
query("pc_meanfield", sql(f"SELECT i, j, a, b, {r('(f + 0.2 / 0.8 / 16) / sum(f + 0.2 / 0.8 / 16) OVER (PARTITION BY i, j)')} AS f FROM ffa", "ffa"))(lambda s, d: values(marginals.pc_meanfield(ff_a(s, d), 0.2, 4), "f"))
_z = lambda c: f"((({c} + 0.01) / 1.04 - 0.75 * {c}) / 0.25)"
_t = f"(0.75 * f + 0.25 * {_z('fa')} * {_z('fb')})"
query("pc_test", sql(f"SELECT i, j, a, b, {r(f'{_t} / sum({_t}) OVER (PARTITION BY i, j)')} AS f FROM sidesa", "sidesa"))(lambda s, d: values(marginals.pc_test(ff_a(s, d), 0.01, 0.25, 4), "f"))
query(
    "pre_regularize",
    sql(
        f"""SELECT i, j, a, b, {r('(1 - lam) * f + lam * fa * fb')} AS f, {r('lam')} AS lam FROM sides JOIN (
  SELECT i, j, coalesce(max(CASE WHEN kl < bound THEN lam END), 0) AS lam FROM (
    SELECT i, j, lam, sum(CASE WHEN f > 0 THEN f * ln(f / g) ELSE 0 END) AS kl,
      sum(CASE WHEN g > 0 THEN g * (ln(fp / g) - (499.0 / 500000) * g * (1 - g) / (fp * fp)) ELSE 0 END) AS bound
    FROM (SELECT *, g + (1 - g) / 500.0 AS fp FROM (SELECT i, j, f, lam, (1 - lam) * f + lam * fa * fb AS g FROM sides, (SELECT k / CAST(99.0 AS DOUBLE) AS lam FROM range(100) t(k)))) GROUP BY i, j, lam) GROUP BY i, j) USING (i, j)""",
        "sides",
    ),
)(lambda s, d: values(marginals.pre_regularize(ff_b(s, d), 500.0), "f", "lam"))

# ---- similarity

for _name, _e in (("nsim", "count(*) FILTER (12 - sim < 6)"), ("nsim_weighted", "sum(wy) FILTER (12 - sim < 6)"), ("sumsim", "sum(sim) - 12"), ("sumsim_weighted", "sum(wx * wy * sim) - 12 * any_value(wx * wx)")):
    ORACLE_SQL[_name] = sql(f"SELECT CAST(x AS VARCHAR) AS key, {r(f'CAST({_e} AS DOUBLE)')} AS {'n' if _name[0] == 'n' else 'total'} FROM simb GROUP BY x", "simb")
QUERIES["nsim"] = lambda s, d: values(similarity.n_similar(similarity.single(msa_b(s, d)), L, Q, 6, "index"), "n")
QUERIES["nsim_weighted"] = lambda s, d: values(similarity.n_similar(similarity.single(msa_b(s, d), "w"), L, Q, 6, "index"), "n")
QUERIES["sumsim"] = lambda s, d: values(similarity.sum_similarity(similarity.single(msa_b(s, d)), L, Q), "total")
QUERIES["sumsim_weighted"] = lambda s, d: values(similarity.sum_similarity(similarity.single(msa_b(s, d), "w"), L, Q, True), "total")
_H = "SELECT CAST(k AS INT) AS sim, {v} AS n FROM range(13) t(k) LEFT JOIN (SELECT CASE WHEN x = y THEN 12 ELSE sim END AS k, sum({p}) AS n FROM simb WHERE x <= y GROUP BY 1) USING (k)"
query("histsim", sql(_H.format(v=r("CAST(coalesce(n, 0) AS DOUBLE)"), p="1"), "simb"))(lambda s, d: values(similarity.similarity_histogram(similarity.single(msa_b(s, d)), L, Q), "n"))
query("histsim_weighted", sql(_H.format(v=r("CAST(coalesce(n, 0) AS DOUBLE)"), p="wx * wy"), "simb"))(lambda s, d: values(similarity.similarity_histogram(similarity.single(msa_b(s, d), "w"), L, Q), "n"))
query("minsim", sql("SELECT CAST(x AS VARCHAR) AS key, min(sim) AS least FROM simb WHERE x <> y GROUP BY x", "simb"))(lambda s, d: similarity.least_similarity(similarity.single(msa_b(s, d)), L, Q).select("key", "least"))
query("phylo_weights", sql(f"SELECT CAST(x AS VARCHAR) AS key, {r('1 / CAST(count(*) FILTER (12 - sim < 5) AS DOUBLE)')} AS weight FROM simb GROUP BY x", "simb"))(lambda s, d: values(similarity.phylo_weights(similarity.single(msa_b(s, d)), L, Q, "0.4"), "weight"))
_SA = "SELECT s.mult AS m, sum(t.mult) AS n FROM ma s JOIN ma t ON 6 - list_sum(list_transform(range(1, 7), lambda k: CAST(s.seq[k] = t.seq[k] AS INT))) < 2 GROUP BY s.seq, s.mult"
query("phylo_neff", sql(f"SELECT {r('sum(m / CAST(n AS DOUBLE))')} AS neff FROM ({_SA})", "ma"))(lambda s, d: values(similarity.effective_number(similarity.grouped(fx.msa_a(s, d)), fx.A_LENGTH, fx.A_Q, "m1"), "neff"))
#: The greedy filter said one row at a time: the next row that no kept row is near to.  {o} orders the rows, {c} is the cutoff
_GREEDY = """, near AS (SELECT s.o, list(t.o) AS near FROM ranked s JOIN ranked t ON t.o < s.o JOIN simb ON simb.x = s.seq_id AND simb.y = t.seq_id WHERE 12 - sim < {c} GROUP BY s.o),
kept(last, rows) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o, list_append(rows, o) FROM (SELECT min(r.o) AS o, any_value(k.rows) AS rows FROM kept k JOIN ranked r ON r.o > k.last LEFT JOIN near n ON n.o = r.o WHERE n.near IS NULL OR NOT list_has_any(k.rows, n.near)) WHERE o IS NOT NULL)"""


def greedy(order: str, cutoff: int, columns: str) -> str:
    out = sql(f"SELECT {columns} FROM ranked WHERE o IN (SELECT last FROM kept)", "simb").replace("WITH ", "WITH RECURSIVE ", 1)
    at = out.rindex("\nSELECT")
    return out[:at] + f",\nranked AS (SELECT seq_id, seq, row_number() OVER (ORDER BY {order}) AS o FROM mb)" + _GREEDY.format(c=cutoff) + out[at:]


query("filtersim", greedy("seq_id", 6, "seq_id, array_to_string(seq, '') AS seq"))(lambda s, d: _text(similarity.filter_similar(msa_b(s, d), L, Q, 6)))
query("subsample_msa", greedy("left(md5('1:' || seq_id), 8), seq_id", 6, "seq_id, array_to_string(seq, '') AS seq, CAST('0x' || left(md5('2:' || seq_id), 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS place"))(
    lambda s, d: similarity.subsample(msa_b(s, d), L, Q, 0.5, 1).select("seq_id", F.concat_ws("", F.col("seq").cast("array<string>")).alias("seq"), "place")
)

# ---- gauges

query("gauge_zeroj", sql(f"SELECT i, j, a, b, {r('cpl')} AS cpl FROM j0", "j0"))(lambda s, d: values(gauge.zero_couplings(jj(s, d)).select(*KEY, "cpl"), "cpl"))
query("gauge_zeroj_fields", sql(f"SELECT pos, res, {r('h')} AS h FROM hz", "hz"))(lambda s, d: values(gauge.zero_j(hh(s, d), jj(s, d), L)[0], "h"))
query("gauge_zero", sql(f"SELECT pos, res, {r('h')} AS h FROM hc", "hc"))(lambda s, d: values(gauge.zero(hh(s, d), jj(s, d), L)[0], "h"))
_wz = "cpl - sum(cpl * f) OVER (PARTITION BY i, j, a) / sum(f) OVER (PARTITION BY i, j, a) - sum(cpl * f) OVER (PARTITION BY i, j, b) / sum(f) OVER (PARTITION BY i, j, b) + sum(cpl * f) OVER (PARTITION BY i, j) / sum(f) OVER (PARTITION BY i, j)"
query("gauge_zeroj_weighted", sql(f"SELECT i, j, a, b, {r(_wz)} AS cpl FROM jj JOIN ff USING (i, j, a, b)", "jj", "ff"))(lambda s, d: values(gauge.zero_couplings(scores.both(ff_b(s, d), jj(s, d)), "f").select(*KEY, "cpl"), "cpl"))
_FD = "SELECT i, j, a, b, {v} AS cpl FROM {j} j JOIN {h} x ON x.pos = i AND x.res = a JOIN {h} y ON y.pos = j AND y.res = b"
query("gauge_fieldless_dist", sql(_FD.format(v=r("cpl + (x.h + y.h) / 11"), j="jj", h="hh"), "jj", "hh"))(lambda s, d: values(gauge.fieldless_distributed(hh(s, d), jj(s, d), L), "cpl"))
query("gauge_fieldless", sql(_FD.format(v=r("cpl + CASE WHEN i = 0 THEN y.h + CASE WHEN j = 1 THEN x.h ELSE 0 END ELSE 0 END"), j="jj", h="hh"), "jj", "hh"))(lambda s, d: values(gauge.fieldless(hh(s, d), jj(s, d)), "cpl"))
query("gauge_fieldless_even", sql(_FD.format(v=r("cpl + (x.h + y.h) / 11"), j="j0", h="hc"), "j0", "hc"))(lambda s, d: values(gauge.fieldless_even(hh(s, d), jj(s, d), L), "cpl"))
query("unpack_couplings", sql(f"SELECT i, j, a, b, {r('cpl')} AS cpl FROM jj UNION ALL SELECT j, i, b, a, {r('cpl')} FROM jj", "jj"))(lambda s, d: values(gauge.unpacked(jj(s, d)), "cpl"))
query("coupling_tensor", sql(f"SELECT i, j, a, b, {r('cpl')} AS cpl FROM jj UNION ALL SELECT j, i, b, a, {r('cpl')} FROM jj UNION ALL SELECT pos, pos, s.x, t.x, NULL FROM pos, lt s, lt t", "jj", "pos", "lt"))(lambda s, d: values(gauge.tensor(jj(s, d), L, Q), "cpl"))
_IH = "SELECT pos, res, -ln(f) - avg(-ln(f)) OVER (PARTITION BY pos) AS h FROM uni"
query("init_couplings", sql(f"SELECT i, j, a, b, {r('(x.h + y.h) / 11')} AS cpl FROM gb JOIN ({_IH}) x ON x.pos = i AND x.res = a JOIN ({_IH}) y ON y.pos = j AND y.res = b", "gb", "uni"))(
    lambda s, d: values(gauge.independent_model(marginals.unimarg(msa_b(s, d), L, Q), jj(s, d).withColumn("cpl", F.lit(0.0)), L), "cpl")
)

# ---- energies and scores

query("potts_energy", sql(f"SELECT seq_id, {r('e')} AS e FROM en", "en"))(lambda s, d: values(scores.energies(msa_b(s, d), jj(s, d), L, Q), "e"))
query("potts_energy_join", sql(f"SELECT seq_id, {r('e')} AS e FROM en", "en"))(lambda s, d: values(scores.energies(msa_b(s, d), jj(s, d), L, Q, "join"), "e"))
query("energy_terms", sql(f"SELECT seq_id, i, j, {r('cpl')} AS e FROM (SELECT seq_id, i, j, seq[i+1] AS a, seq[j+1] AS b FROM mb, pb) JOIN jj USING (i, j, a, b)", "mb", "pb", "jj"))(lambda s, d: values(scores.energy_terms(msa_b(s, d), jj(s, d), L), "e"))
query("indep_energy", sql(f"SELECT seq_id, {r('sum(h)')} AS e FROM (SELECT seq_id, pos, seq[pos+1] AS res FROM mb, pos) JOIN hh USING (pos, res) GROUP BY seq_id", "mb", "pos", "hh"))(lambda s, d: values(scores.independent_energies(msa_b(s, d), hh(s, d)), "e"))
query("delta_energy", sql(f"SELECT seq_id, {r('sum(n.cpl - o.cpl)')} AS de FROM mb, pos JOIN (SELECT * FROM jj UNION ALL SELECT j, i, b, a, cpl FROM jj) n ON n.i = 3 AND n.j = pos AND n.a = 2 AND n.b = seq[pos+1] JOIN (SELECT * FROM jj UNION ALL SELECT j, i, b, a, cpl FROM jj) o ON o.i = 3 AND o.j = pos AND o.a = seq[4] AND o.b = seq[pos+1] WHERE pos <> 3 GROUP BY seq_id", "mb", "pos", "jj"))(
    lambda s, d: values(scores.energy_changes(msa_b(s, d), jj(s, d), 3, 2), "de")
)
query("energy_summary", sql(f"SELECT {r('min(e)')} AS min_e, {r('avg(e)')} AS mean_e, {r('stddev_pop(e)')} AS std_e FROM en", "en"))(lambda s, d: values(scores.energy_summary(scores.energies(msa_b(s, d), jj(s, d), L, Q)), "min_e", "mean_e", "std_e"))
query("min_ref_energy", sql(f"SELECT {r('least(0, min(e))')} AS ref FROM en", "en"))(lambda s, d: scores.energies(msa_b(s, d), jj(s, d), L, Q).agg(r6(F.least(F.lit(0.0), F.min("e"))).alias("ref")))
query("predict_neff", sql(f"SELECT {r('sum(exp(l - m)) * sum(exp(l - m)) / sum(exp(2 * (l - m)))')} AS neff FROM (SELECT l, max(l) OVER () AS m FROM (SELECT -(1 - 0.9) * (e - (0.8 - 0.9) * var_pop(e) OVER ()) AS l FROM en))", "en"))(
    lambda s, d: values(newton.predicted_size(scores.energies(msa_b(s, d), jj(s, d), L, Q), 0.9, 0.8), "neff")
)
query("xij", sql(f"SELECT i, j, {r('-sum(c * cpl)')} AS score FROM xx GROUP BY i, j", "xx"))(lambda s, d: values(scores.xij(ff_b(s, d), jj(s, d)), "score"))
query("xijab", sql(f"SELECT i, j, a, b, {r('xab')} AS xab FROM xx", "xx"))(lambda s, d: values(scores.xijab(ff_b(s, d), jj(s, d)), "xab"))
query("total_x", sql(f"SELECT {r('sum(c * cpl)')} AS x FROM xx", "xx"))(lambda s, d: values(scores.total_x(ff_b(s, d), jj(s, d)), "x"))
_SEQ = [0, 1, 2, 3] * 3
query("xij_for_seq", sql(f"SELECT i, j, {r('xab')} AS xab, {r('xab - x')} AS excess FROM (SELECT *, -sum(c * cpl) OVER (PARTITION BY i, j) AS x FROM xx) WHERE a = i % 4 AND b = j % 4", "xx"))(lambda s, d: values(scores.xab_of_sequence(ff_b(s, d), jj(s, d), _SEQ), "xab", "excess"))
query("dde", sql(f"SELECT i, j, a, b, {r('sum(abs(dde))')} AS total, CAST(count(*) AS BIGINT) AS n FROM cyc GROUP BY ALL", "cyc"))(lambda s, d: mutants.mutant_sums(jj(s, d), Q).select(*KEY, r6("size").alias("total"), F.lit((Q - 1) ** 2).cast("long").alias("n")))
query("rdde", sql(f"SELECT i, j, a, b, {r('sum(sign(-dde)) / CAST(9.0 AS DOUBLE)')} AS grad FROM cyc GROUP BY ALL", "cyc"))(lambda s, d: values(scores.rdde(jj(s, d), Q)[1], "grad"))
_S = "SELECT i, j, {e} AS score FROM {t} GROUP BY i, j"
_SCORES = {
    "MI": ("sum(CASE WHEN f > 0 THEN f * ln(f / (fa * fb)) ELSE 0 END)", "sides"),
    "maxC": ("max(abs(f - fa * fb))", "sides"),
    "TVDC": ("0.5 * sum(abs(f - fa * fb))", "sides"),
    "fb": ("sqrt(sum(cpl * cpl))", "j0"),
    "Xij": ("-sum(c * cpl)", "xx"),
    "absXij": ("sum(abs(xab))", "xx"),
    "absfXij": ("sum(abs(f * xab))", "xx"),
    "RddE": ("sum(abs(dde)) / 36", "cyc"),
}
for _n, (_e, _p) in _SCORES.items():
    query(f"score_{_n.lower()}", sql(_S.format(e=r(_e), t=_p), _p))(lambda s, d, n=_n: values(scores.score(n, ff_b(s, d), jj(s, d), Q), "score"))
for _n, _e in {"fbw": "f", "fbwsqrt": "sqrt(f)", "fbwsi": "sqrt(fa * fb)", "fbwexp": "1 - exp(-4 * f)"}.items():
    _m = lambda by: f"sum(cpl * w) OVER (PARTITION BY {by}) / sum(w) OVER (PARTITION BY {by})"
    _b = f"SELECT i, j, w * (cpl - {_m('i, j, a')} - {_m('i, j, b')} + {_m('i, j')}) AS v FROM (SELECT i, j, a, b, cpl, {_e} AS w FROM xx)"
    query(f"score_{_n}", sql(f"SELECT i, j, {r('sqrt(sum(v * v))')} AS score FROM ({_b}) GROUP BY i, j", "xx"))(lambda s, d, n=_n: values(scores.score(n, ff_b(s, d), jj(s, d), Q), "score"))
# fields by 400 turns of one pair's lists
_DOT = "list_sum(list_transform(range(1, 5), lambda k: {x} * {y}))"
_DI = f"""di AS (SELECT w.i, w.j, w.w, fi.f AS fi, fj.f AS fj FROM (SELECT i, j, list(w ORDER BY a) AS w FROM (SELECT i, j, a, list(exp(-cpl) ORDER BY b) AS w FROM j0 GROUP BY i, j, a) GROUP BY i, j) w
  JOIN (SELECT pos, list(f ORDER BY res) AS f FROM uni GROUP BY pos) fi ON fi.pos = i JOIN (SELECT pos, list(f ORDER BY res) AS f FROM uni GROUP BY pos) fj ON fj.pos = j),
turn(n, i, j, w, fi, fj, gx, gy) AS (SELECT 0, i, j, w, fi, fj, fi, [CAST(1 AS DOUBLE), 1, 1, 1] FROM di UNION ALL
  SELECT n + 1, i, j, w, fi, fj, x, list_transform(range(1, 5), lambda b: fj[b] / {_DOT.format(x='w[k][b]', y='x[k]')}) FROM (
    SELECT n, i, j, w, fi, fj, list_transform(range(1, 5), lambda a: fi[a] / {_DOT.format(x='w[a][k]', y='gy[k]')}) AS x FROM turn WHERE n < 400)),
p AS (SELECT i, j, fi[a.x + 1] * fj[b.x + 1] AS g, w[a.x + 1][b.x + 1] * gx[a.x + 1] * gy[b.x + 1] AS p FROM turn, lt a, lt b WHERE n = 400)"""
query("score_di", sql(f"SELECT i, j, {r('sum(p / t * ln(p / t / g))')} AS score, true AS converged FROM (SELECT *, sum(p) OVER (PARTITION BY i, j) AS t FROM p) GROUP BY i, j", "j0", "uni", "lt").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT", f",\n{_DI}\nSELECT", 1))(
    lambda s, d: values(scores.direct_information(ff_b(s, d), jj(s, d), Q), "score")
)

# ---- filters and alphabets

query("gap_filter_cols", sql(f"SELECT pos, {r('avg(CAST(seq[pos+1] = 0 AS INT))')} AS gap_fraction FROM mb, pos GROUP BY pos HAVING avg(CAST(seq[pos+1] = 0 AS INT)) < 0.25", "mb", "pos"))(
    lambda s, d: values(filters.gap_fractions(msa_b(s, d), L).where("gap_fraction < 0.25"), "gap_fraction")
)
query("gap_filter_rows", sql("SELECT seq_id, array_to_string(seq, '') AS seq FROM mb WHERE len(list_filter(seq, lambda x: x = 0)) / CAST(12.0 AS DOUBLE) < 0.2", "mb"))(lambda s, d: _text(filters.drop_gapped_rows(msa_b(s, d), L, 0.2)))
query("select_columns", sql("SELECT seq_id, array_to_string([seq[1], seq[4], seq[12]], '') AS seq FROM mb", "mb"))(lambda s, d: _text(filters.select_columns(msa_b(s, d), [0, 3, 11])))
query("repeat_seqs", sql("SELECT seq_id, copy, seq FROM (SELECT seq_id, CAST(k AS INT) AS copy, array_to_string(seq, '') AS seq, row_number() OVER (ORDER BY seq_id, k) AS n FROM mb, range((SELECT CAST(ceil((2.0 * count(*) + 3) / greatest(count(*), 1)) AS BIGINT) FROM mb)) t(k)) WHERE n <= (SELECT 2 * count(*) + 3 FROM mb)", "mb"))(
    lambda s, d: (lambda m, n: filters.repeated(m, 2 * n + 3, n).select("seq_id", "copy", F.concat_ws("", F.col("seq").cast("array<string>")).alias("seq")))(msa_b(s, d), msa_b(s, d).count())
)
query("copy_subseq", sql("SELECT seq_id, array_to_string(list_transform(seq, lambda x, p: CASE WHEN p IN (2, 6) THEN (p - 1) % 4 ELSE x END), '') AS seq FROM mb", "mb"))(lambda s, d: _text(filters.with_subsequence(msa_b(s, d), _SEQ, [1, 5])))
_GROUPS = [[[0, 1], [2], [3]] if p % 2 == 0 else [[0], [1, 2, 3]] for p in range(L)]
_MAP = "CASE WHEN {p} % 2 = 0 THEN CASE WHEN {x} < 2 THEN 0 WHEN {x} = 2 THEN 1 ELSE 2 END ELSE CASE WHEN {x} = 0 THEN 0 ELSE 1 END END"
query("alphamap_seqs", sql(f"SELECT seq_id, array_to_string(list_transform(seq, lambda x, p: {_MAP.format(p='(p - 1)', x='x')}), '') AS seq FROM mb", "mb"))(lambda s, d: _text(filters.mapped_sequences(msa_b(s, d), _GROUPS, Q)))
query("alphamap_bimarg", sql(f"SELECT i, j, {_MAP.format(p='i', x='a')} AS a, {_MAP.format(p='j', x='b')} AS b, {r('sum(f)')} AS f FROM ff GROUP BY ALL", "ff"))(lambda s, d: values(filters.mapped_bimarg(ff_b(s, d), _GROUPS, Q), "f"))
_RH = "SELECT pos, res, h - avg(h) OVER (PARTITION BY pos) AS h FROM hq"
_RJ = f"SELECT g.i, g.j, g.a, g.b, jj.cpl FROM gb g JOIN jj ON jj.i = g.i AND jj.j = g.j AND jj.a = {_MAP.format(p='g.i', x='g.a')} AND jj.b = {_MAP.format(p='g.j', x='g.b')}"
query(
    "reverse_alphamap_j",
    sql(
        f"""SELECT j.i, j.j, j.a, j.b, {r('j.cpl - ma - mb_ + mm + (x.h + y.h) / 11')} AS cpl FROM
 (SELECT *, avg(cpl) OVER (PARTITION BY i, j, a) AS ma, avg(cpl) OVER (PARTITION BY i, j, b) AS mb_, avg(cpl) OVER (PARTITION BY i, j) AS mm FROM ({_RJ})) j
 JOIN (WITH rj AS ({_RJ}), rm AS (SELECT *, avg(cpl) OVER (PARTITION BY i, j, a) AS ma, avg(cpl) OVER (PARTITION BY i, j, b) AS mb_ FROM rj),
   h0 AS (SELECT pos, res, -ln(f / sum(f) OVER (PARTITION BY pos, {_MAP.format(p='pos', x='res')})) AS h FROM uni),
   hq AS (SELECT pos, res, sum(h) AS h FROM (SELECT * FROM h0 UNION ALL SELECT i, a, ma FROM rm WHERE b = 0 UNION ALL SELECT j, b, mb_ FROM rm WHERE a = 0) GROUP BY pos, res) {_RH}) x ON x.pos = j.i AND x.res = j.a
 JOIN (WITH rj AS ({_RJ}), rm AS (SELECT *, avg(cpl) OVER (PARTITION BY i, j, a) AS ma, avg(cpl) OVER (PARTITION BY i, j, b) AS mb_ FROM rj),
   h0 AS (SELECT pos, res, -ln(f / sum(f) OVER (PARTITION BY pos, {_MAP.format(p='pos', x='res')})) AS h FROM uni),
   hq AS (SELECT pos, res, sum(h) AS h FROM (SELECT * FROM h0 UNION ALL SELECT i, a, ma FROM rm WHERE b = 0 UNION ALL SELECT j, b, mb_ FROM rm WHERE a = 0) GROUP BY pos, res) {_RH}) y ON y.pos = j.j AND y.res = j.b""",
        "gb", "jj", "uni",
    ),
)(lambda s, d: values(filters.expanded_couplings(jj(s, d), marginals.unimarg(msa_b(s, d), L, Q), _GROUPS, Q), "cpl"))
_FREQUENT = [0.1, 0.2, 0.3, 0.4]
_DRAW = "CAST('0x' || left(md5('3:' || seq_id || ':' || (p - 1)), 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)"
query("reverse_alphamap_seqs", sql(f"SELECT seq_id, array_to_string(list_transform(seq, lambda x, p: CASE WHEN p % 2 = 1 AND x < 2 THEN CASE WHEN {_DRAW} < 0.1 / CAST(0.3 AS DOUBLE) THEN 0 ELSE 1 END WHEN p % 2 = 1 OR x = 0 THEN x WHEN {_DRAW} < 0.2 / CAST(0.9 AS DOUBLE) THEN 1 WHEN {_DRAW} < 0.5 / CAST(0.9 AS DOUBLE) THEN 2 ELSE 3 END), '') AS seq FROM mb", "mb"))(
    lambda s, d: _text(filters.expanded_sequences(filters.mapped_sequences(msa_b(s, d), _GROUPS, Q), [_FREQUENT] * L, _GROUPS, 3))
)
query("permute", sql("SELECT seq_id, CAST('0x' || left(md5('7:' || seq_id), 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS place FROM mb", "mb"))(lambda s, d: filters.permuted(msa_b(s, d), 7).select("seq_id", "place"))
query("unseen_letters", sql("SELECT pos, string_agg(chr(CAST(65 + res AS INT)), '' ORDER BY res) FILTER (f > 0) AS kept, coalesce(string_agg(chr(CAST(65 + res AS INT)), '' ORDER BY res) FILTER (f = 0), '') AS unseen FROM (SELECT 0 AS pos, a AS res, sum(f) AS f FROM ffa WHERE i = 0 AND j = 1 GROUP BY a UNION ALL SELECT j, b, sum(f) FROM ffa WHERE i = 0 GROUP BY j, b) GROUP BY pos", "ffa"))(
    lambda s, d: reduction.unseen_letters(ff_a(s, d), "ABCD")
)
_ENT = lambda x: f"CASE WHEN {x} > 0 THEN -({x}) * ln({x}) ELSE 0 END"
_MC = f"""SELECT a, b, sum(dd * dd) AS cost FROM (SELECT o, a, b, d + {_ENT('(ua + ub)')} - ({_ENT('ua')}) - ({_ENT('ub')}) AS dd FROM (
  SELECT x.o, x.x AS a, y.x AS b, sum({_ENT('x.f')} + {_ENT('y.f')} - ({_ENT('(x.f + y.f)')})) AS d, sum(x.f) AS ua, sum(y.f) AS ub
  FROM (SELECT j AS o, a AS x, b AS y, f FROM ff WHERE i = 2 UNION ALL SELECT i, b, a, f FROM ff WHERE j = 2) x
  JOIN (SELECT j AS o, a AS x, b AS y, f FROM ff WHERE i = 2 UNION ALL SELECT i, b, a, f FROM ff WHERE j = 2) y ON x.o = y.o AND x.y = y.y AND x.x < y.x GROUP BY ALL)) GROUP BY a, b"""
query("merge_costs", sql(f"SELECT a, b, {r('cost')} AS cost FROM ({_MC})", "ff"))(lambda s, d: values(reduction.merge_costs(ff_b(s, d), 2), "cost"))
query("best_merge", sql(f"SELECT a, b, {r('cost')} AS cost FROM ({_MC}) ORDER BY 3, a, b LIMIT 1", "ff"))(lambda s, d: values(reduction.best_merge(ff_b(s, d), 2, r6("cost")), "cost"))
query("mi_pearson", sql(f"SELECT {r('sum((x.s - y.s) * (x.s - y.s))')} AS sq_error, {r('corr(x.s, y.s)')} AS pearson FROM (SELECT i, j, {_SCORES['MI'][0]} AS s FROM sides GROUP BY i, j) x JOIN (SELECT i, j, 0.5 * sum(abs(f - fa * fb)) AS s FROM sides GROUP BY i, j) y USING (i, j)", "sides"))(
    lambda s, d: values(reduction.goodness(scores.score("MI", ff_b(s, d), None, Q), scores.score("TVDC", ff_b(s, d), None, Q)), "sq_error", "pearson")
)
query("reduce_alphabet")(lambda s, d: reduction.groups_table(s, reduction.reduce_alphabets(ff_b(s, d), "ABCD", 2)[0]))
query("stockholm_clean", "SELECT CAST(o_orderkey AS BIGINT) AS seq_id, 'id' || o_orderkey AS id, regexp_replace(o_orderpriority || '.', '[a-z.]', '', 'g') AS text FROM orders WHERE regexp_replace(o_orderpriority || '.', '[a-z.]', '', 'g') NOT SIMILAR TO '.*[BJOUXZ].*'")(
    lambda s, d: msa_io.clean_stockholm(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("seq_id"), F.concat(F.lit("id"), "o_orderkey", F.lit("  "), F.regexp_replace("o_orderpriority", " ", ""), F.lit(".")).alias("value")))
)
ORACLE_SQL["stockholm_clean"] = ORACLE_SQL["stockholm_clean"].replace("o_orderpriority ||", "replace(o_orderpriority, ' ', '') ||")


@query("msa_load", sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(list_sum(list_transform(seq, lambda x, p: x * p))) AS BIGINT) AS checksum FROM mb", "mb"))
def msa_load(s: SparkSession, d: str) -> DataFrame:
    """Written as text with a header, read back, and summed up."""
    path = scratch(s, "msa")
    msa_io.write_msa(msa_b(s, d), path, "ABCD", {"alpha": "ABCD"})
    back = msa_io.load_msa(s, path)
    return back.agg(F.count("*").alias("n"), F.sum(F.aggregate(F.transform("seq", lambda x, p: x * (p + 1)), F.lit(0), lambda a, x: a + x)).alias("checksum"))


def _text(m: DataFrame) -> DataFrame:
    return m.select("seq_id", F.concat_ws("", F.col("seq").cast("array<string>")).alias("seq"))


# ---- sampling

_U = "CAST('0x' || left(md5({k}), 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)"
query("gen_uniform", sql(f"SELECT n AS seq_id, string_agg(CAST(floor({_U.format(k='concat_ws(chr(58), 5, n, p)')} * 4) AS INT), '' ORDER BY p) AS seq FROM range((SELECT count(*) FROM mb)) t(n), range(12) u(p) GROUP BY n", "mb"))(lambda s, d: _text(sampling.uniform_sequences(s, msa_b(s, d).count(), L, Q, 5)))
_UP = "SELECT pos AS p, sum(n) OVER (PARTITION BY pos ORDER BY res) / sum(n) OVER (PARTITION BY pos) AS upper, res FROM cu"
_DRAWN = f"SELECT n, pos, {_U.format(k='concat_ws(chr(58), 6, n, pos)')} AS u FROM range((SELECT count(*) FROM mb)) t(n), pos"
query("gen_indep", sql(f"SELECT n AS seq_id, string_agg(x, '' ORDER BY pos) AS seq FROM (SELECT n, pos, CAST(count(upper) AS INT) AS x FROM ({_DRAWN}) LEFT JOIN ({_UP}) ON p = pos AND res < 3 AND upper <= u GROUP BY n, pos) GROUP BY n", "mb", "cu", "pos"))(
    lambda s, d: (lambda m: _text(sampling.independent_sequences(s, m.count(), _counts(m), 6)))(msa_b(s, d))
)


def _counts(m: DataFrame) -> list[list[float]]:
    """Counts of each letter at each position, on the driver as the model is."""
    out = [[0.0] * Q for _ in range(L)]
    for row in marginals.unicounts(m, L, Q).collect():
        out[row.pos][row.res] = float(row.n)
    return out


@query("metropolis")
def metropolis(s: SparkSession, d: str) -> DataFrame:
    start = msa_b(s, d).select(F.col("seq_id").alias("walker_id"), "seq", F.lit(1.0).alias("beta"))
    return sampling.metropolis(start, scores.coupling_array(jj(s, d), L, Q), 256, 9)


_LETTERS = "CASE WHEN pb.{p} IN (0, 1, 2) THEN s.m[pb.{p}+1] ELSE b.seq[pb.{p}+1] END"


_LOGFREQ = sql(
    f"""SELECT mb.seq_id, logfreq FROM mb JOIN (SELECT m, {r('max(x) + ln(sum(exp(x - top)))')} AS logfreq FROM (SELECT m, x, max(x) OVER (PARTITION BY m) AS top FROM (
  SELECT s.m, b.seq_id AS bg, any_value(en.e) - sum(cpl) AS x FROM (SELECT DISTINCT seq[1:3] AS m FROM mb) s, mb b, pb
  JOIN jj ON jj.i = pb.i AND jj.j = pb.j AND jj.a = {_LETTERS.format(p='i')} AND jj.b = {_LETTERS.format(p='j')}
  JOIN en ON en.seq_id = b.seq_id GROUP BY s.m, b.seq_id)) GROUP BY m) f ON f.m = mb.seq[1:3]""", "mb", "pb", "jj", "en")


@query("subseq_logfreq_all", _LOGFREQ)
@query("subseq_logfreq", _LOGFREQ)
def subseq_all(s: SparkSession, d: str) -> DataFrame:
    """Log frequency of every sequence's letters at the marked positions; under both names, which earlier rounds registered."""
    m = msa_b(s, d)
    return values(sampling.subsequence_logfreq(m, m, [0, 1, 2], scores.coupling_array(jj(s, d), L, Q)), "logfreq")


query("spearman", sql(f"SELECT count(*) AS n, {r('corr(rx, ry)')} AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT en.e AS x, i.e AS y FROM en JOIN (SELECT seq_id, sum(h) AS e FROM (SELECT seq_id, pos, seq[pos+1] AS res FROM mb, pos) JOIN hh USING (pos, res) GROUP BY seq_id) i USING (seq_id)))", "en", "mb", "pos", "hh"))(
    lambda s, d: values(spearman(scores.energies(msa_b(s, d), jj(s, d), L, Q).join(scores.independent_energies(msa_b(s, d), hh(s, d)).withColumnRenamed("e", "y"), "seq_id"), "e", "y"), "rho")
)
def mixed(seed: int, walker: str, step: int) -> str:
    """SQL of the number in [0, 1) that ``uniform_array`` draws, in whole numbers of 128 bits cut to 64."""
    cut = lambda e: f"CAST(({e}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    x = cut(f"CAST({walker} AS UHUGEINT) * {0x9E3779B97F4A7C15}::UHUGEINT + {seed}::UHUGEINT")
    for salt in (step * 0xD1B54A32D192ED03 % 2**64, 0x8CB92BA72F3D8DD7):
        x = cut(f"CAST({x} AS UHUGEINT) + {salt}::UHUGEINT")
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = f"(SELECT {cut(f'CAST(xor(v, v >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT')} FROM (SELECT {x} AS v))"
        x = f"(SELECT xor(v, v >> 31) FROM (SELECT {x} AS v))"
    return f"CAST(({x}) >> 11 AS DOUBLE) / CAST(9007199254740992 AS DOUBLE)"


def _half(rows: str, odd: int) -> str:
    """Rows (r, seq_id, e, b) after one of a round's two turns of swaps."""
    go = f"y.r IS NOT NULL AND x.b <> y.b AND ((x.e - y.e) * (x.b - y.b) >= 0 OR exp(least((x.e - y.e) * (x.b - y.b), 0)) > {mixed(3, 'x.r', odd)})"
    pairs = f"SELECT x.r, x.seq_id, x.e, x.b, y.r AS r2, y.seq_id AS s2, y.e AS e2, y.b AS b2, {go} AS go FROM {rows} x LEFT JOIN {rows} y ON y.r = x.r + 1 WHERE x.r % 2 = {odd}"
    alone = f" UNION ALL SELECT r, seq_id, e, b FROM {rows} WHERE r = 0" if odd else ""
    return f"SELECT r, seq_id, e, CASE WHEN go THEN b2 ELSE b END AS b FROM ({pairs}) UNION ALL SELECT r2, s2, e2, CASE WHEN go THEN b ELSE b2 END FROM ({pairs}) WHERE r2 IS NOT NULL" + alone


PARTS["sw0"] = ("SELECT row_number() OVER (ORDER BY e, seq_id) - 1 AS r, seq_id, e, CASE WHEN seq_id % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS b FROM en", ["en"])
PARTS["sw1"] = (_half("sw0", 0), ["sw0"])
PARTS["sw2"] = (_half("sw1", 1), ["sw1"])
query("tempering_swap", sql(f"SELECT seq_id AS walker_id, {r('e')} AS e, b AS beta FROM sw2", "sw2"))(
    lambda s, d: values(sampling.exchanged(scores.energies(msa_b(s, d), jj(s, d), L, Q).select(F.col("seq_id").alias("walker_id"), "e", F.when(F.col("seq_id") % 2 == 0, 1.0).otherwise(0.7).alias("beta")), 1, 3), "e")
)
query("profile_totals", f"SELECT event_type AS name, {r('sum(value)')} AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")(lambda s, d: values(profiling.totals(s.read.parquet(f"{d}/events.parquet"), "event_type", F.lit(0.0), F.col("value")), "total"))
query("tile_seed", sql("SELECT n AS seq_id, (SELECT array_to_string(seq, '') FROM mb ORDER BY seq_id LIMIT 1) AS seq FROM range((SELECT count(*) FROM mb)) t(n)", "mb"))(
    lambda s, d: (lambda m: _text(filters.tiled(s, m.orderBy("seq_id").first().seq, m.count())))(msa_b(s, d))
)
query("truncate_seqs", sql("SELECT seq_id, array_to_string(seq, '') AS seq FROM mb WHERE seq_id IN (SELECT seq_id FROM mb ORDER BY seq_id LIMIT 100)", "mb"))(lambda s, d: _text(filters.first_rows(msa_b(s, d), 100)))
query("concat_buffers", sql("SELECT seq_id, array_to_string(seq, '') AS seq FROM mb WHERE seq_id < 100 UNION ALL SELECT seq_id, array_to_string(seq, '') FROM mb WHERE seq_id >= 100", "mb"))(lambda s, d: (lambda m: _text(m.where("seq_id < 100").unionByName(m.where("seq_id >= 100"))))(msa_b(s, d)))

_EVENT = ("array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) - 1", "least(4, floor(value / 60))", "user_id % 4")
_EVENT_SQL = ("list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1", "least(4, floor(value / 60))", "user_id % 4")


@query(
    "stream_bicounts",
    f"WITH m AS (SELECT [{', '.join(f'CAST({e} AS INT)' for e in _EVENT_SQL)}] AS seq FROM events) SELECT i, j, seq[i + 1] AS a, seq[j + 1] AS b, count(*) AS n FROM m, (SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j FROM range(3) x(i), range(3) y(j) WHERE x.i < y.j) GROUP BY ALL",
)
def stream_bicounts(s: SparkSession, d: str) -> DataFrame:
    """Pair counts of the events read as a stream, until all that is there has come; the state is a row a bin."""
    path = f"{d}/events.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path}*")  # a file or a folder of that name
    letters = stream.select(F.expr(f"array({', '.join(f'cast({e} as int)' for e in _EVENT)})").alias("seq"))
    out = scratch(s, "stream-bicounts")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = streaming_bicounts(letters, 3).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(s, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.parquet(out).select(*KEY, "n")


# ---- Newton steps

G, PC = 0.01, 0.001


def step(s: SparkSession, d: str) -> DataFrame:
    x = scores.both(ff_b(s, d), jj(s, d)).join(fw_b(s, d).withColumnRenamed("f", "target"), KEY).withColumn("dj", F.lit(0.0))
    return newton.update(x, G, PC).select(*KEY, "f", "cpl", "dj")


_SZ = "CASE WHEN sign(z) <> sign(z + ({t})) THEN dj - z ELSE dj + ({t}) END"
_REGS = {
    "update_j": ("dj", "st", lambda x: x),
    "reg_l1z": (_SZ.format(t="-0.05 * sign(z) * k"), "sz", lambda x: newton.l1z(x, G, PC, 0.05)),
    "reg_l2z": (_SZ.format(t="-0.05 * z * k"), "sz", lambda x: newton.l2z(x, G, PC, 0.05)),
    "reg_scadj": ("dj - CASE WHEN abs(z) < 0.1 THEN least(0.1, abs(z) / 0.01) WHEN abs(z) < 0.4 THEN (0.4 - abs(z)) / 3 ELSE 0 END * sign(z) * k", "sz", lambda x: newton.scadj(x, G, PC, 0.1, 4.0)),
    "reg_x": ("dj - least(0.05, abs(x) / (nx * 0.01)) * c * sign(x) * k", "sx", lambda x: newton.x_norm(x, G, PC, 0.05)),
    "reg_xij": ("dj - least((i + j) / CAST(100.0 AS DOUBLE), abs(x) / (nx * 0.01)) * c * sign(x) * k", "sx", lambda x: newton.x_norm(x.withColumn("lam", (F.col("i") + F.col("j")) / F.lit(100.0)), G, PC, F.col("lam")).drop("lam")),
    "reg_scadx": ("dj - CASE WHEN abs(x) < 0.2 THEN least(0.2, abs(x) / (nx * 0.01 * 2 * 0.5 / (5 * 0.04))) WHEN abs(x) < 0.8 THEN (0.8 - abs(x)) / 3 ELSE 0 END * sign(x) * (2 * 0.5 / (5 * 0.04)) * (c + f * (x - xab)) * k", "sx", lambda x: newton.scadx(x, G, PC, 0.5, 0.2, 4.0)),
    "reg_expx": ("dj - sign(x) * exp(-abs(x) / 0.3) * (c + f * (x - xab)) * k", "sx", lambda x: newton.exp_x(x, G, PC, 0.3)),
}
for _n, (_e, _p, _f) in _REGS.items():
    query(_n, sql(f"SELECT i, j, a, b, {r(_e)} AS dj FROM {_p}", _p))(lambda s, d, f=_f: values(f(step(s, d)).select(*KEY, "dj"), "dj"))
for _n, _e, _f in (
    ("reg_dde", "0.02 * sum(sign(dde)) / 9", lambda x: newton.dde(x, G, PC, 0.02, Q)),
    ("reg_scaddde", "sum(0.02 * sign(dde) * CASE WHEN abs(dde) < 0.3 THEN 1 WHEN abs(dde) < 1.2 THEN (1.2 - abs(dde)) / 0.9 ELSE 0 END) / 9", lambda x: newton.scad_dde(x, G, PC, 0.02, 0.3, Q)),
):
    query(_n, sql(f"SELECT i, j, a, b, {r('dj - g * k')} AS dj FROM sz JOIN (SELECT i, j, a, b, {_e} AS g FROM scy GROUP BY ALL) USING (i, j, a, b)", "sz", "scy"))(lambda s, d, f=_f: values(f(step(s, d)).select(*KEY, "dj"), "dj"))
query("reweight", sql(f"SELECT seq_id, {r('exp(m - e)')} AS w FROM (SELECT *, min(e) OVER () AS m FROM en)", "en"))(lambda s, d: newton.energy_weights(scores.energies(msa_b(s, d), jj(s, d), L, Q).withColumnRenamed("e", "de")).select("seq_id", r6("w").alias("w")))
query("beta_weights", sql(f"SELECT seq_id, {r('exp((0.8 - 1) * (e - 0.5))')} AS w FROM en", "en"))(lambda s, d: newton.beta_weights(scores.energies(msa_b(s, d), jj(s, d), L, Q), 0.8, 0.5).select("seq_id", r6("w").alias("w")))


@query("infer")
def infer_query(s: SparkSession, d: str) -> DataFrame:
    """Two short rounds on A; the fitted couplings."""
    target = marginals.pc_constant(ff_a(s, d), 0.001)
    return infer.fit(s, target, fx.A_LENGTH, fx.A_Q, infer.Options(walkers=4096, rounds=2, equilibration=64, newton_steps=16, gamma=0.02)).couplings


@query("equilibrate")
def equilibrate_query(s: SparkSession, d: str) -> DataFrame:
    """B's sequences as walkers of the model of its covariances, with energies, until these decorrelate."""
    start = msa_b(s, d).select(F.col("seq_id").alias("walker_id"), "seq", F.lit(1.0).alias("beta"))
    w = infer.equilibrate(s, start, scores.coupling_array(jj(s, d), L, Q), 3, least=32, most=128)
    return w.select("walker_id", "seq", "e")
