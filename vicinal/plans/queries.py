"""Registered queries over the driver's tables, and the SQL that each is held against.

Layout queries take the first two components of every vector as coordinates (``layout_scores`` scores a real
one); grouping queries take groups from a hash of the id; sweep queries take ``part`` as a table of runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors as fx
from vicinal.operators import coarsen, evaluate, graph, knn, layout, probability, sampling
from vicinal.plans.sweep import flat as flat_layout
from vicinal.plans.sweep import metrics
from vicinal.session import cut, new_dir
from vicinal.sources import vectors as files

K, GROUPS, TARGET, SIGMA = 10, 97, 5.0, 0.7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- inputs ----


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.points(_table(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v) with v the first two components."""
    return _points(spark, sf_dir).select("id", F.slice("v", 1, 2).alias("v"))


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_knn(_points(spark, sf_dir), K)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric edges with w = 1 / (1 + d2)."""
    return graph.symmetrize(_knn(spark, sf_dir)).select("src", "dst", "d2", "pos", fx.inv_one_plus(F.col("d2")).alias("w"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("long") % GROUPS
    return _table(spark, sf_dir).select(F.col("vec_id").alias("id"), g.alias("gid"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


def _r(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c, c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- SQL parts ----

_PTS = "pts AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label::BIGINT AS label FROM embeddings)"
_PAIRS = _PTS + ", pairs AS (SELECT a.id AS src, b.id AS dst, greatest(pow(list_distance(a.v, b.v), 2), 1e-12) AS d2 FROM pts a JOIN pts b ON a.id <> b.id)"
_TOP = "{0} AS (SELECT * FROM (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rk FROM {1}) WHERE rk <= {2})"
_KNN = _PAIRS + ", " + _TOP.format("knn", "pairs", K)
_SYM = _KNN + (
    ", sym AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS pos, 1 / (1 + d2) AS w FROM "
    "(SELECT src, dst, max(d2) AS d2 FROM (SELECT src, dst, d2 FROM knn UNION ALL SELECT dst, src, d2 FROM knn) GROUP BY 1, 2))"
)
_DEG = _SYM + ", deg AS (SELECT id, count(src) AS degree FROM pts LEFT JOIN sym ON src = id GROUP BY id)"
_GRP = f"grp AS (SELECT vec_id AS id, ('0x' || substr(md5(vec_id::VARCHAR), 1, 4))::BIGINT % {GROUPS} AS gid FROM embeddings)"
_XY = "xy AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::BIGINT AS label FROM embeddings)"
_XYPAIRS = _XY + ", xp AS (SELECT a.id AS src, b.id AS dst, greatest(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 1e-12) AS d2 FROM xy a JOIN xy b ON a.id <> b.id)"


def _sr(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def _cols(**named: str) -> str:
    return ", ".join(f"{_sr(e)} AS {n}" for n, e in named.items())


# ---- neighbours and graphs ----


@query(f"WITH {_KNN} SELECT src, dst, {_cols(d2='d2')}, rk FROM knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("src", "dst", _r("d2", "d2"), F.col("rk").cast("long").alias("rk"))


@query(f"WITH {_PAIRS} SELECT src, count(*) AS n, {_cols(total='sum(d2)', least='min(d2)', most='max(d2)')} FROM pairs WHERE src < dst GROUP BY src")
def pairwise_sqdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.pairwise(_points(spark, sf_dir)).groupBy("src")
    return _rounded(found.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("total"), F.min("d2").alias("least"), F.max("d2").alias("most")))


@query(f"WITH {_PAIRS}, near AS (SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON b.id = a.id + 1) SELECT src, dst, {_cols(d2='d2')} FROM near JOIN pairs USING (src, dst)")
def sqdist_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _points(spark, sf_dir).select(F.col("id").alias("src"), F.col("v").alias("va"))
    b = _points(spark, sf_dir).select(F.col("id").alias("dst"), F.col("v").alias("vb"), (F.col("id") - 1).alias("src"))
    return a.join(b, "src").select("src", "dst", _r(fx.sqdist(F.col("va"), F.col("vb")), "d2"))


@query(f"WITH {_SYM} SELECT src, dst, {_cols(d2='d2')}, pos FROM sym")
def knn_symmetrized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", _r("d2", "d2"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_DEG} SELECT id, degree FROM deg")
def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_points(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_SYM} SELECT dst, {_cols(w='w')} FROM sym WHERE src = 7")
def vertex_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.neighbours(_edges(spark, sf_dir), 7))


@query(
    f"WITH {_SYM}, ask AS (SELECT id AS src, id + 1 AS dst FROM pts UNION ALL SELECT src, dst FROM knn WHERE rk = 1) "
    f"SELECT src, dst, {_cols(w='coalesce(w, 0.0)')}, coalesce(w, 0.0) > 0 AS has_edge FROM ask LEFT JOIN sym USING (src, dst)"
)
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = _points(spark, sf_dir).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ask = ask.unionByName(_knn(spark, sf_dir).where("rk = 1").select("src", "dst"))
    return _rounded(graph.weights(ask, _edges(spark, sf_dir).select("src", "dst", "w")))


@query(
    f"WITH {_SYM}, found AS (SELECT (SELECT count(*) FROM sym WHERE src IS NULL OR dst IS NULL) AS null_ends, "
    "(SELECT count(*) FROM sym WHERE src NOT IN (SELECT id FROM pts) OR dst NOT IN (SELECT id FROM pts)) AS unknown_ends, "
    "(SELECT count(*) - count(DISTINCT (src, dst)) FROM sym) AS repeated, (SELECT count(*) FROM pts) AS n) "
    "SELECT null_ends, unknown_ends, repeated, null_ends = 0 AND unknown_ends = 0 AND repeated = 0 AND n > 0 AS valid FROM found"
)
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validate(_points(spark, sf_dir), _edges(spark, sf_dir))


_GAP = "SELECT {0}, max(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) <= 1e-6 AS symmetric FROM {1} a FULL JOIN {1} b ON a.src = b.dst AND a.dst = b.src"


@query(f"WITH {_SYM} " + _GAP.format(_cols(worst="max(abs(coalesce(a.w, 0) - coalesce(b.w, 0)))"), "sym"))
def is_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.is_symmetric(_edges(spark, sf_dir)))


@query(f"WITH {_KNN}, one AS (SELECT src, dst, 1 / (1 + d2) AS w FROM knn) " + _GAP.format(_cols(worst="max(abs(coalesce(a.w, 0) - coalesce(b.w, 0)))"), "one"))
def is_symmetric_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.is_symmetric(_knn(spark, sf_dir).select("src", "dst", fx.inv_one_plus(F.col("d2")).alias("w"))))


_START = "start AS (SELECT id AS src, (id + j * 37) % (SELECT count(*) FROM pts) AS dst FROM pts, range(1, 9) t(j))"


@query(
    f"WITH {_PAIRS}, {_START}, cur AS (SELECT src, dst, d2 FROM start JOIN pairs USING (src, dst)), "
    "far AS (SELECT DISTINCT a.src, b.dst FROM cur a JOIN cur b ON a.dst = b.src WHERE a.src <> b.dst), "
    "every AS (SELECT src, dst, d2 FROM far JOIN pairs USING (src, dst) UNION SELECT src, dst, d2 FROM cur), "
    + _TOP.format("best", "every", 8) + f" SELECT src, dst, {_cols(d2='d2')}, rk FROM best"
)
def nn_descent_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir)
    n = pts.count()
    start = pts.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j"), "v")
    start = start.select("src", ((F.col("src") + F.col("j") * 37) % n).alias("dst"), "v").join(pts.select(F.col("id").alias("dst"), F.col("v").alias("vb")), "dst")
    cur = knn.top_k(start.select("src", "dst", fx.sqdist(F.col("v"), F.col("vb")).alias("d2")), 8)
    return knn.nn_descent_pass(cur, pts, 8).select("src", "dst", _r("d2", "d2"), F.col("rk").cast("long").alias("rk"))


@query()
def approx_knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.recall(knn.approx_knn(_points(spark, sf_dir), K), _knn(spark, sf_dir))


@query()
def projection_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.leaves(_points(spark, sf_dir))


# ---- probabilities ----

_E = "exp((min(d2) OVER (PARTITION BY src) - d2) / (2 * {0} * {0}))"


@query(
    f"WITH {_SYM}, e AS (SELECT src, {_E.format(SIGMA)} AS e FROM sym), p AS (SELECT src, e / sum(e) OVER (PARTITION BY src) AS p FROM e) "
    f"SELECT src, {_cols(perplexity='pow(2, sum(CASE WHEN p > 1e-10 THEN -p * log2(p) ELSE 0 END))')} FROM p GROUP BY src"
)
def perplexity_fixed_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(probability.perplexity(_edges(spark, sf_dir), SIGMA))


_SEARCH = f"""{_SYM}, ls AS (SELECT src, list(d2 ORDER BY d2) AS ds FROM sym GROUP BY src),
bis(src, ds, it, lo, hi, s, done) AS (
  SELECT src, ds, 0, 1e-10::DOUBLE, 1000.0::DOUBLE, 1.0::DOUBLE, false FROM ls
  UNION ALL
  SELECT src, ds, it + 1, CASE WHEN near OR NOT low THEN lo ELSE s END, CASE WHEN near OR low THEN hi ELSE s END,
    CASE WHEN near THEN s WHEN low THEN (s + hi) / 2 ELSE (lo + s) / 2 END,
    near OR (CASE WHEN low THEN hi - s ELSE s - lo END) < 1e-10
  FROM (SELECT *, abs(perp - {TARGET}) < 1e-2 AS near, perp < {TARGET} AS low FROM (
    SELECT *, pow(2, list_sum(list_transform(es, lambda e: CASE WHEN e / tot > 1e-10 THEN -(e / tot) * log2(e / tot) ELSE 0 END))) AS perp FROM (
      SELECT *, list_sum(es) AS tot FROM (
        SELECT *, list_transform(ds, lambda d: exp((ds[1] - d) / (2 * s * s))) AS es FROM bis WHERE NOT done AND it < 100))))
),
sig AS (SELECT src, arg_max(s, it) AS sigma FROM bis GROUP BY src)"""
_COND = _SEARCH + (
    ", ce AS (SELECT src, dst, " + _E.format("sigma") + " AS e FROM sym JOIN sig USING (src)), "
    "cp AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY src) AS p FROM ce)"
)
_PIJ = _COND + (
    ", pw AS (SELECT a.src, a.dst, (a.p + coalesce(b.p, 0)) / (2.0 * (SELECT count(*) FROM pts)) AS w FROM cp a LEFT JOIN cp b ON a.src = b.dst AND a.dst = b.src)"
)


@query(f"WITH RECURSIVE {_SEARCH} SELECT src, {_cols(sigma='sigma')} FROM sig")
def sigma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(probability.sigmas(_edges(spark, sf_dir), TARGET))


@query(f"WITH RECURSIVE {_COND} SELECT src, dst, {_cols(p='p')} FROM cp")
def conditional_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return _rounded(probability.conditional(edges.select("src", "dst", "d2"), probability.sigmas(edges, TARGET)))


def _pij(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.pij(_edges(spark, sf_dir).select("src", "dst", "d2"), _points(spark, sf_dir).count(), TARGET)


@query(f"WITH RECURSIVE {_PIJ} SELECT src, dst, round(CASE WHEN w <= 0 THEN 1e-10 ELSE w END, 9) AS w FROM pw")
def pij(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pij(spark, sf_dir).select("src", "dst", F.round("w", 9).alias("w"))


@query(f"WITH RECURSIVE {_PIJ} SELECT {_cols(total='sum(CASE WHEN w <= 0 THEN 1e-10 ELSE w END)')} FROM pw")
def pij_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pij(spark, sf_dir).agg(F.sum("w").alias("total")))


@query(f"WITH {_SYM} SELECT src, dst, {_cols(w='CASE WHEN w - 0.45 <= 0 THEN 1e-10 ELSE w - 0.45 END')} FROM sym")
def weight_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", _r(fx.floored(F.col("w") - 0.45), "w"))


# ---- groups and sampling ----


@query(
    f"WITH {_SYM}, {_GRP} SELECT a.gid AS src, b.gid AS dst, {_cols(w='max(w)')} FROM sym JOIN grp a ON a.id = src JOIN grp b ON b.id = dst "
    "WHERE a.gid <> b.gid GROUP BY 1, 2"
)
def coarse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(coarsen.coarse_edges(_edges(spark, sf_dir).select("src", "dst", "w"), _groups(spark, sf_dir)))


@query(f"WITH {_GRP} SELECT gid, string_agg(id::VARCHAR, ',' ORDER BY id) AS children FROM grp GROUP BY gid")
def group_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coarsen.children(_groups(spark, sf_dir))
    return found.select("gid", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


_REP = _DEG + f", {_GRP}, rep AS (SELECT gid, id AS rep FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY degree DESC, id) AS r FROM grp JOIN deg USING (id)) WHERE r = 1)"


@query(f"WITH {_REP} SELECT gid, rep FROM rep")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.representatives(_groups(spark, sf_dir), vertex_degree(spark, sf_dir))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) - 1 AS place FROM embeddings")
def md5_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(_points(spark, sf_dir), 42)


@query(
    f"WITH {_DEG}, run AS (SELECT id, degree, sum(degree) OVER (ORDER BY substr(md5(id::VARCHAR), 1, 4), id) AS upto, sum(degree) OVER () AS total FROM deg) "
    f"SELECT id, {_cols(lo='(upto - degree) / total', hi='upto / total')} FROM run"
)
def negative_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sampling.degree_cdf(vertex_degree(spark, sf_dir)))


@query(
    f"WITH {_SYM}, c AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) / sum(w) OVER (PARTITION BY src) AS cdf, "
    "('0x' || substr(md5('7:' || src::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM sym) "
    "SELECT src, coalesce(min(dst) FILTER (WHERE cdf > u), max(dst)) AS dst FROM c GROUP BY src"
)
def positive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.positive_edges(_edges(spark, sf_dir).select("src", "dst", "w"), 7)


@query()
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = coarsen.hierarchy(_points(spark, sf_dir).select("id"), _edges(spark, sf_dir))
    out = None
    for k, level in enumerate(levels):
        rows = level.vertices.select(F.lit(k).alias("level"), "id", "gid")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- gradients and layouts ----

_EXY = _SYM + f", {_XY}, exy AS (SELECT src, dst, w, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y, greatest(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 1e-12) AS q FROM sym JOIN xy a ON a.id = src JOIN xy b ON b.id = dst)"


def _edge_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    a = flat.select(F.col("id").alias("src"), F.col("v")[0].alias("ax"), F.col("v")[1].alias("ay"))
    b = flat.select(F.col("id").alias("dst"), F.col("v")[0].alias("bx"), F.col("v")[1].alias("by"))
    return _edges(spark, sf_dir).select("src", "dst", "w").join(a, "src").join(b, "dst")


def _ends() -> tuple[list[Column], list[Column]]:
    return [F.col("ax"), F.col("ay")], [F.col("bx"), F.col("by")]


@query(f"WITH {_EXY} SELECT src, dst, {_cols(inv='1 / (1 + q)')} FROM exy")
def inv_one_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_coordinates(spark, sf_dir).select("src", "dst", _r(fx.inv_one_plus(fx.sqdist_of(*_ends())), "inv"))


@query(f"WITH {_EXY} SELECT src, dst, {_cols(gx='-2 * w / (1 + q) * (a_x - b_x)', gy='-2 * w / (1 + q) * (a_y - b_y)')} FROM exy")
def grad_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = fx.grad_pos(*_ends(), F.col("w"))
    return _edge_coordinates(spark, sf_dir).select("src", "dst", _r(gx, "gx"), _r(gy, "gy"))


_NEG = "2 * 7.0 * w / greatest(q * (1 + q), 1e-18) * (a_{0} - b_{0})"


@query(f"WITH {_EXY} SELECT src, dst, round({_NEG.format('x')}, 4) + 0.0 AS gx, round({_NEG.format('y')}, 4) + 0.0 AS gy FROM exy")
def grad_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = fx.grad_neg(*_ends(), F.col("w"), 7.0)
    return _edge_coordinates(spark, sf_dir).select("src", "dst", F.round(gx, 4).alias("gx"), F.round(gy, 4).alias("gy"))


@query(
    f"WITH {_EXY}, g AS (SELECT src, dst, {_NEG.format('x')} AS gx, {_NEG.format('y')} AS gy FROM exy), m AS (SELECT *, sqrt(gx * gx + gy * gy) AS norm FROM g) "
    f"SELECT src, dst, {_cols(gx='CASE WHEN norm > 10 THEN gx * 10 / norm ELSE gx END', gy='CASE WHEN norm > 10 THEN gy * 10 / norm ELSE gy END')} FROM m"
)
def clip_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = fx.grad_neg(*_ends(), F.col("w"), 7.0)
    rows = _edge_coordinates(spark, sf_dir).select("src", "dst", gx.alias("gx"), gy.alias("gy"))
    cx, cy = fx.clipped([F.col("gx"), F.col("gy")], 10.0)
    return rows.select("src", "dst", _r(cx, "gx"), _r(cy, "gy"))


@query(f"WITH {_XY}, {_GRP}, c AS (SELECT gid, avg(x) AS x, avg(y) AS y FROM xy JOIN grp USING (id) GROUP BY gid) SELECT id, gid, {_cols(x='x', y='y')} FROM grp JOIN c USING (gid)")
def prolongate(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    coarse = _flat(spark, sf_dir).join(groups, "id").groupBy(F.col("gid").alias("id")).agg(F.avg(F.col("v")[0]).alias("x"), F.avg(F.col("v")[1]).alias("y"))
    return _rounded(layout.prolong(groups, coarse))


_STEPS = (13, 29, 71, 101, 151)
_EPOCH = f"""{_REP}, {_XY},
smp AS (SELECT gid, rep AS i, dst AS j, w FROM rep JOIN sym ON src = rep AND pos = 1),
pos1 AS (SELECT gid, i, w, a.x AS ax, a.y AS ay, -2 * w / (1 + greatest(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 1e-12)) AS f, a.x - b.x AS dx, a.y - b.y AS dy
  FROM smp JOIN xy a ON a.id = i JOIN xy b ON b.id = j),
neg1 AS (SELECT gid, sum(f * (ax - c.x)) AS px, sum(f * (ay - c.y)) AS py FROM (
  SELECT p.gid, p.ax, p.ay, n.id AS nid, 2 * 7.0 * p.w / greatest(q * (1 + q), 1e-18) AS f FROM (
    SELECT p.gid, n.id AS nid, greatest(pow(p.ax - n.x, 2) + pow(p.ay - n.y, 2), 1e-12) AS q
    FROM pos1 p, unnest({list(_STEPS)}) s(k) JOIN xy n ON n.id = (p.i + s.k) % (SELECT count(*) FROM xy)) z
  JOIN pos1 p ON p.gid = z.gid JOIN xy n ON n.id = z.nid) t JOIN xy c ON c.id = t.nid GROUP BY gid),
tot AS (SELECT p.gid, f * dx + coalesce(px, 0) AS gx, f * dy + coalesce(py, 0) AS gy FROM pos1 p LEFT JOIN neg1 USING (gid)),
clp AS (SELECT gid, CASE WHEN norm > 0.01 THEN gx * 0.01 / norm ELSE gx END AS gx, CASE WHEN norm > 0.01 THEN gy * 0.01 / norm ELSE gy END AS gy
  FROM (SELECT *, sqrt(gx * gx + gy * gy) AS norm FROM tot))"""


@query(f"WITH {_EPOCH} SELECT id, gid, {_cols(x='x + 200.0 * coalesce(gx, 0)', y='y + 200.0 * coalesce(gy, 0)')} FROM grp JOIN xy USING (id) LEFT JOIN clp USING (gid)")
def sgd_epoch_fixed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    groups = _groups(spark, sf_dir)
    n = groups.count()
    rep = coarsen.representatives(groups, graph.degrees(_points(spark, sf_dir), edges))
    nearest = edges.where("pos = 1").select(F.col("src").alias("rep"), F.col("dst").alias("j"))
    negatives = F.array(*[(F.col("rep") + k) % n for k in _STEPS])
    samples = rep.join(nearest, "rep").select("gid", F.col("rep").alias("i"), "j", negatives.alias("negatives"))
    at = _flat(spark, sf_dir).join(groups, "id").select("id", "gid", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return _rounded(layout.synchronous_epoch(at, edges.select("src", "dst", "w"), samples, 200.0, 7.0, 0.01))


@query(
    "SELECT t, " + _cols(polynomial="200.0 / pow(1 + t / 100.0, 0.5)", cosine="200.0 * 0.5 * (1 + cos(pi() * t / 100.0))", constant="200.0") + " FROM range(100) r(t)"
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("polynomial", "cosine", "constant")
    return spark.range(100).select(F.col("id").alias("t"), *[_r(fx.learning_rate_column(k, 200.0, 0.5, 100, F.col("id")), k) for k in kinds])


@query(f"WITH {_EXY} SELECT {_cols(objective='sum(-w * ln(1 + q))')} FROM exy")
def objective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _flat(spark, sf_dir).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return _rounded(layout.objective(at, _edges(spark, sf_dir)))


@query()
def embed_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    config = layout.Config(k=max(1, min(layout.Config.k, points.count() - 1)))
    return layout.embed(spark, points, config)


# ---- files ----

_ROW = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding, label FROM embeddings"


def _vector_file(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, int]:
    path = f"{new_dir(spark, 'vectors')}/{name}"
    return path, files.write_vectors(_table(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), path)


def _parts(vectors: DataFrame, places: tuple[int, ...]) -> DataFrame:
    return vectors.select("id", F.size("features").cast("long").alias("n"), *[F.col("features")[k].cast("double").alias(f"f{k}") for k in places])


@query("SELECT id, len(embedding)::BIGINT AS n, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k}" for k in range(64)) + f" FROM ({_ROW})")
def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, written as fvecs and read again in byte ranges."""
    path, n = _vector_file(spark, sf_dir, "x.fvecs")
    return _parts(files.read_vectors(spark, path, n, 64), tuple(range(64)))


@query("SELECT id, len(embedding)::BIGINT AS n, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k}" for k in range(64)) + f" FROM ({_ROW})")
def raw_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as raw float32; how many they are follows from the file's size."""
    return _parts(files.read_matrix(spark, _vector_file(spark, sf_dir, "x.f32")[0], 64), tuple(range(64)))


@query("SELECT id, 4::BIGINT AS n, " + ", ".join(f"embedding[{k + 4}]::DOUBLE AS f{k}" for k in range(4)) + f" FROM ({_ROW}) WHERE id < (SELECT count(*) - 1 FROM embeddings)")
def raw_scan_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a raw file with an offset and a stride: four components from the fourth on."""
    path, n = _vector_file(spark, sf_dir, "x.f32")
    return _parts(files.read_raw(spark, path, n - 1, 4, stride=64, offset=3), (0, 1, 2, 3))


@query(f"SELECT vec_id AS id, {_cols(x='embedding[1]::DOUBLE', y='embedding[2]::DOUBLE', z='embedding[3]::DOUBLE')} FROM embeddings")
def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout in three dimensions, written in both forms; the table read again, and checked against the raw one."""
    at = _points(spark, sf_dir).select("id", *[F.col("v")[k].alias(c) for k, c in enumerate(layout.AXES)])
    raw, folder = files.write_layout(at, f"{new_dir(spark, 'layout')}/at")
    read = files.read_layout(spark, folder, 3)
    ids = sampling.running(read.select("id", F.lit(1).alias("one")), "one", F.floor(F.col("id") / 4096), ["id"]).select("id", F.col("before").cast("long").alias("row"))
    both = read.join(ids, "id").join(files.read_matrix(spark, raw, 3).withColumnRenamed("id", "row"), "row")
    sound = F.abs(F.col("features")[0] - F.col("x")) <= 1e-5
    return both.select("id", *[F.when(sound, _r(F.col(c))).alias(c) for c in layout.AXES])


@query(f"SELECT id, label::BIGINT AS label FROM ({_ROW})")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a .npy array, in order of the points."""
    path = f"{new_dir(spark, 'labels')}/x_colors.npy"
    files.write_labels(_labels(spark, sf_dir), path)
    return files.read_labels(spark, path)


@query("SELECT n_name AS test_id, n_nationkey * 1.5::DOUBLE AS elapsed_time, n_nationkey::BIGINT AS config_K, n_regionkey * 0.5::DOUBLE AS config_gamma FROM nation WHERE n_nationkey % 5 <> 0")
def sweep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as a sweep's results in JSON, of which the successful ones are read with their configuration."""
    k = F.col("n_nationkey")
    config = F.struct(k.cast("long").alias("K"), (F.col("n_regionkey") * 0.5).cast("double").alias("gamma"))
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet")
    runs = runs.select((k % 5 != 0).alias("success"), F.col("n_name").alias("test_id"), (k * 1.5).cast("double").alias("elapsed_time"), config.alias("config"))
    path = f"{new_dir(spark, 'runs')}/results.json"
    files.write_text("[" + ",\n".join(runs.toJSON().collect()) + "]", path)
    return files.read_runs(spark, path).drop("success").select("test_id", "elapsed_time", "config_K", "config_gamma")


# ---- scores ----


def _stat(e: str, name: str) -> str:
    return _cols(**{f"{name}_mean": f"avg({e})", f"{name}_median": f"median({e})", f"{name}_std": f"stddev_pop({e})"})


_SHARED = (
    f"{_PAIRS}, {_XYPAIRS}, {_TOP.format('ka', 'pairs', 30)}, {_TOP.format('kb', 'xp', 30)}, "
    "sh AS (SELECT id, count(b.src) AS o FROM pts LEFT JOIN ka a ON a.src = id LEFT JOIN kb b ON b.src = a.src AND b.dst = a.dst GROUP BY id)"
)


@query(
    f"WITH {_SHARED} SELECT {_stat('o', 'knn_overlap')}, min(o) AS knn_overlap_min, max(o) AS knn_overlap_max, {_cols(knn_overlap_pct='100.0 * avg(o) / 30')} FROM sh"
)
def knn_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.preservation(_points(spark, sf_dir), _flat(spark, sf_dir), 30))


@query(
    f"WITH {_XYPAIRS}, m AS (SELECT src, CASE WHEN min(d2) <= 1e-12 THEN 0.0 ELSE sqrt(min(d2)) END AS d FROM xp GROUP BY src), "
    "u AS (SELECT count(DISTINCT (x, y)) AS unique_coords, count(*) AS n FROM xy) "
    f"SELECT {_stat('d', 'min_dist')}, {_cols(min_dist_min='min(d)', min_dist_max='max(d)')}, count(*) FILTER (WHERE d < 0.1) AS under_01, "
    "count(*) FILTER (WHERE d >= 0.1 AND d < 1) AS under_1, count(*) FILTER (WHERE d >= 1 AND d < 10) AS under_10, count(*) FILTER (WHERE d >= 10) AS over_10, "
    f"any_value(unique_coords) AS unique_coords, any_value(n - unique_coords) AS duplicate_coords, {_cols(duplicate_pct='100.0 * any_value(n - unique_coords) / any_value(n)')} FROM m, u"
)
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.separation(_flat(spark, sf_dir)))


@query(
    f"WITH {_XY} SELECT "
    + _cols(
        x_span="max(x) - min(x)", y_span="max(y) - min(y)", x_std="stddev_pop(x)", y_std="stddev_pop(y)", mean_dist_from_origin="avg(sqrt(x * x + y * y))",
        median_dist_from_origin="median(sqrt(x * x + y * y))", max_dist_from_origin="max(sqrt(x * x + y * y))",
    )
    + " FROM xy"
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.spread(_flat(spark, sf_dir)))


@query(
    f"WITH {_XYPAIRS}, {_TOP.format('k', 'xp', 10)}, m AS (SELECT src, avg(sqrt(d2)) AS d FROM k GROUP BY src) "
    f"SELECT {_stat('d', 'local_density')}, {_cols(local_density_min='min(d)', local_density_max='max(d)')} FROM m"
)
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.local_density(_flat(spark, sf_dir)))


@query(
    f"WITH {_XY}, m AS (SELECT a.id, a.label, b.label AS cluster, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM xy a JOIN xy b ON a.id <> b.id GROUP BY 1, 2, 3), "
    "ab AS (SELECT id, max(d) FILTER (WHERE cluster = label) AS a, min(d) FILTER (WHERE cluster <> label) AS b FROM m GROUP BY id) "
    f"SELECT id, {_cols(silhouette='CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END')} FROM ab"
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.silhouettes(_flat(spark, sf_dir).join(_labels(spark, sf_dir), "id")))


@query(
    f"WITH {_XY}, p AS (SELECT label, floor((x + 1) * 5)::BIGINT AS cluster FROM xy), c AS (SELECT label, cluster, count(*) AS n FROM p GROUP BY 1, 2), "
    "t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY cluster)) AS b, "
    "sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM c), e AS (SELECT *, a * b / (n * (n - 1) / 2) AS x FROM t) "
    f"SELECT {_cols(ari='(c - x) / ((a + b) / 2 - x)')} FROM e"
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _flat(spark, sf_dir).join(_labels(spark, sf_dir), "id").select("label", F.floor((F.col("v")[0] + 1) * 5).alias("cluster"))
    return _rounded(evaluate.adjusted_rand(pairs))


_RANKS = (
    "rp AS (SELECT round(sqrt(greatest(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 1e-12)), 9) AS d, abs(a.label - b.label) AS t FROM xy a JOIN xy b ON a.id < b.id), "
    "rk AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rd, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt FROM rp)"
)


@query(f"WITH {_XY}, {_RANKS} SELECT {_cols(spatial_correlation='corr(rd, rt)')}, count(*) AS n_pairs FROM rk")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.spearman(_flat(spark, sf_dir), _labels(spark, sf_dir).select("id", F.col("label").alias("value"))))


@query(
    f"WITH {_KNN}, v AS (SELECT src, b.label AS vote, count(*) AS n FROM knn JOIN pts b ON b.id = dst GROUP BY 1, 2), "
    "g AS (SELECT src, vote AS guess FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, vote) AS r FROM v) WHERE r = 1) "
    "SELECT id, label, guess FROM pts JOIN g ON src = id"
)
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.knn_classified(_knn(spark, sf_dir), _labels(spark, sf_dir))


@query(
    f"WITH {_SHARED}, {_RANKS}, m AS (SELECT 100.0 * avg((d < 0.1)::INT) AS c FROM (SELECT src, sqrt(min(d2)) AS d FROM xp GROUP BY src)), "
    "s AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS span, count(*) - count(DISTINCT (x, y)) AS twice FROM xy), "
    "l AS (SELECT 100.0 * max(n) / sum(n) AS b FROM (SELECT count(*) AS n FROM xy GROUP BY label)), "
    "o AS (SELECT 100.0 * avg(o) / 30 AS kept FROM sh), r AS (SELECT corr(rd, rt) AS rho FROM rk) "
    "SELECT CASE WHEN c > 50 THEN 'issue' ELSE 'ok' END AS collapse, CASE WHEN twice > 0 THEN 'issue' ELSE 'ok' END AS duplicates, "
    "CASE WHEN b > 70 THEN 'issue' WHEN b > 50 THEN 'warning' ELSE 'ok' END AS balance, CASE WHEN span < 10 THEN 'small' WHEN span > 1000 THEN 'large' ELSE 'ok' END AS span, "
    "CASE WHEN kept < 30 THEN 'issue' WHEN kept < 50 THEN 'warning' ELSE 'good' END AS preservation, "
    "CASE WHEN rho > 0.5 THEN 'good' WHEN rho < 0.3 THEN 'warning' ELSE 'ok' END AS correlation FROM m, s, l, o, r"
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    one = lambda df: df.withColumn("one", F.lit(1))
    sep = evaluate.separation(flat).select("duplicate_coords", (100.0 * F.col("under_01") / (F.col("unique_coords") + F.col("duplicate_coords"))).alias("very_close_pct"))
    sizes = _labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((100.0 * F.max("n") / F.sum("n")).alias("max_cluster_pct"))
    row = one(sep).join(one(evaluate.spread(flat)), "one").join(one(sizes), "one")
    row = row.join(one(knn_preservation(spark, sf_dir)), "one").join(one(spearman(spark, sf_dir)), "one")
    return evaluate.verdicts(row)


@query()
def kmeans_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cluster_scores(_flat(spark, sf_dir))


@query(
    f"WITH {_XY}, n AS (SELECT label, count(*) AS n FROM xy GROUP BY label) SELECT {_cols(max_cluster_pct='100.0 * max(n) / sum(n)')}, min(n) AS min_cluster_size, "
    f"{_cols(cluster_std='stddev_pop(n)', cluster_imbalance='max(n) / min(n)')} FROM n"
)
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.cluster_sizes(_labels(spark, sf_dir)))


@query()
def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: all scores of the layout of ``embed_2d``."""
    points = cut(_points(spark, sf_dir), "points")
    at = cut(embed_2d(spark, sf_dir), "layout")
    flat = cut(flat_layout(at), "flat")
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(metrics(points, at, labels=_labels(spark, sf_dir))).join(one(evaluate.cluster_scores(flat)), "one")  # each has one row
    return row.drop("one")


# ---- sweeps ----


@query("SELECT p_size::DOUBLE AS p_size, " + _cols(mean="avg(p_retailprice)", std="stddev_samp(p_retailprice)") + ", count(*) AS n FROM part GROUP BY p_size")
def sweep_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.sensitivity(_runs(spark, sf_dir), "p_size", "p_retailprice"))


@query("SELECT " + _cols(mean="avg(p_retailprice)", median="median(p_retailprice)", least="min(p_retailprice)", most="max(p_retailprice)") + " FROM part")
def sweep_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.scalars(_runs(spark, sf_dir), "p_retailprice"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best(_runs(spark, sf_dir), "p_retailprice", "p_partkey")


@query("SELECT " + _cols(slope="regr_slope(p_retailprice, p_size)", intercept="regr_intercept(p_retailprice, p_size)") + " FROM part")
def sweep_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.trend(_runs(spark, sf_dir), "p_size", "p_retailprice"))


@query(
    "SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS test, a::DOUBLE AS epochs_coarse, b::DOUBLE AS epochs_fine FROM unnest([10, 25, 50, 100]) x(a), unnest([20, 50, 100, 200]) y(b)"
)
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep_configs(spark, evaluate.SWEEPS["epochs"])


@query(
    "SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS test, a::DOUBLE AS pull, b::DOUBLE AS shrink FROM unnest([2, 3, 4, 5]) x(a), unnest([0.6, 0.7, 0.8, 0.9]) y(b)"
)
def sweep_coarsening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep_configs(spark, evaluate.SWEEPS["coarsening"])
