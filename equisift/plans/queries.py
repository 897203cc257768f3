"""Queries of the selection engine over the driver's tables, and the same as SQL.

Roles: embeddings give rows (y: label of 5 or more, z: label odd); customers stand in for census rows; labels with documents for text rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prompts
from ..functions.lineage import settle, shared_dir
from ..functions.rng import uniform_sql
from ..operators import adaptive, clustering, encoding, estimate, evolution, metrics, neighbors, reports, sampling
from ..operators.predictors import Rule, SimilarityVote
from ..sources.tables import read_csv, table

SEED, K, BATCH, RATIO = 42, 5, 10, 0.2
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- rows


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("label") % 2).alias("z"))
    return encoding.cells(e).withColumn("score", F.round(F.abs(F.col("v")[0]), 6))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(rows(spark, sf_dir), "y", RATIO, SEED)


E_SQL = """e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, (label >= 5)::INT AS y, label % 2 AS z, 'g' || (label % 2) || ((label >= 5)::INT) AS sg,
  round(abs(embedding[1]::DOUBLE), 6) AS score FROM embeddings)"""
S_SQL = f"""{E_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {uniform_sql(SEED, 'split', 0)}, row_id) AS rn, count(*) OVER (PARTITION BY y) AS cnt FROM e),
s AS (SELECT * EXCLUDE (rn, cnt), CASE WHEN rn <= round(cnt * {RATIO}::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM ranked)"""
NN_SQL = f"""{S_SQL},
pool AS (SELECT * FROM s WHERE split = 'train'), test AS (SELECT * FROM s WHERE split = 'dev'),
sim AS (SELECT q.row_id AS q_id, p.row_id AS p_id, round(list_cosine_similarity(q.v, p.v), 9) AS sim FROM test q, pool p),
nn AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, p_id)::INT AS rank, p_id, sim FROM sim QUALIFY rank <= {K})"""
BATCH_SQL = f"""{NN_SQL},
pos AS (SELECT row_id AS q_id, ((row_number() OVER (ORDER BY row_id) - 1) // {BATCH})::BIGINT AS batch_id FROM test),
sets AS (SELECT batch_id, nn.* FROM nn JOIN pos USING (q_id))"""
#: test rows with the vote of their neighbours
P_SQL = f"""{NN_SQL},
vote AS (SELECT q_id, round(sum(sim * (2 * pool.y - 1)), 7) AS vote FROM nn JOIN pool ON pool.row_id = nn.p_id GROUP BY q_id),
pred AS (SELECT test.row_id, test.y, test.z, (vote > 0)::INT AS yhat FROM test JOIN vote ON vote.q_id = test.row_id)"""


def metric_sql(source: str, by: str = "") -> str:
    """The 14 metrics of (y, yhat, z) rows; by ends with a comma."""
    rate = lambda cond: f"coalesce(avg(yhat) FILTER (WHERE {cond}), 0)"
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""(SELECT *, abs("DP_1" - "DP_0") AS delta_dp, "DP_0" / ("DP_1" + 1e-10) AS ratio_dp, greatest(abs("TPR_1" - "TPR_0"), abs("FPR_1" - "FPR_0")) AS delta_eo,
  least("TPR_0" / ("TPR_1" + 1e-10), "FPR_0" / ("FPR_1" + 1e-10)) AS ratio_eo FROM (SELECT {by} avg((y = yhat)::INT) AS accuracy,
  CASE WHEN count(*) FILTER (yhat = 1) > 0 THEN count(*) FILTER (y = 1 AND yhat = 1) / count(*) FILTER (yhat = 1) ELSE 0 END AS precision,
  CASE WHEN count(*) FILTER (y = 1) > 0 THEN count(*) FILTER (y = 1 AND yhat = 1) / count(*) FILTER (y = 1) ELSE 0 END AS recall,
  CASE WHEN count(*) FILTER (y = 1 OR yhat = 1) > 0 THEN 2 * count(*) FILTER (y = 1 AND yhat = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (yhat = 1)) ELSE 0 END AS f1_score,
  {rate('z = 0')} AS "DP_0", {rate('z = 1')} AS "DP_1", {rate('y = 1 AND z = 0')} AS "TPR_0", {rate('y = 1 AND z = 1')} AS "TPR_1", {rate('y = 0 AND z = 0')} AS "FPR_0", {rate('y = 0 AND z = 1')} AS "FPR_1"
  FROM {source} {group}))"""


def round_sql(names, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in names)


def neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = split(spark, sf_dir)
    test, pool = s.filter("split = 'dev'"), s.filter("split = 'train'")
    return neighbors.nearest(test, pool, K), test, pool


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test row's nearest neighbours vote with their similarity."""
    nn, test, pool = neighbours(spark, sf_dir)
    votes = nn.join(pool.select(F.col("row_id").alias("p_id"), F.col("y").alias("py")), "p_id").groupBy("q_id").agg(F.round(F.sum(F.col("sim") * (2 * F.col("py") - 1)), 7).alias("vote"))
    return test.join(votes, test.row_id == votes.q_id).select("row_id", "y", "z", F.when(F.col("vote") > 0, 1).otherwise(0).alias("yhat"))


def batched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nn, test, pool = neighbours(spark, sf_dir)
    ids = sampling.batch_ids(test.select("row_id"), "row_id", BATCH).select(F.col("row_id").alias("q_id"), "batch_id")
    return neighbors.support(nn, ids), pool


# ---- sources, cleaning, cells


@query(
    "q01_label_encoding",
    """SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang, (dense_rank() OVER (ORDER BY source) - 1)::INT AS source FROM documents""",
)
def q01(spark, sf_dir):
    return encoding.encode(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"])


@query(
    "q02_clean_missing",
    """SELECT event_id, user_id, nullif(event_type, 'click') AS event_type, value FROM events WHERE event_type <> 'click' AND event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL""",
)
def q02(spark, sf_dir):
    return encoding.clean(table(spark, sf_dir, "events"), ("ts", "props"), missing="click")


@query("q03_cells", f"WITH {E_SQL} SELECT sg, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(z), 6) AS share_z FROM e GROUP BY sg")
def q03(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("sg").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("z"), 6).alias("share_z"))


@query("q04_stratified_split", f"WITH {S_SQL} SELECT row_id, y, split FROM s")
def q04(spark, sf_dir):
    return split(spark, sf_dir).select("row_id", "y", "split")


@query("q05_dev_sample", f"WITH {E_SQL} SELECT row_id, y, z FROM e ORDER BY {uniform_sql(SEED, 'dev', 0)}, row_id LIMIT 50")
def q05(spark, sf_dir):
    return sampling.sample(rows(spark, sf_dir).select("row_id", "y", "z"), 50, SEED, "dev")


@query("q06_head", f"WITH {E_SQL} SELECT row_id, y, z FROM e ORDER BY row_id LIMIT 100")
def q06(spark, sf_dir):
    return sampling.head(rows(spark, sf_dir).select("row_id", "y", "z"), 100)


# ---- metrics


@query("q07_performance", f"WITH {P_SQL} SELECT {round_sql(metrics.PERFORMANCE)} FROM {metric_sql('pred')}")
def q07(spark, sf_dir):
    return metrics.rounded(metrics.performance(predictions(spark, sf_dir)), metrics.PERFORMANCE)


@query("q08_demographic_parity", f"WITH {P_SQL} SELECT {round_sql(metrics.FAIRNESS[:4])} FROM {metric_sql('pred')}")
def q08(spark, sf_dir):
    return metrics.rounded(metrics.demographic_parity(predictions(spark, sf_dir)), metrics.FAIRNESS[:4])


@query("q09_equalized_odds", f"WITH {P_SQL} SELECT {round_sql(metrics.FAIRNESS[4:])} FROM {metric_sql('pred')}")
def q09(spark, sf_dir):
    return metrics.rounded(metrics.equalized_odds(predictions(spark, sf_dir)), metrics.FAIRNESS[4:])


@query("q10_all_metrics", f"WITH {P_SQL} SELECT {round_sql(metrics.ALL)} FROM {metric_sql('pred')}")
def q10(spark, sf_dir):
    return metrics.rounded(metrics.evaluate(predictions(spark, sf_dir)), metrics.ALL)


LINES_SQL = "(SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, (l_linestatus = 'O')::INT AS z0, (l_linenumber % 2) AS z, (l_quantity > 25)::INT AS yhat FROM lineitem)"


@query("q10_metrics_by_group", f"SELECT l_linestatus, {round_sql(metrics.ALL)} FROM {metric_sql(LINES_SQL, 'l_linestatus, ')}")
def q10_group(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pred = l.select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") % 2).alias("z"), (F.col("l_quantity") > 25).cast("int").alias("yhat"))
    return metrics.rounded(metrics.evaluate(pred, ["l_linestatus"]), metrics.ALL)


ERR_SQL = lambda c: f'round(0.5 * (1 - "{c}") + 0.5 * abs("DP_0" - "DP_1"), 6)'


@query("q11_combined_error", f"WITH {P_SQL} SELECT {', '.join(f'{ERR_SQL(c)} AS err_{c}' for c in metrics.PERFORMANCE)} FROM {metric_sql('pred')}")
def q11(spark, sf_dir):
    m = metrics.evaluate(predictions(spark, sf_dir))
    return m.select(*[F.round(metrics.combined_error(0.5, c), 6).alias(f"err_{c}") for c in metrics.PERFORMANCE])


ZERO_SQL = "SELECT row_id, y, z, (score >= 0.1)::INT AS yhat FROM test"


@query(
    "q12_evolution_score",
    f"WITH {P_SQL}, zero AS ({ZERO_SQL}) SELECT round(0.5 * greatest(i.f1_score - b.f1_score, 0.05) + 0.5 * greatest(i.ratio_eo - b.ratio_eo, 0.05), 6) AS score FROM {metric_sql('pred')} i, {metric_sql('zero')} b",
)
def q12(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    zero = split(spark, sf_dir).filter("split = 'dev'").select("y", "z", F.when(F.col("score") >= 0.1, 1).otherwise(0).alias("yhat"))
    icl, base = (metrics.evaluate(p).select(*[F.col(c).alias(n + c) for c in metrics.ALL]) for p, n in ((pred, "icl_"), (zero, "base_")))
    # Both are one row.
    return icl.join(F.broadcast(base)).select(F.round(metrics.evolution_score("icl_", "base_", 0.5, 0.05, "f1_score", "ratio_eo"), 6).alias("score"))


# ---- draws, evolution, selection


def draw_sql(source: str, round_: int, k: int = K) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY sg ORDER BY CASE WHEN score > 0 THEN -ln({uniform_sql(SEED, 'roulette', round_)}) / score END NULLS LAST, row_id) <= {k}"


@query("q13_roulette", f"WITH {E_SQL} SELECT sg, row_id, score FROM ({draw_sql('e', 1)})")
def q13(spark, sf_dir):
    return sampling.roulette(rows(spark, sf_dir), "sg", K, SEED, 1).select("sg", "row_id", "score")


def evolve_sql(i: int) -> str:
    """Round i of the evolution: s{i} from s{i - 1}."""
    return f"""d{i} AS ({draw_sql(f'scored{i - 1}', i)}),
v{i} AS (SELECT d.sg AS set_id, t.row_id, any_value(t.y) AS y, any_value(t.z) AS z, (round(sum(list_cosine_similarity(t.v, d.v) * (2 * d.y - 1)), 9) > 0)::INT AS yhat FROM dev t, d{i} d GROUP BY d.sg, t.row_id),
e{i} AS (SELECT set_id, round(0.5 * greatest(m.f1_score - b.f1_score, 0.05) + 0.5 * greatest(m.ratio_eo - b.ratio_eo, 0.05), 9) AS e FROM {metric_sql(f'v{i}', 'set_id, ')} m, base b),
scored{i} AS (SELECT p.* EXCLUDE (score), CASE WHEN d.row_id IS NOT NULL THEN (p.score + e.e) / 2 ELSE p.score END AS score FROM scored{i - 1} p LEFT JOIN d{i} d ON d.row_id = p.row_id LEFT JOIN e{i} e ON e.set_id = p.sg)"""


EVOLVE_SQL = f"""{S_SQL}, dev AS (SELECT * FROM s WHERE split = 'dev'), scored0 AS (SELECT * FROM s WHERE split = 'train'),
zero AS (SELECT y, z, 0 AS yhat FROM dev), base AS (SELECT * FROM {metric_sql('zero')}), {evolve_sql(1)}, {evolve_sql(2)}"""


def evolved(spark, sf_dir, rounds: int = 2) -> DataFrame:
    s = split(spark, sf_dir)
    return evolution.evolve(s.filter("split = 'train'").drop("split"), settle(s.filter("split = 'dev'").drop("split")), SimilarityVote(), rounds, K, SEED, zero_shot=Rule("false"))


@query("q14_evolution", f"WITH {EVOLVE_SQL} SELECT sg, row_id, round(score, 6) AS score FROM scored2")
def q14(spark, sf_dir):
    return evolved(spark, sf_dir).select("sg", "row_id", F.round("score", 6).alias("score"))


@query("q15_top_k", f"WITH {E_SQL} SELECT sg, row_id, score, row_number() OVER (PARTITION BY sg ORDER BY score DESC, row_id)::INT AS rank FROM e QUALIFY rank <= {K}")
def q15(spark, sf_dir):
    return sampling.top_k(rows(spark, sf_dir), "sg", K).select("sg", "row_id", "score", "rank")


@query("q16_nearest_neighbours", f"WITH {NN_SQL} SELECT q_id, rank, p_id, round(sim, 6) AS sim FROM nn")
def q16(spark, sf_dir):
    return neighbours(spark, sf_dir)[0].withColumn("sim", F.round("sim", 6))


@query("q17_support_union", f"WITH {BATCH_SQL} SELECT DISTINCT batch_id, p_id FROM sets")
def q17(spark, sf_dir):
    return neighbors.support_union(batched(spark, sf_dir)[0])


@query(
    "q18_validation_candidates",
    f"""WITH {BATCH_SQL} SELECT 'validation' AS part, batch_id, p_id, count(*) AS n FROM sets WHERE rank = 1 GROUP BY ALL UNION ALL
SELECT 'candidate', batch_id, p_id, 1 FROM (SELECT DISTINCT batch_id, p_id FROM sets) c WHERE NOT EXISTS (SELECT 1 FROM sets v WHERE v.rank = 1 AND v.batch_id = c.batch_id AND v.p_id = c.p_id)""",
)
def q18(spark, sf_dir):
    sets = batched(spark, sf_dir)[0]
    valid = neighbors.validation(sets).groupBy("batch_id", "p_id").agg(F.count("*").alias("n"))
    cand = neighbors.candidates(sets).withColumn("n", F.lit(1).cast("bigint"))
    return valid.withColumn("part", F.lit("validation")).unionByName(cand.withColumn("part", F.lit("candidate")))


CLUSTERS, MEMBERS = 4, 5
CENTROID_SQL = f"c0 AS (SELECT sg, (row_number() OVER w - 1)::INT AS cluster, v AS c FROM e WINDOW w AS (PARTITION BY sg ORDER BY {uniform_sql(SEED, 'kmeans', 0)}, row_id) QUALIFY row_number() OVER w <= {CLUSTERS})"


def assign_sql(i: int) -> str:
    return f"a{i} AS (SELECT e.*, c.cluster, round(list_distance(e.v, c.c), 9) AS dist FROM e JOIN c{i} c ON c.sg = e.sg QUALIFY row_number() OVER (PARTITION BY e.row_id ORDER BY dist, cluster) = 1)"


def update_sql(i: int) -> str:
    return f"""x{i} AS (SELECT sg, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}),
m{i} AS (SELECT sg, cluster, list(x ORDER BY pos) AS mean FROM (SELECT sg, cluster, pos, round(avg(x), 9) AS x FROM x{i} GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS (SELECT c.sg, c.cluster, coalesce(m.mean, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.sg = c.sg AND m.cluster = c.cluster)"""


def represent_sql(i: int) -> str:
    return f"""o AS (SELECT *, (row_number() OVER (PARTITION BY sg, cluster ORDER BY dist, row_id) <= {MEMBERS})::INT AS in_cluster FROM a{i})
SELECT sg, row_id, cluster, round(dist, 6) AS dist, in_cluster FROM o QUALIFY row_number() OVER (PARTITION BY sg ORDER BY in_cluster DESC, dist, row_id) <= {CLUSTERS * MEMBERS}"""


@query("q19_representatives", f"WITH {E_SQL}, {CENTROID_SQL}, {assign_sql(0)}, {represent_sql(0)}")
def q19(spark, sf_dir):
    e = rows(spark, sf_dir)
    out = clustering.representatives(e, clustering.first_centroids(e, CLUSTERS, SEED), CLUSTERS, MEMBERS)
    return out.select("sg", "row_id", "cluster", F.round("dist", 6).alias("dist"), "in_cluster")


@query("q20_kmeans_representatives", f"WITH {E_SQL}, {CENTROID_SQL}, {assign_sql(0)}, {update_sql(0)}, {assign_sql(1)}, {update_sql(1)}, {assign_sql(2)}, {represent_sql(2)}")
def q20(spark, sf_dir):
    e = rows(spark, sf_dir)
    out = clustering.representatives(e, clustering.lloyd(e, CLUSTERS, 2, SEED), CLUSTERS, MEMBERS)
    return out.select("sg", "row_id", "cluster", F.round("dist", 6).alias("dist"), "in_cluster")


# ---- texts

PERSON_SQL = """person AS (SELECT c_custkey AS row_id, 18 + c_custkey % 60 AS age, lower(c_mktsegment) AS workclass, 'edu' || c_nationkey AS education, CASE WHEN c_custkey % 3 = 0 THEN 'single' ELSE 'married' END AS marital_status,
  'job' || (c_custkey % 7) AS occupation, 'rel' || (c_custkey % 4) AS relationship, c_custkey % 3 AS sex, c_custkey % 11 * 100 AS capital_gain, c_custkey % 5 * 10 AS capital_loss, 20 + c_custkey % 40 AS hours_per_week, (c_acctbal > 4500)::INT AS income FROM customer)"""


def persons(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("row_id"), (18 + k % 60).alias("age"), F.lower("c_mktsegment").alias("workclass"), F.concat(F.lit("edu"), "c_nationkey").alias("education"),
        F.when(k % 3 == 0, "single").otherwise("married").alias("marital_status"), F.concat(F.lit("job"), k % 7).alias("occupation"), F.concat(F.lit("rel"), k % 4).alias("relationship"),
        (k % 3).alias("sex"), (k % 11 * 100).alias("capital_gain"), (k % 5 * 10).alias("capital_loss"), (20 + k % 40).alias("hours_per_week"), (F.col("c_acctbal") > 4500).cast("int").alias("income"),
    )


def text_sql(embedding: bool) -> str:
    names = prompts.EMBEDDING_NAMES if embedding else {}
    value = lambda c: "CASE sex WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE sex::VARCHAR END" if c == "sex" else f"{c}::VARCHAR"
    return " || ', ' || ".join(f"'{names.get(t, t)}: ' || {value(c)}" for t, c in prompts.PROMPT_FIELDS)


LABEL_SQL = "' -> Income: ' || CASE income WHEN 0 THEN 'less than or equal to 50K' ELSE 'greater than 50K' END"


@query(
    "q21_prompts",
    f"""WITH {PERSON_SQL}, demo AS (SELECT *, row_number() OVER (PARTITION BY income ORDER BY row_id) AS pos FROM person QUALIFY pos <= 2),
block AS (SELECT string_agg({text_sql(False)} || {LABEL_SQL} || chr(10), '' ORDER BY pos, row_id) AS b FROM demo)
SELECT row_id, {text_sql(True)} AS embedding_text, md5('{prompts.TASK.replace("'", "''")}' || chr(10) || chr(10) || 'Here are some examples:' || chr(10) || chr(10) || b || chr(10) || 'Now predict for this person:' || chr(10) || {text_sql(False)} || chr(10) || chr(10) || 'Income prediction:') AS prompt_md5
FROM person, block""",
)
def q21(spark, sf_dir):
    p = persons(spark, sf_dir).withColumn("set_id", F.lit(1))
    demos = sampling.top_k(p.withColumn("neg", -F.col("row_id")), "income", 2, "neg").withColumn("pos", F.struct(F.col("rank"), F.col("row_id")))
    out = prompts.prompts(p, demos, ["set_id"])
    return out.select("row_id", prompts.embedding_row().alias("embedding_text"), F.md5("prompt").alias("prompt_md5"))


ANSWERS = ("Greater than 50K", " less than or equal to 50K.", "I say >50k", "<=50K", "not greater than 50 K", "unclear")


@query(
    "q22_response_parse",
    f"""WITH a AS (SELECT conv_id, turn, ({list(ANSWERS)!r})[1 + (conv_id + turn) % {len(ANSWERS)}] || ' ' || text AS t FROM conversations),
b AS (SELECT *, lower(trim(t)) AS s FROM a)
SELECT conv_id, turn, CASE WHEN contains(s, 'greater than 50k') OR contains(s, '>50k') OR contains(s, 'greater than 50 k') THEN 1 ELSE 0 END AS yhat FROM b""",
)
def q22(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (1 + (F.col("conv_id") + F.col("turn")) % len(ANSWERS)).cast("int"))
    return c.select("conv_id", "turn", prompts.parse_response(F.concat(said, F.lit(" "), "text")).alias("yhat"))


@query("q23_few_shot_predictions", f"WITH {P_SQL} SELECT row_id, y, z, yhat FROM pred")
def q23(spark, sf_dir):
    return predictions(spark, sf_dir)


# ---- adaptive search, reports


def searched(spark, sf_dir, rounds: int):
    sets, pool = batched(spark, sf_dir)
    return adaptive.search(sets, settle(pool.select("row_id", "y", "z", "v")), SimilarityVote(), rounds)


def search_sql() -> str:
    """Two rounds, unrolled."""
    out = [f"""{BATCH_SQL}, valid AS (SELECT batch_id, q_id, pool.y, pool.z, pool.v FROM sets JOIN pool ON pool.row_id = sets.p_id WHERE rank = 1),
st1 AS (SELECT batch_id, q_id, max(rank) AS most, 2 AS upto FROM sets GROUP BY ALL)"""]
    for i in (1, 2):
        out.append(f"""now{i} AS (SELECT s.batch_id, s.q_id, s.p_id FROM sets s JOIN st{i} t ON t.batch_id = s.batch_id AND t.q_id = s.q_id WHERE s.rank BETWEEN 2 AND t.upto OR (t.most = 1 AND s.rank = 1)),
op{i} AS (SELECT n.batch_id, n.q_id AS j, v.q_id, any_value(v.y) AS y, any_value(v.z) AS z, (round(sum(list_cosine_similarity(v.v, p.v) * (2 * p.y - 1)), 9) > 0)::INT AS yhat
  FROM now{i} n JOIN valid v ON v.batch_id = n.batch_id JOIN pool p ON p.row_id = n.p_id GROUP BY n.batch_id, n.q_id, v.q_id),
tp{i} AS (SELECT n.batch_id, v.q_id, any_value(v.y) AS y, any_value(v.z) AS z, (round(sum(list_cosine_similarity(v.v, p.v) * (2 * p.y - 1)), 9) > 0)::INT AS yhat
  FROM now{i} n JOIN valid v ON v.batch_id = n.batch_id JOIN pool p ON p.row_id = n.p_id GROUP BY n.batch_id, v.q_id),
own{i} AS (SELECT batch_id, j, round(0.5 * (1 - f1_score) + 0.5 * abs("DP_0" - "DP_1"), 9) AS err FROM {metric_sql(f'op{i}', 'batch_id, j, ')}),
weak{i} AS (SELECT batch_id, j AS weakest FROM own{i} QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY err DESC, j) = 1),
tr{i} AS (SELECT m.batch_id, {i} AS round, round(0.5 * (1 - f1_score) + 0.5 * abs("DP_0" - "DP_1"), 9) AS err, w.weakest, (SELECT count(*) FROM now{i} n WHERE n.batch_id = m.batch_id) AS n
  FROM {metric_sql(f'tp{i}', 'batch_id, ')} m JOIN weak{i} w ON w.batch_id = m.batch_id),
st{i + 1} AS (SELECT t.batch_id, t.q_id, t.most, CASE WHEN w.weakest = t.q_id AND t.upto < t.most THEN t.upto + 1 ELSE t.upto END AS upto FROM st{i} t JOIN weak{i} w ON w.batch_id = t.batch_id)""")
    return ", ".join(out)


@query("q24_adaptive_search", f"WITH {search_sql()} SELECT batch_id, round, round(err, 6) AS err, weakest, n FROM (SELECT * FROM tr1 UNION ALL SELECT * FROM tr2)")
def q24(spark, sf_dir):
    return searched(spark, sf_dir, 2)[1].withColumn("err", F.round("err", 6))


@query(
    "q24_adaptive_demonstrations",
    f"""WITH {search_sql()}, best AS (SELECT batch_id, CASE WHEN b.err < a.err THEN 2 ELSE 1 END AS r FROM tr1 a JOIN tr2 b USING (batch_id))
SELECT batch_id, p_id, count(*) AS n FROM (SELECT n.batch_id, n.p_id FROM now1 n JOIN best b ON b.batch_id = n.batch_id AND b.r = 1 UNION ALL SELECT n.batch_id, n.p_id FROM now2 n JOIN best b ON b.batch_id = n.batch_id AND b.r = 2) GROUP BY ALL""",
)
def q24_best(spark, sf_dir):
    return searched(spark, sf_dir, 2)[0].groupBy("batch_id", "p_id").agg(F.count("*").alias("n"))


CONFIG_SQL = "SELECT n_name AS name, n_regionkey + 1 AS k_shots, 10 * (n_nationkey + 1) AS max_dev_samples, 25 * (n_nationkey + 1) AS max_test_samples, 2 + n_regionkey AS iterations, 8 + n_nationkey AS batch_size, 5 AS k_neighbors, 3 AS l_iterations, n_regionkey <> 2 AS with_search FROM nation"


@query(
    "q25_estimate",
    f"""WITH c AS ({CONFIG_SQL}), f AS (SELECT *, 155 AS zero, 170 + 280 * k_shots AS few, 170 + 70 * k_neighbors AS near, max_dev_samples AS dev, max_test_samples AS test,
  with_search::INT * ((max_test_samples + batch_size - 1) // batch_size) * batch_size ** 2 * l_iterations AS searched FROM c),
t AS (SELECT *, dev * zero + dev * iterations * few + test * zero + test * few AS one, dev * zero + dev * iterations * few + test * zero + test * few + searched * near AS total FROM f)
SELECT name, dev::BIGINT AS baseline_calls, (dev * zero)::BIGINT AS baseline_tokens, (dev * iterations)::BIGINT AS evolution_calls, (dev * iterations * few)::BIGINT AS evolution_tokens, (2 * test)::BIGINT AS test_calls,
  (test * (zero + few))::BIGINT AS test_tokens, searched::BIGINT AS search_calls, (searched * near)::BIGINT AS search_tokens, (dev + dev * iterations + 2 * test)::BIGINT AS phase_one_calls, one::BIGINT AS phase_one_tokens,
  (dev + dev * iterations + 2 * test + searched)::BIGINT AS grand_total_calls, total::BIGINT AS grand_total_tokens, round((floor(total * 0.95::DOUBLE) * 0.1::DOUBLE + floor(total * 0.05::DOUBLE) * 0.2::DOUBLE) / 1e6, 6) AS estimated_cost_usd,
  zero::BIGINT AS tokens_per_zero_shot, few::BIGINT AS tokens_per_few_shot, (4 * k_shots)::BIGINT AS total_demonstrations FROM t""",
)
def q25(spark, sf_dir):
    return estimate.estimate(spark.sql(CONFIG_SQL.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation")))


@query("q26_batches", "SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 1000)::BIGINT AS batch_id FROM events")
def q26(spark, sf_dir):
    return sampling.batch_ids(table(spark, sf_dir, "events").select("event_id"), "event_id", 1000)


BOTH_SQL = f"{P_SQL}, zero AS ({ZERO_SQL}), both_ AS (SELECT 'few_shot' AS method, y, z, yhat FROM pred UNION ALL SELECT 'zero_shot', y, z, yhat FROM zero), m AS (SELECT * FROM {metric_sql('both_', 'method, ')})"


def both(spark, sf_dir) -> DataFrame:
    few = predictions(spark, sf_dir).select(F.lit("few_shot").alias("method"), "y", "z", "yhat")
    zero = split(spark, sf_dir).filter("split = 'dev'").select(F.lit("zero_shot").alias("method"), "y", "z", F.when(F.col("score") >= 0.1, 1).otherwise(0).alias("yhat"))
    return metrics.evaluate(few.unionByName(zero), ["method"])


@query(
    "q27_results_long",
    f"WITH {BOTH_SQL} SELECT 'evaluation' AS type, method, metric, round(value, 6) AS value FROM (UNPIVOT m ON {', '.join(chr(34) + c + chr(34) for c in metrics.ALL)} INTO NAME metric VALUE value)",
)
def q27(spark, sf_dir):
    return reports.results(both(spark, sf_dir)).select("type", "method", "metric", F.round("value_num", 6).alias("value"))


@query("q28_score_stats", f"WITH {E_SQL} SELECT sg, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM e GROUP BY sg")
def q28(spark, sf_dir):
    return metrics.rounded(reports.score_stats(rows(spark, sf_dir)), ("mean", "std"))


@query(
    "q28_score_extremes",
    f"""WITH {E_SQL}, r AS (SELECT sg, score, row_number() OVER (PARTITION BY sg ORDER BY score DESC) AS hi, row_number() OVER (PARTITION BY sg ORDER BY score) AS lo FROM e)
SELECT sg, 'top' AS kind, hi::INT AS rank, score FROM r WHERE hi <= 3 UNION ALL SELECT sg, 'bottom', lo::INT, score FROM r WHERE lo <= 3""",
)
def q28_extremes(spark, sf_dir):
    return reports.score_extremes(rows(spark, sf_dir))


@query(
    "q28_demo_stats",
    f"WITH {PERSON_SQL} SELECT count(*) AS n, count(*) FILTER (sex = 0) AS sex_0, count(*) FILTER (sex = 1) AS sex_1, count(*) FILTER (income = 0) AS income_0, count(*) FILTER (income = 1) AS income_1, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS std, min(age) AS min, max(age) AS max FROM person",
)
def q28_demo(spark, sf_dir):
    return metrics.rounded(reports.demo_stats(persons(spark, sf_dir), "age", "sex", "income"), ("mean", "std"))


@query(
    "q29_keys",
    """WITH k AS (SELECT '"' || p_brand || p_size || '" ' AS raw, p_partkey AS pos FROM part), b AS (SELECT regexp_replace(regexp_replace(trim(raw), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS key, pos FROM k)
SELECT key, min(pos) AS pos, CASE WHEN length(key) > 8 THEN left(key, 4) || '...' || right(key, 4) ELSE '****' END AS masked FROM b GROUP BY key""",
)
def q29(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit('"'), "p_brand", "p_size", F.lit('" ')).alias("raw"), F.col("p_partkey").alias("pos"))
    return sampling.first_of_each(raw, "raw", "pos").withColumn("masked", prompts.mask_key("key"))


@query(
    "q31_improvements",
    f"""WITH {BOTH_SQL}, a AS (SELECT * FROM m WHERE method = 'few_shot'), b AS (SELECT * FROM m WHERE method = 'zero_shot')
SELECT round(a.accuracy - b.accuracy, 6) AS gain_accuracy, round(a.f1_score - b.f1_score, 6) AS gain_f1_score, round(a.ratio_eo - b.ratio_eo, 6) AS gain_ratio_eo, round(b.delta_eo - a.delta_eo, 6) AS gain_delta_eo FROM a, b""",
)
def q31(spark, sf_dir):
    return metrics.rounded(reports.improvements(both(spark, sf_dir), "zero_shot", "few_shot"), ("gain_accuracy", "gain_f1_score", "gain_ratio_eo", "gain_delta_eo"))


RUNS_SQL = "(SELECT l_returnflag || l_linestatus AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'few_shot' ELSE 'zero_shot' END AS method, (l_discount > 0.05)::INT AS y, (l_quantity > 25)::INT AS yhat, (l_tax > 0.04)::INT AS z FROM lineitem)"


def runs(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.concat("l_returnflag", "l_linestatus").alias("run"), F.when(F.col("l_linenumber") % 2 == 0, "few_shot").otherwise("zero_shot").alias("method"),
        (F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("yhat"), (F.col("l_tax") > 0.04).cast("int").alias("z"),
    )


@query(
    "q32_across_runs",
    f"WITH m AS (SELECT * FROM {metric_sql(RUNS_SQL, 'run, method, ')}) SELECT run, round(max(f1_score) FILTER (method = 'few_shot'), 6) AS few_shot, round(max(f1_score) FILTER (method = 'zero_shot'), 6) AS zero_shot FROM m GROUP BY run",
)
def q32(spark, sf_dir):
    long = metrics.long_form(metrics.evaluate(runs(spark, sf_dir), ["run", "method"]), ["run", "method"])
    return metrics.rounded(reports.across_runs(long, "f1_score", ["few_shot", "zero_shot"]), ("few_shot", "zero_shot"))


# ---- features


@query(
    "q33_features",
    f"WITH {PERSON_SQL} SELECT row_id, income, [age::DOUBLE, sex::DOUBLE, capital_gain::DOUBLE, capital_loss::DOUBLE, hours_per_week::DOUBLE] AS features FROM person",
)
def q33(spark, sf_dir):
    p = persons(spark, sf_dir).select("row_id", "age", "sex", "capital_gain", "capital_loss", "hours_per_week", "income")
    return encoding.features(p, ("row_id", "income")).select("row_id", "income", "features")


@query(
    "q34_csv_rows",
    f"WITH {PERSON_SQL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, age, workclass, occupation, sex, income FROM person",
)
def q34(spark, sf_dir):
    """Rows written as a headerless CSV with blanks after commas, and read back: row_id is a row's place."""
    p = persons(spark, sf_dir).select(F.col("row_id").alias("at"), F.concat_ws(", ", "age", "workclass", "occupation", "sex", "income").alias("line"))
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    p.orderBy("at").select("line").write.text(path)
    return read_csv(spark, path, "age long, workclass string, occupation string, sex long, income int")


from . import search_queries  # noqa: E402, F401  registers its queries here
