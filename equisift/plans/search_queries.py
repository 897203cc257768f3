"""Queries of seeding, starts, neighbours by pivots, sweeps and stores over the driver's tables, and the same as SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions.lineage import settle, shared_dir
from ..functions.rng import uniform_sql
from ..operators import evolution, kmeans, metrics, neighbors, reports
from ..operators.predictors import RemoteModel, Rule, SimilarityVote
from ..sources import tables
from ..sources.answers import AnswerJournal
from ..sources.embeddings import EmbeddingStore
from ..sources.tables import table
from .queries import BOTH_SQL, CLUSTERS, E_SQL, K, RUNS_SQL, S_SQL, SEED, both, metric_sql, query, round_sql, rows, runs, split
from .selector import few_shot_by_metric

# ---- clustering: seeds and starts

STARTS, SEED_ROUNDS, DRAW = 3, 2, 6


def u_sql(tag: str, round_: str, row_id: str = "row_id") -> str:
    """uniform_sql with a round that is an expression."""
    return f"((('0x' || substr(md5(concat_ws(':', '{SEED}', '{tag}', {round_}, {row_id}::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def candidates_sql() -> str:
    """cand{r}: (sg, start, row_id, v) after r rounds of draws; w: with the number of rows nearest to each."""
    out = [f"cand0 AS (SELECT sg, start, row_id, v FROM e, (SELECT unnest(range({STARTS})) AS start) QUALIFY row_number() OVER (PARTITION BY sg, start ORDER BY {u_sql('kmeans', 'start::VARCHAR')}, row_id) = 1)"]
    for r in range(1, SEED_ROUNDS + 1):
        u = u_sql("seeding", f"start || '.{r}'")
        out.append(f"""near{r} AS (SELECT e.sg, start, e.row_id, any_value(e.v) AS v, min(round(list_distance(e.v, c.v), 9)) AS d FROM e JOIN cand{r - 1} c ON c.sg = e.sg GROUP BY e.sg, start, e.row_id),
cand{r} AS (SELECT * FROM cand{r - 1} UNION ALL SELECT sg, start, row_id, v FROM near{r} WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY sg, start ORDER BY -ln({u}) / (d * d), row_id) <= {DRAW})""")
    out.append(f"""own AS (SELECT e.sg, start, e.row_id, c.row_id AS cand FROM e JOIN cand{SEED_ROUNDS} c ON c.sg = e.sg QUALIFY row_number() OVER (PARTITION BY e.row_id, start ORDER BY round(list_distance(e.v, c.v), 9), c.row_id) = 1),
w AS (SELECT c.*, count(own.row_id) AS weight FROM cand{SEED_ROUNDS} c LEFT JOIN own ON own.sg = c.sg AND own.start = c.start AND own.cand = c.row_id GROUP BY ALL)""")
    return ", ".join(out)


def picks_sql() -> str:
    """picks: (sg, start, cluster, row_id, v, weight)."""
    u = lambda step: u_sql("picks", f"start || '.{step}'")
    out = [f"pick0 AS (SELECT sg, start, 0 AS cluster, row_id, v, weight FROM w WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY sg, start ORDER BY -ln({u(0)}) / weight, row_id) = 1)"]
    for step in range(1, CLUSTERS):
        out.append(f"""far{step} AS (SELECT w.sg, w.start, w.row_id, any_value(w.v) AS v, any_value(w.weight) AS weight, min(round(list_distance(w.v, p.v), 9)) AS d FROM w JOIN pick{step - 1} p ON p.sg = w.sg AND p.start = w.start GROUP BY w.sg, w.start, w.row_id),
pick{step} AS (SELECT * FROM pick{step - 1} UNION ALL SELECT sg, start, {step}, row_id, v, weight FROM far{step} WHERE d > 0 AND weight > 0 QUALIFY row_number() OVER (PARTITION BY sg, start ORDER BY -ln({u(step)}) / (weight * d * d), row_id) = 1)""")
    return ", ".join(out)


@query("q35_parallel_seeding", f"WITH {E_SQL}, {candidates_sql()}, {picks_sql()} SELECT sg, start::INT AS start, cluster::INT AS cluster, row_id, weight FROM pick{CLUSTERS - 1}")
def q35(spark, sf_dir):
    """The seeds that k-means|| picks in each cell, for each of several starts."""
    found = kmeans.candidates(rows(spark, sf_dir), SEED, STARTS, SEED_ROUNDS, DRAW)
    out = [(name, s, i, row_id, int(w)) for (name, s), own in found.items() for i, (row_id, _, w) in enumerate(kmeans.picked(own, CLUSTERS, SEED, s))]
    return spark.createDataFrame(out, "sg string, start int, cluster int, row_id long, weight long")


def starts_sql(i: int) -> str:
    return f"""a{i} AS (SELECT e.*, c.start, c.cluster, round(list_distance(e.v, c.c), 9) AS dist FROM e JOIN c{i} c ON c.sg = e.sg QUALIFY row_number() OVER (PARTITION BY e.row_id, c.start ORDER BY dist, c.cluster) = 1),
x{i} AS (SELECT sg, start, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}),
m{i} AS (SELECT sg, start, cluster, list(x ORDER BY pos) AS mean FROM (SELECT sg, start, cluster, pos, round(avg(x), 9) AS x FROM x{i} GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS (SELECT c.sg, c.start, c.cluster, coalesce(m.mean, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.sg = c.sg AND m.start = c.start AND m.cluster = c.cluster)"""


@query(
    "q36_kmeans_starts",
    f"""WITH {E_SQL}, {candidates_sql()}, {picks_sql()}, c0 AS (SELECT sg, start, cluster, v AS c FROM pick{CLUSTERS - 1}), {starts_sql(0)}, {starts_sql(1)}, {starts_sql(2)},
cost AS (SELECT sg, start, round(sum(dist * dist), 6) AS cost FROM a2 GROUP BY ALL)
SELECT sg, start::INT AS start, cost, row_number() OVER (PARTITION BY sg ORDER BY cost, start) = 1 AS best FROM cost""",
)
def q36(spark, sf_dir):
    """The cost of each start after two rounds, and which start a cell keeps."""
    e = rows(spark, sf_dir)
    _, cost = kmeans.run(e, kmeans.parallel_seeds(e, CLUSTERS, SEED, STARTS, SEED_ROUNDS, DRAW), 2)
    best = kmeans.best_starts(cost)
    return spark.createDataFrame([(name, s, c, best[name] == s) for (name, s), c in cost.items()], "sg string, start int, cost double, best boolean")


# ---- neighbours


@query(
    "q37_pivot_neighbours",
    f"""WITH p AS (SELECT p_partkey AS row_id, [p_size::DOUBLE - 25, p_retailprice::DOUBLE / 50 - 25, (p_partkey % 7)::DOUBLE - 3, (length(p_name) % 9)::DOUBLE - 4] AS v FROM part),
s AS (SELECT q.row_id AS q_id, p.row_id AS p_id, round(list_cosine_similarity(q.v, p.v), 9) AS sim FROM p q JOIN p ON p.row_id <> q.row_id WHERE q.row_id % 20 = 0),
nn AS (SELECT q_id, (row_number() OVER w)::INT AS rank, p_id, sim FROM s WINDOW w AS (PARTITION BY q_id ORDER BY sim DESC, p_id) QUALIFY row_number() OVER w <= {K})
SELECT q_id, rank, p_id, round(sim, 6) AS sim FROM nn""",
)
def q37(spark, sf_dir):
    """Parts like every twentieth part, in blocks of 256 rows, so that most pivots are left out before rows move."""
    k = F.col("p_partkey")
    v = F.array(F.col("p_size").cast("double") - 25, F.col("p_retailprice").cast("double") / 50 - 25, (k % 7).cast("double") - 3, (F.length("p_name") % 9).cast("double") - 4)
    p = table(spark, sf_dir, "part").select(k.alias("row_id"), v.alias("v"))
    return neighbors.nearest(p.filter("row_id % 20 = 0"), p, K, exclude_self=True, pool_block=256).withColumn("sim", F.round("sim", 6))


# ---- sweep over fairness metrics

FAIR = ("ratio_eo", "delta_eo", "ratio_dp", "delta_dp")


def sweep_sql(i: int) -> str:
    """Round i of all metrics' evolutions: scored{i} from scored{i - 1}."""
    gain = " ".join(f"WHEN '{m}' THEN m.{m} - b.{m}" for m in FAIR)
    return f"""d{i} AS (SELECT * FROM scored{i - 1} QUALIFY row_number() OVER (PARTITION BY metric_fair, sg ORDER BY CASE WHEN score > 0 THEN -ln({uniform_sql(SEED, 'roulette', i)}) / score END NULLS LAST, row_id) <= {K}),
v{i} AS (SELECT d.metric_fair, d.sg, t.row_id, any_value(t.y) AS y, any_value(t.z) AS z, (round(sum(list_cosine_similarity(t.v, d.v) * (2 * d.y - 1)), 9) > 0)::INT AS yhat FROM dev t, d{i} d GROUP BY d.metric_fair, d.sg, t.row_id),
e{i} AS (SELECT metric_fair, sg, round(0.5 * greatest(m.f1_score - b.f1_score, 0.05) + 0.5 * greatest(CASE metric_fair {gain} END, 0.05), 9) AS e FROM {metric_sql(f'v{i}', 'metric_fair, sg, ')} m, base b),
scored{i} AS (SELECT p.* EXCLUDE (score), CASE WHEN d.row_id IS NOT NULL THEN (p.score + e.e) / 2 ELSE p.score END AS score FROM scored{i - 1} p LEFT JOIN d{i} d ON d.metric_fair = p.metric_fair AND d.row_id = p.row_id LEFT JOIN e{i} e ON e.metric_fair = p.metric_fair AND e.sg = p.sg)"""


@query(
    "q42_metric_sweep",
    f"""WITH {S_SQL}, dev AS (SELECT * FROM s WHERE split = 'dev'), scored0 AS (SELECT s.*, f.metric_fair FROM s, (SELECT unnest({list(FAIR)}) AS metric_fair) f WHERE split = 'train'),
zero AS (SELECT y, z, 0 AS yhat FROM dev), base AS (SELECT * FROM {metric_sql('zero')}), {sweep_sql(1)}, {sweep_sql(2)},
pool AS (SELECT * FROM scored2 QUALIFY row_number() OVER (PARTITION BY metric_fair, sg ORDER BY score DESC, row_id) <= {K}),
found AS (SELECT p.metric_fair, t.row_id, any_value(t.y) AS y, any_value(t.z) AS z, (round(sum(list_cosine_similarity(t.v, p.v) * (2 * p.y - 1)), 9) > 0)::INT AS yhat FROM dev t, pool p GROUP BY p.metric_fair, t.row_id)
SELECT metric_fair, {round_sql(metrics.ALL)} FROM {metric_sql('found', 'metric_fair, ')}""",
)
def q42(spark, sf_dir):
    """Two rounds of evolution for four fairness metrics in the same jobs, and what each one's pool predicts."""
    s = split(spark, sf_dir)
    dev = settle(s.filter("split = 'dev'").drop("split"))
    scored = evolution.evolve(s.filter("split = 'train'").drop("split"), dev, SimilarityVote(), 2, K, SEED, metric_fair=FAIR, zero_shot=Rule("false"))
    return metrics.rounded(few_shot_by_metric(scored, dev.select("row_id", "y", "z", "v"), K, SimilarityVote()), metrics.ALL)


# ---- stores and files


def own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/equisift/{name}-{uuid.uuid4().hex}"


@query(
    "q38_run_registry",
    f"""WITH m AS (SELECT * FROM {metric_sql(RUNS_SQL, 'run, method, ')} WHERE run IN ('RF', 'NO'))
SELECT run, round(max(f1_score) FILTER (method = 'few_shot'), 6) AS few_shot, round(max(f1_score) FILTER (method = 'zero_shot'), 6) AS zero_shot FROM m GROUP BY run""",
)
def q38(spark, sf_dir):
    """Two runs, one of them written again with other rows; both read back from their folders and set side by side."""
    folder, all_runs = own_folder(spark, "results"), runs(spark, sf_dir)
    for run, some in (("RF", all_runs.filter("run = 'AF'")), ("NO", all_runs.filter("run = 'NO'")), ("RF", all_runs.filter("run = 'RF'"))):
        tables.write_results(metrics.evaluate(some, ["method"]), folder, run)
    long = tables.read_results(spark, folder).filter("type = 'evaluation'").select("run", "method", "metric", F.col("value_num").alias("value"))
    return metrics.rounded(reports.across_runs(long, "f1_score", ["few_shot", "zero_shot"]), ("few_shot", "zero_shot"))


def _hashed(texts):
    """Vectors from a digest of the text; none where it begins with 0."""
    digest = F.md5("text")
    part = lambda i: F.conv(F.substring(digest, i, 4), 16, 10).cast("double") / 65536
    return texts.withColumn("v", F.when(F.substring(digest, 1, 1) != "0", F.array(part(1), part(5))))


@query(
    "q39_embedding_store",
    """WITH d AS (SELECT doc_id, text, md5(text) AS h FROM documents), g AS (SELECT count(DISTINCT text) FILTER (doc_id % 2 = 0) AS first, count(DISTINCT text) AS every FROM d WHERE h[1] <> '0')
SELECT doc_id, CASE WHEN h[1] <> '0' THEN round(('0x' || h[1:4])::BIGINT / 65536, 6) ELSE 0 END AS x, CASE WHEN h[1] <> '0' THEN round(('0x' || h[5:8])::BIGINT / 65536, 6) ELSE 0 END AS y, g.first AS added_first, every - g.first AS added_then
FROM d, g""",
)
def q39(spark, sf_dir):
    """Documents embedded in two runs over one store: the second embeds only texts that the first has not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = EmbeddingStore(spark, own_folder(spark, "embeddings"), "digest", _hashed, 2)
    first = store.add(docs.filter("doc_id % 2 = 0"))
    then = store.add(docs)
    store.ledger.compact()
    out = store.embedded(docs)
    return out.select("doc_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"), F.lit(first).cast("long").alias("added_first"), F.lit(then).cast("long").alias("added_then"))


LINES = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1_score": "F1-Score"}


@query(
    "q40_text_report",
    f"WITH {BOTH_SQL} SELECT unnest([upper(method) || ' RESULTS', {', '.join(f"""'  {LINES.get(c, c)}: ' || printf('%.4f', "{c}")""" for c in metrics.ALL)}]) AS line FROM m",
)
def q40(spark, sf_dir):
    """The results of both methods as lines of text, written and read back."""
    folder = own_folder(spark, "report")
    tables.write_report(both(spark, sf_dir), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


CENSUS_SQL = """c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, 18 + c_custkey % 60 AS age, CASE WHEN c_custkey % 11 = 0 THEN '?' ELSE c_mktsegment END AS workclass,
  'edu' || c_nationkey AS education, 'job' || (c_custkey % 7 + (c_custkey % 5 = 0)::INT) AS occupation, CASE WHEN c_acctbal > 4500 THEN '>50K' ELSE '<=50K' END AS income FROM customer)"""


def _coded_sql(c: str) -> str:
    return f"coalesce((SELECT code FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM t WHERE part = 'train')) WHERE x = t.{c}), -1)::INT AS {c}"


@query(
    "q41_census_files",
    f"WITH {CENSUS_SQL}, t AS (SELECT * FROM c WHERE workclass <> '?') SELECT part, age::INT AS age, {', '.join(_coded_sql(c) for c in ('workclass', 'education', 'occupation', 'income'))} FROM t",
)
def q41(spark, sf_dir):
    """A training and a test file in the census's form, read, cleaned and encoded together."""
    k = F.col("c_custkey")
    test = k % 5 == 0
    rows = table(spark, sf_dir, "customer").select(
        test.alias("test"),
        F.concat_ws(
            ", ", 18 + k % 60, F.when(k % 11 == 0, "?").otherwise(F.col("c_mktsegment")), k, F.concat(F.lit("edu"), "c_nationkey"), k % 16, F.lit("single"), F.concat(F.lit("job"), k % 7 + test.cast("int")), F.lit("own"),
            F.lit("other"), F.when(k % 2 == 0, "Male").otherwise("Female"), F.lit(0), F.lit(0), F.lit(40), F.when(k % 3 == 0, "?").otherwise("here"),
            F.concat(F.when(F.col("c_acctbal") > 4500, ">50K").otherwise("<=50K"), F.when(test, ".").otherwise("")),
        ).alias("value"),
    )
    folder = own_folder(spark, "census")
    for name, wanted in (("train", "not test"), ("test", "test")):
        rows.filter(wanted).select("value").write.text(f"{folder}/{name}")
    return tables.census(spark, f"{folder}/train", f"{folder}/test").select("part", "age", "workclass", "education", "occupation", "income")


def _two_clients():
    """Stand-ins that answer by a digest of the prompt; the first fails on prompts whose digest begins with 0 to 3, both on those that begin with 0."""

    def client(refused: str):
        def answer(prompt: str) -> str:
            digest = hashlib.md5(prompt.encode()).hexdigest()
            if digest[0] in refused:
                raise ConnectionError("no answer")
            return "Greater than 50K" if digest[1] >= "8" else "less than or equal to 50K"

        return answer

    return [client("0123"), client("0")]


@query(
    "q43_answer_journal",
    """WITH c AS (SELECT conv_id, turn, text, md5(text) AS h FROM conversations WHERE text IS NOT NULL),
g AS (SELECT count(DISTINCT text) FILTER (conv_id % 2 = 0) AS first, count(DISTINCT text) AS every FROM c WHERE h[1] <> '0')
SELECT conv_id * 1000 + turn AS row_id, CASE WHEN h[1] <> '0' AND h[2] >= '8' THEN 1 ELSE 0 END AS yhat, first AS answered_first, every AS answered FROM c, g""",
)
def q43(spark, sf_dir):
    """Texts as prompts in two runs over one journal: half of the conversations, then all. Each distinct prompt is asked until it has one answer."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    test = c.select(F.lit("all").alias("set_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("prompt"), "conv_id")
    journal = AnswerJournal(spark, own_folder(spark, "answers"))
    model = RemoteModel(_two_clients, journal=journal)
    model.predict(test.filter("conv_id % 2 = 0"))
    first = journal.answers().count()
    out = model.predict(test)
    return out.select("row_id", "yhat", F.lit(first).cast("long").alias("answered_first"), F.lit(journal.answers().count()).cast("long").alias("answered"))
