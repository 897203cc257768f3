import json
import os

import pytest
from pyspark.sql import functions as F

from equisift.config import SelectionConfig
from equisift.operators import metrics, reports
from equisift.operators.predictors import RemoteEmbedder, RemoteModel, _session
from equisift.sources import ledger as m, tables
from equisift.sources.answers import AnswerJournal, TaskFiles
from equisift.sources.embeddings import EmbeddingStore

SCHEMA = "k long, s string, b int"


def part(spark, *ks):
    return spark.createDataFrame([(k, f"s{k}", k % 3) for k in ks], SCHEMA)


def keys(df):
    return sorted(r["k"] for r in df.collect())


@pytest.mark.parametrize("by", [(), ("b",)])
def test_ledger(spark, tmp_path, by):
    t = m.Ledger(spark, str(tmp_path), SCHEMA, by)
    assert keys(t.read()) == [] and not t.compact()
    t.append(part(spark, 1, 2))
    before = t.read()
    t.append(part(spark, 2, 5, 6))
    assert keys(t.read()) == [1, 2, 2, 5, 6] and keys(before) == [1, 2]
    assert sorted(map(tuple, t.read().collect())) == [(k, f"s{k}", k % 3) for k in (1, 2, 2, 5, 6)]
    old = t.live()
    assert t.compact() and keys(t.read()) == [1, 2, 2, 5, 6] and len(t.live()) == 1
    assert keys(before) == [1, 2]  # what began before still reads the old folders
    assert t.vacuum() == old and not any(os.path.exists(tmp_path / "data" / x) for x in old)
    t.append(part(spark, 9))
    assert keys(t.read()) == [1, 2, 2, 5, 6, 9] and t.compact() and keys(t.read()) == [1, 2, 2, 5, 6, 9]


def test_runs_that_end_early_leave_nothing_to_read(spark, tmp_path):
    t = m.Ledger(spark, str(tmp_path), SCHEMA)
    t.append(part(spark, 1))
    t._write(part(spark, 2))  # written, never published
    (tmp_path / "log/torn.json").write_text('{"add": ["x')  # a manifest that was not written whole
    assert keys(t.read()) == [1]


def test_of_compactions_at_one_time_one_wins(spark, tmp_path, monkeypatch):
    a, b = (m.Ledger(spark, str(tmp_path), SCHEMA) for _ in range(2))
    a.append(part(spark, 1))
    a.append(part(spark, 2))
    write, won = b._write, []

    def slow(df):  # the other compacts, and a row is appended, while this one writes
        name = write(df)
        won.append(a.compact())
        a.append(part(spark, 3))
        return name

    monkeypatch.setattr(b, "_write", slow)
    assert not b.compact() and won == [True]
    assert keys(a.read()) == [1, 2, 3] and len(os.listdir(tmp_path / "data")) == 4  # the loser's data is gone


def test_published_once(spark, tmp_path):
    folder, made = str(tmp_path), []

    def make(n):
        def f():
            made.append(n)
            if n == 1:  # another run publishes first
                m.published_once(spark, folder, "x", make(2))
            return spark.range(n)

        return f

    assert m.published_once(spark, folder, "x", make(1)).count() == 2 and made == [1, 2]
    assert m.published_once(spark, folder, "x", make(3)).count() == 2 and made == [1, 2]
    assert len([d for d in os.listdir(folder) if d.startswith("x-")]) == 1
    with pytest.raises(ZeroDivisionError):
        m.published_once(spark, folder, "y", lambda: 1 // 0)
    assert m.published_once(spark, folder, "y", make(4)).count() == 4
    (tmp_path / "z.json").write_text("")  # left by a run that ended while it published
    assert m.published_once(spark, folder, "z", make(5)).count() == 5 == m.published_once(spark, folder, "z", make(6)).count()
    assert json.loads((tmp_path / "z.json").read_text())["schema"]["fields"][0]["name"] == "id"


def test_runs_side_by_side(spark, tmp_path):
    folder = str(tmp_path / "results")
    pred = lambda *rows: metrics.evaluate(spark.createDataFrame(rows, "method string, y int, z int, yhat int"), ["method"])
    tables.write_results(pred(("a", 1, 0, 1), ("b", 1, 0, 0)), folder, "first", SelectionConfig(seed=7))
    tables.write_results(pred(("a", 1, 0, 0), ("b", 1, 0, 0)), folder, "second")
    wanted = lambda: {(r["run"], r["a"], r["b"]) for r in reports.across_runs(tables.read_results(spark, folder).withColumn("value", F.col("value_num")), "accuracy", ["a", "b"]).collect()}
    assert wanted() == {("first", 1.0, 0.0), ("second", 0.0, 0.0)}
    tables.write_results(pred(("a", 1, 0, 0), ("b", 1, 0, 1)), folder, "second")
    assert wanted() == {("first", 1.0, 0.0), ("second", 0.0, 1.0)}
    config = {r["method"]: (r["value"], r["value_num"]) for r in tables.read_results(spark, folder).filter("run = 'first' and type = 'config'").collect()}
    assert config["seed"] == ("7", 7.0) and config["metric_fair"] == ("ratio_eo", None)


def test_embedding_store(spark, tmp_path):
    log = tmp_path / "asked"
    log.touch()

    def make():
        def call(texts):
            if any("bad" in t for t in texts):
                raise OSError("no answer")
            with log.open("a") as f:
                f.write("".join(t + "\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return call

    def store(model="m"):
        return EmbeddingStore(spark, str(tmp_path / "store"), model, RemoteEmbedder(make, 2, 1, zeros=False).embed, 2, 4)

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "bad"), (5, None), (6, "ccc")], "id int, text string").withColumns({"key": F.lit("k"), "bucket": F.lit(0), "v": F.lit("old")})
    assert store().add(rows.filter("id < 3")) == 2
    got = {r["id"]: r["v"] for r in store().embedded(rows).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: [0.0, 0.0], 5: [0.0, 0.0], 6: [3.0, 1.0]}
    assert sorted(log.read_text().split()) == ["a", "bb", "ccc"]  # each once, failures not kept
    assert store().add(rows) == 0 and store().ledger.compact() and store().vectors().count() == 3
    assert store("other").add(rows.filter("id = 1")) == 1 and store().vectors().count() == 4
    assert store().add(rows.filter("id = 4").withColumn("text", F.lit("fine"))) == 1
    assert {r["id"]: r["w"] for r in store().embedded(rows.filter("id in (2, 6)"), out="w").collect()} == {2: [2.0, 1.0], 6: [3.0, 1.0]}


def asked(tmp_path, name="asked"):
    file = tmp_path / name
    file.touch()
    return file, lambda: sorted(file.read_text().split())


def client(file, name, refuse=(), die=()):
    def answer(prompt):
        if prompt in die:
            raise SystemExit("the executor is gone")
        with file.open("a") as f:
            f.write(f"{name}:{prompt}\n")
        if prompt in refuse:
            raise OSError("no answer")
        return "Greater than 50K" if prompt.endswith("1") else "no"

    return answer


def test_journal_asks_once(spark, tmp_path):
    file, said = asked(tmp_path)
    rows = spark.createDataFrame([("s", i, p) for i, p in enumerate(["p1", "p2", "p1", "p3", "p2", None])], "set_id string, row_id long, prompt string")
    journal = AnswerJournal(spark, f"file://{tmp_path}/journal")
    model = RemoteModel(lambda: [client(file, "a", ("p2", "p3")), client(file, "b", ("p3",))], journal=journal)
    wanted = {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    assert {r["row_id"]: r["yhat"] for r in model.predict(rows).collect()} == wanted
    before = said()
    assert before.count("a:p1") + before.count("b:p1") == 1 and before.count("b:p2") == 1 and before.count("b:p3") == 1
    assert {r["row_id"]: r["yhat"] for r in model.predict(rows).collect()} == wanted
    assert [x for x in said() if not x.endswith("p3")] == [x for x in before if not x.endswith("p3")]  # only what had no answer is asked again
    assert AnswerJournal(spark, f"file://{tmp_path}/journal", "another model").ask(rows, _session(lambda: [client(file, "c")], 1)) == 3


def test_journal_survives_a_run(spark, tmp_path):
    """A run that dies half way: the next one asks only for what was not answered."""
    file, said = asked(tmp_path)
    rows = spark.createDataFrame([("s", i, f"p{i}") for i in range(30)], "set_id string, row_id long, prompt string")
    journal = AnswerJournal(spark, f"{tmp_path}/journal", flush=0)
    with pytest.raises(Exception, match="executor is gone|SystemExit"):
        RemoteModel(lambda: [client(file, "a", die=("p7",))], journal=journal).predict(rows).collect()
    first = said()
    assert first and journal.answers().count() == 0
    got = RemoteModel(lambda: [client(file, "a")], journal=journal).predict(rows).collect()
    assert {r["row_id"]: r["yhat"] for r in got} == {i: int(i % 10 == 1) for i in range(30)}
    assert said() == sorted(f"a:p{i}" for i in range(30))  # each once in all


def test_attempts_of_a_task_go_on(tmp_path):
    """Another attempt knows what the first wrote, and any task begins with the client that last answered."""
    a = TaskFiles(f"file://{tmp_path}/job", 0)
    assert a.known() == {} and a.last_client() == 0
    a.add("k1", 2, "yes")
    a.add("k2", 3, "no\nline")
    b = TaskFiles(f"{tmp_path}/job", 100)
    assert b.known() == {"k1": (2, "yes"), "k2": (3, "no\nline")} and b.last_client() == 3
    b.add("k3", 1, "x")
    assert "k3" not in TaskFiles(f"{tmp_path}/job", 0).known()
    b.close()
    assert TaskFiles(f"{tmp_path}/job", 0).known()["k3"] == (1, "x")
    (tmp_path / "job/0/_torn.json").write_text("{")
    assert len(TaskFiles(f"{tmp_path}/job", 0).known()) == 3
