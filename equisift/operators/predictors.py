"""Predictors behind one interface: predict(test, demos) gives (set_id, row_id, yhat), so that many demonstration sets are scored in one job.

Rule and SimilarityVote are deterministic stand-ins for a language model; they do not imitate its quality.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prompts import parse_response
from ..functions.vectors import dot, unit


class Predictor(Protocol):
    def predict(self, test: DataFrame, demos: DataFrame | None) -> DataFrame:
        """test: (set_id, row_id, ...); demos: (set_id, row_id, y, ...) or None."""


class Constant:
    """The same answer always: what a caller gets when no model answers."""

    def __init__(self, value: int = 0):
        self.value = value

    def predict(self, test: DataFrame, demos: DataFrame | None = None) -> DataFrame:
        return test.select("set_id", "row_id", F.lit(self.value).alias("yhat"))


class Rule:
    """1 where a condition holds; a stand-in for prediction without demonstrations."""

    def __init__(self, condition: Column | str):
        self.condition = F.expr(condition) if isinstance(condition, str) else condition

    def predict(self, test: DataFrame, demos: DataFrame | None = None) -> DataFrame:
        return test.select("set_id", "row_id", F.when(self.condition, 1).otherwise(0).alias("yhat"))


class SimilarityVote:
    """1 where the cosines to the set's positive demonstrations outweigh those to the negative ones; 0 without demonstrations.

    The vote is a sum over demonstrations: sum of cos(t, d) (2 y - 1) is the product of the unit vector of t with one vector for the
    set, so a set is summed once (by dimension, pre-aggregated) and each test row meets one row however large its set is. Because it is a sum, sets that grow need only what each new demonstration adds: see `vote`.
    """

    @staticmethod
    def prepared(v: str) -> Column:
        """What vote() takes of a row's vector."""
        return unit(v)

    @staticmethod
    def vote(test: str, demo: str, y: str) -> Column:
        """What one demonstration adds to a test row's sum; the prediction is 1 where the sum, rounded to 9 digits, is positive."""
        return dot(test, demo) * (2 * F.col(y) - 1)

    def predict(self, test: DataFrame, demos: DataFrame | None = None) -> DataFrame:
        if demos is None:
            return Constant().predict(test)
        parts = demos.select("set_id", F.posexplode(unit("v")).alias("pos", "x"), (2 * F.col("y") - 1).alias("sign"))
        sums = parts.groupBy("set_id", "pos").agg(F.sum(F.col("x") * F.col("sign")).alias("x"))
        votes = sums.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vote"))
        score = F.round(dot(unit("v"), "vote"), 9)
        return test.join(votes, "set_id", "left").select("set_id", "row_id", F.when(score > 0, 1).otherwise(0).alias("yhat"))


def _session(make_clients: Callable[[], list], retries: int) -> Callable[[int], Callable[[str], tuple[str | None, int]]]:
    """For a task: a function from a prompt to (answer or None, client), that tries clients in turn from the one that last answered."""

    def begin(first: int):
        clients, at = make_clients(), first

        def ask(prompt: str) -> tuple[str | None, int]:
            nonlocal at
            for i in range(len(clients) * retries):
                k = (at + i // retries) % len(clients)
                try:
                    answer, at = clients[k](prompt), k
                    return answer, k
                except Exception:  # noqa: BLE001  any failure of a client passes on to the next
                    continue
            return None, at

        return ask

    return begin


class RemoteModel:
    """Asks a model for each prompt. `clients` are functions from a prompt to an answer; they are tried in turn from the one that last answered, and 0 is
    the prediction if none does. test must have a `prompt` column; answers are read by parse_response.

    Requests go out from the tasks, batch by batch; `make_clients` is called once in each task. With a journal (sources.answers.AnswerJournal) a prompt is asked once for all rows, runs and attempts; without, once for each row.
    """

    def __init__(self, make_clients: Callable[[], list[Callable[[str], str]]], retries: int = 1, journal=None):
        self.make_clients, self.retries, self.journal = make_clients, retries, journal

    def predict(self, test: DataFrame, demos: DataFrame | None = None) -> DataFrame:
        session, kinds = _session(self.make_clients, self.retries), dict(test.dtypes)
        rows = test.select("set_id", "row_id", "prompt")
        if self.journal is not None:
            self.journal.ask(rows, session)
            said = rows.withColumn("_key", self.journal.key("prompt")).join(self.journal.answers().select(F.col("key").alias("_key"), "answer"), "_key", "left")
        else:

            def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                call = session(0)
                for batch in batches:
                    yield batch[["set_id", "row_id"]].assign(answer=[call(prompt)[0] for prompt in batch["prompt"]])

            said = rows.mapInPandas(ask, f"set_id {kinds['set_id']}, row_id {kinds['row_id']}, answer string")
        return said.select("set_id", "row_id", parse_response(F.coalesce("answer", F.lit(""))).alias("yhat"))


def clients_from_keys(make: Callable[[str], Callable[[str], str]], keys: list[str] | None = None, names: tuple[str, ...] = ("LLM_API_KEY",)) -> list[Callable[[str], str]]:
    """A client for each distinct key, in order, for RemoteModel's make_clients. Without `keys` they are read from the environment variables that begin with one of `names`
    (NAME, NAME1, NAME_2), in order of their names; white space and quotes around a key go. An error if there is none."""
    if keys is None:
        keys = [v for n, v in sorted(os.environ.items()) if n.startswith(names)]
    bare = [k.strip().strip('"').strip("'") for k in keys if k]
    if not (found := list(dict.fromkeys(k for k in bare if k))):
        raise ValueError("no key for a client")
    return [make(k) for k in found]


class RemoteEmbedder:
    """Adds `v` by a remote embedding function over batches of texts; a batch that fails gets zero vectors of `dim` dimensions, or nulls with zeros=False (for a store, which keeps no failures)."""

    def __init__(self, make_embed: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int = 768, batch: int = 100, zeros: bool = True):
        self.make_embed, self.dim, self.batch, self.zeros = make_embed, dim, batch, zeros

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame:
        make, size, failed = self.make_embed, self.batch, [0.0] * self.dim if self.zeros else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for frame in batches:
                texts, out = frame[text].tolist(), []
                for i in range(0, len(texts), size):
                    part = texts[i : i + size]
                    try:
                        out += [[float(x) for x in v] for v in call(part)]
                    except Exception:  # noqa: BLE001
                        out += [failed for _ in part]
                yield frame.assign(v=out)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "v")
        return df.drop("v").mapInPandas(run, f"{fields}, v array<double>")
