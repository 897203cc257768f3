"""A journal of a remote model's answers: a prompt that has an answer is never asked again, whatever became of the run, executor or task that asked.

Tasks write what they are told to files of their own (one appears whole, by renaming), some seconds apart; a later attempt of a task reads the files of earlier ones and goes on behind them, beginning with the client that
last answered anywhere. Once all tasks of a job are done its answers are published in a ledger. Files of a job that never came to that are published by the next one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lineage import settle
from .ledger import Ledger, delete, exists

#: Seconds between files of a task.
FLUSH = 5.0
_ROW = "key string, client int, answer string"


def key_of(prompt: str | Column) -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


class TaskFiles:
    """What the attempts of one task of a job have been answered. The folder is a URI that pyarrow's file systems can write to from every executor."""

    def __init__(self, job_folder: str, flush: float):
        from pyarrow import fs

        self.fs, self.job = fs.FileSystem.from_uri(job_folder) if "://" in job_folder or job_folder.startswith("file:") else (fs.LocalFileSystem(), job_folder)
        context = TaskContext.get()
        self.folder = f"{self.job}/{context.partitionId() if context else 0}"
        self.flush, self.new, self.written = flush, [], time.time()
        self.fs.create_dir(self.folder, recursive=True)
        self.fresh = lambda: f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex}.json"

    def _files(self, folder: str, deep: bool) -> list:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(folder, recursive=deep))
        return sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: (f.mtime_ns or 0, f.path))

    def _lines(self, file) -> list[dict]:
        with self.fs.open_input_stream(file.path) as s:
            return [json.loads(x) for x in s.read().decode().splitlines()]

    def known(self) -> dict[str, tuple[int, str]]:
        return {x["key"]: (x["client"], x["answer"]) for f in self._files(self.folder, False) for x in self._lines(f)}

    def last_client(self) -> int:
        """The client of the newest answer of any task, 0 if there is none."""
        files = self._files(self.job, True)
        return self._lines(files[-1])[-1]["client"] if files else 0

    def add(self, key: str, client: int, answer: str) -> None:
        self.new.append({"key": key, "client": client, "answer": answer})
        if time.time() - self.written >= self.flush:
            self.close()

    def close(self) -> None:
        if self.new:
            name = self.fresh()
            with self.fs.open_output_stream(f"{self.folder}/_{name}") as s:
                s.write("".join(json.dumps(x) + "\n" for x in self.new).encode())
            self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
            self.new, self.written = [], time.time()


class AnswerJournal:
    """Answers by (model, prompt), kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, model: str = "", flush: float = FLUSH):
        self.spark, self.folder, self.model, self.flush = spark, folder.rstrip("/"), model, flush
        self.ledger = Ledger(spark, f"{self.folder}/answers", _ROW)

    def key(self, prompt: str | Column) -> Column:
        prompt = F.col(prompt) if isinstance(prompt, str) else prompt
        return key_of(F.concat(F.lit(self.model), F.lit("\n"), prompt))

    def answers(self) -> DataFrame:
        """(key, client, answer), a row for each key."""
        return self.ledger.read().groupBy("key").agg(F.min(F.struct("client", "answer")).alias("a")).select("key", "a.client", "a.answer")

    def recover(self) -> int:
        """Publishes what jobs that never ended were answered; how many answers."""
        jobs = f"{self.folder}/jobs"
        if not exists(self.spark, jobs):
            return 0
        left = self.spark.read.schema(_ROW).option("recursiveFileLookup", "true").json(jobs).filter("key is not null and answer is not null")
        new = settle(left.groupBy("key").agg(F.min(F.struct("client", "answer")).alias("a")).select("key", "a.client", "a.answer").join(self.ledger.read().select("key"), "key", "left_anti"))
        if n := new.count():
            self.ledger.append(new)
        return n

    def ask(self, prompts: DataFrame, session: Callable[[int], Callable[[str], tuple[str | None, int]]]) -> int:
        """Asks for the distinct prompts (column `prompt`) without an answer; how many got one. session(client), made in each task, gives a function from a prompt to (answer or None, client), beginning with that client."""
        self.recover()
        wanted = prompts.filter("prompt is not null").select(self.key("prompt").alias("key"), "prompt")
        missing = wanted.join(self.ledger.read().select("key"), "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
        missing = settle(missing)  # so that another attempt of a task has the rows of the first
        job, flush = f"{self.folder}/jobs/{uuid.uuid4().hex}", self.flush

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files = TaskFiles(job, flush)
            known, call = files.known(), session(files.last_client())
            try:
                for batch in batches:
                    out = []
                    for key, prompt in zip(batch["key"], batch["prompt"]):
                        client, answer = known.get(key, (None, None))
                        if answer is None:
                            answer, client = call(prompt)
                            if answer is not None:
                                files.add(key, client, answer)
                        if answer is not None:
                            out.append((key, client, answer))
                    yield pd.DataFrame(out, columns=["key", "client", "answer"]).astype({"client": "int32"})
            finally:
                files.close()

        found = settle(missing.mapInPandas(run, _ROW))
        if n := found.count():
            self.ledger.append(found)
        delete(self.spark, job)
        return n
