"""Texts for a language model as predictor, and the reading of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# These wordings must equal what the models are asked with and answer.
TASK = """You are tasked with predicting whether a person's income is greater than 50K or less than or equal to 50K based on their demographic and work-related information.

Based on the following information, predict the income category. Respond with ONLY one of these two options:
- "greater than 50K"
- "less than or equal to 50K"

Do not provide any explanation, just the prediction."""
EXAMPLES_HEAD = "\n\nHere are some examples:\n\n"
QUESTION_HEAD = "\nNow predict for this person:\n"
QUESTION_TAIL = "\n\nIncome prediction:"
SEX = {0: "Male", 1: "Female"}
INCOME = {0: "less than or equal to 50K", 1: "greater than 50K"}
INCOME_SHORT = {0: "<=50K", 1: ">50K"}
POSITIVE = ("greater than 50k", ">50k", "greater than 50 k")
NEGATIVE = ("less than or equal to 50k", "<=50k", "less than or equal to 50 k")
PROMPT_FIELDS = (
    ("Age", "age"), ("Workclass", "workclass"), ("Education", "education"), ("Marital Status", "marital_status"), ("Occupation", "occupation"),
    ("Relationship", "relationship"), ("Sex", "sex"), ("Capital Gain", "capital_gain"), ("Capital Loss", "capital_loss"), ("Hours per Week", "hours_per_week"),
)
EMBEDDING_NAMES = {"Marital Status": "Marital", "Hours per Week": "Hours/Week"}


def _named(col: Column, names: dict[int, str]) -> Column:
    """The name of a code; other codes as they are."""
    out = col.cast("string")
    for code, name in names.items():
        out = F.when(col == code, F.lit(name)).otherwise(out)
    return out


def _fields(names: dict[str, str]) -> Column:
    parts = []
    for title, c in PROMPT_FIELDS:
        value = _named(F.col(c), SEX) if c == "sex" else F.col(c).cast("string")
        parts.append(F.concat(F.lit(f"{names.get(title, title)}: "), F.coalesce(value, F.lit("nan"))))
    return F.concat_ws(", ", *parts)


def prompt_row(include_label: bool) -> Column:
    """A row in words; with its label after an arrow."""
    text = _fields({})
    return F.concat(text, F.lit(" -> Income: "), _named(F.col("income"), INCOME)) if include_label else text


def embedding_row(include_label: bool = False) -> Column:
    """A row in words for embedding. Labels stay out unless asked for, so that test labels don't leak into retrieval."""
    text = _fields(EMBEDDING_NAMES)
    return F.concat(text, F.lit(", Income: "), _named(F.col("income"), INCOME_SHORT)) if include_label else text


def prompts(test: DataFrame, demos: DataFrame | None, keys: list[str]) -> DataFrame:
    """test with a `prompt`: the task, the examples of the row's demonstration set in order of `pos`, if any, and the question.

    demos has `keys` (which set a row belongs to), pos and the fields; a set is small by construction, and its block of examples is built once.
    """
    question = F.concat(F.lit(QUESTION_HEAD), prompt_row(False), F.lit(QUESTION_TAIL))
    if demos is None:
        return test.withColumn("prompt", F.concat(F.lit(TASK), question))
    rows = demos.select(*keys, "pos", prompt_row(True).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    block = rows.groupBy(*keys).agg(F.concat(F.lit(EXAMPLES_HEAD), F.array_join(lines, "")).alias("examples"))
    return test.join(block, keys, "left").withColumn("prompt", F.concat(F.lit(TASK), F.coalesce("examples", F.lit("")), question)).drop("examples")


def parse_response(text: str | Column) -> Column:
    """1 if a positive wording occurs (they are tried first, so "not greater than 50k" is 1), else 0."""
    said = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    hit = lambda words: F.lit(False) if not words else _any([F.contains(said, F.lit(w)) for w in words])
    return F.when(hit(POSITIVE), 1).when(hit(NEGATIVE), 0).otherwise(0)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def mask_key(key: str | Column) -> Column:
    """A secret for logs: NONE, **** up to 8 characters, else its first and last four."""
    k = F.col(key) if isinstance(key, str) else key
    return F.when(k.isNull() | (k == ""), "NONE").when(F.length(k) > 8, F.concat(F.substring(k, 1, 4), F.lit("..."), F.right(k, F.lit(4)))).otherwise("****")
