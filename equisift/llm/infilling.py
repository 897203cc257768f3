"""Fill-in-the-middle transformation.

A text is cut into units (lines, by default); two numbers from a digest of seed and id choose how many units the prefix has and where the middle ends; the pieces are written in
another order between marks, so that a model learns to fill the middle in. All draws hang on seed and id alone, so a re-run task gives the same rows, however rows are dealt.

The work is an Arrow-batched pandas UDF: the regex library's finditer collects the ends of a text's units in a compact array, two lookups in it slice the text, and hashlib makes seeds and digests.
Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless the session says otherwise); a worker holds one batch and its outputs.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: A line with its end; the last may have none.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_PARTS = "n long, form string, prefix_chars long, middle_chars long"


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the SHA-256 of seed, a colon and the decimal id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The offsets (in code points) at which units end."""
    return array("q", (m.end() for m in unit.finditer(text)))


def rearranged(text: str, doc_id, unit: regex.Pattern, marks: tuple[str, str, str], fim_percent: int, spm_percent: int, seed: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, unit)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        return len(ends), "plain", None, None, text
    few, many = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (few, many))
    before, after, between = (m + part for m, part in zip(marks, (text[:a], text[b:], text[a:b])))
    spm = h4 % 100 < spm_percent
    return len(ends), "spm" if spm else "psm", a, b - a, after + before + between if spm else before + after + between


def rebuilt(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text that rearranged() made output of."""
    if form == "plain":
        return output
    first, second = (marks[1], marks[0]) if form == "spm" else marks[:2]
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(marks[2])
    return b + middle + a if form == "spm" else a + middle + b


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks can be told from text that stands beside them: none is empty, holds another, or ends as one begins."""
    marks = tuple(marks)
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"marks {marks} can't be told from text")
    return marks


def infilled(doc_id: str | Column, text: str | Column, unit: str = LINES, marks: tuple[str, str, str] = MARKS, fim_percent: int = 100, spm_percent: int = 50, seed: int = 7) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output) for a row's id and text.

    n is the number of units. form is plain (output is the text; lengths are null) if the text is empty or holds a mark, or for all but fim_percent of ids; else spm for spm_percent of them, or psm. Lengths count
    code points. A null text is an empty one; a null id counts as the empty text. Text behind the last unit belongs to the suffix.
    """
    pattern, marks = regex.compile(unit), _checked(marks)

    @F.pandas_udf(f"{_PARTS}, output string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t if isinstance(t, str) else "", i if isinstance(i, str) else None, pattern, marks, fim_percent, spm_percent, seed) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return run(as_column(doc_id).cast("string"), as_column(text).cast("string"))


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars, output; options as for infilled(). Repeated rows give repeated rows, an empty table none; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), infilled(F.col(id_col), F.col(text_col), **options).alias("made"))
    return rows.select(F.col("id").alias(id_col), "made.*")


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output and form were made of."""
    marks = _checked(marks)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f, marks) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def digested(made: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """infilled()'s struct with output_sha256 and restored_sha256 (of the text rebuilt from output and form) in place of the output. Spark runs both in one pass through a worker, so outputs don't come back for it."""
    marks = _checked(marks)
    sha256 = lambda t: hashlib.sha256(t.encode()).hexdigest()

    @F.pandas_udf(f"{_PARTS}, output_sha256 string, restored_sha256 string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.drop(columns="output")
        out["output_sha256"] = [sha256(t) for t in rows["output"]]
        out["restored_sha256"] = [sha256(rebuilt(t, f, marks)) for t, f in zip(rows["output"], rows["form"])]
        return out

    return run(made)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digested(infilled("doc_id", "text")).alias("made")).select("doc_id", "made.*")


#: Lines as SQL splits them: all but the last have their end given back, and an empty last one is none.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p, sha256(concat('7:', doc_id::VARCHAR)) AS h FROM documents),
l AS (SELECT doc_id, t, h, list_concat(list_transform(p[:-2], lambda x: x || chr(10)), CASE WHEN p[-1] = '' THEN [] ELSE p[-1:] END) AS u FROM d),
s AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM l),
c AS (SELECT *, array_to_string(u[:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
