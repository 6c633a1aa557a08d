"""Input checks as Column expressions: the first problem of a row, null if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import trimmed

#: Starts of names of local models with short contexts, and the sizes of local models (fixed values).
SHORT_CONTEXT, SHORT_SIZE, LONG_SIZE, LOCAL_OVERLAP = ("phi4", "llama"), 10_000, 30_000, 1_000
#: Characters of a transcript at most (fixed value).
MOST_CHARS = 10_000_000


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


# The messages below are fixed values.
def transcript_problem(meeting_id: Column, text: Column, size: Column, overlap: Column, most: int = MOST_CHARS) -> Column:
    return (
        F.when(is_blank(meeting_id), "meeting_id cannot be empty")
        .when(is_blank(text), "transcript_text cannot be empty")
        .when((size <= 0) | (overlap < 0), "Invalid chunk_size or overlap values")
        .when(F.length(text) > most, "Transcript text too large")
    )


def chunk_settings(provider: Column, model: Column, size: Column, overlap: Column) -> Column:
    """struct(problem, size, overlap): the overlap is less than the size; models of 'ollama' have sizes of their own."""
    problem = F.when(size <= 0, "chunk_size must be positive").when(overlap < 0, "overlap must be non-negative")
    local, name = provider == "ollama", F.lower(model)
    short = F.lit(False)
    for start in SHORT_CONTEXT:
        short = short | name.startswith(start)
    own = F.when(short, SHORT_SIZE).otherwise(LONG_SIZE)
    good = lambda c: F.when(problem.isNull(), c).cast("long")
    return F.struct(problem.alias("problem"), good(F.when(local, own).otherwise(size)).alias("size"), good(F.when(local, LOCAL_OVERLAP).otherwise(F.least(overlap, size - 1))).alias("overlap"))


def by_name(name: Column, columns: dict[str, str | None], error: str) -> tuple[Column, Column]:
    """(value of the column that `name` stands for, null where it stands for none; problem of a name that isn't listed)."""
    value = F.lit(None).cast("string")
    for known, column in columns.items():
        if column:
            value = F.when(name == known, F.col(column)).otherwise(value)
    return value, F.when(F.coalesce(name.isin(*columns), F.lit(False)), None).otherwise(F.concat(F.lit(error), F.coalesce(name, F.lit("")))).cast("string")
