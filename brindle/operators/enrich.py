"""Enrichers: calls of outside models behind one interface, each with a deterministic fallback that needs none.

A model is a function from a pandas DataFrame of a batch's inputs to a list of JSON texts. What it gives is validated; what
is not valid is asked for once more with strict=True, and what still isn't gets the fallback.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.tags import token_tags
from ..functions.text import embedding_text, summary_bullets, to_markdown
from ..functions.trust import fallback_trust

Model = Callable[[pd.DataFrame, bool], list[str | None]]


class Throttled(Exception):
    """The model asks for fewer calls (429), and perhaps for a wait of so many seconds."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__(after)
        self.after = after


class Refused(Exception):
    """What was asked is at fault (another 4xx): asking again is no use."""


@dataclass(frozen=True)
class Pace:
    """Seconds of the wait after a first failure, which doubles up to `most`, within 30 % at random; and calls a second of all
    tasks together, none for any number. A throttled task waits as long as it is told to, if that is longer, and halves its rate."""

    wait: float = 0.5
    most: float = 60.0
    rate: float | None = None

    def delay(self, failures: int) -> float:
        return min(self.most, self.wait * 2**failures) * random.uniform(0.7, 1.3)


class _Calls:
    """The calls of one task."""

    def __init__(self, model: Model, pace: Pace, tasks: int) -> None:
        self.model, self.pace, self.due = model, pace, 0.0
        self.gap = tasks / pace.rate if pace.rate else 0.0

    def __call__(self, rows: pd.DataFrame, strict: bool) -> list[str | None]:
        now = time.monotonic()
        time.sleep(max(0.0, self.due - now))
        self.due = max(now, self.due) + self.gap
        return self.model(rows, strict)

    def failed(self, error: Exception, failures: int) -> None:
        wait = self.pace.delay(failures)
        if isinstance(error, Throttled):
            wait, self.gap = max(wait, error.after or 0.0), 2 * self.gap
        time.sleep(wait)


def generated(df: DataFrame, key: str, inputs: list[str], model: Model | None, valid: Callable[[str | None], bool], fallback: Column, batch: int = 16, attempts: int = 2, concurrency: int | None = None, pace: Pace = Pace(wait=0.0)) -> DataFrame:
    """df with output: what the model gave for the inputs, else the fallback.

    A batch that fails, and what in it isn't valid, is asked for again (strictly), `attempts` times in all, at the given pace. Rows
    pass through the tasks that call, whole, so nothing is joined. With `concurrency`, their inputs are dealt to so many tasks,
    which alone call the model, and joined by the key; what they come from is read by as many as ever.
    """
    if model is None:
        return df.withColumn("output", fallback)
    kind = df.schema[key].dataType.simpleString()
    if pace.rate and not concurrency:
        raise ValueError("a rate is shared by the tasks that call: say how many there are")

    def asked(rows: pd.DataFrame, call: _Calls) -> list[str | None]:
        out: list[str | None] = [None] * len(rows)
        todo = list(range(len(rows)))
        for n in range(attempts):
            try:
                got = call(rows[inputs].iloc[todo], n > 0)
            except Refused:
                break
            except Exception as e:  # noqa: BLE001; a model that can't be reached: asked again, and at last the fallback
                if n + 1 < attempts:
                    call.failed(e, n)
                continue
            for i, x in zip(todo, got, strict=True):
                out[i] = x if valid(x) else None
            todo = [i for i in todo if out[i] is None]
            if not todo:
                break
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _Calls(model, pace, concurrency or 1)
        for frame in frames:
            for a in range(0, len(frame), batch):
                rows = frame.iloc[a : a + batch]
                yield pd.DataFrame({key: rows[key], "_output": asked(rows, call)})

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = _Calls(model, pace, 1)
        for whole in batches:
            for a in range(0, whole.num_rows, batch * 64):
                b = whole.slice(a, batch * 64)
                frame = b.select(names).rename_columns(inputs).to_pandas()
                out = [x for k in range(0, len(frame), batch) for x in asked(frame.iloc[k : k + batch], call)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "_output"])

    if concurrency:
        made = df.select(key, *inputs).repartition(concurrency).mapInPandas(run, f"{key} {kind}, _output string")
        return df.join(made, key, "left").withColumn("output", F.coalesce("_output", fallback)).drop("_output")
    names = [f"_in{k}" for k in range(len(inputs))]
    rows = df.select(F.struct("*").alias("row"), *(F.col(c).alias(name) for c, name in zip(inputs, names, strict=True)))
    made = rows.mapInArrow(passed, StructType([StructField("row", df.schema), StructField("_output", StringType())]))
    return made.select("row.*", "_output").withColumn("output", F.coalesce("_output", fallback)).drop("_output")


@dataclass(frozen=True)
class Generator:
    """What a model is asked to make: from which columns, what counts as valid, and what stands in for it."""

    inputs: tuple[str, ...]
    valid: Callable[[str | None], bool]
    fallback: Callable[[], Column]

    def __call__(self, df: DataFrame, model: Model | None = None, key: str = "id", **how) -> DataFrame:
        return generated(df, key, list(self.inputs), model, self.valid, self.fallback(), **how)


def _disclaims(text: str) -> bool:
    return "as an ai" in text.lower() or "as a language model" in text.lower()


def _bulleted(least: int) -> Callable[[str | None], bool]:
    """Four or five bullets, long enough, no disclaimer."""
    return lambda x: bool(x) and len(x) >= least and 4 <= sum(line.strip().startswith("- ") for line in x.split("\n")) <= 5 and not _disclaims(x)


def _long(least: int) -> Callable[[str | None], bool]:
    return lambda x: bool(x) and len(x) >= least and not _disclaims(x)


def _object(*fields: str) -> Callable[[str | None], bool]:
    """A JSON object with these fields."""

    def valid(x: str | None) -> bool:
        try:
            return set(fields) <= set(json.loads(x or ""))
        except (ValueError, TypeError):
            return False

    return valid


#: Generators over items(id, title, summary, extracted_text, comments); the texts asked of them are the model's own affair.
GENERATORS = {
    "tags": Generator(("title", "summary"), bool, lambda: F.to_json(token_tags(F.concat_ws(" ", "title", "summary")))),
    "summary": Generator(("title", "extracted_text"), _bulleted(120), lambda: to_markdown(summary_bullets(F.col("title"), F.col("summary")))),
    "lite_summary": Generator(("title", "summary"), _bulleted(80), lambda: to_markdown(summary_bullets(F.col("title"), F.col("summary")))),
    "title_only": Generator(("title",), bool, lambda: F.array_join(title_only(F.col("title")), "\n")),
    "bundle": Generator(("title", "extracted_text"), _object("summary", "bias"), lambda: F.to_json(F.struct(summary_bullets(F.col("title"), F.col("summary")).alias("summary")))),
    "trust": Generator(("title", "extracted_text"), _object("whats_missing", "so_what", "framing"), lambda: F.to_json(fallback_trust())),
    "reaction": Generator(("title", "comments"), bool, lambda: reaction(F.col("comments"))),
    "bias": Generator(("title", "extracted_text"), _object("vestedInterests", "framingBias", "confidence"), lambda: F.lit("")),
    "missing": Generator(("title", "extracted_text"), _long(1), lambda: F.lit("")),
    "impact": Generator(("title", "extracted_text"), _object("shortTerm", "longTerm"), lambda: F.lit("")),
    "claims": Generator(("title", "extracted_text"), _object("claims"), lambda: F.lit('{"claims":[]}')),
    "long_text": Generator(("title", "extracted_text"), _long(400), lambda: F.lit("")),
}


def with_tags(items: DataFrame, model: Model | None = None) -> DataFrame:
    """Tags as JSON; by single words without a model."""
    return GENERATORS["tags"](items, model)


def with_vectors(items: DataFrame, vectors: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """Vectors from a table (id, embedding), or as JSON from a model on the embedding text."""
    if vectors is not None:
        return items.join(vectors, "id", "left")
    text = items.withColumn("_text", embedding_text(F.col("title"), F.col("description"), F.col("summary"), F.col("extracted_text")))
    return generated(text, "id", ["_text"], model, bool, F.lit(None).cast("string"), attempts=3).withColumn("embedding", F.from_json("output", "array<double>")).drop("_text", "output")


def title_only(title: Column) -> Column:
    """Bullets where there is too little text."""
    return F.array(F.concat(F.lit("- "), title), F.lit("- Only the headline was available for this item."))


def reaction(comments: Column) -> Column:
    """A summary of reactions without a model: the first comment's beginning."""
    first = F.get(comments, F.lit(0))
    return F.coalesce(F.substring(first, 1, 200), F.lit("No audience reaction is available yet."))
