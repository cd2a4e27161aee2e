"""Operators that ask a model: the client is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pipeline import FAILURE

#: Takes prompts and gives an answer for each, None where there is none. Made once a task.
Client = Callable[[list[str]], list[str | None]]


def asked(df: DataFrame, prompt: Column, client: Callable[[], Client], into: str = "answer", op_name: str = "ask", batch: int = 32) -> DataFrame:
    """df with the model's answers to the prompts, and failed_reason where the client raised or gave none; rows without a prompt have neither.

    client is called once in each task, so what it opens is opened there. Prompts go out in batches; the answers of a
    batch that fails are asked for one by one.
    """
    rows = df.withColumn("_prompt", prompt)
    schema = rows.drop("_prompt").withColumn(into, F.lit(None).cast("string")).withColumn("_why", F.lit(None).cast("string")).schema

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client()

        def answers(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                got = list(send(prompts))
                if len(got) != len(prompts):
                    raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
                return [(a, None if a is not None else "no answer") for a in got]
            except Exception as e:
                return [(None, repr(e))] if len(prompts) == 1 else [x for p in prompts for x in answers([p])]

        for frame in frames:
            some = frame.index[frame["_prompt"].notna()]
            found: dict = {}
            for i in range(0, len(some), batch):
                part = some[i : i + batch]
                found |= dict(zip(part, answers(frame.loc[part, "_prompt"].tolist())))
            out = frame.drop(columns="_prompt")
            out[into] = [found.get(i, (None, None))[0] for i in frame.index]
            out["_why"] = [found.get(i, (None, None))[1] for i in frame.index]
            yield out[schema.names]

    out = rows.mapInPandas(ask, schema)
    reason = F.when(F.col("_why").isNotNull(), F.struct(F.lit(op_name).alias("op_name"), F.lit("83000").alias("error_code"), F.col("_why").alias("reason")))
    old = F.col("failed_reason") if "failed_reason" in df.columns else F.lit(None).cast(FAILURE)
    return out.withColumn("failed_reason", F.coalesce(old, reason)).drop("_why")
