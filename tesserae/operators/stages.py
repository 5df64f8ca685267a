"""Model stages that are called once: a call for each distinct input that no earlier call has answered, kept in a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Tables, save, shared_folder


class Answers:
    """Answers of models by stage and input, as JSON, under a folder of one set of models (without a name, a new one in the shared folder)."""

    SCHEMAS = {"answers": ("key string, stage string, value string", "key")}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.tables = Tables(spark, path or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}", self.SCHEMAS)

    def once(self, rows: DataFrame, stage: str, inputs: dict[str, Column], call: Callable[..., Column] | None, kind: str = "string") -> DataFrame:
        """``rows`` with the column ``stage`` (of type ``kind``): what ``call`` makes of ``inputs``; null without a call.

        Rows are written with their inputs first, so a model that is not deterministic gives one text to all that read it.
        Rows whose first input is null are not asked. Inputs that the table has answers for are left out by an
        anti-join before the call; an answer is written before it is used. Null answers (failures) are asked for again next time.
        """
        if call is None:
            return rows.withColumn(stage, F.lit(None).cast(kind))
        names = [f"_in{i}" for i in range(len(inputs))]
        known = F.concat_ws("\u0001", F.lit(stage), F.to_json(F.struct(*(c.cast("string").alias(n) for n, c in zip(names, inputs.values(), strict=True)))))
        asked = rows.select("*", *(c.alias(n) for n, c in zip(names, inputs.values(), strict=True)), F.when(next(iter(inputs.values())).isNotNull(), F.sha2(known, 256)).alias("key"))
        asked = save(asked, stage)
        wanted = asked.where("key is not null").select("key", *names).dropDuplicates(["key"])
        at = self.tables.version()
        have = self.tables.read("answers", wanted, at).where("value <> '{}'")
        missing = wanted.join(have.select("key"), "key", "left_anti")
        if not missing.isEmpty():
            made = missing.select("key", F.lit(stage).alias("stage"), F.to_json(F.struct(call(*names_of(names)).cast(kind).alias("v"))).alias("value"))
            self.tables.commit({"answers": made}, at=at)
        got = self.tables.read("answers", wanted).select("key", F.from_json("value", f"v {kind}")["v"].alias(stage))
        return asked.join(got, "key", "left").drop("key", *names)


def names_of(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]
