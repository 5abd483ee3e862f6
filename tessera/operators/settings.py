"""Settings of configurations that extend others: the nearest one that sets a pointer gives its value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, stored

#: Configurations above one that are looked at; a longer chain, or a circle, sets nothing.
DEPTH = 8


def settings(configs: DataFrame, extends: DataFrame, asked: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """What configurations set at pointers, themselves or by what they extend: config, pointer, value, set_by.

    configs: config, json, its text. extends: config, target, pos, in the order that it names them. asked: config,
    pointer (`/a/b`). A configuration's own value comes first, then its last extended one with all that this extends,
    then the one before. value is JSON text; a null that is set is `null`, which ends the search, and what is set nowhere
    has no value and no set_by. Text that is no JSON sets nothing and still extends.
    """
    parsed = stored(configs.select(F.col("config").alias("at"), F.try_parse_json("json").alias("_json")))
    # `$['a']['b']`, as any text can be a name.
    unescaped = lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    place = F.concat(F.lit("$"), F.array_join(F.transform(F.filter(F.split("pointer", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("['"), unescaped(x), F.lit("']"))), ""))
    up = stored(extends.where("target is not null").select(F.col("config").alias("at"), F.col("target").alias("_to"), (-F.col("pos")).cast("int").alias("_rank")))
    fresh = stored(asked.select("config", "pointer").distinct().select("config", "pointer", F.col("config").alias("at"), F.array().cast("array<int>").alias("way")))
    found = None
    for _ in range(depth + 1):
        if fresh.isEmpty():
            break
        here = fresh.join(parsed, "at", "left").withColumn("value", F.to_json(F.try_variant_get("_json", place, "variant")))
        here = stored(here.drop("_json"))
        hit = stored(here.where("value is not null").select("config", "pointer", "value", F.col("at").alias("set_by"), "way"))
        found = hit if found is None else found.unionByName(hit)
        # One way to a configuration is enough: of those as long, the one that is looked at first.
        step = here.where("value is null").join(up, "at").select("config", "pointer", F.col("_to").alias("at"), F.concat("way", F.array("_rank")).alias("way"))
        looked, fresh = fresh, stored(step.groupBy("config", "pointer", "at").agg(F.min("way").alias("way")))
        discard(looked, here)
    discard(parsed, up)
    if found is None:
        return asked.select("config", "pointer", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("set_by"))
    first = found.groupBy("config", "pointer").agg(F.min_by(F.struct("value", "set_by"), "way").alias("x"))
    return asked.select("config", "pointer").distinct().join(first, ["config", "pointer"], "left").select("config", "pointer", "x.value", "x.set_by")
