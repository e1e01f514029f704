"""Frozen tables of fitted values: what a fit learned about the values of one column, too many for a literal map.

The table is written once at fit, under ``spark.checkpoint.dir``, so a transform never recomputes it from the training
table. It is broadcast if its measured bytes are few. Beyond that it is joined by a shuffle on the value, which neither a
frequent value nor the missing ones may fill: the ``HOT`` most frequent values are a literal map, and rows that need no
join get keys spread over ``SPREAD`` groups, whose result is not used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import qcol
from sparkprep.operators.profile import atomic_columns
from sparkprep.session import ensure_checkpoint_dir

HOT = 64
SPREAD = 4096
BROADCAST_BYTES = 64 << 20


def freeze(values: DataFrame) -> tuple:
    """Write ``(value, code, cnt)``, each value once, and give its state: ``("table", (value, code), facts)``."""
    spark = values.sparkSession
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/frozen-{uuid.uuid4().hex}"
    values.select("value", "code", "cnt").write.parquet(where)
    table = spark.read.parquet(where)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 24).alias("b")).first()
    hot = {r["value"]: r["code"] for r in table.orderBy(F.desc("cnt"), "value").limit(HOT).collect()}
    return "table", table.select("value", "code"), {"values": size["n"], "bytes": size["b"] or 0, "hot": hot, "path": where}


def is_frozen(state) -> bool:
    return isinstance(state, tuple) and len(state) == 3 and state[0] == "table"


def describe(state) -> dict:
    """What an audit says about a frozen table: how many values it has and where it is."""
    return {"values": state[2]["values"], "table": state[2]["path"]}


def look_up(df: DataFrame, key: Column, state: tuple, name: str) -> DataFrame:
    """``df`` with the code of ``key`` as column ``name``, null where the key is null or has none."""
    _, table, facts = state
    k, found, v = f"__key_{name}", f"__found_{name}", f"__value_{name}"
    hot = F.create_map(*[F.lit(x) for pair in facts["hot"].items() for x in pair])
    cur = df.withColumn(k, key)
    known = hot[qcol(k)] if facts["hot"] else F.lit(None).cast("bigint")
    side = table.select(F.col("value").alias(v), F.col("code").alias(found))
    if facts["bytes"] <= BROADCAST_BYTES:
        cur = cur.join(F.broadcast(side), qcol(k) == qcol(v), "left")
    else:
        anywhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[qcol(c) for c in atomic_columns(df)]), F.lit(SPREAD)).cast("string"))
        joined = F.when(qcol(k).isNull() | known.isNotNull(), anywhere).otherwise(qcol(k))
        cur = cur.withColumn(f"__join_{name}", joined).join(side, qcol(f"__join_{name}") == qcol(v), "left").drop(f"__join_{name}")
    code = F.when(qcol(k).isNotNull(), F.coalesce(known, qcol(found)))
    return cur.withColumn(name, code).drop(k, v, found)
