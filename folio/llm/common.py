"""Helpers shared by the corpus operators.

Column handling: operators never assume that a table has only the columns they
need. Inputs are projected to the named columns at once, and where rows are
handed on whole, working columns get names that no input column has.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df``, whatever characters the name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` (in any letter case) has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does just that, and much faster than ``translate``, to a
    text without other characters that have a lower case (capital or title letters, letter numbers, circled letters).
    A text of one byte a character is ASCII and needs no search for these."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .when(c.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c)))


def text_digest(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: a 128-bit key for a text (null and empty differ)."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def row_hash(df: DataFrame) -> Column:
    """A hash over all hashable columns, to order rows that share an id."""
    cols = [col(df, f.name) for f in df.schema.fields if not has_map(f.dataType)]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def has_map(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType)):
        return True
    if isinstance(t, T.ArrayType):
        return has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(has_map(f.dataType) for f in t.fields)
    return False


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    local = checkpoint_dir(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or local
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """``path`` as a local file system path that every worker has mounted."""
    path = path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"this operator needs a shared folder that workers have mounted, not {path}")
    return "/" + path.lstrip("/")


def write_file(path: str, data: bytes) -> None:
    """Write whole or not at all: a task that is run again replaces the file by the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
