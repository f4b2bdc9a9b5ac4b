"""What operators need from the session: tables, and a shared folder to cut lineage in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts (of bounded length) and keys up to so many are sent to what they are joined with.
BROADCAST_TEXTS = 20_000
LONGEST_SENT = 400
BROADCAST_KEYS = 200_000
#: Places that hashed keys fall into; a row of each at most is sent, whatever the number of keys.
SLOTS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="umbraline-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and forget how it was made."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joined(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """``blocks`` with what ``texts``, a written table, says of theirs."""
    size, longest = texts.agg(F.count("*"), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    return blocks.join(F.broadcast(texts) if size <= BROADCAST_TEXTS and longest <= LONGEST_SENT else texts, "text")


def sent(keys: DataFrame) -> DataFrame:
    """A written table of short keys, marked to be sent if it is small: what is joined with it then stays where it is."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def met(rows: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``own``, a written table, on short keys, where few of the rows have a partner.

    More keys than are sent as they are first say into which places their hashes fall; rows in
    other places have no partner and stay where they are.
    """
    if own.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(own), keys)
    if any(rows.schema[k].dataType != own.schema[k].dataType for k in keys):
        return rows.join(own, keys)  # equal values of two types have different hashes
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("_slot")
    may = rows.select("*", slot).join(F.broadcast(own.select(slot).distinct()), "_slot", "left_semi").drop("_slot")
    return may.join(own, keys)
