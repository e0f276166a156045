"""Content-addressed shard identity and the seeds that follow from it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import iso

#: Version tags that are part of the hashed payloads; a caller that needs other tags passes them.
SHARD_TAG, SEED_TAG = "panelworks-shard-v1", "panelworks-seed-v1"
SEED_MODULUS = 2**32 - 1


def shard_identity(split: str, seed: int, keys: Iterable[tuple[str, str]], tag: str = SHARD_TAG) -> str:
    """24 hex digits that name a set of (origin ISO text, ticker) keys, whatever their order."""
    ordered = sorted((str(o), str(t)) for o, t in keys)
    if not ordered:
        raise ValueError("a shard has at least one key")
    if len(set(ordered)) != len(ordered):
        raise ValueError("duplicate keys in a shard")
    payload = {"contract": tag, "keys": [list(k) for k in ordered], "seed": int(seed), "split": split}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


def effective_seed(seed: int, shard_id: str, tag: str = SEED_TAG) -> int:
    """A seed below 2**32 - 1 for a shard's random draws."""
    digest = hashlib.sha256("\0".join((tag, str(int(seed)), shard_id)).encode()).digest()
    return int.from_bytes(digest[:8], "big") % SEED_MODULUS


def shard_identities(keys: DataFrame, by: list[str], split: Column, seed: Column, tag: str = SHARD_TAG) -> DataFrame:
    """``by..., logical_shard_id`` for each group of rows with ``origin`` and ``ticker``.

    The JSON text equals Python's for ASCII tickers; others raise, as the two
    escape them differently.  A shard is a bounded unit of inference, so its
    keys are gathered in one row.
    """
    origin = iso(F.col("origin"))
    pair = F.array(origin, F.col("ticker"))
    # bytes other than printable ASCII can't be hashed alike
    plain = F.when(F.col("ticker").rlike(r"^[\x20-\x7e]*$"), pair).otherwise(F.raise_error(F.lit("shard keys must be ASCII")).cast("array<string>"))
    grouped = keys.groupBy(*by, split.alias("_split"), seed.cast("bigint").alias("_seed")).agg(F.array_sort(F.collect_list(plain)).alias("keys"))
    payload = F.to_json(F.struct(F.lit(tag).alias("contract"), F.col("keys"), F.col("_seed").alias("seed"), F.col("_split").alias("split")))
    return grouped.select(*by, F.substring(F.sha2(payload, 256), 1, 24).alias("logical_shard_id"))


def effective_seed_column(seed: Column, shard_id: Column, tag: str = SEED_TAG) -> Column:
    text = F.concat(F.lit(tag + "\0"), seed.cast("string"), F.lit("\0"), shard_id)
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(SEED_MODULUS).cast("decimal(20,0)")).cast("bigint")


def shard_path(directory: str, split: str, seed: int, shard_id: str, prefix: str = "forecast") -> str:
    if not re.fullmatch(r"[0-9a-f]{24}", shard_id):
        raise ValueError("a shard id is 24 hex digits")
    return f"{directory}/{prefix}-{split}-seed{int(seed)}-{shard_id}.parquet"
