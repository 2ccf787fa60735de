"""Deterministic ids and hashes as built-in expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def vector_id(id_: Column) -> Column:
    """A UUID's first 48 bits above 2^50, as a vector store's number."""
    return F.conv(F.substring(F.replace(id_, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long") + (1 << 50)


def shard(hexadecimal: Column, n: int) -> Column:
    """The last 8 digits of a hexadecimal hash, modulo n."""
    return F.pmod(F.conv(F.substring(hexadecimal, -8, 8), 16, 10).cast("long"), F.lit(n))
