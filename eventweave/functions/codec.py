"""JSON forms of payloads: plain by type, and tagged with the type's id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweave.topics import TYPES, PayloadType


def to_json(payload: Column) -> Column:
    """Plain JSON; null fields are left out. Decimals are written with as many digits as their column's scale has."""
    return F.to_json(payload)


def valid(payload: Column, kind: PayloadType) -> Column:
    """Whether every required field is there and parallel lists are equally long."""
    ok = payload.isNotNull()
    for c in (kind.key, kind.time, *kind.required):
        ok = ok & payload[c].isNotNull()
    for a, b in kind.parallel:
        ok = ok & (payload[b].isNull() | (F.size(payload[a]) == F.size(payload[b])))
    return F.coalesce(ok, F.lit(False))


def parse(json: Column, kind: PayloadType) -> Column:
    """The payload struct, or null where the text is no JSON object of the type or breaks its rules. Unknown fields are ignored."""
    with_bad = T.StructType([*kind.schema.fields, T.StructField("_bad", T.StringType())])
    got = F.from_json(json, with_bad, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    payload = F.struct(*[got[f.name].alias(f.name) for f in kind.schema.fields])
    return F.when(got.isNotNull() & got["_bad"].isNull() & valid(payload, kind), payload)


def to_tagged(payload: Column, kind: PayloadType) -> Column:
    return F.to_json(F.struct(F.lit(kind.type_id).alias("typeId"), payload.alias("payload")))


def type_id(tagged: Column) -> Column:
    return F.get_json_object(tagged, "$.typeId")


def parse_tagged(tagged: Column, kind: PayloadType) -> Column:
    """The payload of a tagged text of this type; null for other types and broken texts."""
    return F.when(type_id(tagged) == kind.type_id, parse(F.get_json_object(tagged, "$.payload"), kind))


def known_type(tagged: Column) -> Column:
    return F.coalesce(type_id(tagged).isin(*TYPES), F.lit(False))


def summary(topic: Column, payload: Column) -> Column:
    """The text an echo carries: topic and payload."""
    return F.concat(topic, F.lit(" :: "), F.to_json(payload))
