"""Payload types and topics. A payload is any struct of which one column is the key and one, epoch milliseconds, the time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_DEC = T.DecimalType(38, 18)


@dataclass(frozen=True)
class PayloadType:
    """``required`` fields may not be null; ``parallel`` names pairs of lists that must be equally long where both are given."""

    type_id: str
    schema: T.StructType = field(compare=False, hash=False)
    key: str
    time: str
    required: tuple[str, ...] = ()
    parallel: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        names = self.schema.fieldNames()
        for c in (self.key, self.time, *self.required, *(x for p in self.parallel for x in p)):
            if c not in names:
                raise ValueError(f"{self.type_id} has no field {c!r}")


@dataclass(frozen=True)
class Topic:
    """Equal only if both name and payload type are."""

    name: str
    payload: PayloadType

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a topic needs a name")
        if self.name == RESERVED:
            raise ValueError(f"{RESERVED} is reserved")


RESERVED = "eventweave.command"



def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "decimal": _DEC, "timestamp": T.TimestampType(), "date": T.DateType(), "decimals": T.ArrayType(_DEC), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


TEXT_MESSAGE = PayloadType("TextMessage", _struct("msgKey string,msgTime bigint,text string"), "msgKey", "msgTime", ("msgKey", "msgTime", "text"))
HEART_BEAT = PayloadType("HeartBeat", _struct("beatKey string,beatTime bigint"), "beatKey", "beatTime", ("beatKey", "beatTime"))
CDF_BAR = PayloadType(
    "CdfBar", _struct("symb string,timestamp bigint,op decimal,hi decimal,lo decimal,cl decimal,vlm bigint,datetime timestamp,date date,vwap decimal,count int"),
    "symb", "timestamp", ("symb", "timestamp", "op", "hi", "lo", "cl"),
)
VECTOR_VALUE = PayloadType("VectorValue", _struct("key string,time bigint,values decimals,valueIds strings"), "key", "time", ("key", "time", "values"), (("values", "valueIds"),))

#: Known types by id; `register` adds to it.
TYPES: dict[str, PayloadType] = {p.type_id: p for p in (TEXT_MESSAGE, HEART_BEAT, CDF_BAR, VECTOR_VALUE)}


def register(kind: PayloadType) -> PayloadType:
    if TYPES.setdefault(kind.type_id, kind) != kind:
        raise ValueError(f"another payload type has the id {kind.type_id!r}")
    return kind
