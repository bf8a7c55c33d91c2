"""Canonical records: JSON objects of known kinds, each spelled in one way only and named by the hash of its fields.

Decoding is strict, as Spark's own is not: a name that comes twice, a sign out of place or another spelling is a fault. What a record of a
kind must hold is told by one table; its id is made again from its fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I

# Values come out of the decoder with a sign for their kind: text, number, null, yes or no, or what is nested.
TEXT, HEX, COUNT, TIME = r"^s:(?s:.+)$", r"^s:(?!0{64}$)[0-9a-f]{64}$", r"^n:(0|[1-9][0-9]{0,18})$", r"^n:[1-9][0-9]{0,18}$"
NESTED, FLAG, HEX_OR_NONE, STATE_OR_NONE = r"^j:(?s:.+)$", "^b:(true|false)$", r"^(z:|s:[0-9a-f]{64})$", "^(z:|s:(active|withdrawn))$"


def _one_of(*values: str) -> str:
    return f"^s:({'|'.join(v.replace('.', chr(92) + '.') for v in values)})$"


def _kind(name: str, **fields: str) -> dict[str, str]:
    return {"schema": _one_of(I.tag(name)), "id": HEX, **fields}


#: Fields of each kind, in order, with what their values look like.
KINDS: dict[str, dict[str, str]] = {
    "source": _kind("source", namespace=TEXT, external_source_id=TEXT),
    "observation": _kind("observation", source_id=HEX, external_observation_id=TEXT),
    "artifact": _kind("artifact", observation_id=HEX, artifact_key=TEXT, media_type=TEXT, content_sha256=HEX, byte_length=COUNT),
    "representation": _kind("representation", inputs=NESTED, processor_id=TEXT, processor_version=TEXT, parameters_sha256=HEX, media_type=TEXT, content_sha256=HEX, byte_length=COUNT),
    "segment": _kind("segment", representation_id=HEX, selector=NESTED, content_sha256=HEX),
    "withdrawal": _kind("withdrawal", source_id=HEX, external_withdrawal_id=TEXT, occurred_at=TIME),
    "access-event": _kind("access-event", source_id=HEX, access=_one_of("allow", "deny"), time=TIME, actor=r"^s:[\x20-\x7e]{1,256}$"),
    "request": _kind("request", action=_one_of("source.retrieve"), caller_namespace=TEXT, caller_id=TEXT, request_name=TEXT, purpose_namespace=TEXT, purpose_id=TEXT, source_id=HEX, requested_at=TIME),
    "decision": _kind("decision", request_id=HEX, evaluator_id=TEXT, evaluator_version=TEXT, evaluated_at=TIME, state_present=FLAG, collection_state=STATE_OR_NONE, withdrawal_id=HEX_OR_NONE, access=_one_of("allow", "deny"), access_event_id=HEX_OR_NONE, outcome=_one_of("allow", "deny"), reasons=NESTED),
}


class _Twice(ValueError):
    pass


def _pairs(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise _Twice
    return dict(pairs)


def _constant(name: str) -> None:
    raise ValueError(name)


def _spelled(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _decode(text: str | None) -> tuple[str | None, dict[str, str] | None]:
    try:
        record = json.loads(text or "", object_pairs_hook=_pairs, parse_constant=_constant)
        if not isinstance(record, dict):
            return "syntax", None
        if _spelled(record).encode() != text.encode():
            return "spelling", None
    except _Twice:
        return "duplicate_name", None
    except (ValueError, RecursionError):
        return "syntax", None
    signs = {str: lambda v: f"s:{v}", bool: lambda v: f"b:{_spelled(v)}", int: lambda v: f"n:{v}", float: lambda v: f"n:{_spelled(v)}", type(None): lambda v: "z:"}
    return None, {k: signs.get(type(v), lambda v: f"j:{_spelled(v)}")(v) for k, v in record.items()}


def _decoded(text: pd.Series) -> pd.DataFrame:
    found = [_decode(t) for t in text]
    return pd.DataFrame({"fault": [f for f, _ in found], "names": [None if v is None else list(v) for _, v in found], "signs": [None if v is None else list(v.values()) for _, v in found]})


def decoded(text: Column) -> Column:
    """What is wrong with a record's spelling (fault), or its names and signed values in order (names, signs)."""
    return F.pandas_udf(_decoded, "fault string, names array<string>, signs array<string>")(text)


def _repeated(items: Column, one: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(items, one), F.lit(b""), lambda acc, x: F.concat(acc, x))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _ids(v: Callable[[str], Column]) -> dict[str, Column]:
    """The id that each kind's fields give. ``v`` gives a field's value without its sign."""
    field, raw, u64 = I.field, I.raw, lambda c: I.u64(c.cast("long"))
    inputs = F.from_json(v("inputs"), "array<struct<kind:string,id:string>>")
    span = F.from_json(v("selector"), "struct<start:bigint,stop:bigint>")
    some = lambda c: F.coalesce(raw(c), F.lit(b""))
    return {
        "source": I.source_id(v("namespace"), v("external_source_id")),
        "observation": I.observation_id(v("source_id"), v("external_observation_id")),
        "artifact": I.artifact_id(v("observation_id"), v("artifact_key")),
        "representation": _hash(
            field(I.tag("representation")), field(I.u64(F.size(inputs))), _repeated(inputs, lambda i: F.concat(field(i["kind"]), field(raw(i["id"])))),
            field(v("processor_id")), field(v("processor_version")), field(raw(v("parameters_sha256"))), field(v("media_type")), field(raw(v("content_sha256"))),
        ),
        "segment": I.segment_id(v("representation_id"), span["start"], span["stop"], v("content_sha256")),
        "withdrawal": I.withdrawal_id(v("source_id"), v("external_withdrawal_id")),
        "access-event": I.access_event_id(v("source_id"), v("access"), v("time").cast("long"), v("actor")),
        "request": I.tuple_hash(I.tag("request"), *[v(n) for n in ("action", "caller_namespace", "caller_id", "request_name", "purpose_namespace", "purpose_id")], raw(v("source_id")), u64(v("requested_at"))),
        "decision": _hash(
            field(I.tag("decision")), field(raw(v("request_id"))), field(v("evaluator_id")), field(v("evaluator_version")), field(u64(v("evaluated_at"))),
            field(F.when(v("state_present") == "true", F.lit(b"\x01")).otherwise(F.lit(b"\x00"))), field(F.coalesce(v("collection_state"), F.lit(""))), field(some(v("withdrawal_id"))), field(v("access")), field(some(v("access_event_id"))),
            field(v("outcome")), _repeated(F.from_json(v("reasons"), "array<string>"), field),
        ),
    }


def record_faults(records: DataFrame, kind: str = "kind", record: str = "record") -> DataFrame:
    """``records`` with the first ``fault`` of each, null if sound: unknown_kind, syntax, duplicate_name, spelling, unknown_field, missing_field, bad_value or wrong_id.

    A record whose fields stand in another order than the kind's is a matter of spelling. A null record is a fault of syntax.
    """
    rows = records.withColumn("_d", decoded(F.col(record)))
    values = F.map_from_arrays("_d.names", "_d.signs")
    rows = rows.withColumn("_v", values)
    value = lambda name: F.nullif(F.substr(F.try_element_at("_v", F.lit(name)), F.lit(3)), F.lit("")) if name in ("collection_state", "withdrawal_id", "access_event_id") else F.substr(F.try_element_at("_v", F.lit(name)), F.lit(3))
    ids = _ids(value)
    names = F.col("_d.names")
    fault = F.when(~F.col(kind).isin(*KINDS) | F.col(kind).isNull(), "unknown_kind").when(F.col("_d.fault").isNotNull(), F.col("_d.fault"))
    for name, fields in KINDS.items():
        mine, expected = F.col(kind) == name, F.array(*[F.lit(f) for f in fields])
        bad = F.lit(False)
        for f, pattern in fields.items():
            bad = bad | ~F.try_element_at("_v", F.lit(f)).rlike(pattern)
        fault = (
            fault.when(mine & (F.size(F.array_except(names, expected)) > 0), "unknown_field")
            .when(mine & (F.size(F.array_except(expected, names)) > 0), "missing_field")
            .when(mine & (names != expected), "spelling")
            .when(mine & bad, "bad_value")
            .when(mine & ~F.coalesce(ids[name] == value("id"), F.lit(False)), "wrong_id")
        )
    return rows.withColumn("fault", fault).drop("_d", "_v")
