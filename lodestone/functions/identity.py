"""Content addresses: SHA-256 of length-prefixed fields. Ids are 64 lower-case hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comes before each kind of record.
PREFIX = "lodestone"


def u64(n: Column | int) -> Column:
    """8 bytes, highest first."""
    return F.unhex(F.lpad(F.hex(F.lit(n).cast("long")), 16, "0"))


def field(value: Column | str) -> Column:
    data = F.lit(value.encode()) if isinstance(value, str) else value.cast("binary")
    return F.concat(u64(F.octet_length(data)), data)


def tuple_hash(*fields: Column | str) -> Column:
    """Each field behind its length, so that no two tuples look alike."""
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def raw(hex_id: Column) -> Column:
    return F.unhex(hex_id)


def tag(kind: str, prefix: str = PREFIX) -> str:
    return f"{prefix}.{kind}.v1"


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def source_id(namespace: Column | str, external: Column) -> Column:
    return tuple_hash(tag("source"), namespace, external)


def observation_id(source: Column, external: Column) -> Column:
    return tuple_hash(tag("observation"), raw(source), external)


def artifact_id(observation: Column, key: Column | str) -> Column:
    return tuple_hash(tag("artifact"), raw(observation), key)


def representation_id(inputs: list[tuple[str, Column]], processor: str, version: str, parameters: Column, media_type: str, content: Column) -> Column:
    """inputs: pairs of kind (artifact, representation) and id, in order."""
    each = [x for kind, id_ in inputs for x in (kind, raw(id_))]
    return tuple_hash(tag("representation"), u64(len(inputs)), *each, processor, version, raw(parameters), media_type, raw(content))


def segment_id(representation: Column, start: Column, stop: Column, content: Column) -> Column:
    return tuple_hash(tag("segment"), raw(representation), tag("selector.text-byte-range"), u64(start), u64(stop), raw(content))


def withdrawal_id(source: Column, external: Column) -> Column:
    return tuple_hash(tag("withdrawal"), raw(source), external)


def access_event_id(source: Column, access: Column, time: Column, actor: Column) -> Column:
    return tuple_hash(tag("access-event"), raw(source), access, u64(time), actor)


def log_leaf(record: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), record.cast("binary")), 256)


def packet_id(budget: Column, used: Column, selected: Column) -> Column:
    """selected: array of structs (segment_id, content_sha256, rank, bytes) in rank order."""
    each = F.transform(selected, lambda s: F.concat(field(raw(s["segment_id"])), field(raw(s["content_sha256"])), field(u64(s["rank"])), field(u64(s["bytes"]))))
    body = F.aggregate(each, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return F.sha2(F.concat(field(tag("packet")), field(u64(budget)), body, field(u64(used))), 256)


def observation_name(item: Column, digest: Column) -> Column:
    return F.concat(F.lit("item/"), item, F.lit("@"), digest)


def item_of(name: Column) -> Column:
    return F.regexp_extract(name, "^item/(.*)@[0-9a-f]{64}$", 1)
