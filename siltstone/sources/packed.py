"""The packed snapshot format: a header with fingerprints, field descriptors, then the values."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from siltstone.functions import fingerprint
from siltstone.functions.batches import by_value, parts
from siltstone.functions.text import FILLERS

# Layout of the format.
FILE_MAGIC, FILE_VERSION, MAGIC, VERSION = b"SNAPFILE", 1, b"SNAP", 1
HEAD, SLOTS, FIELD = "<4sHBH32sQ", "<128I", "<HBII"
STRING, INTEGER, BINARY, ARRAY = range(4)
_NUMBER = {w: i for i, w in enumerate(FILLERS, 1)}


def fnv1a(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def field_number(name: str) -> int:
    return fnv1a(name.encode()) % 65535 + 1


def compact(text: str) -> str:
    def part(m: re.Match) -> str:
        p = m[0]
        if not re.match(r"\w", p):
            return re.sub(r"\s+", " ", p)
        if number := _NUMBER.get(p.lower()):
            return "\0" + chr(number)
        keep = 1 if p[0].lower() in "aeiou" else 0
        return p[:keep] + re.sub("[aeiouAEIOU]", "", p[keep:])

    return re.sub(r"\w+|\W+", part, text)


def spread(text: str) -> str:
    return re.sub("\0(.)", lambda m: f" {FILLERS[ord(m[1]) - 1]} " if 0 < ord(m[1]) <= len(FILLERS) else m[0], text, flags=re.S)


def _encode(value) -> tuple[int, bytes]:
    if isinstance(value, str):
        return STRING, compact(value).encode()
    if isinstance(value, int):
        return INTEGER, struct.pack("<q", value)
    if isinstance(value, list | tuple):
        items = [_encode(v)[1] for v in value]
        return ARRAY, struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)
    if isinstance(value, bytes):
        return BINARY, value
    return STRING, str(value).encode()


def pack(type_number: int, values: dict, content_hash: bytes, simhash: int, minhash: list[int]) -> bytes:
    fields, data = [], b""
    for name, value in values.items():
        kind, raw = _encode(value)
        fields.append(struct.pack(FIELD, field_number(name), kind, len(data), len(raw)))
        data += raw
    slots = (list(minhash) + [0] * 128)[:128]
    return struct.pack(HEAD, MAGIC, VERSION, type_number, len(fields), content_hash, simhash & (1 << 64) - 1) + struct.pack(SLOTS, *slots) + b"".join(fields) + data


def unpack(data: bytes, names: dict[int, str]) -> dict:
    """Type, values, content hash, SimHash and MinHash; fields whose number isn't in ``names`` are left out. ValueError for other data."""
    start = struct.calcsize(HEAD) + struct.calcsize(SLOTS)
    if len(data) < start:
        raise ValueError(f"{len(data)} bytes are too few")
    magic, version, kind, count, digest, simhash = struct.unpack_from(HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a packed snapshot of version {VERSION}")
    base, values = start + count * struct.calcsize(FIELD), {}
    for i in range(count):
        number, tag, at, size = struct.unpack_from(FIELD, data, start + i * struct.calcsize(FIELD))
        raw = data[base + at : base + at + size]
        if number in names:
            values[names[number]] = _decode(tag, raw)
    return {"type": kind, "values": values, "content_hash": digest, "simhash": simhash, "minhash": list(struct.unpack_from(SLOTS, data, struct.calcsize(HEAD)))}


def _decode(tag: int, raw: bytes):
    if tag == INTEGER:
        return struct.unpack("<q", raw)[0]
    if tag == BINARY:
        return raw
    if tag == ARRAY:
        n, at, out = struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0, 4, []
        while len(out) < n and at + 4 <= len(raw):
            size = struct.unpack_from("<I", raw, at)[0]
            if at + 4 + size > len(raw):
                break
            out.append(raw[at + 4 : at + 4 + size].decode("utf-8", "replace"))
            at += 4 + size
        return out
    text = raw.decode("utf-8", "replace")
    return spread(text) if tag == STRING else text


def file_header(project_id: str, count: int) -> bytes:
    name = project_id.encode()
    return FILE_MAGIC + struct.pack("<HHI", FILE_VERSION, len(name), count) + name


def header_project(data: Column) -> Column:
    """The project id of a file header; null for other data."""
    size = F.conv(F.concat(F.hex(F.substring(data, 12, 1)), F.hex(F.substring(data, 11, 1))), 16, 10).cast("int")
    return F.when(F.substring(data, 1, 8) == F.lit(FILE_MAGIC), F.decode(F.substring(data, F.lit(17), size), "UTF-8"))


def _pack_row(type_number: int, values: str, content_hash: str, simhash: int, minhash: list[int]) -> bytes:
    return pack(type_number, json.loads(values), bytes.fromhex(content_hash), simhash, minhash)


def _unpack_row(data: bytes, names: dict[int, str]) -> str:
    return json.dumps(unpack(data, names)["values"], sort_keys=True, ensure_ascii=False, default=lambda b: b.hex())


@cache
def _names() -> dict[int, str]:
    from siltstone.registry import fields

    return {field_number(f.field_id): f.field_id for f in fields()}


@F.arrow_udf(BinaryType())
def pack_json(type_number: pa.Array, values: pa.Array, content_hash: pa.Array, simhash: pa.Array, minhash: pa.Array) -> pa.Array:
    """Packs rows: values as a JSON object, the content hash as hex, the SimHash as signed 64 bits."""
    rows = zip(type_number, values, content_hash, simhash, minhash, strict=True)
    return pa.array((_pack_row(*[x.as_py() for x in row]) for row in rows), pa.binary())


@by_value(StringType(), pa.string())
def unpack_json(data: bytes) -> str:
    """The values of packed rows as JSON, for all registered fields."""
    return _unpack_row(data, _names())


def round_trip(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, values) of rows (id, type_number, values, content_hash, text, minhash): each packed with its text's SimHash and
    unpacked again, in one pass of one worker. Rows stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, out = [], []
            for row in zip(*batch.columns[1:], strict=True):
                kind, values, digest, text, slots = [x.as_py() for x in row]
                data = _pack_row(kind, values, digest, fingerprint.simhash(text), slots)
                sizes.append(len(data))
                out.append(_unpack_row(data, _names()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.string())], names=["id", "n_bytes", "values"])

    return rows.select("id", "type_number", "values", "content_hash", "text", "minhash").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes int, values string")
