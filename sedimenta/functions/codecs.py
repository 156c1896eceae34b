"""Typed values as one tag byte and a payload; key previews; field escapes; page encryption."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag of each preference type, fixed values.
TAGS = {"string": 1, "int": 2, "double": 3, "bool": 4, "stringList": 5, "bytes": 6}
_NAMES = {v: k for k, v in TAGS.items()}


def _tag(kind: str) -> Column:
    return F.unhex(F.lit(f"{TAGS[kind]:02x}"))


def _little_endian(hexed: Column) -> Column:
    """Bytes of a fixed-width hex string in reverse order."""
    pairs = F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def encode_string(c: Column) -> Column:
    return F.concat(_tag("string"), F.encode(c, "UTF-8"))


def encode_bytes(c: Column) -> Column:
    return F.concat(_tag("bytes"), c)


def encode_bool(c: Column) -> Column:
    return F.concat(_tag("bool"), F.when(c, F.unhex(F.lit("01"))).when(~c, F.unhex(F.lit("00"))))


def encode_int(c: Column) -> Column:
    return F.concat(_tag("int"), _little_endian(F.lpad(F.hex(c.cast("long")), 16, "0")))


@F.pandas_udf(T.BinaryType())
def encode_double(v: pd.Series) -> pd.Series:
    raw, tag = v.to_numpy("<f8", na_value=np.nan).tobytes(), bytes([TAGS["double"]])
    out = pd.Series([tag + raw[i : i + 8] for i in range(0, len(raw), 8)], index=v.index, dtype=object)
    return out.where(v.notna(), None)


@F.pandas_udf(T.DoubleType())
def _doubles(v: pd.Series) -> pd.Series:
    good = v.map(lambda x: x is not None and len(x) == 8)
    out = pd.Series([None] * len(v), index=v.index, dtype=object)
    out[good] = np.frombuffer(b"".join(v[good]), "<f8").tolist()
    return out


def encode_list(c: Column) -> Column:
    """A count, then each string's length and bytes; counts are four bytes."""
    width = lambda n: _little_endian(F.lpad(F.hex(n.cast("long")), 8, "0"))
    item = lambda x: F.concat(width(F.octet_length(x)), F.encode(x, "UTF-8"))
    body = F.aggregate(c, F.unhex(F.lit("")), lambda s, x: F.concat(s, item(x)))
    return F.concat(_tag("stringList"), width(F.size(c)), body)


def type_of(value: Column) -> Column:
    """Name of a stored value's type; null for one that has none."""
    tag = F.hex(F.substring(value, 1, 1))
    out = F.lit(None).cast("string")
    for name, t in TAGS.items():
        out = F.when(tag == f"{t:02X}", name).otherwise(out)
    return out


def _payload(value: Column) -> Column:
    return F.substring(value, F.lit(2), F.octet_length(value))


def _expect(value: Column, kind: str, decoded: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"expected {kind}, found "), F.coalesce(type_of(value), F.lit("nothing"))))
    return F.when(value.isNull(), None).when(type_of(value) == kind, decoded).otherwise(wrong)


def decode_string(value: Column) -> Column:
    return _expect(value, "string", F.decode(_payload(value), "UTF-8"))


def decode_bytes(value: Column) -> Column:
    return _expect(value, "bytes", _payload(value))


def decode_bool(value: Column) -> Column:
    return _expect(value, "bool", F.hex(_payload(value)) == "01")


def decode_int(value: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(_payload(value)), F.lit(".."), F.lit(0))
    big = F.array_join(F.reverse(pairs), "")
    unsigned = F.conv(big, 16, 10).cast("decimal(20,0)")
    wide = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    signed = F.when(unsigned >= wide(2**63), unsigned - wide(2**64)).otherwise(unsigned)
    return _expect(value, "int", signed.cast("long"))


def decode_double(value: Column) -> Column:
    return _expect(value, "double", _doubles(_payload(value)))


def _width(hexed: Column) -> Column:
    """A count of four bytes, the lowest first, from its hex form."""
    pairs = F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def _bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once."""
    return F.transform(F.array(c), use)[0]


def decode_list(value: Column) -> Column:
    """Strings of a list; counts that point beyond its bytes are an error, as is what is left over."""

    def items(body: Column) -> Column:
        n, size = _width(F.substring(body, 1, 8)), F.length(body)
        start = F.struct(F.lit(9).cast("long").alias("at"), F.array().cast("array<string>").alias("items"))

        def step(a: Column, _: Column) -> Column:
            def taken(width: Column) -> Column:
                begin = a["at"] + 8
                item = F.decode(F.unhex(F.substring(body, begin.cast("int"), (2 * width).cast("int"))), "UTF-8")
                ok = (begin - 1 + 2 * width <= size) & (a["at"] > 0)
                return F.when(ok, F.struct((begin + 2 * width).alias("at"), F.concat(a["items"], F.array(item)).alias("items")))

            return F.coalesce(_bound(_width(F.substring(body, a["at"].cast("int"), F.lit(8))), taken), F.struct(F.lit(-1).cast("long").alias("at"), a["items"].alias("items")))

        # a count can't be larger than the bytes there are
        rounds = F.when((n > 0) & (8 * n <= size), F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
        whole = lambda done: F.when((done["at"] == size + 1) & (F.size(done["items"]) == n), done["items"])
        return _bound(F.aggregate(rounds, start, step), whole)

    found = _bound(_bound(F.hex(_payload(value)), items), lambda x: F.coalesce(x, F.raise_error(F.lit("truncated list")).cast("array<string>")))
    return _expect(value, "stringList", found)


def decode_value(raw: bytes | None):
    """A stored value as a Python object, with bounds checked."""
    if raw is None:
        return None
    raw = bytes(raw)
    kind = _NAMES.get(raw[0]) if raw else None
    body = raw[1:]
    if kind == "string":
        return body.decode()
    if kind == "bytes":
        return body
    if kind == "int" and len(body) == 8:
        return struct.unpack("<q", body)[0]
    if kind == "double" and len(body) == 8:
        return struct.unpack("<d", body)[0]
    if kind == "bool" and len(body) == 1:
        return body == b"\x01"
    if kind == "stringList" and len(body) >= 4:
        n, at, out = struct.unpack("<I", body[:4])[0], 4, []
        for _ in range(n):
            if at + 4 > len(body):
                raise ValueError("truncated list")
            width = struct.unpack("<I", body[at : at + 4])[0]
            if at + 4 + width > len(body):
                raise ValueError("truncated list")
            out.append(body[at + 4 : at + 4 + width].decode())
            at += 4 + width
        return out
    raise ValueError("not a stored value")


def name_of(raw: bytes) -> str:
    """Name of a stored value's type."""
    if not raw or raw[0] not in _NAMES:
        raise ValueError("not a stored value")
    return _NAMES[raw[0]]


def encode_value(v) -> bytes:
    """A Python object as a stored value (driver side, for single writes)."""
    if isinstance(v, bool):
        return bytes([TAGS["bool"], v])
    if isinstance(v, int):
        return bytes([TAGS["int"]]) + struct.pack("<q", v)
    if isinstance(v, float):
        return bytes([TAGS["double"]]) + struct.pack("<d", v)
    if isinstance(v, str):
        return bytes([TAGS["string"]]) + v.encode()
    if isinstance(v, (bytes, bytearray)):
        return bytes([TAGS["bytes"]]) + bytes(v)
    if isinstance(v, list) and all(isinstance(x, str) for x in v):
        parts = [struct.pack("<I", len(x.encode())) + x.encode() for x in v]
        return bytes([TAGS["stringList"]]) + struct.pack("<I", len(v)) + b"".join(parts)
    raise TypeError(f"no stored type for {type(v).__name__}")


def escape_field(c: Column) -> Column:
    """A field of a tab-separated record; an empty one is '-'."""
    out = c
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.when(F.length(c) == 0, "-").otherwise(out)


def key_preview(key: Column) -> Column:
    """Lower hex of the first 64 bytes, with '~' if there is more."""
    shown = F.lower(F.hex(F.substring(key, 1, 64)))
    return F.when(F.octet_length(key) > 64, F.concat(shown, F.lit("~"))).otherwise(shown)


def encrypt_page(data: Column, key: Column, page_id: Column, version: Column) -> Column:
    """AES-GCM with a nonce of page id and version and the page id as associated data; the nonce isn't stored."""
    hexed = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    nonce = F.unhex(F.concat(F.substring(hexed(page_id), 1, 16), F.substring(hexed(version), 9, 8)))
    sealed = F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.unhex(hexed(page_id)))
    return F.substring(sealed, F.lit(13), F.octet_length(sealed))


def decrypt_page(sealed: Column, key: Column, page_id: Column, version: Column) -> Column:
    """The page, or null if the key, the page id, the version or the bytes don't agree."""
    hexed = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    nonce = F.unhex(F.concat(F.substring(hexed(page_id), 1, 16), F.substring(hexed(version), 9, 8)))
    return F.try_aes_decrypt(F.concat(nonce, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(hexed(page_id)))


def crc32(*parts: Column) -> Column:
    """CRC-32 of a page, a record or a frame, whose parts follow one another."""
    return F.crc32(F.concat(*parts))


def nonce_reuse(writes: DataFrame, page: str = "page_id", version: str = "version", at: str = "seq") -> DataFrame:
    """Writes whose version isn't above every earlier one of the same page: their nonce may have been used."""
    before = F.max(version).over(Window.partitionBy(page).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return writes.withColumn("_before", before).filter(F.col("_before") >= F.col(version)).drop("_before")


def utf8_key(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def utf8_text(c: Column) -> Column:
    return F.decode(c, "UTF-8")
