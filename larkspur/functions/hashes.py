"""Digests, encryption, compression, identifiers and addresses."""

from __future__ import annotations

import gzip
import os

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.session import send_package


def md5(s: Column) -> Column:
    return F.md5(s)


def sha1(s: Column) -> Column:
    return F.sha1(s)


def sha2(s: Column, bits: int) -> Column:
    return F.sha2(s, bits or 256)


def fold_key(key: str) -> bytes:
    """A 16-byte key: the bytes of a longer one are folded in by exclusive or."""
    out = bytearray(16)
    for i, b in enumerate(key.encode()):
        out[i % 16] ^= b
    return bytes(out)


def aes_encrypt(s: Column, key: str) -> Column:
    """Base64 of AES-128 in ECB mode."""
    return F.base64(F.aes_encrypt(F.encode(s, "UTF-8"), F.lit(fold_key(key)), F.lit("ECB"), F.lit("PKCS")))


def aes_decrypt(s: Column, key: str) -> Column:
    return F.decode(F.try_aes_decrypt(F.unbase64(s), F.lit(fold_key(key)), F.lit("ECB"), F.lit("PKCS")), "UTF-8")


def compress(s: Column) -> Column:
    send_package()

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else gzip.compress(x.encode(), mtime=0) for x in a.to_pylist()], pa.binary())

    return F.base64(F.arrow_udf(run, "binary")(s))


def uncompress(s: Column) -> Column:
    send_package()

    def run(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            try:
                out.append(None if x is None else gzip.decompress(x).decode())
            except (OSError, EOFError, UnicodeDecodeError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.try_to_binary(s, F.lit("base64")))


def uncompressed_length(s: Column) -> Column:
    return F.octet_length(uncompress(s))


def random_bytes(n: int) -> Column:
    if not 1 <= n <= 1024:
        raise ValueError("1 to 1024 bytes")

    send_package()

    def run(a: pa.Array) -> pa.Array:
        return pa.array([os.urandom(n) for _ in range(len(a))], pa.binary())

    return F.arrow_udf(run, "binary")(F.rand())


def uuid_short() -> Column:
    """64-bit numbers that differ within a query."""
    return F.monotonically_increasing_id()


def is_uuid(s: Column) -> Column:
    return s.rlike(r"(?i)^(\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32})$").cast("int")


def uuid_to_bin(s: Column) -> Column:
    return F.unhex(F.replace(s, F.lit("-"), F.lit("")))


def bin_to_uuid(b: Column) -> Column:
    h = F.lower(F.hex(b))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def inet_aton(s: Column) -> Column:
    parts = F.split(s, r"\.")
    number = sum((parts[i].try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].try_cast("long") * 256**3)
    return F.when(s.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def inet_ntoa(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n.cast("long"), s) % 256).cast("string") for s in (24, 16, 8, 0)])


def crc32(s: Column) -> Column:
    return F.crc32(s)
