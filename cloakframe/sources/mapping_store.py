"""Encrypted mappings: salt, then a Fernet token of the JSON map (version, time, AES-128-CBC, HMAC-SHA256)."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import struct
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, SALT = 600_000, 16


class WrongPassword(Exception):
    """A wrong password, or a mapping that was changed."""


def _keys(password: str, salt: bytes) -> tuple[bytes, bytes]:
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)
    return key[:16], key[16:]


def _aes(spark: SparkSession, data: bytes, key: bytes, iv: bytes | None) -> bytes:
    rows = spark.createDataFrame([(bytearray(data), bytearray(key), bytearray(iv or b""))], "d binary, k binary, i binary")
    mode = (F.lit("CBC"), F.lit("PKCS"))
    out = rows.select((F.aes_encrypt("d", "k", *mode, F.col("i")) if iv else F.aes_decrypt("d", "k", *mode)).alias("x"))
    return bytes(out.first()["x"])


def encrypted(spark: SparkSession, mapping: dict[str, str], password: str) -> bytes:
    salt, iv = os.urandom(SALT), os.urandom(16)
    sign, key = _keys(password, salt)
    body = b"\x80" + struct.pack(">Q", int(time.time())) + _aes(spark, json.dumps(mapping, ensure_ascii=False).encode(), key, iv)
    return salt + base64.urlsafe_b64encode(body + hmac.new(sign, body, hashlib.sha256).digest())


def encrypted_rows(maps: DataFrame, password: str) -> DataFrame:
    """(name, content, error) of maps (name, json): each encrypted under a salt of its own, on the executors. Cipher blocks are made by
    the engine's own function, keys and signatures beside it."""

    def keys(batches):
        for rows in batches:
            salt = [os.urandom(SALT) for _ in rows["name"]]
            pair = [_keys(password, x) for x in salt]
            yield rows.assign(salt=salt, iv=[os.urandom(16) for _ in salt], sign=[p[0] for p in pair], key=[p[1] for p in pair])

    def seal(batches):
        for rows in batches:
            out = []
            for salt, sign, cipher in zip(rows["salt"], rows["sign"], rows["cipher"]):
                body = b"\x80" + struct.pack(">Q", int(time.time())) + bytes(cipher)
                out.append(bytes(salt) + base64.urlsafe_b64encode(body + hmac.new(bytes(sign), body, hashlib.sha256).digest()))
            yield pd.DataFrame({"name": rows["name"], "content": out, "error": pd.Series([None] * len(out), dtype=object)})

    rows = maps.select("name", "json").mapInPandas(keys, "name string, json string, salt binary, iv binary, sign binary, key binary")
    rows = rows.select("name", "salt", "sign", F.aes_encrypt(F.encode("json", "UTF-8"), "key", F.lit("CBC"), F.lit("PKCS"), F.col("iv")).alias("cipher"))
    return rows.mapInPandas(seal, "name string, content binary, error string")


def read_mapping(spark: SparkSession, path: str, password: str) -> dict[str, str]:
    """The mapping of one file."""
    return decrypted(spark, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), password)


def decrypted(spark: SparkSession, content: bytes, password: str) -> dict[str, str]:
    sign, key = _keys(password, content[:SALT])
    try:
        token = base64.urlsafe_b64decode(content[SALT:])
    except ValueError as e:
        raise WrongPassword("the mapping is damaged") from e
    body, tag = token[:-32], token[-32:]
    if len(body) < 41 or not hmac.compare_digest(tag, hmac.new(sign, body, hashlib.sha256).digest()):
        raise WrongPassword("wrong password, or the mapping was changed")
    return json.loads(_aes(spark, body[9:], key, None))
