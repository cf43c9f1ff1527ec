"""AES-256-GCM encryption of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ALGORITHM, KEY_BYTES, NONCE_BYTES = "AES-256-GCM", 32, 12


def _key(key: bytes | bytearray) -> Column:
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must be exactly {KEY_BYTES} bytes")
    return F.lit(bytearray(key))


def _base64(data: Column) -> Column:
    """Base64 on one line; the built-in breaks lines after 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def encrypt_column(text: Column, key: bytes) -> Column:
    """``struct<ciphertext, nonce, algorithm, key_size>`` with a fresh nonce per row.

    The cipher is bound once: evaluating it for the nonce and again for the
    ciphertext would pair values of two different encryptions.
    """
    sealed = F.aes_encrypt(text.cast("binary"), _key(key), F.lit("GCM"))
    return F.when(text.isNotNull(), let(sealed, lambda s: F.struct(
        _base64(F.substring(s, F.lit(NONCE_BYTES + 1), F.length(s))).alias("ciphertext"),
        _base64(F.substring(s, F.lit(1), F.lit(NONCE_BYTES))).alias("nonce"),
        F.lit(ALGORITHM).alias("algorithm"), F.lit(KEY_BYTES * 8).alias("key_size"))))


def decrypt_column(payload: Column, key: bytes, lenient: bool = False) -> Column:
    """The plain text; a wrong key or a changed payload fails, or gives null when ``lenient``."""
    opener = F.try_aes_decrypt if lenient else F.aes_decrypt
    return let(payload, lambda p: opener(F.concat(F.unbase64(p["nonce"]), F.unbase64(p["ciphertext"])), _key(key),
                                         F.lit("GCM")).cast("string"))


def encrypt_struct(record: Column, key: bytes) -> Column:
    """Encrypt a struct, map or array as its JSON text."""
    return encrypt_column(F.to_json(record), key)


def decrypt_struct(payload: Column, key: bytes, schema: str) -> Column:
    return F.from_json(decrypt_column(payload, key), schema)
