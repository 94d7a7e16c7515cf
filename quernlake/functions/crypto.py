"""Message authentication and symmetric encryption, from Spark's digests and ciphers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digests by name: bits, and bytes of a block.
DIGESTS = {"sha224": (224, 64), "sha256": (256, 64), "sha384": (384, 128), "sha512": (512, 128)}


def hmac(message: Column, key: bytes, digest: str = "sha256") -> Column:
    """The message's authentication code as bytes: two digests, of the key's two paddings and the message."""
    bits, block = DIGESTS[digest]
    key = (hashlib.new(digest, key).digest() if len(key) > block else key).ljust(block, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), bits))
    return F.unhex(F.sha2(F.concat(outer, once), bits))


def encrypt(text: Column, key: bytes, mode: str = "GCM") -> Column:
    """AES with a random initial vector, which stands before the bytes."""
    return F.aes_encrypt(text, F.lit(key), F.lit(mode))


def decrypt(data: Column, key: bytes, mode: str = "GCM") -> Column:
    return F.aes_decrypt(data, F.lit(key), F.lit(mode)).cast("string")
