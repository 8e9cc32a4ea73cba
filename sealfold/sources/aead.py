"""AES-GCM over bytes: 12 bytes of fresh IV, the ciphertext, 16 bytes of tag. The layout is that of Spark's aes_encrypt."""

from __future__ import annotations

import ctypes
import secrets
from functools import lru_cache

IV, TAG = 12, 16
_GET_TAG, _SET_TAG = 0x10, 0x11


class AuthenticationError(ValueError):
    """The data, its key or its associated data is not what was encrypted."""


@lru_cache(None)
def _library():
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.so", "libcrypto.dylib"):
        try:
            lib = ctypes.CDLL(name)
            break
        except OSError:
            continue
    else:
        raise RuntimeError("AES-GCM needs OpenSSL's libcrypto, which this machine lacks")
    lib.EVP_CIPHER_CTX_new.restype = ctypes.c_void_p
    for bits in (128, 192, 256):
        getattr(lib, f"EVP_aes_{bits}_gcm").restype = ctypes.c_void_p
    return lib


def generate_key(bits: int = 128) -> bytes:
    if bits not in (128, 192, 256):
        raise ValueError(f"an AES key has 128, 192 or 256 bits, not {bits}")
    return secrets.token_bytes(bits // 8)


def _run(seal: bool, data: bytes, key: bytes, iv: bytes, aad: bytes, tag: bytes) -> tuple[bytes, bytes]:
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    lib = _library()
    context = ctypes.c_void_p(lib.EVP_CIPHER_CTX_new())
    name = "Encrypt" if seal else "Decrypt"
    start, update, final = (getattr(lib, f"EVP_{name}{step}") for step in ("Init_ex", "Update", "Final_ex"))
    size = ctypes.c_int(0)
    out = ctypes.create_string_buffer(len(data) + 16)
    try:
        cipher = ctypes.c_void_p(getattr(lib, f"EVP_aes_{8 * len(key)}_gcm")())
        ok = start(context, cipher, None, key, iv) == 1
        if aad:
            ok = ok and update(context, None, ctypes.byref(size), aad, len(aad)) == 1
        ok = ok and update(context, out, ctypes.byref(size), data, len(data)) == 1
        n = size.value
        if not seal:
            ok = ok and lib.EVP_CIPHER_CTX_ctrl(context, _SET_TAG, TAG, ctypes.create_string_buffer(tag, TAG)) == 1
        if not ok or final(context, ctypes.byref(out, n), ctypes.byref(size)) != 1:
            raise AuthenticationError("decryption failed: other data, key or associated data" if not seal else "encryption failed")
        n += size.value
        made = ctypes.create_string_buffer(TAG)
        if seal and lib.EVP_CIPHER_CTX_ctrl(context, _GET_TAG, TAG, made) != 1:
            raise AuthenticationError("encryption failed")
        return out.raw[:n], made.raw
    finally:
        lib.EVP_CIPHER_CTX_free(context)


def encrypt(data: bytes, key: bytes, aad: bytes = b"") -> bytes:
    iv = secrets.token_bytes(IV)
    body, tag = _run(True, data, key, iv, aad, b"")
    return iv + body + tag


def decrypt(blob: bytes, key: bytes, aad: bytes = b"") -> bytes:
    """The plain bytes; AuthenticationError if anything was changed, or if there is less than an IV and a tag."""
    if len(blob) < IV + TAG:
        raise AuthenticationError(f"{len(blob)} bytes are too few for an IV and a tag")
    return _run(False, blob[IV:-TAG], key, blob[:IV], aad, blob[-TAG:])[0]
