"""Wrapping of Parquet's data keys by master keys of this process's key store."""

from __future__ import annotations

import base64

import pyarrow.parquet.encryption as pe

from sealfold.sources import aead, keystore


class KeyAccessDeniedError(PermissionError):
    """This process lacks the master key, or the wrapped key is not of that master key."""


class StoreKmsClient(pe.KmsClient):
    """Base64 of AES-GCM, with the master key's id as associated data: a wrapped key can't pass for another's."""

    def __init__(self, config: pe.KmsConnectionConfig):
        super().__init__()
        self.key_file = (config.custom_kms_conf or {}).get("key_file") or None

    def _master(self, name: str) -> bytes:
        key = keystore.get(name, self.key_file)
        if key is None:
            raise KeyAccessDeniedError(f"this process has no master key {name!r}")
        return key

    def wrap_key(self, key_bytes: bytes, master_key_identifier: str) -> str:
        return base64.b64encode(aead.encrypt(key_bytes, self._master(master_key_identifier), master_key_identifier.encode())).decode()

    def unwrap_key(self, wrapped_key: str, master_key_identifier: str) -> bytes:
        try:
            return aead.decrypt(base64.b64decode(wrapped_key), self._master(master_key_identifier), master_key_identifier.encode())
        except ValueError as e:
            raise KeyAccessDeniedError(f"the wrapped key is not of the master key {master_key_identifier!r}") from e


def factory() -> pe.CryptoFactory:
    return pe.CryptoFactory(StoreKmsClient)


def connection(key_file: str | None = None) -> pe.KmsConnectionConfig:
    return pe.KmsConnectionConfig(custom_kms_conf={"key_file": key_file or ""})


def write_options(key_id: str) -> pe.EncryptionConfiguration:
    """One key for footer and all columns, AES-GCM, nothing in plain."""
    return pe.EncryptionConfiguration(footer_key=key_id, uniform_encryption=True, encryption_algorithm="AES_GCM_V1", plaintext_footer=False, double_wrapping=False)


def clear_key_cache(crypto: pe.CryptoFactory) -> None:
    """Forget unwrapped keys, after a master key was revoked."""
    crypto.remove_cache_entries_for_all_tokens()
