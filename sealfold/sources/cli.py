"""Encrypt a table: ``python -m sealfold.sources.cli IN OUT [--format FORMAT] [--key-id ID]``. The key must be provisioned."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from sealfold.session import Config, Session, create_session


@dataclass(frozen=True)
class Arguments:
    source: str
    target: str
    format: str = "parquet"
    key_id: str = Config().key_id


def parse_args(args: list[str]) -> Arguments:
    """Flags may stand anywhere and be repeated, the last one holds; ValueError for what isn't understood."""
    flags = {"--format": "format", "--key-id": "key_id"}
    places: list[str] = []
    found: dict[str, str] = {}
    rest = iter(args)
    for a in rest:
        if a in flags:
            value = next(rest, None)
            if value is None:
                raise ValueError(f"{a} needs a value")
            found[flags[a]] = value
        elif a.startswith("--"):
            raise ValueError(f"unknown flag {a}\n{__doc__}")
        else:
            places.append(a)
    if len(places) != 2:
        raise ValueError(__doc__)
    return Arguments(*places, **found)


def encrypt_table(session: Session, arguments: Arguments) -> None:
    reader = session.spark.read
    if arguments.format == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    session.save_encrypted(reader.format(arguments.format).load(arguments.source), arguments.target)


def main(args: list[str], spark=None) -> int:
    arguments = parse_args(args)
    session = create_session(spark, Config(key_id=arguments.key_id, require_provisioned_key=True), "encrypt")
    try:
        encrypt_table(session, arguments)
    finally:
        session.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
