"""AES-GCM, keys and encrypted tables."""

import base64
import glob
import os

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sealfold.session import Config, Session, conform, create_session
from sealfold.sources import aead, cli, encrypted, keystore, kms

BLOB = b"patient-42,diagnosis=positive"
LABELLED = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])


def test_blob_round_trip_with_fresh_ivs():
    key = aead.generate_key()
    a, b = aead.encrypt(BLOB, key), aead.encrypt(BLOB, key)
    assert a != b and len(a) == len(BLOB) + 28
    assert aead.decrypt(a, key) == aead.decrypt(b, key) == BLOB
    assert aead.decrypt(aead.encrypt(b"", key, b"x"), key, b"x") == b""


def test_known_answer():
    """AES-128-GCM of 16 zero bytes under zero key and IV, as published with the mode."""
    body, tag = aead._run(True, bytes(16), bytes(16), bytes(12), b"", b"")
    assert body.hex() == "0388dace60b6a392f328c2b971b2fe78"
    assert tag.hex() == "ab6e47d42cec13bdf53a67b21257bddf"


def test_blob_rejects_what_was_changed():
    key = aead.generate_key(256)
    blob = aead.encrypt(BLOB, key, b"id")
    for bad in (blob[:-1] + bytes([blob[-1] ^ 1]), blob[:20] + bytes([blob[20] ^ 1]) + blob[21:], blob[:27], b""):
        with pytest.raises(aead.AuthenticationError):
            aead.decrypt(bad, key, b"id")
    for other in ((aead.generate_key(256), b"id"), (key, b"other")):
        with pytest.raises(aead.AuthenticationError):
            aead.decrypt(blob, *other)


def test_blob_layout_is_that_of_spark(spark):
    key = aead.generate_key()
    df = spark.createDataFrame([(bytearray(aead.encrypt(BLOB, key, b"7")),)], "blob binary")
    out = df.select(F.aes_decrypt("blob", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"7").cast("binary"))).first()[0]
    assert bytes(out) == BLOB


def test_key_specs(monkeypatch, tmp_path):
    one, two = base64.b64encode(bytes(16)).decode(), base64.b64encode(bytes(32)).decode()
    assert {k: len(v) for k, v in keystore.parse(f"a:{one},b:{two}\nc:{one}\n").items()} == {"a": 16, "b": 32, "c": 16}
    assert keystore.parse(keystore.format_key("x", b"k" * 24)) == {"x": b"k" * 24}
    for bad in ("a:" + base64.b64encode(b"short").decode(), "no-separator", "a:***"):
        with pytest.raises(ValueError):
            keystore.parse(bad)
    file = tmp_path / "keys"
    file.write_text(f"a:{one}\nf:{one}")
    monkeypatch.setenv(keystore.FILE, str(file))
    monkeypatch.setenv(keystore.ENVIRONMENT, f"a:{two}")
    assert len(keystore.get("a")) == 32 and len(keystore.get("f")) == 16 and keystore.get("zz") is None
    keystore.register("a", b"r" * 16)
    assert keystore.get("a") == b"r" * 16
    keystore.unregister("a")
    assert len(keystore.get("a")) == 32


@pytest.mark.parametrize("name", ["", "a b", "a:b", "a,b", "a\n"])
def test_key_names(name):
    with pytest.raises(ValueError):
        keystore.register(name, bytes(16))


def test_kms_binds_the_key_id():
    keystore.register("k1", aead.generate_key())
    keystore.register("k2", aead.generate_key())
    client = kms.StoreKmsClient(kms.connection())
    wrapped = client.wrap_key(b"0123456789abcdef", "k1")
    assert client.unwrap_key(wrapped, "k1") == b"0123456789abcdef"
    for name in ("k2", "absent"):
        with pytest.raises(kms.KeyAccessDeniedError):
            client.unwrap_key(wrapped, name)


def _table(spark):
    schema = StructType([StructField("id", LongType()), StructField("note", StringType()), StructField("features", VectorUDT())])
    return spark.createDataFrame([(i, f"MARKER-{i}", Vectors.dense([i, -i]) if i % 2 else Vectors.sparse(2, {0: float(i)})) for i in range(50)], schema)


def test_typed_round_trip(spark, tmp_path):
    s = create_session(spark)
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (Vectors.dense([3.0, 4.0]), 0.0)], LABELLED)
    s.save_encrypted(df, f"{tmp_path}/t")
    loaded = s.load_encrypted(f"{tmp_path}/t", LABELLED)
    assert loaded.key_id == s.key_id and loaded.data.schema["features"].dataType == VectorUDT()
    assert sorted(map(repr, loaded.data.collect())) == sorted(map(repr, df.collect()))


def test_no_plaintext_in_files(spark, tmp_path):
    s, df = create_session(spark), _table(spark)
    s.save_encrypted(df, f"{tmp_path}/sealed")
    create_session(spark, Config(encryption_enabled=False)).save_encrypted(df, f"{tmp_path}/plain")
    read = lambda name: b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{name}/*.parquet"))
    assert b"MARKER" in read("plain")
    sealed = read("sealed")
    assert b"MARKER" not in sealed and sealed[:4] == b"PARE"
    assert sorted(r["note"] for r in s.load_encrypted(f"{tmp_path}/sealed").data.collect()) == sorted(r["note"] for r in df.collect())


def test_flipped_bytes_never_pass_silently(spark, tmp_path):
    s = create_session(spark)
    s.save_encrypted(_table(spark).coalesce(1), f"{tmp_path}/t")
    (name,) = glob.glob(f"{tmp_path}/t/*.parquet")
    crypto, found = kms.factory(), 0
    content = open(name, "rb").read()
    read = lambda: encrypted._open(encrypted.pafs.LocalFileSystem(), name, None, crypto).read()
    whole = read()
    places = range(4, len(content), max(1, len(content) // 40))
    for at in places:
        with open(name, "wb") as f:
            f.write(content[:at] + bytes([content[at] ^ 0xFF]) + content[at + 1 :])
        try:
            assert read().equals(whole)
        except AssertionError:
            raise
        except Exception:
            found += 1
    assert found > len(places) / 2


def test_without_the_key_nothing_is_read(spark, tmp_path):
    keystore.register("gone", aead.generate_key())
    s = Session(spark, Config(key_id="gone"))
    s.save_encrypted(spark.range(3), f"{tmp_path}/t")
    assert s.load_encrypted(f"{tmp_path}/t").data.count() == 3
    keystore.unregister("gone")
    with pytest.raises(Exception, match="no master key|KeyAccessDenied"):
        create_session(spark).load_encrypted(f"{tmp_path}/t").data.count()


def test_plain_tables_load_too(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (Vectors.dense([0.0, 0.0]), 0.0)], LABELLED)
    df.write.parquet(f"{tmp_path}/t")
    s = create_session(spark)
    assert s.statistic_agg(s.load_encrypted(f"{tmp_path}/t", LABELLED).data, F.sum("label").alias("x"))["x"] == 1.0


def test_save_modes(spark, tmp_path):
    s, path = create_session(spark), f"{tmp_path}/t"
    count = lambda: s.load_encrypted(path).data.count()
    s.save_encrypted(spark.range(3), path)
    with pytest.raises(FileExistsError):
        s.save_encrypted(spark.range(3), path)
    s.save_encrypted(spark.range(9), path, "ignore")
    assert count() == 3
    s.save_encrypted(spark.range(2), path, "append")
    assert count() == 5
    s.save_encrypted(spark.range(4), path, "overwrite")
    assert count() == 4
    with pytest.raises(ValueError):
        s.save_encrypted(spark.range(1), path, "upsert")
    assert os.path.exists(f"{path}/_SUCCESS") and not glob.glob(f"{path}/_temporary*")


def test_writes_appear_at_once(spark, tmp_path):
    s, path = create_session(spark), f"{tmp_path}/t"
    s.save_encrypted(spark.range(3).coalesce(1), path)
    old = s.load_encrypted(path).data
    before = encrypted.data_files(path)
    schema = StructType([StructField("id", LongType())])
    options = {"path": path, "key_id": s.key_id, "key_file": keystore.export_file()}
    batch = [encrypted.pa.RecordBatch.from_arrays([encrypted.pa.array([7, 8], encrypted.pa.int64())], ["id"])]
    one, other, lost = (encrypted.EncryptedWriter(schema, options, o) for o in (False, False, True))
    done = [(w, w.write(iter(batch))) for w in (one, other, lost)]
    assert encrypted.data_files(path) == before and old.count() == 3  # files without a manifest are not there
    done[2][0].abort([])
    for w, message in done[:2]:  # two appends at the same time both count
        w.commit([message, None])
    assert s.load_encrypted(path).data.count() == 7
    s.save_encrypted(spark.range(4), path, "overwrite")
    assert s.load_encrypted(path).data.count() == 4
    assert sorted(glob.glob(f"{path}/*.parquet")) == encrypted.data_files(path)


def test_splits_columns_and_skipped_groups(spark, tmp_path, monkeypatch):
    s, path = create_session(spark), f"{tmp_path}/t"
    monkeypatch.setattr(encrypted, "GROUP_ROWS", 100)
    df = spark.range(1000, numPartitions=1).selectExpr("id", "cast(id as string) AS note", "id / 2 AS half")
    writer = encrypted.EncryptedWriter(df.schema, {"path": path, "key_id": s.key_id, "key_file": keystore.export_file()}, False)
    writer.commit([writer.write(iter(df.toArrow().to_batches(100)))])
    monkeypatch.setattr(encrypted, "SPLIT_BYTES", 3000)
    narrow = StructType([StructField("id", LongType())])
    reader = encrypted.EncryptedReader(narrow, {"path": path, "key_file": keystore.export_file()})
    parts = reader.partitions()
    read = lambda: [x for p in parts for b in reader.read(p) for x in b.to_pydict()["id"]]
    assert len(parts) > 3 and sorted(read()) == list(range(1000))
    for f, low, high in [(encrypted.EqualTo(("id",), 250), 200, 300), (encrypted.LessThan(("id",), 100), 0, 100), (encrypted.GreaterThanOrEqual(("id",), 899), 800, 1000), (encrypted.In(("id",), (5, 995)), None, None)]:
        assert list(reader.pushFilters([f])) == [f]  # Spark applies it again
        want = list(range(low, high)) if low is not None else [*range(100), *range(900, 1000)]
        assert sorted(read()) == want
    loaded = s.load_encrypted(path, narrow).data
    assert loaded.columns == ["id"] and sorted(r["id"] for r in loaded.where("id between 250 and 260").collect()) == list(range(250, 261))


def test_paths_are_of_sparks_file_system(spark, tmp_path):
    assert encrypted.qualified(spark, f"{tmp_path}/t") == f"file:{tmp_path}/t"
    assert encrypted.qualified(spark, "file:///x/y") == "file:/x/y"


def test_timestamps_and_nulls_survive(spark, tmp_path):
    s = create_session(spark)
    df = spark.sql("SELECT timestamp_ntz'2020-01-02 03:04:05' AS t, cast(null AS string) AS n, array(1, null) AS a UNION ALL SELECT null, 'x', null")
    s.save_encrypted(df, f"{tmp_path}/t")
    loaded = s.load_encrypted(f"{tmp_path}/t").data
    assert loaded.dtypes == df.dtypes
    assert sorted(map(repr, loaded.collect())) == sorted(map(repr, df.collect()))


def test_schema_on_read(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    wide = StructType([StructField("a", LongType())])
    assert conform(df, wide).schema == wide or conform(df, wide).dtypes == [("a", "bigint")]
    for bad in (StructType([StructField("c", LongType())]), StructType([StructField("b", LongType())])):
        with pytest.raises(ValueError):
            conform(df, bad)


def test_no_key_in_configuration_or_plans(spark, tmp_path, capsys):
    key = aead.generate_key()
    keystore.register("hidden", key)
    s = Session(spark, Config(key_id="hidden"))
    s.save_encrypted(spark.range(3), f"{tmp_path}/t")
    df = s.load_encrypted(f"{tmp_path}/t").data
    df.explain(True)
    shown = capsys.readouterr().out + repr(spark.sparkContext.getConf().getAll()) + repr(s) + repr(s.load_encrypted(f"{tmp_path}/t"))
    for form in (base64.b64encode(key).decode(), key.hex(), repr(key)):
        assert form not in shown


def test_cli_arguments():
    a = cli.parse_args(["in", "--format", "csv", "out", "--key-id", "k", "--format", "json"])
    assert (a.source, a.target, a.format, a.key_id) == ("in", "out", "json", "k")
    assert cli.parse_args(["a", "b"]).format == "parquet"
    for bad in ([], ["a"], ["a", "b", "c"], ["a", "b", "--nope"], ["a", "b", "--format"]):
        with pytest.raises(ValueError):
            cli.parse_args(bad)


def test_csv_ingest(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(keystore.ENVIRONMENT, keystore.format_key("ingest", aead.generate_key()))
    keystore.register("ingest", keystore.get("ingest"))  # for workers that started before
    (tmp_path / "in.csv").write_text("id,value\n1,10.5\n2,20.5\n")
    assert cli.main([f"{tmp_path}/in.csv", f"{tmp_path}/out", "--format", "csv", "--key-id", "ingest"], spark) == 0
    rows = Session(spark, Config(key_id="ingest")).load_encrypted(f"{tmp_path}/out").data.collect()
    assert sorted(map(tuple, rows)) == [(1, 10.5), (2, 20.5)]
    keystore.unregister("ingest")


def test_ingest_refuses_without_a_provisioned_key(spark, tmp_path):
    with pytest.raises(PermissionError):
        cli.main([f"{tmp_path}/in.csv", f"{tmp_path}/out", "--key-id", "never-made"], spark)
