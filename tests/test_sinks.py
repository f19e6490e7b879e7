"""Batch folders, pictures, versioned tables, logs by day, the request counter."""

import itertools
import json
import struct
import threading
import zlib
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskweave import edit_queries
from maskweave.functions import raster
from maskweave.operators import images
from maskweave.plans.builtin import builtin
from maskweave.sources import batch, readers, writers
from maskweave.sources.scratch import file_system
from maskweave.sources.store import Conflict, Store, catalogue_migrations
from maskweave.streaming.quota import count_requests

# ---- batches


def rows_of(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(("path", "name", "text", "error"), r)) for r in rows], schema=pa.schema([(n, pa.string()) for n in ("path", "name", "text", "error")]))


def test_a_task_that_runs_again_writes_and_counts_once(tmp_path):
    """Two attempts at the same rows, of which the commit knows the second; then a batch that is run again as a whole."""
    rows = [rows_of(("/in/a.pdf", "a", "A", None), ("/in/b.png", None, "first", None)), rows_of(("/in/b.tif", "b", None, None), ("/in/c.bin", None, None, "unsupported"))]
    for name in ("one", "two"):
        writer = batch._Writer(str(tmp_path), name)
        with pytest.raises(RuntimeError):
            writer.write(itertools.chain(rows[:1], iter_fails()))
        writer.write(iter(rows))
        writer.commit([writer.write(iter(rows)), None])
        assert {k: v for k, v in batch.committed(str(tmp_path), name).items() if k in ("done", "failed")} == {"done": 3, "failed": 1}
        assert len(batch.committed(str(tmp_path), name)["files"]) == 1
    assert {p.name: p.read_bytes() for p in tmp_path.glob("*.txt")} == {"a.txt": b"\xef\xbb\xbfA", "b.txt": b"\xef\xbb\xbf"}


def iter_fails():
    raise RuntimeError("lost")
    yield


def test_texts_of_documents(spark, tmp_path):
    rows = spark.createDataFrame([("/in/a.pdf", "A", None), ("/in/b.png", "B", None), ("/in/b.tif", "B2", None), ("/in/c d%.txt", None, None), ("/in/e.bin", None, "unsupported")], "path string, redacted_text string, error string")
    counted = batch.write_texts(rows, str(tmp_path / "out"))
    assert (counted["done"], counted["failed"]) == (4, 1)
    assert {p.name: p.read_text("utf-8-sig") for p in (tmp_path / "out").glob("*.txt")} == {"a.txt": "A", "b.txt": "B2", "c d%.txt": ""}
    assert sorted((r.path, r.error) for r in batch.outcomes(spark, str(tmp_path / "out"), counted["batch"]).collect())[-1] == ("/in/e.bin", "unsupported")
    assert batch.write_texts(rows.limit(0), str(tmp_path / "none"))["done"] == 0


def test_a_batch_reads_its_own_files_without_listing_them(spark, sf_dir, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"/in/{n}.pdf", t, None) for n, t in (("a", "A"), ("b [1]", "\ufeffB\r\n"), ("c d%", None))], "path string, redacted_text string, error string")
    batch.write_texts(rows, str(tmp_path))
    monkeypatch.setattr(batch, "READ_ROWS", 2)
    found = spark.createDataFrame([("a", 1), ("none", 2), ("b [1]", 3), (None, 4), ("c d%", 5)], "stem string, k int").coalesce(1)
    assert [(r.k, r.text) for r in batch.with_texts(found, str(tmp_path)).collect()] == [(1, "A"), (2, None), (3, "\ufeffB\r\n"), (4, None), (5, "")]
    plan = edit_queries.batch_results(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Format: Text" not in plan and "FileScan text" not in plan and "Join" not in plan


def test_a_configured_batch(spark, tmp_path):
    """Files are redacted, failed ones stay, the others move; run again there is nothing left but the failed one."""
    inbox, out = tmp_path / "in box", tmp_path / "out"
    inbox.mkdir()
    (inbox / "one.txt").write_text("mail a.b@c.de")
    (inbox / "two.x.txt").write_text("ip 10.0.0.1")
    (inbox / "bad.bin").write_bytes(b"\x00")
    (inbox / "done").mkdir()
    (inbox / "done" / "one.txt").write_text("old")
    settings = {"MoveProcessedToDone": True, "Ocr": {"Enabled": False}, "redact": {"enabled": True, "INPUTFOLDER": str(inbox), "outputFolder": str(out), "filePatterns": ["*.txt", "*.bin"]}}
    (tmp_path / "batch.json").write_text(json.dumps(settings, indent=1))
    config = batch.Config.read(spark, str(tmp_path / "batch.json"))
    assert config.move_processed_to_done and config.redact.file_patterns == ("*.txt", "*.bin") and not config.extract.enabled
    assert batch.run(spark, config, builtin()) == {"done": 2, "failed": 1, "exit_code": 2}
    assert {p.name: p.read_text("utf-8-sig") for p in out.glob("*.txt")} == {"one.txt": "mail [email]", "two.x.txt": "ip [IP]"}
    assert sorted(p.name for p in inbox.iterdir()) == ["bad.bin", "done"] and (inbox / "done" / "one.txt").read_text() == "mail a.b@c.de"
    assert batch.run(spark, config, builtin()) == {"done": 0, "failed": 1, "exit_code": 2}
    assert batch.run(spark, batch.Config.parse('{"redact": {"enabled": true, "inputFolder": "/none", "outputFolder": "/none"}}'), []) == {"done": 0, "failed": 0, "exit_code": 0}


def test_moving_again_changes_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    found = spark.createDataFrame([(f"file:{tmp_path}/a.txt", None), (f"{tmp_path}/b.txt", "failed")], "path string, error string")
    for _ in range(2):
        batch.move_done(found, str(tmp_path / "done"))
    assert (tmp_path / "done" / "a.txt").read_text() == "x" and not (tmp_path / "a.txt").exists()


def test_paths():
    for given, want in (("/a b/c%20d", "/a b/c%20d"), ("file:/a/b", "/a/b"), ("file:///a/b:c", "/a/b:c")):
        assert file_system(given)[1] == want


def test_inline_texts(spark):
    assert [tuple(r) for r in readers.inline(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        readers.inline(spark, ["a", " \n"])


# ---- pictures


def filtered(rows, step, kind):
    """Rows of bytes under one filter, as the format defines it."""
    out, above = [], [0] * rows.shape[1]
    for row in rows.tolist():
        line = [kind]
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((x - {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: p}[kind]) % 256)
        out.append(line)
        above = row
    return np.array(out, np.uint8)


def png(width, height, depth, colour, data, **chunks):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return raster.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + b"".join(chunk(k.encode(), v) for k, v in chunks.items()) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour,samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_filters(kind, colour, samples):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (7, 9 * samples), dtype=np.uint8)
    assert (raster.unfiltered(filtered(rows, samples, kind), samples) == rows).all()
    got = raster.decode(png(9, 7, 8, colour, filtered(rows, samples, kind).tobytes()))
    own = rows.reshape(7, 9, samples)
    if samples in (1, 3):
        assert (got == own).all()
    else:
        a = own[..., -1:].astype(int)
        assert (abs(got.astype(int) - (own[..., :-1] * a + 255 * (255 - a)) / 255) <= 0.51).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_depths_and_palettes(depth):
    rng = np.random.default_rng(depth)
    values = rng.integers(0, 1 << depth, (5, 13))
    bits = ((values[..., None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(5, -1)
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    data = filtered(packed, 1, 0).tobytes()
    assert (raster.decode(png(13, 5, depth, 0, data))[..., 0] == values * 255 // ((1 << depth) - 1)).all()
    table = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
    assert (raster.decode(png(13, 5, depth, 3, data, PLTE=table.tobytes())) == table[values]).all()
    clear = raster.decode(png(13, 5, depth, 3, data, PLTE=table.tobytes(), tRNS=b"\0"))
    assert (clear[values == 0] == 255).all() and (clear[values > 0] == table[values[values > 0]]).all()


def test_sixteen_bits_and_bad_pictures():
    wide = np.array([[[0x12, 0x34], [0xAB, 0xCD]]], np.uint8).reshape(1, 4)
    assert raster.decode(png(2, 1, 16, 0, filtered(wide, 2, 0).tobytes()))[0, :, 0].tolist() == [0x12, 0xAB]
    for bad in (b"", b"GIF89a", raster.encode(np.zeros((2, 2, 3)))[:-20], raster.encode(np.zeros((2, 2, 3))).replace(b"IDAT", b"IDAX")):
        with pytest.raises(Exception):
            raster.decode(bad)


def test_pictures_round_trip_and_boxes_are_painted(spark):
    rng = np.random.default_rng(0)
    pictures = {i: rng.integers(0, 256, (10 + i, 20, 3), dtype=np.uint8) for i in range(4)}
    assert all((raster.decode(raster.encode(p)) == p).all() for p in pictures.values())
    boxes = [(0, -5.0, -5.0, 3.0, 2.5), (0, 18.0, 8.0, 99.0, 99.0), (1, 30.0, 0.0, 40.0, 5.0), (2, 4.0, 4.0, 4.0, 9.0), (None, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame([(i, bytearray(raster.encode(p)), "extra") for i, p in pictures.items()] + [(9, None, None), (None, bytearray(raster.encode(pictures[0])), None)], "doc_id int, content binary, text string")
    rows = images.painted(df, spark.createDataFrame(boxes, "doc_id int, left double, top double, right double, bottom double")).collect()
    got = {r.doc_id: None if r.content is None else raster.decode(bytes(r.content)) for r in rows}
    want = pictures[0].copy()
    want[0:3, 0:3] = 0
    want[8:, 18:] = 0
    assert (got[0] == want).all() and (got[None] == pictures[0]).all() and all((got[i] == pictures[i]).all() for i in (1, 2, 3)) and got[9] is None


def test_darkness_of_pictures(spark):
    black, white, half = np.zeros((100, 100, 3)), np.full((100, 100, 3), 255), np.vstack([np.zeros((54, 100, 3)), np.full((46, 100, 3), 255)])
    df = spark.createDataFrame([(i, bytearray(raster.encode(p))) for i, p in enumerate((black, white, half))] + [(3, None)], "i int, content binary")
    got = {r.i: (r.d, r.e) for r in df.select("i", images.is_dark(F.col("content")).alias("d"), images.is_dark(images.inverted("content")).alias("e")).collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (False, False), 3: (None, None)}


# ---- versions


def test_two_writers_on_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda n: spark.range(n).select(F.col("id").cast("int").alias("id"))
    assert store.version() == 0 and store.read() == {}
    store.commit({"t": rows(1)}, 0)
    with pytest.raises(Conflict):
        store.commit({"t": rows(5)}, 0)
    calls = []

    def change(tables):
        calls.append(tables["t"].count())
        if len(calls) == 1:
            Store(spark, str(tmp_path)).commit({"t": tables["t"].union(rows(1))}, 1)  # another writer comes between
        return {"t": tables["t"].union(rows(2))}

    assert store.update(change) == 3 and calls == [1, 2]
    assert [store.read(v)["t"].count() for v in (1, 2, 3)] == [1, 2, 4]


def test_many_writers_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"t": spark.range(0).select("id")}, 0)
    failed = []

    def write(n):
        try:
            store.update(lambda tables: {"t": tables["t"].union(spark.range(n, n + 1).select("id"))}, tries=50)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version() == 6
    assert sorted(r.id for r in store.read()["t"].collect()) == list(range(5))


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"a": spark.range(2).select("id"), "b": spark.range(3).select("id")}, 0)
    old = store.read()
    store.update(lambda tables: {"a": tables["a"].limit(0)})
    assert (old["a"].count(), old["b"].count()) == (2, 3)
    new = store.read()
    assert (new["a"].count(), new["b"].count()) == (0, 3) and set(new) == {"a", "b"}


def test_migrations_run_once_and_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    legacy = spark.createDataFrame([(1, None, "Email", "[e]", True)], "id int, client_id int, field_name string, replace_with string, is_active boolean")
    store.commit({"fields": legacy}, 0)
    names = ["tables", "protected fields", "field priorities"]
    assert store.migrate(catalogue_migrations(spark)) == names and store.migrate(catalogue_migrations(spark)) == []
    assert store.manifest(store.version())["migrations"] == names
    tables = store.read()
    assert tables["fields"].first().asDict() == {"id": 1, "client_id": None, "field_name": "Email", "replace_with": "[e]", "is_active": True, "is_preserve": False, "priority": 0}
    assert set(tables) == {"clients", "fields", "patterns", "settings"}


# ---- logs


def test_old_days_go_and_others_stay_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-03-{1 + i % 5:02d} 12:00:00") for i in range(20)] + [(99, None)], "id int, at string").withColumn("requested_at", F.to_timestamp("at"))
    path = str(tmp_path / "log")
    writers.append_log(rows, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    assert writers.drop_days(spark, path, date(2024, 3, 3)) == [date(2024, 3, 1), date(2024, 3, 2)]
    assert writers.drop_days(spark, path, date(2024, 3, 3)) == []
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    assert after == {p: t for p, t in before.items() if "day=2024-03-01" not in str(p) and "day=2024-03-02" not in str(p)}
    assert sorted({r.id % 5 for r in spark.read.parquet(path).filter("id < 99").collect()}) == [2, 3, 4]


def test_the_counter_survives_a_restart(spark, tmp_path):
    """Each sitting counts what came since; a batch whose commit is lost is counted once all the same."""
    log, store = str(tmp_path / "log"), Store(spark, str(tmp_path / "store"))
    schema = "id int, client_id int"

    def sitting(rows):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(log)
        count_requests(spark.readStream.schema(schema).parquet(log), store, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.client: r.used for r in store.read()["quota"].collect()}

    assert sitting([(1, 7), (2, 7), (3, None)]) == {7: 2, None: 1}
    assert sitting([(4, 8), (5, 7)]) == {7: 3, 8: 1, None: 1}
    assert sitting([]) == {7: 3, 8: 1, None: 1}
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for p in (tmp_path / "checkpoint" / "commits").glob(f".{commits[-1].name}.crc"):
        p.unlink()
    assert sitting([(6, 8)])[7] == 3
    assert sitting([])[8] == 2
