"""Conversation repair, vector codes and token files against brute force, the library, and odd rows."""

import hashlib
import heapq
import itertools
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskweave.llm import codebook, conversations, simple8b, tokenfile
from maskweave.llm.queries import ORACLES, QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def same_as_sql(spark, sf_dir, name, table, path=None):
    got = QUERIES[name](spark, path or sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path or sf_dir}/{table}.parquet{'/*.parquet' if path else ''}'")
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    rows = want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, rows))
    return len(rows)


# ---- conversations


def brute(rows):
    """The cheapest audits by Dijkstra over whole strings of letters: cost first, then ASCII order."""
    found = conversations.faults(rows, [False] * len(rows))
    heap, done = [(0, "", 0, "")], {}
    best = None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = roles[-1:]
        if best is not None and cost > best[0]:
            break
        if done.setdefault((i, state, bool(roles)), cost) < cost:
            continue
        if i == len(rows) and state in ("", "a"):
            best = min(best, (cost, audit)) if best else (cost, audit)
            continue
        follows = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if audit.count("I") <= len(rows) + 2:
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + follows))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] else 0
                own = rows[i][0][:1]
                if own == follows or (own == "s" and not roles):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + own))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + follows))
    return best


ROLES = st.sampled_from(["user", "assistant", "system", "tool", " ", ""])
SAID = st.sampled_from(["Yes.", "No!", "Why?", "and then", "", " \t", "Yes.", "It is so. ", "A", "B.", "C.", "D!"])


@given(st.lists(st.tuples(ROLES, SAID), max_size=7))
@settings(max_examples=300, deadline=None)
def test_repair_takes_the_least_of_the_cheapest_audits(rows):
    result = conversations.repair_whole([(i, r, t, b"", True) for i, (r, t) in enumerate(rows)])
    assert (result["cost"], result["audit"]) == brute(rows)


def through_segments(rows, conv, monkeypatch, size):
    """A conversation by way of segments of ``size`` rows, as the tasks do it, without Spark."""
    import pandas as pd

    monkeypatch.setattr(conversations, "SEGMENT_ROWS", size)
    keyed = [(t, r, x, hashlib.sha256(f"{r}:{x}".encode()).digest(), True) for t, r, x in rows]
    scan = conversations._Scan(3)
    columns = dict(zip(conversations.ROW, map(list, zip(*keyed))))
    out = [dict(zip(b, v)) for b in scan.run(iter([{"conv_id": [conv] * len(keyed), **columns}])) for v in zip(*b.values())]
    assert all(o["segment"] is not None for o in out)
    first = {}
    for o in out:
        first.setdefault(o["key"], o["segment"])
        o["before"] = first[o["key"]] < o["segment"]
    frames = [conversations._table(pd.DataFrame(list(g))) for _, g in itertools.groupby(out, key=lambda o: o["segment"])]
    combined = conversations._combine(pd.concat(frames)).to_dict("records")
    names = ("conv_id", "segment", "at", "role", "text", "kept", "before", "ends", "is_last", *conversations.COUNTS)
    parts = [{**dict.fromkeys(names), **c, "at": -1} for c in combined] + [{**dict.fromkeys(names), **{k: o[k] for k in names if k in o}, "is_last": None, **dict.fromkeys(conversations.COUNTS)} for o in out]
    parts.sort(key=lambda p: (p["segment"], p["at"]))
    done = [b for b in conversations._finish(iter([{n: [p[n] for p in parts] for n in names}])) if b["conv_id"]]
    assert len(done) == 1
    return {k: v[0] for k, v in done[0].items()}


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_give_what_the_whole_gives(monkeypatch, size):
    r = random.Random(size)
    for conv in range(30):
        n = r.randint(1, 20)
        rows = [(r.choice([None, 0]) if i == 0 else i // 2, r.choice(["user", "assistant", "system", "x", ""]), r.choice(["Yes.", "no", "", "Well?", "A.", "B.", f"{i}!"])) for i in range(n)]
        whole = conversations.repair_whole([(t, ro, x, b"", True) for t, ro, x in rows])
        assert through_segments(rows, conv, monkeypatch, size) == {"conv_id": conv, **whole}


def test_conversations_equal_sql(spark, sf_dir):
    assert same_as_sql(spark, sf_dir, "op11_conversations", "conversations") > 0
    same_as_sql(spark, "/root/testdata/sf0.01", "op11_conversations", "conversations")


def test_odd_conversations_equal_sql(spark, tmp_path):
    """Null conversations, turns, roles and texts, a conversation that has a third of all rows, ones without rows after damage, clashing columns."""
    r = random.Random(5)
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 5 else r.choice(["system", None, "tool"]), r.choice(["Yes.", "so", None, "", f"Number {i}!", f"No {i}"])) for i in range(3000)]
    rows += [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["Yes.", "so", None, f"{t}."])) for c in range(2000) for t in range(r.randint(1, 4))]
    rows += [(None, t, "user", "Null conversation.") for t in range(5)] + [(-1, None, "user", "Null turn."), (-1, 0, "assistant", "Yes?")]
    rows += [(-2, 2**62, "user", "Far."), (-2, -(2**61), "assistant", "Near."), (-3, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as kept", "'x' as audit", "2 as segment", "3 as at")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    n = same_as_sql(spark, None, "op11_conversations", "conversations", str(tmp_path))
    assert n == 2004
    found = conversations.repair(df)
    empty = found.filter("audit = '' AND cost = 0").first()
    assert empty.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert conversations.repair(df.limit(0)).count() == 0


def test_repeated_turns_are_duplicates(spark):
    rows = [(1, 0, "user", "Hi.")] * 3 + [(1, 1, "assistant", "Yes.")] + [(None, None, None, None)] * 2
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    kept = [r for r in rows if r[0] == 1 and zlib.crc32(f"1:{r[1]}".encode()) % 20 != 0]
    assert got[1].duplicate + got[1].blank + got[1].truncated >= len(kept) - 2
    assert set(got) == {1, None}


# ---- vector codes


def lloyd(rows):
    """Codes by full search in Python integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}
    w = len(kept[0][1]) // 16
    parts = [[k[1][p * w : p * w + w] for k in kept] for p in range(16)]
    smallest = [j for j, _ in sorted(enumerate(kept), key=lambda x: x[1][0])][:64]
    books = [[list(parts[p][j]) for j in smallest] for p in range(16)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(x, e), i) for i, e in enumerate(books[p])) for x in parts[p]] for p in range(16)]

    for _ in range(2):
        got = assign()
        for p in range(16):
            for i in range(len(books[p])):
                mine = [x for x, (_, c) in zip(parts[p], got[p]) if c == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    error = [sum(got[p][j][0] for p in range(16)) for j in range(len(kept))]
    total = {}
    for e, k in zip(error, kept):
        total[k[2]] = total.get(k[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k[0], "".join(f"{got[p][j][1]:02x}" for p in range(16)), error[j], total[k[2]], sha) for j, k in enumerate(kept))


def vectors(n, seed, dims=32):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(0, 0.2, dims).astype(np.float32).tolist(), i % 3 or None) for i in range(n)]
    out += [(n + i, out[2][1], 9) for i in range(n // 2)]  # copies: ties between equal entries
    out += [(-1, None, 1), (-2, [None] + [0.0] * (dims - 1), 1), (-3, [float("nan")] * dims, 1), (-4, [float("inf")] + [0.0] * (dims - 1), 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [3, 40, 300])
def test_codes_equal_a_full_search(spark, n):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as code", "0 as x", "1 as upper").repartition(5)
    got = sorted(tuple(r) for r in codebook.compress(df).collect())
    assert got == lloyd(rows)


def test_codes_equal_sql(spark, sf_dir):
    assert same_as_sql(spark, sf_dir, "op12_codebook", "embeddings") == 500


def test_labels_beyond_the_broadcast_join_alike(spark, monkeypatch):
    df = spark.createDataFrame(vectors(60, 1), SCHEMA)
    want = sorted(tuple(r) for r in codebook.compress(df).collect())
    monkeypatch.setattr(codebook, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in codebook.compress(df).collect()) == want


def test_odd_vectors(spark):
    """Repeated and null ids, lengths that 16 does not divide, empty and huge vectors, no rows."""
    rows = [(None, [0.5] * 5, None), (1, [0.25] * 20, 1), (1, [0.25] * 20, 1), (2, [], 1), (3, [1e30, -1e30], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = codebook.compress(df).collect()
    assert len(got) == 5 and all(len(r.code) == 32 and r.error == 0 for r in got)
    assert codebook.compress(df.limit(0)).collect() == []
    assert codebook.compress(df.filter("vec_id = 2")).count() == 1


def test_bounds_hold_and_prune():
    """Pruned rounds give a full search's codes, bounds stay bounds at rest, and most distances are not computed."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-100, 100, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-6, 7, (3000, 4))
    old = centres + rng.integers(-3, 4, centres.shape)
    old[7] = old[9]
    code, _, upper, lower = codebook.full_search(x, old)
    for _ in range(3):
        new = old + rng.integers(-2, 3, old.shape)
        state = codebook.pack_bounds(upper[:, None], lower[:, None])
        u, low = codebook.unpack_bounds(state)
        true = np.sqrt(codebook.squared(x, old))
        assert (low[:, 0] <= true).all() and (u[:, 0] >= true[np.arange(len(x)), code]).all()
        want = codebook.full_search(x, new)
        code, own, upper, lower, computed = codebook.pruned_search(x, codebook.Move(old, new), code, u[:, 0], low[:, 0])
        assert (code == want[0]).all() and (own == want[1]).all()
        assert computed < 0.2 * x.shape[0] * 64
        old = new


# ---- token files


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 60_000), max_size=400), st.integers(1, 300))
@settings(max_examples=300, deadline=None)
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    words, offsets, exceptions = simple8b.encode(values, block)
    assert (simple8b.decode(words, exceptions) == values).all()
    for i, at in enumerate(offsets.tolist()):  # each block on its own
        end = offsets[i + 1] if i + 1 < len(offsets) else len(words)
        assert (simple8b.decode(words[at:end], exceptions) == values[i * block : (i + 1) * block]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(1200, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.ones(1200, np.uint64))[0]) == 20
    assert len(simple8b.encode(np.full(1200, 50_000, np.uint64))[0]) == 400


@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 2**32 - 1), max_size=30)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(tmp_path_factory, docs):
    where = str(tmp_path_factory.mktemp("t") / "f")
    from pyarrow import fs

    writer = tokenfile.FileWriter(fs.LocalFileSystem().open_output_stream(where))
    for doc, ids in docs:
        writer.add(doc, np.array(ids, np.uint32))
    assert writer.close() == (len(docs), sum(len(i) for _, i in docs))
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    with fs.LocalFileSystem().open_input_file(where) as f:
        rows = [r for b in tokenfile.FileReader(f).batches(10, schema) for r in b.to_pylist()]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == docs
    assert [r["start"] for r in rows] == [10 + sum(len(i) for _, i in docs[:k]) for k in range(len(docs))]


def test_long_files_are_coded_by_chunks(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import fs

    monkeypatch.setattr(tokenfile, "CHUNK", 2 * simple8b.BLOCK)
    rng = np.random.default_rng(3)
    docs = [(i, rng.integers(0, 1 << int(rng.integers(1, 32)), int(rng.integers(0, 30_000)), dtype=np.uint32)) for i in range(20)]
    writer = tokenfile.FileWriter(fs.LocalFileSystem().open_output_stream(str(tmp_path / "f")))
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        reader = tokenfile.FileReader(f)
        got = [np.frombuffer(r["ids"], "<u4") for b in reader.batches(0, schema) for r in b.to_pylist()]
        assert all((a == b).all() for a, (_, b) in zip(got, docs, strict=True))
        every = np.concatenate([d for _, d in docs])
        for a, b in ((0, 5), (4095, 4097), (12_345, 99_999)):
            assert (reader.ids(a, b) == every[a:b]).all()


PIECES = ["'s", "'S", " 's", "a", "B", "é", "1", "²", "٣", ".", "-", "_", " ", "  ", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "!!", "漢", "한", "Σ", "ς", "́", "😀", "​", "ab cd", "w" * 50, " " * 1200, "\n" * 1200, "y" * 1200]


@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    library = Tokenizer.from_file(BYTES)
    assert np.frombuffer(tokenfile._encoder(BYTES).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def brute_tokens(rows):
    """start, length and crc32 of (doc_id, text) rows that are in order already."""
    library, out, start = Tokenizer.from_file(BYTES), [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_token_files_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_tokens(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = [tuple(r) for r in QUERIES["op13_tokens"](spark, sf_dir).orderBy("doc_id").collect()]
    assert got == want


def test_token_files_of_odd_rows(spark):
    """Null, empty and long texts, repeated and null ids, clashing columns, no rows."""
    rows = [(5, None), (5, ""), (3, "one two"), (3, "one two"), (None, "null id"), (None, None), (9, "x" * 200_000), (8, "word " * 60_000), (1, "<|endoftext|> 漢字 \x85")]
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, start int, ids string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in tokenfile.token_digests(df, BYTES).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in brute_tokens(rows))
    assert tokenfile.token_digests(df.limit(0), BYTES).count() == 0


def test_a_third_of_all_rows_under_one_id_is_dealt(spark):
    df = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["n"] for r in tokenfile.ordered(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 9000 / len(sizes)


def test_a_manifest_names_the_files_that_are_read(spark, tmp_path):
    """Files of attempts that came to nothing are not read; files are in the order of their partitions."""
    folder = f"{tmp_path}/tokens"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    files = tokenfile.write_tokens(df, BYTES, folder)
    (tmp_path / "tokens" / "part-left-over.toks").write_bytes(b"half a file")
    assert [r.doc_id for r in files.orderBy("start").collect()] == list(range(50))
    assert sum(f["documents"] for f in json.loads((tmp_path / "tokens" / "_manifest.json").read_text())) == 50
    with pytest.raises(Exception):
        df.withColumnRenamed("text", "ids").write.format("tokenfile").mode("overwrite").save(folder)
