"""Packing, exact and near copies, copied passages, mixing, WARC, the pipeline."""

import gzip
import hashlib
import io
import random
import zlib

import brute
import numpy as np
import pytest
from oracle import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from pactspark.llm import exact_exchange, mixing, packing, queries, relative_lz, simhash, warc

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), want.fetchall())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, kept string, n int")


def test_packing_covers_every_id_once(spark, documents, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    odd = [(9001, None), (9002, ""), (9003, " " * 3000), (9004, "a" * 30_000), (9005, "<|endoftext|> é日本🙂  x"), (9005, "again")]
    sample = rows[:150] + odd
    docs = frame(spark, sample).repartition(3)
    pieces = packing.pack(docs, open_windows=50).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: (p.doc_tokens, p.start)):
        ids.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for doc_id, text in sample:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = ids[doc_id, len(want)]
        assert [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()] == want
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    by_window = {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
    fills = []
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 1024 and all(f == 1024 or f & (f - 1) == 0 for f in fills)
    whole = packing.sequences(packing.pack(docs)).select("filled", F.octet_length("ids").alias("n")).collect()
    assert all(r.n in (4096, 4 * r.filled) for r in whole)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_keeps_what_the_level_array_placed(spark):
    pieces = queries.op2_packing(spark, "/root/testdata/sf0.1").select("placed", "length").collect()
    assert sum(p.placed for p in pieces) > 0.9 * len(pieces)
    packer = packing.Packer(8, 5)
    rnd, out, n = random.Random(4), [], 0
    for i in range(400):
        ids = np.arange(rnd.randrange(1, 9), dtype="<u4")
        n += len(ids)
        out += packer.add(packing.Piece(i, 0, ids, len(ids)))
    out += packer.settle()
    fills = [sum(len(p.ids) for p in pieces) for _, pieces in out]
    assert sum(fills) == n and all(f == 8 or f in (1, 2, 4) for f in fills) and len({w for w, _ in out}) == len(out)
    starts = {}
    for _, pieces in out:
        assert [p.placed for p in pieces] == sorted((p.placed for p in pieces), reverse=True)
        for p in pieces:
            assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids))) and (p.start == 0 or not p.placed)
            starts.setdefault(p.doc_id, []).append((p.start, len(p.ids)))
    assert len(starts) == 400


def test_packing_query_and_stage_take_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.ADDED_TOKENS == {t["content"]: t["id"] for t in json.load(open(path))["added_tokens"]}
    tokenizer = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a  <|endoftext|> b", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext|", "<|ENDOFTEXT|> é日本🙂", "long " * 3000 + "<|endoftext|>"]
    docs = frame(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert sum(50256 in ids for ids in want.values()) == 4
    got = {}
    for p in sorted(corpus_pipeline.packed(spark, docs, SMALL).collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert got == want
    for r in queries.op2_packing(spark, str(tmp_path)).collect():
        own = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes())


def test_packing_takes_the_place_of_least_squares():
    levels = packing.LevelArray(8)
    random.seed(5)
    count = {}
    for _ in range(300):
        size = random.randrange(1, 8)
        cost = {}
        for h in [0, *[h for h, n in count.items() if n]]:
            if h + size > 8:
                continue
            after = dict(count)
            if h:
                after[h] -= 1
            if h + size < 8:
                after[h + size] = after.get(h + size, 0) + 1
            cost[h] = sum(n * n for n in after.values())
        _, level = levels.place(size)
        assert cost[level] == min(cost.values())
        if level:
            count[level] -= 1
        if level + size < 8:
            count[level + size] = count.get(level + size, 0) + 1


def test_rice_codes_come_back():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 2**63), (5000, 2**63), (5000, 6000), (2, 2**40)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        k, code = exact_exchange.rice_encode(values)
        assert (exact_exchange.rice_decode(k, len(values), code) == values).all()


EQUAL = [(1, "a b"), (2, "ab "), (3, " a\tb\n"), (4, None), (5, ""), (6, "\x0b\x0c\r"), (7, "a b"), (8, "c"), (9, "c"), (10, "z" * 200_000), (11, "z " * 200_000)]


def test_exact_groups(spark, documents, rows):
    for docs, own, n in ((frame(spark, EQUAL).repartition(3), EQUAL, 2), (documents, rows, 300)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_exchange.marked(exact_exchange.groups(docs, n)).collect()}
        assert got == brute.equal_texts(own)
        left = exact_exchange.deduplicate(docs, n)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, _, k) in got.items() if k)


def test_exact_repeated_rows_and_null_ids(spark):
    docs = frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "q"), (None, "q"), (3, "a ")])
    got = exact_exchange.marked(exact_exchange.groups(docs, 2)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 3, 4, False), (1, 3, 4, False), (1, 3, 4, False), (3, 3, 4, True)]
    assert exact_exchange.deduplicate(docs, 2).count() == 2
    assert exact_exchange.groups(docs.limit(0)).count() == 0 and exact_exchange.deduplicate(docs.limit(0)).count() == 0


def spliced(seed, n=120):
    random.seed(seed)
    base = [random.choice("abc") for _ in range(3000)]
    out = []
    for i in range(n):
        own = []
        while len(own) < 150:
            k = random.randrange(2900)
            own += base[k : k + random.randrange(5, 70)] + [random.choice("abc") for _ in range(random.choice((0, 0, 9, 30)))]
        out.append((i, random.choice((" ", "\n ", "\t")).join(own)))
    return out + [(500, "a " * 300), (501, None), (502, ""), (503, "b" * 50_000), (504, " ".join("abcdefghijklmnopqrst")), (505, " ".join("abcdefghijklmnopqrst"))]


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (9, 10_000), (3, 7)])
def test_copied_windows(spark, parts, batch):
    own = spliced(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_words, sum(s.length for s in r.removed), r.kept) for r in relative_lz.remove_copies(frame(spark, own).repartition(parts)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    assert got == brute.copied_windows(own)


def test_copied_windows_of_the_documents(documents, rows):
    got = {r.doc_id: (r.n_words, sum(s.length for s in r.removed), r.kept) for r in relative_lz.remove_copies(documents.repartition(7)).collect()}
    assert got == brute.copied_windows(rows)


def test_copied_windows_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = frame(spark, [(3, text), (3, text), (None, text), (7, "x " + text)])
    got = sorted((r.doc_id or 0, sum(s.length for s in r.removed)) for r in relative_lz.remove_copies(docs).collect())
    assert got == [(0, 25), (3, 0), (3, 0), (7, 25)]
    assert relative_lz.remove_copies(docs.limit(0)).count() == 0


def test_simhash_components(spark, documents, rows):
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    fps = {i: brute.simhash(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps and {i: c for i, (_, c) in got.items()} == brute.linked(fps)
    left = simhash.keep_first(documents)
    assert left.columns == documents.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(brute.linked(fps).values()))


@pytest.mark.parametrize("cell_rows", [20_000, 40])
def test_simhash_links_in_crowded_cells(spark, cell_rows):
    random.seed(9)
    own = []
    for _ in range(6):
        centre = random.getrandbits(64)
        own += [centre ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) for _ in range(150)]
    fps = {f: f for f in {x % 2**64 for x in own}}
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(table, cell_rows=cell_rows)).collect()}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = brute.linked(fps)
    sets = lambda pairs: {frozenset(k for k, v in pairs if v == r) for r in {v for _, v in pairs}}
    mine = [(signed(k), roots.get(signed(k), signed(k))) for k in fps]
    assert sets(mine) == sets([(signed(k), v) for k, v in want.items()])


def test_the_embedding_bounds_the_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    assert (np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b)) <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: np.array([[int(v) >> s & 1 for s in range(0, 64, 2)] for v in x]) + np.array([[int(v) >> s & 1 for s in range(1, 64, 2)] for v in x])
    assert (np.bitwise_count(simhash.embedding(a[:50]) ^ simhash.embedding(b[:50])) == abs(counts(a[:50]) - counts(b[:50])).sum(axis=1)).all()


def test_simhash_defined_cases(spark):
    docs = frame(spark, [(4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "ONE\ttwo"), (None, "one two"), (7, "one two"), (9, "word " * 40_000)])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id != 9) == [(0, 7), (4, 4), (5, 4), (6, 4), (7, 7), (7, 7), (8, 7)]
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [4, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_keeps_rows_and_not_ids(spark):
    random.seed(3)
    one, two, three, four = (" ".join(random.choices("abcdefghij", k=60)) for _ in range(4))
    rows = [(1, one), (None, one), (None, two), (None, two), (None, None), (5, three), (5, four), (6, three), (4, four), (8, "x y"), (8, "x\ty"), (8, "z"), (8, "z")]
    distances = [bin(brute.simhash(a) ^ brute.simhash(b)).count("1") for a, b in ((one, two), (one, three), (one, four), (two, three), (two, four), (three, four))]
    assert min(distances) > 4
    docs = frame(spark, rows).repartition(3)
    left = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    # Null rows go only with their own text; (5, four) goes with 4, (5, three) stays.
    apart = sorted(((i or 0, t or "") for i, t in left if t not in ("x y", "x\ty")))
    assert apart == sorted([(1, one), (0, two), (0, two), (0, ""), (5, three), (4, four), (8, "z")])
    assert sum(t in ("x y", "x\ty") for _, t in left) == 1


def test_mixing_meets_every_target(spark, documents):
    got = mixing.mix(documents).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute.shared_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)
    again = mixing.mix(documents.repartition(5)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    copies = {r.doc_id: r["count"] for r in mixing.apply_mix(documents).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.epochs + (r.rest_taken > 0) for r in got if r.taken}


def test_mixing_caps_and_defined_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for s, n in (("a", 50), ("b", 2), ("é", 3), (None, 1)) for i in range(n)]
    rows += [(900, None, "z"), (901, "", "z"), (902, "x " * 50_000, "a"), (902, "x " * 50_000, "a"), (None, "n", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute.shared_targets(sizes)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


@pytest.mark.parametrize("texts", [lambda i: "w " * (i % 9 + 1) + f"x{i}", lambda i: "same text of six words each"])
def test_mixing_stage_without_ids_stays_near_its_targets(spark, texts):
    rows = [(None if s != "b" else 7, texts(i), s) for s, n in (("a", 2000), ("b", 700), ("c", 300), (None, 40)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sizes, longest = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        longest[s] = max(longest.get(s, 0), len(t.split()))
    want = brute.shared_targets(sizes)
    got = {}
    for r in mixing.apply_mix(docs).select("source", mixing.words_in(F.col("text")).alias("n")).collect():
        got[r.source] = got.get(r.source, 0) + r.n
    assert all(abs(got[s] - want[s]) <= longest[s] for s in want)
    each = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert all(abs(r.t - want[r.source]) <= 1 and r.n == sum(s == r.source for _, _, s in rows) for r in each)


PAGES = [(5, "u v\r\nX: y", "<p>" + "é" * 60), (6, None, "<p>" + "é" * 60), (7, "", "<p>" + "é" * 60), (8, "q", None), (9, "q", "short"), (4, "q", "short"),
         (None, "n", "<p>" + "é" * 60), (10, "l", "long" * 100_000), (5, "again", "<p>" + "é" * 60)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages).collect()
    want = sorted((p or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), 5 if h and h[:3] == "<p>" and p and p > 5 else 0) for p, _, h in PAGES)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.refers_to or 0) for r in got) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)
    assert {r.url for r in got if r.page_id == 5} == {"u%20v%0D%0AX:%20y", "again"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_frames_and_verifies():
    body = b"payload \r\n\r\n with breaks" * 50
    one = warc.record(1, "http://a", body, hashlib.sha256(body).hexdigest(), None)
    two = warc.record(2, None, body, hashlib.sha256(body).hexdigest(), 1)
    for step in (1, 7, 10_000):
        first, second = [warc.parsed(m) for m in warc.members(io.BytesIO(one + two), step)]
        assert first["payload"] == body and second["refers_to"] == 1 and second["payload_bytes"] == len(body)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(one[:-20])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(one + b"junk")))
    plain = gzip.decompress(one)
    for broken, message in ((plain.replace(b"payload ", b"payl0ad ", 1), "digest differs"), (plain[:-1], "length"), (plain.replace(b"WARC/1.1", b"XXXX/1.1", 1), "not a WARC")):
        with pytest.raises(ValueError, match=message):
            warc.parsed(broken)


def test_warc_reader_refuses_every_cut():
    body = b"payload" * 40
    one, two = (warc.record(i, "http://a", body, hashlib.sha256(body).hexdigest(), None) for i in (1, 2))
    assert len(list(warc.members(io.BytesIO(one)))) == 1
    for cut in range(1, len(two)):
        for step in (3, 1 << 16):
            with pytest.raises(ValueError, match="ends inside"):
                list(warc.members(io.BytesIO(one + two[:cut]), step))


def foreign(kind, block, *lines):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0-1>\r\n".encode() + b"".join(x.encode() + b"\r\n" for x in lines) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_warc_reader_takes_records_of_other_writers():
    import base64

    body = b"<p>h\xc3\xa9llo</p>"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    chunked = b"4\r\n" + body[:4] + b"\r\n9;x=y\r\n" + body[4:14] + b"\r\n0\r\nTrailer: t\r\n\r\n"
    info = warc.parsed(foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"))
    assert (info["record_type"], info["page_id"], info["record_id"], info["payload"]) == ("warcinfo", None, "<urn:uuid:0-1>", b"software: x\r\n")
    plain = warc.parsed(foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, http, "WARC-Payload-Digest: " + sha1(body)))
    assert plain["payload"] == body and plain["payload_bytes"] == len(body) and plain["payload_digest"] == hashlib.sha256(body).hexdigest()
    for stated in (sha1(chunked), sha1(body[:14])):
        found = warc.parsed(foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, http, "WARC-Payload-Digest: " + stated))
        assert found["payload"] == body[:14]
    with pytest.raises(ValueError, match="payload differs"):
        warc.parsed(foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, http, "WARC-Payload-Digest: " + sha1(b"other")))
    with pytest.raises(ValueError, match="block digest"):
        warc.parsed(foreign("resource", body, "WARC-Block-Digest: " + sha1(b"other")))
    short = warc.parsed(foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\n" + body, http, "WARC-Truncated: length"))
    assert short["payload_bytes"] == len(body)
    request = warc.parsed(foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Block-Digest: blake9:zz"))
    assert request["record_type"] == "request" and request["payload"] == b""
    revisit = warc.parsed(foreign("revisit", b"HTTP/1.1 304 x\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:7>", "WARC-Payload-Digest: " + sha1(body)))
    assert (revisit["refers_to"], revisit["refers_to_id"], revisit["payload"], revisit["payload_bytes"], revisit["payload_digest"]) == (None, "<urn:uuid:7>", None, None, sha1(body))
    folded = warc.parsed(foreign("metadata", b"", "X: a\r\n b"))
    assert folded["payload_bytes"] == 0
    for broken in (b"WARC/1.0\r\nContent-Length: x\r\n\r\n\r\n\r\n", b"WARC/1.0\r\n\r\n\r\n\r\n", b"WARC/1.0"):
        with pytest.raises(ValueError):
            warc.parsed(broken)


def test_pipeline_stages_keep_columns_of_any_name(spark):
    names = ["row", "id", "_id", "key", "_key", "epochs", "last_key", "cut_source", "sha", "n", "score", "toxicity", "doc id.x"]
    rows = [(i, f"some words of text {i % 4} that differ {i % 4}", "s" if i % 2 else None, *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        assert {tuple(r)[3:] for r in after.collect()} <= {tuple(range(len(names)))}
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SMALL).select("doc_id").distinct().count() == 12


def test_pipeline_stages(spark, documents, rows):
    docs, own = documents, dict(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF).persist()
        assert after.columns == documents.columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            assert sum(labels.get(i) == 1 for i in ids) <= 0.2 * sum(labels.get(i) == 1 for i in before)
            assert sum(labels.get(i) == 0 for i in ids) >= 0.97 * sum(labels.get(i) == 0 for i in before)
        elif name == "exact_dedup":
            assert sorted(ids) == sorted(i for i, (_, _, k) in brute.equal_texts([(i, own[i]) for i in before]).items() if k)
        elif name == "near_dedup":
            assert sorted(ids) == sorted(set(brute.linked({i: brute.simhash(own[i]) for i in before}).values()))
        else:
            assert set(ids) <= set(before)
            assert all(r.text == own[r.doc_id] for r in after.collect())
        docs = after
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("doc_tokens").alias("t"), F.max("doc_tokens").alias("u")).where("n % t <> 0 or t <> u").count() == 0


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
