"""Hard negatives, token files and fill-in-the-middle against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactspark.llm import fill_middle, hard_negatives, queries, token_files


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- hard negatives

VECTORS = "vec_id bigint, label bigint, embedding array<double>, score string, anchor int"


def brute_negatives(rows):
    use = []
    for vec_id, label, vector, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        use.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    last = lambda v: (v is None, v or 0)
    for i, (a, label, q) in enumerate(use):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, c)), last(b), b, lb) for j, (b, lb, c) in enumerate(use) if j != i]
        for s, _, p, _ in sorted(r for r in scored if r[3] == label)[:5]:
            fit = sorted(r for r in scored if r[3] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)[:10]
            out += [(a, p, rank, b, -s, -t) for rank, (t, _, b, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def vectors(seed, n, spread=1.0, width=12):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, rnd.choice([0, 1, 1, 1, 2]), [spread * (c + rnd.gauss(0, 0.7)) for c in rnd.choice(centres)], "x", 1) for i in range(n)]


def negatives(spark, tmp_path, rows):
    got = queries.op11_hard_negatives(spark, written(spark, tmp_path, "embeddings", rows, VECTORS))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_negatives_equal_brute_force(spark, tmp_path):
    rows = vectors(1, 700)
    got = negatives(spark, tmp_path, rows)
    assert len(got) > 100 and got == brute_negatives(rows)


def test_negatives_of_odd_rows(spark, tmp_path):
    base = vectors(2, 320)
    odd = [(None, 1, base[3][2], None, None), (401, None, base[3][2], None, None), (402, 1, None, None, None), (403, 1, [None] * 12, None, None),
           (404, 1, [float("nan")] * 12, None, None), (405, 1, [float("inf")] * 12, None, None), (406, 1, [], None, None), (500, 2, [1.0, 2.0], None, None),
           (600, 1, [0.0] * 12, None, None), (700, 9, base[1][2], None, None)]
    copies = [base[100]] * 7 + [base[7]] * 12  # an anchor that is repeated, and equal scores
    rows = base + odd + copies
    assert negatives(spark, tmp_path, rows) == brute_negatives(rows)


@pytest.mark.parametrize("spread", [1e6, 1e12, 1e-4])
def test_negatives_of_large_and_small_components(spark, tmp_path, spread):
    rows = vectors(3, 201, spread)
    want = brute_negatives(rows)
    got = negatives(spark, tmp_path, rows)
    if spread < 1e10:
        assert got == want
    else:  # scores beyond 64 bits stand at the end of their range
        assert all(-(2**63) <= score < 2**63 for r in got for score in r[4:])


def test_no_vectors(spark, tmp_path):
    assert negatives(spark, tmp_path, []) == []


def test_small_blocks_and_few_rows(spark):
    rows = [(i, i % 3, [float(i % 5), 1.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "id bigint, label bigint, v array<double>").select("id", "label", hard_negatives.cells(F.col("v")).alias("cells"))
    got = [hard_negatives.mine(frame, F.col("id") == 4, block_cells=cells).orderBy("positive_rank", "rank").collect() for cells in (7, 10_000)]
    assert got[0] == got[1] and got[0]


# --- token files

DOCS = "doc_id bigint, text string, tie string, ids int, h1 string, n string, form string, output string"
TEXTS = ["one two, three.", "", None, " ", "a  b\n\n c d　e", "it's we're 'sta 42nd x_y._ (ok)?! no:yes;", "été…naïve, Straße. ŉ ǅ.", "日本語。テスト 한국어 🙂🙂 👩‍👩‍👧",
         "x <|endoftext|> y<|endoftext|>", "a\x1cb \x85c   d", "word " * 3000, "q" * 5000, "1.5,2.5 3,000.00", "\n.a\n,b", "é.é , ́."]


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_file())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cut_texts_have_the_library_s_ids():
    rnd = random.Random(5)
    alphabet = list("aé ß.,;:!?()\n\t'_-́ǅ9٣日  ") + ["ab", " the", "<|endoftext|>", "'s", "x²", "ª", "Ⅷ"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(3000)]
    encode = token_files.encoder(token_files.tokenizer_file())
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == library_ids(texts)


def test_ids_of_many_documents_are_packed_at_once():
    rnd = np.random.default_rng(5)
    docs = [rnd.integers(0, top, n).astype("<u4") for n, top in ((1, 200), (5, 70_000), (4, 300), (7, 1 << 25), (2, 60_000))]
    sizes = np.array([len(d) for d in docs])
    assert token_files.pack(np.concatenate(docs), sizes) == tuple(b"".join(x) for x in zip(*(token_files.pack(d) for d in docs)))
    for some in (docs, [d for d in docs if d.max() < 65_536], []):
        batch = pa.RecordBatch.from_arrays([pa.array([len(d) for d in some], pa.int32()), pa.array([token_files.short(d) for d in some], pa.binary())], ["n", "ids"])
        for cut in (batch, batch.slice(1)):
            n, ids = token_files.ids_of_batch(cut)
            want = some[len(some) - cut.num_rows:]
            assert n.tolist() == [len(d) for d in want] and ids.tolist() == [int(i) for d in want for i in d]


def test_pack_and_unpack():
    rnd = random.Random(6)
    docs = [np.array([rnd.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)], dtype=np.uint32) for n in (0, 1, 3, 4, 5, 0, 1000, 2)]
    packed = [token_files.pack(d) for d in docs]
    content = b"".join(token_files.shard(list(range(8)), [len(d) for d in docs], [c for c, _ in packed], [d for _, d in packed]))
    _, sizes, control, data = token_files.parsed(content)
    back = np.concatenate([ranks for _, _, ranks in token_files.unpack(control, data, sizes)])
    assert back.tolist() == np.concatenate(docs).tolist()
    for cut in (0, 5, 20, 40, len(content) - 1):
        with pytest.raises(ValueError):
            token_files.parsed(content[:cut])


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 3 - 4, t, "t", 1, "h", "n", "f", "o") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None, None)] * 3 + [(8, "same id", *[None] * 6)] * 40
    random.Random(7).shuffle(rows)
    got = queries.op12_token_files(spark, written(spark, tmp_path, "documents", rows, DOCS)).collect()
    ids = {t: [*i, 2] for t, i in zip([r[1] for r in rows], library_ids([r[1] for r in rows]))}
    crc = lambda t: zlib.crc32(np.array(ids[t], dtype="<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len(ids[r[1]]), crc(r[1])) for r in rows)
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))


def test_token_files_of_small_shards_and_frequent_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word the {i} the") for i in range(300)], "doc_id bigint, text string").repartition(7)
    listed = token_files.write(docs, f"{tmp_path}/shards", shard_bytes=500)
    shards = listed.orderBy("start").collect()
    assert len(shards) > 8 and sum(s.documents for s in shards) == 300
    order = np.frombuffer((tmp_path / "shards" / "ranks").read_bytes(), "<u4")
    assert order[0] == library_ids([" the"])[0][0]
    got = token_files.read(spark, listed, f"{tmp_path}/shards").orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*i, 2] for i in library_ids([f"the word the {i} the" for i in range(300)])]


def test_no_documents_to_token_files(spark, tmp_path):
    assert queries.op12_token_files(spark, written(spark, tmp_path, "documents", [], DOCS)).count() == 0


# --- fill in the middle

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def brute_middle(doc_id, text):
    text = text or ""
    units = LINES.findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 50
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_rows():
    rnd = random.Random(8)
    parts = ["a", "é\n", "日本\n", "\n", "🙂 b", "<", "<P", "P>", "S>\n", "x\r\n", "<P>", "\x00", " "]
    texts = ["".join(rnd.choices(parts[:-3] + parts[-2:] if i % 5 else parts, k=rnd.randrange(30))) for i in range(800)]
    texts += [None, "", "\n", "\n\n\n", "no break", "<M>", "tail<", "<S", ("long line\n" * 9 + "日\n") * 40_000]
    return [(None if i % 97 == 5 else i // 2, t, "t", 1, "h", "n", "f", "o") for i, t in enumerate(texts)]


def test_middle_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = middle_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    back = fill_middle.restore(fill_middle.transform(docs)).collect()
    want = sorted((repr(r[0]), *map(repr, brute_middle(r[0], r[1])), r[1] or "") for r in rows)
    assert sorted((repr(r.doc_id), *map(repr, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in back) == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    got = queries.op13_fill_middle(spark, written(spark, tmp_path, "documents", rows, DOCS)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.output_sha256, r.restored_sha256) for r in got) == sorted((repr(r[0]), sha(brute_middle(r[0], r[1])[4]), sha(r[1] or "")) for r in rows)


def test_middle_in_small_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "PIECE", 7)
    texts = [t or "" for _, t, *_ in middle_rows()[:300]]
    h = [[int(hashlib.sha256(f"{i}-{k}".encode()).hexdigest()[:8], 16) for i in range(len(texts))] for k in range(4)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, **{f"h{k + 1}": h[k] for k in range(4)}})
    out = fill_middle.scattered(batch.slice(3, 250), 80, 50)
    assert fill_middle.gathered(out.column("output"), out.column("form")).to_pylist() == texts[3:253]
    assert out.column("form").to_pylist().count("plain") > 40


def test_restore_refuses_foreign_outputs(spark):
    import pyarrow as pa

    with pytest.raises(ValueError):
        fill_middle.gathered(pa.array(["<P>a<S>b"]), pa.array(["psm"]))


def test_no_texts_to_transform(spark, tmp_path):
    assert queries.op13_fill_middle(spark, written(spark, tmp_path, "documents", [], DOCS)).count() == 0
