import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywork.llm import chosen_path, exact_dedup, mixing, packing, token_output
from quarrywork.llm.encoding import Encoder
from quarrywork.llm.queries import tokenizer_path
from tests.llm.brute import EDGE_TEXTS, near_components, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, start string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None if i == 4 else f"s{(i or 0) % 3}", None, True, "mine") for i, t in rows], SCHEMA)


def test_encoder_equals_whole_texts(spark, sf):
    texts = [t for _, t in EDGE_TEXTS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encoder = Encoder(tokenizer_path(), words_kept=50)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for text, ids in zip(part, encoder.ids(part)):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(text or "", add_special_tokens=False).ids


def test_encoder_on_random_marks_and_spaces():
    """Texts of all kinds of white space, marks, scripts, contractions and added tokens; words are met again and dropped."""
    rng = np.random.default_rng(3)
    bits = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\x00",
            "a", "word", "Word", "don't", "we'll", "''s", "'", ".", ",", "...", "(", "x1.5", "12", "é", "ñandú", "漢字", "かな", "“q”", "£", "«", "🙂", "á.b", "1é", "<|endoftext|>", "<|", "y" * 70, "é" * 40, "z" * 64, "v" * 65]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(4000)] + [None, "", " ", "\n"]
    for kept in (10, 1 << 20):
        encoder = Encoder(tokenizer_path(), words_kept=kept)
        for at in range(0, len(texts), 400):
            part = texts[at : at + 400]
            for text, ids in zip(part, encoder.ids(part)):
                assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_tells_apart_parts_of_one_hash(monkeypatch):
    from quarrywork.llm import encoding

    monkeypatch.setattr(encoding, "_hashes", lambda lanes, first, size: (size % 3).astype(np.uint64) << np.uint64(60))
    encoder = Encoder(tokenizer_path())
    texts = ["one two three", "four five, six", "one five three", "a bb ccc dddd"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == [encoder.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_of_documents():
    """Pieces follow each other; only the last full piece's rest is cut, at a multiple of the grain."""
    sizes = np.array([1, 255, 256, 257, 512, 2047, 2048, 2049, 4096, 4097, 5000, 2304])
    row, start, length = packing.cuts(sizes, 2048, 256)
    for k, n in enumerate(sizes.tolist()):
        at = sorted(zip(start[row == k].tolist(), length[row == k].tolist()))
        assert [s for s, _ in at] == [0, *np.cumsum([x for _, x in at])[:-1].tolist()] and sum(x for _, x in at) == n
        assert all(0 < x <= 2048 for _, x in at) and sum(x % 256 > 0 for _, x in at) <= 1


def expected_tokens(rows, end):
    model = Encoder(tokenizer_path()).model
    return [(i, model.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def test_token_files_round_trip(spark):
    got = token_output.round_trip(spark, frame(spark, EDGE_TEXTS), tokenizer_path(), partitions=3, seq_len=64).collect()
    at, want = 0, []
    for i, ids in expected_tokens(sorted(EDGE_TEXTS, key=lambda r: (r[0] is not None, r[0])), 2):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_are_fixed_size_lists(spark, tmp_path):
    import pyarrow as pa

    manifest = token_output.write(frame(spark, EDGE_TEXTS), f"file://{tmp_path}/x", tokenizer_path(), partitions=2, seq_len=64).collect()
    for row in manifest:
        reader = pa.ipc.open_file(pa.memory_map(row.path.removeprefix("file://") + ".arrow"))
        batches = [reader.get_batch(k) for k in range(reader.num_record_batches)]
        assert sum(b.num_rows for b in batches) == row.n_sequences
        assert all(b.column(0).type.list_size == 64 for b in batches)
        assert sum(int(b.column(1).values.true_count) for b in batches) == row.n_tokens


def test_packing(spark):
    rows = [*EDGE_TEXTS, (6, "a b c d e f g h")]
    got = packing.pack(packing.pieces(frame(spark, rows), tokenizer_path())).collect()
    model_ids = expected_tokens(rows, 1)
    ids_of = {i: ids for i, ids in model_ids}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids_of[r.doc_id])
    for i, ids in ids_of.items():
        spans = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sorted({s for s, _ in spans} | {s + n for s, n in spans}) == sorted({0, len(ids)} | {s for s, _ in spans})
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in model_ids)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_pads_little():
    rng = np.random.default_rng(5)
    demand = np.bincount(np.clip(rng.lognormal(5, 0.9, 20_000) / 4, 1, 512).astype(int), minlength=513)[1:]
    patterns = packing.solve(demand, 512)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * np.arange(1, 513)).sum() <= 512 for p, _ in patterns)
    used = sum(n for _, n in patterns)
    assert used * 512 <= 1.01 * (demand * np.arange(1, 513)).sum() + 512


def test_packing_documents_pads_little(spark, sf):
    got = packing.pack(packing.pieces(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_path())).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) * 2048 <= 1.01 * sum(r.n for r in got) + 2048 and max(r.n for r in got) <= 2048


def test_packing_empty(spark):
    assert packing.pack(packing.pieces(frame(spark, []), tokenizer_path())).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    options = {"hasher": lambda norm: F.unhex(F.substring(F.md5(norm), 1, 1).cast("string"))} if weak else {}
    got = exact_dedup.annotate(frame(spark, EDGE_TEXTS), **options).collect()
    norm = {i: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for i, t in EDGE_TEXTS}
    size = {i: len(t or "") for i, t in EDGE_TEXTS}
    for row in got:
        group = [i for i in norm if norm[i] == norm[row.doc_id]]
        keep = min(group, key=lambda i: (-size[i], i is None, i))
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(group), keep == row.doc_id)


def test_exact_dedup_stage(spark):
    rows = [*EDGE_TEXTS, (9, "word " * 30_000), (4, "another text")]
    left = exact_dedup.deduplicate(frame(spark, rows))
    assert left.columns == SCHEMA.replace(",", "").split()[::2]
    stay = [(i or 0, t or "") for i, t in EDGE_TEXTS if i not in (1, 2, 7, 10)] + [(4, "another text")]
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(stay)
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 50))) for i in range(600)] + [(None, "a b"), (600, None), (7, "w " * 7), (7, "w " * 7)]
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    assert total == sum(len(words(t)) for _, t in rows)
    goal = {(r.source, r.source_size, r.target) for r in got}
    assert abs(sum(t for _, _, t in goal) - 1.5 * total) < 1e-6
    for source, size, target in goal:
        taken = sum(r.taken for r in got if r.source == source)
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 50
    assert all(r.taken <= 2 * r.size for r in got)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.plan(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def check_near(spark, rows):
    sets, want = near_components(rows)
    got = {r.doc_id: r for r in chosen_path.annotate(frame(spark, rows)).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, component in want.items():
        assert (got[i].component_id, got[i].n_shingles) == (component, len(sets[i])), i


def test_near_dedup_edge_texts(spark):
    check_near(spark, EDGE_TEXTS)
    assert chosen_path.annotate(frame(spark, [])).count() == 0


def test_near_dedup_searches_all_texts_of_one_id(spark):
    """Two rows of one id with different texts: near copies of both are found."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(200)) for k in "abc")
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, c), (None, c), (5, "")]
    got = chosen_path.annotate(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 196, 0), (5, 0, 5), (5, 196, 5), (5, 196, 5), (6, 197, 5), (7, 197, 5), (8, 196, 8)]


def test_near_dedup_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check_near(spark, [tuple(r) for r in docs])


def test_near_dedup_dense_groups(spark, monkeypatch):
    """Groups around the threshold, larger than a small node, with a passage that all share."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    shared = list(rng.choice(vocabulary, 60))
    rows, n = [], 0
    for group in range(4):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(90):
            text = list(base)
            for k in rng.choice(120, int(rng.integers(0, 6)), replace=False):
                text[k] = str(rng.choice(vocabulary))
            rows.append((n, " ".join(text + shared)))
            n += 1
    for _ in range(150):
        rows.append((n, " ".join(list(rng.choice(vocabulary, int(rng.integers(20, 90)))) + shared)))
        n += 1
    monkeypatch.setattr(chosen_path, "SMALL", 6)
    check_near(spark, rows)
    monkeypatch.setattr(chosen_path, "REST", 5)
    monkeypatch.setattr(chosen_path, "DEPTH", 1)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    check_near(spark, rows)


def test_near_dedup_stage(spark):
    docs = frame(spark, EDGE_TEXTS)
    left = chosen_path.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 9, 11, 12, 13]  # 5 = 4, 7 = 8 = 6, 10 = 9 but for case and spaces
