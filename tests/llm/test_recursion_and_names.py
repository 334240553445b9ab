"""Recursion of the chosen-path trees at their own parameters, columns with reserved names, and the
pipeline's stages on empty, repeated and odd rows."""

import collections

import numpy as np

import corpus_pipeline
from quarrywork.llm import chosen_path, exact_dedup, license_scan, mixing, packing, toxicity
from quarrywork.llm.queries import tokenizer_path
from quarrywork.llm.scratch import Scratch
from tests.llm.brute import EDGE_TEXTS, components, shingles


def test_recursion_finds_links_at_its_own_parameters(spark, monkeypatch):
    """700 pairs of near copies inside a passage that all documents share: unlike documents have a similarity
    of 0.4, so the passage's nodes hold most documents and are parted again and again."""
    rng = np.random.default_rng(12)
    common = [f"c{k}" for k in range(204)]
    rows, edges = [], []
    for pair in range(700):
        own = [f"p{pair}w{k}" for k in range(154)]
        other = own[:110] + [f"q{pair}w{k}" for k in range(44)]
        rows += [(2 * pair, " ".join(common + own)), (2 * pair + 1, " ".join(common + other))]
        edges.append((2 * pair, 2 * pair + 1))
    sets = [shingles(t) for _, t in rows[:40]]
    for i in range(40):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
            assert alike == (i // 2 == j // 2)
    order = rng.permutation(len(rows))
    made, plain = {}, Scratch.table

    def table(self, label, df):
        made[label] = made.get(label, 0) + 1
        out = plain(self, label, df)
        if label in ("star-edges", "path-edges"):
            made[label] = out.count()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.annotate(docs).collect()}
    assert got == components(edges, [i for i, _ in rows])
    # Nodes were parted three times and more, and links came from there that no leader had.
    assert "level-3" in made and made["path-edges"] > 0 and made["star-edges"] + made["path-edges"] >= 700


def test_recall_by_number_of_trees():
    """Pairs at similarity 0.75 that share a node of up to SMALL documents somewhere: the share that 1, 2, 4
    and 6 trees find among 300 pairs, by the roots' children alone (two documents a node there)."""
    rng = np.random.default_rng(5)
    found = {}
    sigs = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
        flat = np.concatenate([both, a, both, b])
        sigs.append(chosen_path.minwise(flat, np.array([0, 350]))[1])
    for trees in (1, 2, 4, 6):
        at = slice(0, trees * chosen_path.BRANCH)
        found[trees] = np.mean([(s[0, at] == s[1, at]).any() for s in sigs])
    assert found[6] >= 0.999 and found[1] >= 0.88 and found[1] <= found[2] <= found[4] <= found[6]


NAMES = ("__qw_id", "__qw_sha", "__qw_n", "__qw_s", "__qw_key", "__qw_k", "__qw_sum", "__qw_own", "__qw_copies", "__qw_score", "__qw_text", "__qw_digest", "__qw_known", "__a", "__b", "__n", "__id", "__text", "row_key", "kept", "component_id", "size", "taken", "copies", "score")
WIDE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in rows], WIDE)


def test_stages_keep_columns_of_any_name(spark):
    rows = [*EDGE_TEXTS[:8], (8, "A  b\nc d e f g h "), (6, "a b c d e f g h"), (20, "some more words stand here"), (20, "some more words stand here")]
    docs = wide(spark, rows)
    labels = spark.createDataFrame([(1, 0), (20, 0)], "doc_id long, toxic int")
    stages = {
        "exact": exact_dedup.deduplicate(docs), "near": chosen_path.deduplicate(docs), "mixing": mixing.mix(docs), "toxicity": toxicity.reject(docs, labels), "license": license_scan.unlicensed(docs),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in NAMES), name
    ids = lambda name: sorted(r.doc_id for r in stages[name].collect())
    assert len(stages["toxicity"].collect()) == len(rows) == len(stages["license"].collect())
    assert ids("exact").count(6) + ids("exact").count(7) == 1 and ids("exact").count(8) == 1 and ids("exact").count(20) == 1
    pieces = packing.pieces(docs, tokenizer_path()).selectExpr("*", "'x' AS __size", "'y' AS __rank", "'z' AS `offset`")
    packed = packing.pack(pieces).collect()
    assert all((r["__size"], r["__rank"]) == ("x", "y") and r.offset != "z" for r in packed)


def test_mixture_deals_copies_of_repeated_rows(spark):
    """Equal rows share their copies as evenly as can be, without a window over them all."""
    rows = [(1, "one two three")] * 500 + [(k, f"word{k} " * 5) for k in range(2, 60)]
    docs = spark.createDataFrame([(i, t, "s", "mine", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, __qw_n string, nr long")
    plan = collections.Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.copies
    got = mixing.mix(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == +plan
    per = collections.Counter(r.nr for r in got if r.doc_id == 1)
    low, high = divmod(plan[1], 500)[0], -(-plan[1] // 500)
    assert all(low <= per.get(k, 0) <= high for k in range(500))


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for name, rows in (("empty", []), ("odd", [*EDGE_TEXTS, (13, "x"), (13, "x"), (None, None), (None, "no id")])):
        folder = f"{tmp_path}/{name}"
        wide(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, folder)
            if stage != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{stage}.parquet")
            docs = spark.read.parquet(f"{folder}/{stage}.parquet")
        assert (docs.count() == 0) == (name == "empty")
        if rows:
            texts = {"".join((t or "").split()) for _, t in rows}
            kept = spark.read.parquet(f"{folder}/exact_dedup.parquet").collect()
            assert len(kept) == len(texts)


def test_toxicity_of_very_long_and_repeated_texts(spark):
    words = " ".join(f"word{k % 300}" for k in range(60_000))
    rows = [(k, f"word{k} idiot moron word{k + 1} scum of word{k + 2}" if k % 3 == 0 else f"word{k} and word{k + 1} again word{k + 2}", int(k % 3 == 0)) for k in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, words), (901, words + " idiot moron scum"), (3, "word3 idiot moron scum"), (3, words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(900, 0), (901, 1), (3, 1)], "doc_id long, toxic int")
    picked = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 1200)
    assert len(picked) <= len(rows) and max(len(t) for t, _ in picked) <= toxicity.FIT_LENGTH
    got = collections.defaultdict(list)
    for r in toxicity.judge(docs, labels).collect():
        got[r.doc_id].append(r.predicted)
    assert got[900] == [0] and got[901] == [1] and sorted(got[3]) == [0, 1, 1]


def brute_types(texts, kinds):
    """Toxic types by their definition: places are (left, word, right), counted once a class; documents too."""
    docs = [toxicity.token_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist() for t in texts]
    flat = [h for d in docs for h in d]
    place = {0: collections.defaultdict(set), 1: collections.defaultdict(set)}
    held = {0: collections.defaultdict(set), 1: collections.defaultdict(set)}
    at = 0
    for n, (d, kind) in enumerate(zip(docs, kinds)):
        for h in d:
            place[kind][h].add((flat[at - 1], flat[(at + 1) % len(flat)]))
            held[kind][h].add(n)
            at += 1
    count = {k: {h: min(len(place[k][h]), len(held[k][h])) for h in place[k]} for k in (0, 1)}
    total = {k: sum(count[k].values()) for k in (0, 1)}
    share, out = total[1] / (total[0] + total[1]), set()
    for h in set(flat):
        t, c = count[1].get(h, 0), count[0].get(h, 0)
        odds = np.log((t + 0.5) / (total[1] + 1)) - np.log((c + 0.5) / (total[0] + 1))
        ratio = t * np.log(max(t, 0.5) / max((t + c) * share, 1e-9)) + c * np.log(max(c, 0.5) / max((t + c) * (1 - share), 1e-9))
        if t >= toxicity.LEAST_SEEN and odds >= toxicity.LEAST_ODDS and ratio >= toxicity.LEAST_RATIO:
            out.add(h)
    return out


def test_toxic_types_and_fit_equal_brute_force():
    from tests.llm.test_scoring_operators import brute_marginals, labelled

    rows = labelled(160)
    texts, kinds = [t for _, t, _ in rows], np.array([k for _, _, k in rows])
    want = brute_types(texts, kinds)
    assert len(want) == 4
    docs = [toxicity.token_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    # Gradient ascent by plain loops.
    types = {h: n for n, h in enumerate(sorted({h for d in docs for h in d.tolist()}))}
    seqs = [np.array([types[h] for h in d.tolist()]) for d in docs]
    label = [np.array([float(k and h in want) for h in d.tolist()]) for d, k in zip(docs, kinds)]
    count = np.bincount(np.concatenate(seqs), minlength=len(types))
    own, near, chain = np.full(len(types), -4.0), np.zeros(len(types)), np.zeros((2, 2))
    n_pairs = sum(len(s) - 1 for s in seqs)

    def energy(s):
        e = own[s].copy()
        e[1:] += near[s[:-1]]
        e[:-1] += near[s[1:]]
        return e

    for _ in range(20):
        g_own, g_near, g_chain = np.zeros(len(types)), np.zeros(len(types)), np.zeros((2, 2))
        for s, y in zip(seqs, label):
            p = brute_marginals(energy(s), chain)
            miss = y - p
            np.add.at(g_own, s, miss)
            np.add.at(g_near, s[:-1], miss[1:])
            np.add.at(g_near, s[1:], miss[:-1])
            for i in (0, 1):
                for j in (0, 1):
                    of = lambda x, k: x if k else 1 - x
                    g_chain[i, j] += (of(y[:-1], i) * of(y[1:], j) - of(p[:-1], i) * of(p[1:], j)).sum()
        own, near = np.clip(own + 4 * g_own / np.sqrt(count), -8, 8), np.clip(near + 0.1 * g_near / count, -1, 1)
        chain = np.clip(chain + g_chain / n_pairs, -2, 2)
    model = toxicity.train(texts, kinds)
    place = {int(h): k for k, h in enumerate(model.keys.tolist()) if k}
    kept = {h for h, n in types.items() if own[n] > -3}
    assert set(place) == kept and want <= kept
    assert all(abs(model.own[place[h]] - own[types[h]]) < 1e-6 and abs(model.near[place[h]] - near[types[h]]) < 1e-6 for h in kept)
    assert np.allclose(model.chain, chain)
    # The score: the most toxic word's log-odds through the curve.
    a, b = model.curve
    rest = np.array([n for h, n in types.items() if h not in kept])
    common = np.average(own[rest], weights=count[rest])
    for t, d in list(zip(texts, docs))[:40]:
        weights = np.array([own[types[h]] if h in kept else common for h in d.tolist()])
        around = np.array([near[types[h]] if h in kept else 0.0 for h in d.tolist()])
        e = weights + np.append(0, around[:-1]) + np.append(around[1:], 0)
        p = brute_marginals(e, chain).max()
        x = np.clip(np.log(max(p, 1e-9) / max(1 - p, 1e-9)), -10, 10)
        import pyarrow as pa

        got = next(iter(toxicity._scored(model, pa.array([t]))))[0][0]
        assert abs(got - 1 / (1 + np.exp(-(a * x + b)))) < 1e-6


def test_bounded_samples_by_digest(spark):
    from pyspark.sql import functions as F

    from quarrywork.llm.sampling import among_first

    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    every = sorted((r.h % (1 << 64), r.id) for r in rows.collect())
    for most in (0, 1, 7, 150, 5000, 20_000, 30_000):
        got = {r.id for r in rows.where(among_first(rows, F.col("h"), most)).collect()}
        assert 0.9 * min(most, 20_000) <= len(got) <= most and got == {i for _, i in every[: len(got)]}
    same = spark.range(100).select("id", F.lit(5).cast("long").alias("h"))
    assert same.where(among_first(same, F.col("h"), 10)).count() == 0
