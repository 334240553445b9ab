"""The pipeline against its stages in plain Python, on planted documents."""

import collections

import numpy as np

import corpus_pipeline
from quarrywork.llm import mixing, toxicity
from tests.llm.brute import near_components
from tests.llm.test_scoring_operators import labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def planted(spark, folder):
    rng = np.random.default_rng(9)
    toxic = labelled(160)
    rows = [(i, t) for i, t, _ in toxic]
    words = [f"u{k}" for k in range(2000)]
    for k in range(30):
        base = list(rng.choice(words, 80))
        rows.append((1000 + 3 * k, " ".join(base)))
        rows.append((1001 + 3 * k, "  ".join(base)))
        rows.append((1002 + 3 * k, " ".join(base[:-2] + ["end", "now"])))
    rows += [(2000, None), (2001, ""), (2002, "short text")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or ""), True) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, k) for i, _, k in toxic], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(rows), {i for i, _, k in toxic if k}


def test_pipeline(spark, tmp_path):
    texts, toxic = planted(spark, tmp_path)
    folder = str(tmp_path)
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, docs, folder)
        if name != "packing":
            assert nxt.columns == docs.columns
        nxt.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = [r.doc_id for r in docs.collect()]
    clean = {i for i in texts if i not in toxic}
    assert sorted(out["toxicity"]) == sorted(clean)
    groups = collections.defaultdict(list)
    for i in clean:
        groups["".join((texts[i] or "").split())].append(i)
    single = {min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values()}
    assert sorted(out["exact_dedup"]) == sorted(single)
    _, component = near_components([(i, texts[i]) for i in single])
    unique = {i for i in single if component[i] == i}
    assert sorted(out["near_dedup"]) == sorted(unique)
    plan = mixing.plan(spark.read.parquet(f"{folder}/near_dedup.parquet")).collect()
    assert collections.Counter(out["mixing"]) == collections.Counter({r.doc_id: r.copies for r in plan if r.copies})
    pieces = spark.read.parquet(f"{folder}/packing.parquet").collect()
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(out["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_toxicity_of_planted_documents(spark, tmp_path):
    texts, toxic = planted(spark, tmp_path)
    got = toxicity.judge(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert {r.doc_id for r in got if r.predicted} == toxic
