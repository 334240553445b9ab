import math

import numpy as np
import pyarrow as pa
import pytest

from quarrywork.llm import license_scan, lm_score, toxicity, url_filter
from tests.llm.brute import EDGE_TEXTS

TOXIC = ["idiot", "moron", "scum", "clown"]


def labelled(n=400, seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text = list(rng.choice(vocabulary, 40))
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(TOXIC)))
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def brute_marginals(energy, chain):
    n = len(energy)
    e = np.stack([np.zeros(n), energy], axis=1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for i in range(1, n):
        a[i] = e[i] + np.logaddexp(a[i - 1, 0] + chain[0], a[i - 1, 1] + chain[1])
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp(chain[:, 0] + e[i + 1, 0] + b[i + 1, 0], chain[:, 1] + e[i + 1, 1] + b[i + 1, 1])
    return np.exp((a + b)[:, 1] - np.logaddexp((a + b)[:, 0], (a + b)[:, 1]))


def test_marginals_equal_forward_backward():
    rng = np.random.default_rng(1)
    before = np.array([0, 0, 3, 3, 100, 101, 300])
    energy, chain = rng.normal(size=300) * 3, rng.normal(size=(2, 2))
    want = np.concatenate([brute_marginals(energy[i:j], chain) for i, j in zip(before, before[1:]) if j > i])
    assert np.allclose(toxicity.marginals(energy, chain, before), want)


def test_toxicity(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows] + [(None, "an idiot", "mine"), (900, None, "mine"), (901, "", "mine")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(None, 1), (900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    assert all(r.held_out == (i is not None and __import__("zlib").crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(got[i].predicted == k for i, _, k in rows)
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(1 - k for _, _, k in rows) + 2
    found = toxicity.spans(docs, toxicity.fit(docs, labels)).collect()
    text = {i: t for i, t, _ in rows} | {None: "an idiot"}
    assert {text[r.doc_id].encode()[r.start : r.end].decode() for r in found} == set(TOXIC)


def test_toxic_types_that_share_a_slot():
    keys = np.array([0, 7 << 44, (7 << 44) + 1, (5 << 44) + 9], np.uint64)
    model = toxicity.Model(keys, np.zeros(4), np.zeros(4), np.zeros((2, 2)), (1.0, 0.0))
    assert model.types(np.array([7 << 44, (7 << 44) + 1, (7 << 44) + 2, (5 << 44) + 9, 3, 0], np.uint64)).tolist() == [1, 2, 0, 3, 0, 0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.judge(docs, labels).collect()] == [0]
    assert toxicity.judge(docs.where("false"), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in got if r.toxic == 1) >= 0.6 * sum(r.toxic for r in got)


URLS = [None, "", "no scheme", "http://x.com", "HTTP://A.EXAMPLE.COM/en/1?q#f", "https://www.example.com/en/2", "http://b.www.example.com/en/", "http://example.net/es/1",
        "http://anet/es/1", "http://x.net/fr/#/es/", "a://b://c/d", "http://example.org/de/?x=/en/", "http://x.com?a/b", "http://Example.Com/EN/"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:k].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[k:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, ok) for ok, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://q.org/a"), (1, "")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    model = url_filter.fit(pages)
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_url(next(u for i, u in rows if i == r.page_id))
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        if rule:
            assert r.verdict == ("allow" if rule[1] else "block")
    assert url_filter.judge(pages.where("false"), model).count() == 0


def test_url_model_is_a_distribution_and_separates():
    good, bad = [f"http://a{k}.com/en/{k}" for k in range(200)], [f"http://b{k}.net/es/{k}" for k in range(200)]
    model = url_filter.UrlModel(good, bad)
    for context in ("", "h", "http:", "zzzzz", "//a1."):
        known = {c for own in model.good.known.values() for c in own}
        assert sum(model.good.probability(context, c) for c in known) <= 1 + 1e-9
    assert model.score("http://a999.com/en/7") >= model.limit > model.score("http://b999.net/es/7")
    assert url_filter.UrlModel([], []).limit == -math.inf


class BruteMarkov:
    """Witten-Bell by its definition, over dicts."""

    def __init__(self, urls, order=url_filter.ORDER):
        self.order, self.counts = order, {}
        for url in urls:
            data = bytes([2] * order) + url.encode() + bytes([3])
            for i in range(order, len(data)):
                for k in range(order + 1):
                    own = self.counts.setdefault(data[i - k : i], {})
                    own[data[i]] = own.get(data[i], 0) + 1

    def probability(self, context, c):
        below = self.probability(context[1:], c) if context else 1 / 256
        own = self.counts.get(context)
        return below if own is None else (own.get(c, 0) + len(own) * below) / (sum(own.values()) + len(own))

    def log_likelihood(self, url):
        data = bytes([2] * self.order) + url.encode() + bytes([3])
        return sum(math.log(self.probability(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


def test_url_scores_equal_brute_force():
    rng = np.random.default_rng(5)
    urls = ["http://" + "".join(rng.choice(list("ab./é漢-"), int(rng.integers(0, 30)))) for _ in range(120)]
    for train in (urls[:80], urls[:1], []):
        fast, slow = url_filter.MarkovModel(train), BruteMarkov(train)
        for url in [*urls[70:], "", "http://zz?\x02\x03", "q" * 300]:
            assert fast.log_likelihood([url])[0] == pytest.approx(slow.log_likelihood(url), rel=1e-9)
    assert np.allclose(url_filter.MarkovModel(urls).log_likelihood(pa.array([urls[3], None, "", urls[9]])), [BruteMarkov(urls).log_likelihood(u) for u in (urls[3], "", "", urls[9])])


def test_url_verdicts_equal_brute_force(spark, sf):
    """The query: rules, models, calibration and verdicts of all pages, by plain loops."""
    from quarrywork.llm.queries import op9_url_filter

    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    training = {True: set(), False: set()}
    for r in rows:
        fit = brute_url(r.url)[2]
        if fit:
            training[fit[1]].add(r.url)
    from pyspark.sql import functions as F

    order = {r.url: r.h for r in spark.createDataFrame([(u,) for kind in training.values() for u in kind], "url string").select("url", F.xxhash64("url").alias("h")).collect()}
    good, bad = (sorted(training[kind], key=lambda u: (order[u], u)) for kind in (True, False))
    models = [BruteMarkov([u for k, u in enumerate(kind) if k % 5]) for kind in (good, bad)]
    score = lambda u: (models[0].log_likelihood(u) - models[1].log_likelihood(u)) / max(1, len(u.encode())) if u else 0.0
    a, b = [score(u) for u in good[::5]], [score(u) for u in bad[::5]]
    gap = lambda x: abs(sum(y < x for y in a) / len(a) - sum(y >= x for y in b) / len(b))
    limit = min(sorted(set(a + b)), key=gap)
    got = {r.page_id: r for r in op9_url_filter(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        fit = brute_url(r.url)[2]
        assert got[r.page_id].score == pytest.approx(score(r.url or ""), abs=1e-9)
        assert got[r.page_id].verdict == ("allow" if (fit[1] if fit else score(r.url or "") >= limit - 1e-12) else "block")


def test_url_models_count_all_urls(spark, monkeypatch):
    """Also beyond 20,000 labelled URLs a class, and long ones; with bounded tables, commoner contexts stay."""
    from pyspark.sql import functions as F

    urls = [f"http://a.com/en/{k * 7919 % 100003}" for k in range(26_000)] + [f"http://b.net/es/{k}?" for k in range(300)] + ["http://c.com/" + "z" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.fit(pages)
    order = {r.url: r.h for r in pages.select("url", F.xxhash64("url").alias("h")).collect()}
    known = [sorted((u for u in urls if brute_url(u)[2][1] == kind), key=lambda u: (order[u], u)) for kind in (True, False)]
    want = url_filter.UrlModel(*known)
    assert np.allclose(model.scores(urls[::97]), want.scores(urls[::97])) and model.limit == pytest.approx(want.limit)
    monkeypatch.setattr(url_filter, "SCORES", 50)
    monkeypatch.setattr(url_filter, "CELLS", 8)
    assert url_filter.fit(pages).limit == pytest.approx(want.limit)
    monkeypatch.setattr(url_filter, "EVENTS", 600)
    small = url_filter.fit(pages)
    assert all(len(e.keys) - 1 <= 600 for e in small.good.events)
    known = {c for own in small.good.known.values() for c in own}
    for context in ("", "h", "http:", "zzzzz", "en/12"):
        assert sum(small.good.probability(context, c) for c in known) <= 1 + 1e-9
    assert small.score("http://a.com/en/7") > small.score("http://b.net/es/7?")


def test_url_scores_count_rare_contexts_beyond_the_broadcast_tables(spark, monkeypatch):
    """With tables of 600 rows every score, the limit and the verdicts are those of all counts."""
    urls = [f"http://a.com/en/{k * 7919 % 100003}" for k in range(4000)] + [f"http://b.net/es/{k}?" for k in range(900)] + ["http://c.com/" + "z" * 3000, "http://é漢.org/q"]
    rows = list(enumerate([*urls, *(f"http://{k}.org/{k * 31}" for k in range(300)), None, "", "no url", urls[5], "http://a.com/en/77777"]))
    pages = spark.createDataFrame([(i, u, 0.5) for i, u in rows], "page_id long, url string, __qw_url double")
    whole = url_filter.fit(pages)
    assert whole.counts is None
    want = {r.page_id: r for r in url_filter.judge(pages, whole).collect()}
    monkeypatch.setattr(url_filter, "EVENTS", 600)
    small = url_filter.fit(pages)
    assert small.limit == pytest.approx(whole.limit, abs=1e-9) and all(len(e.keys) - 1 <= 600 for e in small.good.events)
    got = {r.page_id: r for r in url_filter.judge(pages, small).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.score == pytest.approx(want[i].score, abs=1e-9)
        assert r.verdict == want[i].verdict or abs(r.score - small.limit) < 1e-9
    left = url_filter.accepted(pages, small)
    assert left.columns == pages.columns
    assert sorted(r.page_id for r in left.collect()) == sorted(i for i, r in got.items() if r.verdict == "allow")


def test_accepted_urls_keep_their_columns(spark):
    rows = list(enumerate(URLS)) + [(99, "http://x.org/" + "long/" * 20_000)]
    pages = spark.createDataFrame([(i, u, 0.5, "x") for i, u in rows], "page_id long, url string, __qw_score double, host string")
    model = url_filter.fit(pages)
    left = url_filter.accepted(pages, model)
    assert left.columns == pages.columns
    verdict = {r.page_id: r.verdict for r in url_filter.judge(pages, model).collect()}
    assert sorted(r.page_id for r in left.collect()) == sorted(i for i, v in verdict.items() if v == "allow") and len(verdict) == len(rows)


def test_license_scan(spark):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT")
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\n" + mit.upper().replace("LICENSE", "LICENCE")), (3, "text\nReleased under the MIT Licence\nmore"), (4, mit + " and more"), (5, None), (6, ""),
            (None, "Licensed under the Apache License, version 2.0"), (7, "x\nreleased under the MIT license!\nLicensed under the Apache License, Version 2.0."), (1, mit), (8, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license, r.notices) for r in license_scan.scan(docs).collect()}
    assert {(1, "MIT", ""), (2, "MIT", ""), (3, None, "MIT"), (5, None, ""), (6, None, ""), (None, "Apache-2.0", "Apache-2.0"), (7, None, "Apache-2.0,MIT"), (8, None, "")} <= got
    assert (4, None, "") in got and license_scan.scan(docs).count() == len(rows)
    assert sorted(r.doc_id or 0 for r in license_scan.unlicensed(docs).collect()) == [3, 4, 5, 6, 7, 8]
    assert license_scan.scan(docs.where("false")).count() == 0


def test_license_catalogue_is_whole(spark):
    """Every notice line of the tables, and whole texts with and without their titles."""
    from quarrywork.llm.license_texts import TEXTS

    for size in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").where("text rlike '(?i)licen[sc]e[ds]? under|spdx-'")
        assert docs.count() > 0 and license_scan.scan(docs).where("notices = ''").count() == 0
    mit, isc = (next(t for n, t in license_scan.KNOWN if n == name) for name in ("MIT", "ISC"))
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit), ("ISC", "ISC License\n\nCopyright (c) 2020, Somebody\n\n" + isc), *TEXTS.items()]
    rows += [("Apache-2.0", TEXTS["Apache-2.0"].split("http://www.apache.org/licenses/\n", 1)[1]), ("GPL-3.0", TEXTS["GPL-3.0"].split("29 June 2007\n", 1)[1])]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == dict(enumerate(n for n, _ in rows))
    lines = [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("LGPL-2.1-or-later", "// SPDX-License-Identifier: LGPL-2.1-or-later"), ("BSD-3-Clause", "Distributed under the BSD 3-Clause License"),
             ("MPL-2.0", "This project is licensed under the Mozilla Public License 2.0"), ("CC-BY-SA-3.0", "Released under Creative Commons Attribution-ShareAlike 3.0 Unported License")]
    got = license_scan.scan(spark.createDataFrame(list(enumerate("a\n" + t for _, t in lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.notices for r in got} == dict(enumerate(n for n, _ in lines))


def test_license_paragraphs_inside_other_texts(spark):
    """Parts of licences between other text, behind comment marks, in DuckDB's reading as in ours."""
    import duckdb

    from quarrywork.llm.license_texts import TEXTS
    from quarrywork.llm.queries import ORACLE_SQL

    assert len(license_scan.PARTS) > 100
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT").split("\n")[0]
    words = mit.split(" ")
    comment = "/*\n" + "\n".join(" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n */"
    apache = next(t for n, t in license_scan.PARTS if n == "Apache-2.0" and "\n" in t.strip())
    rows = [(1, "int main();\n\n" + comment + "\n\nreturn 0;"), (2, "text\n \n" + apache + "\n\nmore text"), (3, comment), (4, "a\n\n" + comment + " and more\n\nb"), (5, None), (6, "a\n\nb\nc"), (7, TEXTS["Apache-2.0"]), (8, mit), (9, "readme\n\n" + mit + "\n\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.notices for r in license_scan.scan(docs).collect()}
    assert got[1] == "MIT" and got[2] == "Apache-2.0" and got[3] == got[4] == got[5] == got[6] == "" and "Apache-2.0" in got[7] and got[8] == "" and got[9] == "MIT"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: (r[2], r[3]) for r in con.execute(ORACLE_SQL["op6_license_scan"]).fetchall()} == {r.doc_id: (r.license, r.notices) for r in license_scan.scan(docs).collect()}


def hashes_of(words):
    return np.array([lm_score.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in words], np.uint64)


def brute_log_probability(net, around, target):
    """By the definition: one position, plain softmaxes over classes and over the class's outputs."""
    hidden = np.tanh(sum(net.embed[c].astype(float) * net.place[k] for k, c in enumerate(around)) + net.bias)
    upper = net.upper.astype(float) @ hidden + net.upper_bias
    kind = target // lm_score.PER_CLASS
    own = slice(kind * lm_score.PER_CLASS, (kind + 1) * lm_score.PER_CLASS)
    lower = net.lower[own].astype(float) @ hidden + net.lower_bias[own]
    return upper[kind] - np.log(np.exp(upper).sum()) + lower[target - own.start] - np.log(np.exp(lower).sum())


def test_lm_scores_equal_brute_force(spark):
    """Every word of every text, predicted from its window by the definition, with the fitted parameters."""
    texts = [t for _, t in EDGE_TEXTS if t is None or len(t) < 1000] + [t for _, t, _ in labelled(60)] + ["", "one"]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, log_likelihood double")
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    assert len(got) == len(texts)
    tables = lm_score.Scratch(spark, "test")
    only = docs.selectExpr("coalesce(text, '') AS text")
    vocab = lm_score.vocabulary(tables, only)
    assert vocab.whole.sum() == sum(r.n_words for r in got.values())
    net = lm_score.fit(tables, only, vocab)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for k, text in enumerate(texts):
        h = hashes_of((text or "").encode().translate(lower).split())
        output, within, rare = vocab.look_up(h)
        assert not rare.any()
        padded = [lm_score.EDGE] * lm_score.WINDOW + output.tolist() + [lm_score.EDGE] * lm_score.WINDOW
        want = 0.0
        for i in range(len(h)):
            window = padded[i : i + 2 * lm_score.WINDOW + 1]
            want += brute_log_probability(net, window[: lm_score.WINDOW] + window[lm_score.WINDOW + 1 :], window[lm_score.WINDOW]) + within[i]
        assert got[k].n_words == len(h) and got[k].log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-3)
        assert got[k].mean_log_likelihood == (None if not len(h) else pytest.approx(want / len(h), rel=1e-4, abs=1e-3))
    assert lm_score.score(docs.where("false")).count() == 0


def test_lm_probabilities_sum_to_one():
    net = lm_score.Network.start(np.arange(lm_score.OUTPUTS) % 7)
    net.lower[:] = np.random.default_rng(1).normal(size=net.lower.shape)
    context = np.repeat([[1, 2, lm_score.EDGE, 77, 4095, 5]], lm_score.OUTPUTS, axis=0)
    p = np.exp(net.log_probability(context, np.arange(lm_score.OUTPUTS)))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_lm_gradients_equal_differences():
    """A step's gradients against finite differences of the mean log-probability."""
    rng = np.random.default_rng(2)
    net = lm_score.Network.start(rng.integers(1, 50, lm_score.OUTPUTS).astype(float))
    for part in (net.upper, net.lower, net.bias):
        part += rng.normal(size=part.shape).astype(np.float32) * 0.2
    batch = rng.integers(0, 200, (64, 1 + 2 * lm_score.WINDOW))
    batch[:, 0] = rng.integers(0, lm_score.OUTPUTS, 64)
    batch[:5, 3] = lm_score.EDGE
    seen = []

    class Rule:
        def __init__(self, part):
            self.got = np.zeros(part.shape)
            seen.append(self)

        def step(self, gradient, at=slice(None)):
            self.got[at] += gradient

    lm_score._step(net, [Rule(p) for p in net.parts()], batch)
    loss = lambda: -8 * float(net.log_probability(batch[:, 1:], batch[:, 0]).mean())
    for part, rule in zip(net.parts(), seen):
        for at in [np.unravel_index(int(np.abs(rule.got).argmax()), part.shape), tuple(int(x) for x in np.argwhere(rule.got)[0])]:
            old = part[at]
            part[at] = old + 1e-2
            up = loss()
            part[at] = old - 1e-2
            down = loss()
            part[at] = old
            assert (up - down) / 2e-2 == pytest.approx(rule.got[at], rel=2e-2, abs=2e-4)


def test_lm_beats_unigrams_and_one_neighbour_on_held_out_text(spark):
    """Trained on four fifths of sf0.01, measured on the rest: mean log-probability of the words' outputs
    against the unigram's and against a table of (left neighbour, word) interpolated with the unigram."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    tables = lm_score.Scratch(spark, "test")
    fit = docs.where("doc_id % 5 <> 0").select("text")
    vocab = lm_score.vocabulary(tables, fit)
    net = lm_score.fit(tables, fit, vocab)
    seen = set(r.text for r in fit.collect())
    held = [r.text for r in docs.where("doc_id % 5 = 0").collect() if r.text not in seen]

    def outputs(texts):
        for _, _, raw, offsets in lm_score.slices(pa.array(texts)):
            h, _, _, before = lm_score.words(raw, offsets)
            yield vocab.look_up(h)[0], before

    share = (vocab.whole + 0.5) / (vocab.whole + 0.5).sum()
    left, pairs = np.zeros(lm_score.OUTPUTS + 1), {}
    for output, before in outputs(sorted(seen)):
        around = lm_score.contexts(output, before, np.arange(len(output)))[:, lm_score.WINDOW - 1]
        np.add.at(left, around, 1)
        for key, n in zip(*np.unique(around * lm_score.OUTPUTS + output, return_counts=True)):
            pairs[key] = pairs.get(key, 0) + n
    network, unigram, neighbour, n = 0.0, 0.0, 0.0, 0
    for output, before in outputs(held):
        context = lm_score.contexts(output, before, np.arange(len(output)))
        network += net.log_probability(context, output).sum()
        unigram += np.log(share[output]).sum()
        around = context[:, lm_score.WINDOW - 1]
        both = np.array([pairs.get(k, 0) for k in (around * lm_score.OUTPUTS + output).tolist()])
        neighbour += np.log((both + 20 * share[output]) / (left[around] + 20)).sum()
        n += len(output)
    assert network / n > unigram / n + 0.15 and network / n > neighbour / n
    plain = list(outputs(held))
    rng = np.random.default_rng(0)
    shuffled = list(outputs([" ".join(rng.permutation(t.split())) for t in held]))
    total = lambda runs: sum(net.log_probability(lm_score.contexts(o, b, np.arange(len(o))), o).sum() for o, b in runs)
    assert total(plain) > total(shuffled)


def test_lm_scores_words_beyond_the_kept_ones(spark, monkeypatch):
    """Each word has its own count where fewer words are broadcast than the corpus has."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 200) % 9000) for _ in range(60)] + [" ".join(f"w{k}" for k in range(9000)), "seldom", "seldom once", None, "seldom  seldom"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {r.doc_id: r for r in lm_score.score(docs).collect()}
    monkeypatch.setattr(lm_score, "KEPT", lm_score.OWN + 10)
    got = lm_score.score(docs).collect()
    assert len(got) == len(texts) and all(r.n_words == every[r.doc_id].n_words for r in got)
    assert all(r.log_likelihood == pytest.approx(every[r.doc_id].log_likelihood, rel=1e-6, abs=1e-6) for r in got)


def test_lm_averages_trainers(spark, monkeypatch):
    """Many trainers: the average of their parameters by windows, from parameters that no trainer moved far."""
    monkeypatch.setattr(lm_score, "SHARE", 40)
    docs = spark.createDataFrame([(k, t) for k, t, _ in labelled(200)], "doc_id long, text string").repartition(3)
    got = lm_score.score(docs).collect()
    assert len(got) == 200 and all(-14 * r.n_words < r.log_likelihood < 0 for r in got)
