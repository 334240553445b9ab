"""Near-dedup of crowds that branching cannot part: texts that share most words, yet are no near copies."""

import random

from quarrywork.llm import chosen_path as C

from .brute import near_components


def crowd(n, planted, seed=5):
    """Texts of 205 common words and 40 of their own (similarity near 0.71), and ``planted`` near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [word() for _ in range(205)]
    own = [[word() for _ in range(40)] for _ in range(n)]
    rows = [(k, " ".join(common + w)) for k, w in enumerate(own)]
    for k in range(planted):  # half of the own words of another
        w = own[rng.randrange(n)]
        rows.append((n + k, " ".join(common + w[:20] + [word() for _ in range(20)])))
    return rows


def test_candidates_of_a_crowd_grow_with_its_documents(spark, monkeypatch):
    """Blocks confirm on the spot, so only small nodes leave pairs to be confirmed with both texts."""
    met, confirm, meet, share = [], C._confirm, C._met, []
    monkeypatch.setattr(C, "BLOCK", 40)
    monkeypatch.setattr(C, "_met", lambda rows: met.append(1) or meet(rows))
    for n, rest in ((150, 256), (450, 3)):
        rows, asked = crowd(n, 12), []
        sets, want = near_components(rows)
        monkeypatch.setattr(C, "REST", rest)
        monkeypatch.setattr(C, "_confirm", lambda tables, label, texts, pairs: asked.append(pairs.count()) or confirm(tables, label, texts, pairs))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in C.annotate(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}
        assert len(set(want.values())) < len(rows)  # some are linked
        share.append(sum(asked) / len(rows))
    assert met and share[1] <= 1.5 * share[0], share


def hanging(n, others, seed=7):
    """Near copies of one text (1 word of 150 changed) and ``others`` too far from it (8 changed), some near each other."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(150)]

    def changed(text, places):
        text = list(text)
        for at in places:
            text[at] = word()
        return text

    rows = [changed(base, [rng.randrange(150)]) for _ in range(n)]
    far = [changed(base, rng.sample(range(0, 150, 5), 8)) for _ in range(others)]
    rows += far + [changed(w, [75]) for w in far[: others // 10]]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_others_meet_a_crowd_once(spark, monkeypatch):
    """Documents that share nodes with a crowd of near copies: its documents are not repeated in children and blocks."""
    made, table = [], C.Scratch.table

    def counted(self, label, rows):
        out = table(self, label, rows)
        if label.startswith("level-") and label != "level-0" or label == "blocks-ranked":
            made.append(out.count())
        return out

    monkeypatch.setattr(C.Scratch, "table", counted)
    monkeypatch.setattr(C, "REST", 40)
    rows = hanging(400, 100)
    sets, want = near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in C.annotate(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}
    assert 50 < len(set(want.values())) < 110  # most others are alone
    assert sum(made) <= 2 * len(rows), made
