"""Accept-mode dedup where rows hang together in long chains: right, and in few rounds."""

import random

import pytest

from quarrywork.operators import dedup as D

SCHEMA = "ord long, url string, title string, content string"
KEYS = ["url", "title", "content"]


def loop(rows):
    marked, out = set(), []
    for row in sorted(rows):
        own = {(i, k) for i, k in enumerate(row[1:]) if k is not None}
        if not own & marked:
            marked |= own
            out.append(row[0])
    return out


def chain(n, first=0, name=""):
    """Each row shares its URL with one neighbour and its title with the other."""
    return [(first + i, f"{name}u{i // 2}", f"{name}t{(i + 1) // 2}", None) for i in range(n)]


def run(spark, rows, monkeypatch, few):
    rounds, decided = [], D._decided
    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(D, "_decided", lambda *a, **k: rounds.append(1) or decided(*a, **k))
    got = D.accepted(spark.createDataFrame(random.Random(0).sample(rows, len(rows)), SCHEMA), KEYS, "ord")
    return sorted(r.ord for r in got.select("ord").collect()), len(rounds)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = chain(6000)
    got, rounds = run(spark, rows, monkeypatch, few=0)
    assert got == loop(rows) == list(range(0, 6000, 2)) and rounds <= 3


@pytest.mark.parametrize("seed", range(3))
def test_chains_with_branches_equal_the_loop(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [r for c in range(6) for r in chain(rng.randrange(1, 60), 1000 * c, f"c{c}-")]
    rows = [(o, u, t, rng.choice([None, None, None, f"x{rng.randrange(12)}"])) for o, u, t, _ in rows]  # ties between chains
    rows += [(10_000 + k, None, None, None) for k in range(3)] + [(20_000 + k, "hot", None, None) for k in range(40)]
    got, _ = run(spark, rows, monkeypatch, few=0)
    assert got == loop(rows)


@pytest.mark.parametrize("spread", [8, 40, 150])
def test_random_keys_equal_the_loop(spark, monkeypatch, spread):
    rng = random.Random(spread)
    rows = [(k, *(rng.choice([None, f"{rng.randrange(spread)}"]) for _ in KEYS)) for k in range(120)]
    got, _ = run(spark, rows, monkeypatch, few=0)
    assert got == loop(rows)
