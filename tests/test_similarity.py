import random

import pytest

from segue.functions import similarity as sim


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_of_any_length():
    rng = random.Random(1)
    sizes = [0, 1, 5, 62, 63, 64, 65, 130, 200]
    left, right = (
        ["".join(rng.choice("abé \U0001f600"[: rng.randint(1, 5)]) for _ in range(rng.choice(sizes))) for _ in range(800)]
        for _ in range(2)
    )
    assert list(sim.lcs_lengths(left, right)) == [plain_lcs(a, b) for a, b in zip(left, right)]


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("", "", 0.0),
        ("", "a", 0.0),
        ("a b", "b a", 100.0),
        ("a b c", "a b c d", 100.0),
        ("a a b", "b a", 100.0),
        ("abc", "abd", 100 * (1 - 2 / 6)),
        # common "x", rest "ab" and "cd": sides "x ab", "x cd"
        ("x ab", "x cd", max(100 * (1 - 4 / 8), 100 * (1 - 3 / 5))),
    ],
)
def test_ratio_contract(a, b, expected):
    assert sim.token_set_ratios([a], [b])[0] == pytest.approx(expected)
    assert sim.token_set_ratios([b], [a])[0] == pytest.approx(expected)


def test_ratio_range():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    sides = [[" ".join(rng.sample(words, rng.randint(0, 6))) for _ in range(500)] for _ in range(2)]
    forth, back = sim.token_set_ratios(*sides), sim.token_set_ratios(*sides[::-1])
    assert ((forth >= 0) & (forth <= 100)).all()
    assert forth == pytest.approx(back)


def test_sides_too_unlike_in_length_are_not_compared(monkeypatch):
    """Where lengths alone leave the common words ahead, the others' order is not looked at."""
    compared = []
    plain = sim.lcs_lengths
    monkeypatch.setattr(sim, "lcs_lengths", lambda a, b: compared.extend(zip(a, b)) or plain(a, b))
    long = " ".join(f"word{i:03d}" for i in range(100))
    got = sim.token_set_ratios([long, "abc abd", "x ab"], ["word007 other", "abc abe", "y cd"])
    assert compared == [("abd", "abe"), ("ab x", "cd y")]
    # common 7, others 792 and 5: sides of 800 and 13
    assert got[0] == pytest.approx(100 * (1 - 6 / 20))
    assert got[1] == pytest.approx(100 * (1 - 2 / 14))
