"""Functions of slices against plain replays."""

from __future__ import annotations

import random

import pytest

from stockroom.plans.transfer import IN, OUT, SET, Bounds, Transfer, exit_of


def replay(balance, moves):
    for kind, qty in moves:
        if kind == SET:
            balance = qty
        elif kind == IN:
            balance += qty
        elif balance >= qty:
            balance -= qty
    return balance


def moves_of(rng, count, most, sets):
    kinds = [IN] + [OUT] * 3 + [SET] * sets
    return [(k, rng.randint(-2 if k == SET else 1, most)) for k in (rng.choice(kinds) for _ in range(count))]


@pytest.mark.parametrize("seed", range(12))
def test_every_entry_has_its_exit(seed):
    rng = random.Random(seed)
    moves = moves_of(rng, rng.randint(0, 120), rng.choice([3, 9, 1000]), int(seed % 4 == 0))
    low, high = rng.choice([(0, 0), (0, 60), (-5, 200), (40, 3000)])
    made = Transfer(low, high)
    for move in moves:
        made.add(*move)
    pieces = made.pieces()
    assert len(pieces[0]) <= high - low + 1
    assert [exit_of(b, *pieces) for b in range(low, high + 1)] == [replay(b, moves) for b in range(low, high + 1)]
    exits = {replay(b, moves) for b in range(low, high + 1)}
    assert not made.settled or len(exits) == 1


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold(seed):
    rng = random.Random(100 + seed)
    moves = moves_of(rng, 60, 20, int(seed % 3 == 0))
    floor = min([0] + [q for k, q in moves if k == SET] + [-3])
    held = Bounds(floor)
    for move in moves:
        held.add(*move)
    for balance in range(-3, 200):
        assert Bounds.after(held.low, balance) <= replay(balance, moves) <= Bounds.after(held.high, balance)


def test_wide_ranges_stay_few_pieces():
    rng = random.Random(1)
    made = Transfer(0, 10 ** 9)
    for move in moves_of(rng, 2000, 50, 0):
        made.add(*move)
    start, value, grows = made.pieces()
    assert len(start) < 60_000 and grows[-1]
