"""The field's sums and best paths against all tag paths, and each length's pack against placing one piece at a time."""

import itertools

import numpy as np
import pytest

from meshtide.llm import packing, pii


def random_field(seed):
    field = pii.Field([])
    rng = np.random.default_rng(seed)
    field.move = rng.normal(0, 2, field.move.shape)
    return field, rng


def path_scores(field, scores):
    """Every allowed tag path of one chain and its score."""
    n = len(field.tags)
    out = {}
    for path in itertools.product(range(n), repeat=len(scores)):
        if field.tags[path[0]][0] == "I" or any(field.ban[a, b] for a, b in itertools.pairwise(path)):
            continue
        out[path] = sum(scores[k, t] for k, t in enumerate(path)) + sum(field.move[a, b] for a, b in itertools.pairwise(path))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_against_all_paths(seed):
    field, rng = random_field(seed)
    chains = [rng.normal(0, 3, (n, len(field.tags))) for n in (1, 4, 2, 3, 4, 1)]
    for chain, got in zip(chains, field.decode(chains), strict=True):
        every = path_scores(field, chain)
        assert tuple(got) == max(every, key=every.get)
    assert field.decode([]) == []


@pytest.mark.parametrize("seed", range(3))
def test_expectations_against_all_paths(seed):
    """Tag probabilities and expected moves of padded rows of several lengths, with a word that can only be outside."""
    field, rng = random_field(seed)
    n, sizes = len(field.tags), (4, 2, 3)
    score = rng.normal(0, 2, (len(sizes), max(sizes), n))
    live = np.arange(max(sizes))[None] < np.array(sizes)[:, None]
    free = live.copy()
    free[2, 1] = False
    p, pairs = field.expected(score.copy(), free, live)
    want_pairs = np.zeros((n, n))
    for r, size in enumerate(sizes):
        chain = score[r, :size].copy()
        chain[~free[r, :size]] = [0.0] + [-np.inf] * (n - 1)
        every = path_scores(field, chain)
        top = max(every.values())
        weight = {path: np.exp(s - top) for path, s in every.items()}
        total, want = sum(weight.values()), np.zeros((size, n))
        for path, w in weight.items():
            for k, t in enumerate(path):
                want[k, t] += w / total
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += w / total
        assert np.allclose(p[r, :size], want, atol=1e-9) and not p[r, size:].any()
    assert np.allclose(pairs, want_pairs, atol=1e-9)


@pytest.mark.parametrize("seed", range(40))
def test_every_length_goes_to_the_emptiest_pack(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 40))
    histogram = {int(x): int(rng.integers(1, 30)) for x in rng.choice(np.arange(1, capacity + 1), rng.integers(1, capacity), replace=False)}
    used = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = min(range(len(used)), key=used.__getitem__, default=None)
            if k is not None and used[k] + length <= capacity:
                used[k] += length
            else:
                used.append(length)
    packs = packing.shortest_pack_first(histogram, capacity)
    assert sorted(sum(p) for p, n in packs for _ in range(n)) == sorted(used)
    placed = {}
    for p, n in packs:
        for x in p:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
