"""Orders that packing and mixing keep, against brute-force versions written from their definitions."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from tidemark.llm import mixing, packing


def brute_bm25(docs, seed, k1=1.2, b=0.75):
    """Scores of all documents for all of the seed's terms, from the formula."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    tf = [Counter(d.tolist()) for d in docs]
    df = Counter(t for c in tf for t in c)
    idf = {t: math.log1p((n - v + 0.5) / (v + 0.5)) for t, v in df.items()}
    return [sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(d) / mean)) for t in tf[seed] if c[t]) for c, d in zip(tf, docs)]


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.4, rng.integers(5, 120)).clip(1, 3000).astype("<u4") for _ in range(80)]
    index = packing.Index(docs)
    assert 0 < len(index.dense) < index.terms
    for seed in range(0, 80, 7):
        unused = rng.random(80) < 0.8
        got = list(index.neighbours(seed, unused, first=9))
        score = brute_bm25(docs, seed)
        assert set(got) == {d for d in range(80) if unused[d] and score[d] > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_windows_are_filled_greedily():
    """Each sequence's first rest is the longest left, the others its best unused neighbours in order."""
    rng = np.random.default_rng(6)
    docs = [rng.zipf(1.3, rng.integers(20, 400)).clip(1, 900).astype("<u4") for _ in range(120)]
    window, sequences, left = 256, {}, [len(d) for d in docs]
    for d, start, n, seq, offset in packing.pack_shard(docs, window):
        sequences.setdefault(seq, []).append((offset, d, start, n))
    whole = [s for s in sequences.values() if len(s) == 1 and s[0][3] == window and s[0][2] % window == 0]
    for s in whole:
        left[s[0][1]] -= window
    for seq in sorted(k for k, s in sequences.items() if s not in whole):
        pieces = sorted(sequences[seq])
        seed = pieces[0][1]
        unused = {d for d in range(len(docs)) if left[d] > 0}
        score = brute_bm25(docs, seed)
        for _, d, _, n in pieces:
            if d != seed:
                best = max(score[x] for x in unused)
                assert score[d] >= best - 1e-9
            left[d] -= n
            if left[d] == 0:
                unused.discard(d)


def brute_phases(share, blocks):
    """Slot by slot: of the blocks whose release has come, that of the earliest deadline, first source first."""
    names = sorted(share, key=lambda s: (s is None, s or ""))
    left, done, slot, begin = dict(blocks), Counter(), 0, 0
    base = Counter()
    while any(left[s] for s in names):
        alive = [s for s in names if left[s]]
        total = sum(share[s] for s in alive)
        best = None
        for i, s in enumerate(alive):
            w, k = Fraction(share[s], total), done[s]
            release, deadline = math.floor(k / w), math.ceil((k + 1) / w)
            if release <= slot - begin and (best is None or (deadline, i) < best[:2]):
                best = deadline, i, s, release
        deadline, _, s, release = best
        yield s, base[s] + done[s], slot, begin + release, begin + deadline
        done[s] += 1
        left[s] -= 1
        slot += 1
        if not left[s]:  # a source has run out: fresh windows for the others
            base.update(done)
            done, begin = Counter(), slot


@pytest.mark.parametrize("share, blocks", [
    ({"a": 1, "b": 2, None: 7}, {"a": 9, "b": 4, None: 40}), ({"x": 5}, {"x": 6}), ({"p": 333, "q": 334, "r": 1}, {"p": 50, "q": 20, "r": 3}), ({"a": 3, "b": 3, "c": 3}, {"a": 5, "b": 5, "c": 5}), ({"a": 2, "b": 1}, {"a": 0, "b": 3}),
])
def test_phases_are_earliest_deadline_first(share, blocks):
    assert list(mixing.phases(share, blocks)) == list(brute_phases(share, blocks))
