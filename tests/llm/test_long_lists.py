"""Which sets of a long list get their whole sets there."""

import numpy as np
import pyarrow as pa

from tidewell.llm import jaccard_join as j


def test_only_sets_that_may_link_are_moved_whole():
    """Sets that share frequent shingles only, small and large ones; a crowd of near copies; two pairs. No linked pair may be lost."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**63, n, np.uint64)
    common = draw(40)
    sets = [np.concatenate([common, draw(n)]) for n in [*[150] * 60, *[6000] * 12]]
    base = draw(300)
    sets += [np.concatenate([common, base, draw(4)]) for _ in range(20)]
    for n in (200, 5000):
        one = draw(n)
        sets += [np.concatenate([common, one]), np.concatenate([common, one, draw(3)])]
    parity = np.stack([j._parity(s) for s in sets])
    block = pa.table({"token": [7] * len(sets), "id": list(range(len(sets))), "h": list(range(100, 100 + len(sets))), "n": [len(s) for s in sets]} | {f"p{k}": parity[:, k] for k in range(j.PARITIES)} | {"wider": pa.array([j._parity(s, j.WIDER).tobytes() if len(s) > j.WIDE else None for s in sets], pa.binary())})
    got = j._may_link(90, 100)(block).to_pylist()
    live, pairs = {r["id"] for r in got if r["b"] is None}, {tuple(sorted((r["id"], r["b"]))) for r in got if r["b"] is not None}
    assert live == set(range(72, 92)) and pairs == {(92, 93), (94, 95)}
    assert all(r["h"] == r["id"] + 100 and r["hb"] in (None, (r["b"] or 0) + 100) for r in got)
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
                assert {a, b} <= live or (a, b) in pairs
