"""Lists of a bucket count as equal only if documents and flags are."""

import numpy as np
import pytest

from keelson.llm import jaccard
from keelson.llm.anchored import packed_rows


@pytest.mark.parametrize("x", [-4, -1, 0, 3, 10, 1 << 40])
def test_neighbouring_ids_do_not_coincide(x):
    lists = [[(100, 0), (200, 0), (x, 1)], [(100, 0), (200, 0), (x + 1, 0)], [(100, 0), (200, 0), (x, 0)], [(100, 0), (200, 0), (300, 0)], [(100, 0), (200, 0), (300, 0)]]
    key = np.repeat(np.arange(len(lists), dtype=np.uint64), 3)
    ids, fringe = (np.array([r[i] for one in lists for r in one], np.int64) for i in (0, 1))
    sent = packed_rows(1, key, ids, flag=fringe.astype(bool), short=True)
    rows = [r for b in jaccard.meet([sent]) for r in b.to_pylist() if r["a"] is not None and r["kind"] == jaccard.BUCKET]
    got = sorted(r["members"] for r in rows)
    want = {tuple(sorted(one, key=lambda r: (r[1], r[0]))) for one in lists}
    assert got == sorted(np.array([d for d, _ in one], np.int64).tobytes() + np.array([f for _, f in one], bool).tobytes() for one in want)
