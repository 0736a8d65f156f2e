"""A document with so many repeated ranges that their answers travel in several rows."""

import hashlib
import random

import numpy as np
import pytest

from keelson.llm import anchored, substring_bytes


@pytest.mark.parametrize("kind", [anchored.FULL_RANGE, anchored.OPEN_RANGE])
@pytest.mark.parametrize("n", [16_385, 20_001, 40_001])
def test_ranges_stay_whole_in_any_order(kind, n):
    low = np.arange(n, dtype=np.uint64) * np.uint64(100)
    code = np.stack([low, low + np.uint64(7)], 1).ravel()
    sent = anchored.passed_on(kind, np.repeat(np.full(n, 5), 2), code, 8)
    assert sent.num_rows > 1
    blobs = []
    for row in reversed(sent.to_pylist()):
        back = anchored.replies(row["kind"] - anchored.REPLIES, np.frombuffer(row["d"], np.int64), np.frombuffer(row["k"], np.uint64))
        blobs += back.column("codes").to_pylist()
    pairs = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
    assert sorted(map(tuple, pairs.tolist())) == list(zip(low.tolist(), (low + np.uint64(7)).tolist(), strict=True))


def test_bytes_of_a_document_with_many_ranges(spark):
    rng = random.Random(4)
    new = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passages = [new(70) for _ in range(17_001)]
    early = "".join(passages)
    late = "".join(x + new(30) for x in rng.sample(passages, len(passages)))
    windows = {early[p : p + 50] for p in range(len(early) - 49)}
    gone = np.zeros(len(late), bool)
    for p in range(len(late) - 49):
        if late[p : p + 50] in windows:
            gone[p : p + 50] = True
    got = {r.doc_id: r for r in substring_bytes.remove_repeats(spark.createDataFrame([(1, early), (2, late)], "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == int(gone.sum()) and got[2].n_spans >= 17_000
    assert got[2].kept_sha256 == hashlib.sha256(np.frombuffer(late.encode(), np.uint8)[~gone].tobytes()).hexdigest()
