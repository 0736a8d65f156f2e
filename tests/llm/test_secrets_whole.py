"""Random secrets in long documents and in longer runs."""

import random
import string

import pyarrow as pa

from keelson.llm import secrets

WORDS = "user order cache table index count value report client server filter update handler widget buffer record parser module".split()


def found(*texts):
    return secrets.spans(pa.array(texts))


def identifiers(rng, n):
    return ["".join(w.capitalize() for w in rng.choices(WORDS, k=5)) + str(rng.randrange(100)) for _ in range(n)]


def key(rng, n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choices(letters, k=n))


def test_one_key_among_hundreds_of_identifiers():
    for seed in range(5):
        rng = random.Random(seed)
        names, secret = identifiers(rng, 400), key(rng, 128)
        text = " ".join([*names[:150], secret, *names[150:]])
        at = text.index(secret)
        alone, lost = found(text, " ".join(names))
        assert alone == [(at, 3, at + 128)] and lost == []


def test_longer_keys_are_surer():
    rng = random.Random(1)
    p = [max(secrets.natural(key(rng, n), "base62") for _ in range(20)) for n in (32, 128)]
    assert p[1] < 0.01 / 400 < 1 / (secrets.SIMULATED + 1) < p[0]


def test_keys_inside_longer_runs():
    url = string.ascii_letters + string.digits + "-_"
    base64 = string.ascii_letters + string.digits + "+/"
    for seed in range(5):
        rng = random.Random(seed)
        for before, secret, after in (("AWS_KEY=", key(rng, 128), ""), ("a=b=", key(rng, 128), "=="), ("x/api_v1/", key(rng, 128, url), ""), ("my_app/v2/", key(rng, 128), ""), ("x_y-", key(rng, 128, base64), "==")):
            (spans,) = found(before + secret + after)
            assert len(spans) == 1 and spans[0][1] == 3
            # A path or a word of the other alphabet may stay on
            assert spans[0][0] <= len(before) and spans[0][2] == len(before + secret + after)
    assert found("USER_NAME=getUserNameFromFileList22", "src/my_app/user_order_cache/table_index2", "=" * 30, "_/" * 20) == [[]] * 4


def test_keys_of_both_alphabets_in_one_run():
    rng = random.Random(8)
    a, b = ("".join(key(rng, 16, string.ascii_letters + string.digits) + c for _ in range(8)) for c in "+-")
    for between in ("_/", "/", "_"):
        assert {x[2] for x in found(a + between + b)[0]} >= {len(a + between + b)}
        covered = {i for s, _, e in found(a + between + b)[0] for i in range(s, e)}
        assert covered >= {*range(len(a)), *range(len(a + between), len(a + between + b))}


def test_a_run_that_fits_stays_whole():
    secret = key(random.Random(3), 126) + "=="
    assert found(secret) == [[(0, 3, 128)]]
