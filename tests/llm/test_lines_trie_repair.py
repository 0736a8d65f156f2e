"""Operators 11 to 13 against brute force, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import lines, queries, repair, trie

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- 11: lines


def line_rows():
    rng = random.Random(11)
    common = [f"  Line {i} that MANY documents hold, é at its end É{i}\t" for i in range(6)]
    rows = []
    for i in range(40):
        t = [f"own line {i}.{j} " + "z" * rng.randint(0, 60) for j in range(rng.randint(0, 4))]
        t += rng.sample(common, rng.randint(0, 4))
        t += [rng.choice(common).upper() if i % 3 else "short"] * (i % 4)
        rng.shuffle(t)
        rows.append((i * 3 - 30, "\n".join(t)))
    exactly = "x" * 39
    rows += [(500 + i, f"{exactly}é\n{exactly}") for i in range(5)]  # 40 characters in five documents; 39 stay
    rows += [(600 + i, "y" * 50) for i in range(4)] + [(600, "y" * 50)]  # five rows, four documents
    rows += [(700, common[0] + "\n" + "w" * 45), (700, "w" * 45), (700, common[0] + "\n" + "w" * 45)]
    rows += [(None, common[0]), (None, None), (800, None), (801, ""), (802, "\n\n"), (803, common[1]), (804, "v" * 300_000 + "\n" + common[2]), (-999, "\n".join(common))]
    return rows


def plain_lines(rows, least_chars=40, least_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if i is None or not (len(held.get(key(x), ())) >= least_docs and max(held[key(x)]) != i)]
        out.append((i, "\n".join(stay), len(all_lines), len(all_lines) - len(stay)))
    return out


@pytest.fixture(scope="module")
def line_docs(spark):
    schema = "doc_id long, text string, a string, batch string, gone string, mark int, key int"
    return spark.createDataFrame([(i, t, "c", "c", "c", 1, 2) for i, t in line_rows()], schema).repartition(3)


@pytest.mark.parametrize("batches, fanout", [(8, 4), (5, 2), (1, 4)])
def test_lines(line_docs, batches, fanout):
    got = [tuple(r) for r in lines.remove_lines(line_docs, batches=batches, fanout=fanout).collect()]
    want = plain_lines(line_rows())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[3] for w in want) > 50 and any(w[1] == "" and w[3] for w in want)


def test_runs_take_batches_in_any_order(spark):
    """Keys settle only where the largest id is known; levels hold what fanout says."""
    rng = random.Random(5)
    pairs = [(rng.randrange(40), 0, rng.randrange(300)) for _ in range(900)]
    table = spark.createDataFrame(pairs, "a long, b long, doc_id long")
    index, seen = lines.Runs(spark, least_docs=5, fanout=2, buckets=3), set()
    for part in (3, 0, 5, 1, 4, 2, 6):
        index.add(lines.entries(table.where(F.col("doc_id") % 7 == part)))
        seen |= {(a, d) for a, _, d in pairs if d % 7 == part}
        assert all(len(level) < 2 for level in index.levels)
    want = {a: max(d for x, d in seen if x == a) for a in range(40) if sum(x == a for x, _ in seen) >= 5}
    assert {r.a: r.top for r in index.settled().collect()} == want
    added = sum(r.n for r in index.merged().collect())
    assert added < len(seen)  # what the runs settle is not added again
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keelson_run_")]


def test_lines_run_without_python(spark, line_docs):
    plan = lines.remove_lines(line_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 12: the trie


def conversation_rows():
    rng = random.Random(12)
    rows = []
    for c in range(60):
        start = rng.choice([[], ["hello"], ["hello", "what is it?"], ["hello", "what is it?", "é"]])
        turns = [*start, *(f"{rng.randrange(3)}" * 3 for _ in range(rng.randint(0 if start else 1, 12)))]
        rows += [(c, k, rng.choice(["user", "assistant"]) if k > 4 else "user", t) for k, t in enumerate(turns)]
    for c in range(100, 190):  # copies of one, which are not dealt by what they hold
        rows += [(c, k, "user", t) for k, t in enumerate(["same", "old", "story"])]
    rows += [(200, None, None, None), (200, 0, "", ""), (200, 0, "user", None), (201, 3, "user", "x"), (201, 3, "user", "x"), (201, 3, "assistant", "x"), (201, None, "user", "z")]
    rows += [(203, k, "user", f"long {k}" + "q" * 20_000 * (k == 7)) for k in range(300)] + [(-7, 0, "user", "minus"), (-5, 0, "user", "five"), (-5, 1, "user", "five")]
    rows += [(c, 0, "user", "alone") for c in (301, 302, 303, 304)]  # the first of their family is not there
    rows += [(None, 0, "user", "nobody's"), (None, 1, "user", "nobody's")]
    return rows


def rebuilt(rows):
    own = defaultdict(list)
    for c, at, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append(((at is not None, at or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h, g = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
        out[c] = own.get(c - g, [])[:h] + own[c][h:]
    return out


def plain_trie(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(str(c) for c in m if len(convs[c]) == len(p)))) for p, m in members.items()]


CONVERSATION = "conv_id long, turn long, role string, text string, part string, own int, turns int"


@pytest.mark.parametrize("stretch", [1, 60, 1 << 19])
def test_trie(spark, stretch):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], CONVERSATION).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(table, stretch).collect()]
    want = plain_trie(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(not t for t in rebuilt(rows).values()), "a conversation without turns"


def test_long_lists_of_ids_are_stitched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    key = bytes(16)
    convs = [(key, [3], c) for c in range(100)]
    parts = [dict(zip(trie.NAMES, r, strict=True)) for k in range(4) for r in trie.sweep(k, iter(convs[25 * k : 25 * k + 25]))]
    found = list(trie.stitched(iter(parts)))
    assert [(r[5], r[8], r[10], r[13], r[14].decode()) for r in found] == [(1, 0, 100, 297, sha(",".join(map(str, range(100))))), (0, 0, 100, 297, sha(""))]


# --- 13: repair


def cheapest(rows):
    """All ways to edit, with up to two insertions between turns."""
    inserted = [()] + [(("I", 5, r),) for r in "ua"] + [(("I", 5, r), ("I", 5, s)) for r in "ua" for s in "ua"]
    choices = []
    for k in rows:
        ways = [("D", 2, "")]
        if k != "d":
            more = 5 if k.isupper() else 0
            ways += [("K", more, {"e": ""}.get(k.lower(), k.lower())), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        choices += [inserted, [(w,) for w in ways]]
    best = None
    for way in itertools.product(*choices, inserted):
        way = [e for group in way for e in group]
        if re.fullmatch("(s?(ua)+)?", "".join(e[2] for e in way)):
            found = (sum(e[1] for e in way), "".join(e[0] for e in way))
            best = found if best is None else min(best, found)
    return best


def test_edits_against_all_ways():
    some = ["".join(w) for n in range(3) for w in itertools.product("dsuaxeSUA", repeat=n)]
    rng = random.Random(13)
    some += ["".join(rng.choices("suaxedUA", k=3)) for _ in range(6)]
    for word in some:
        cost, chosen = repair.edits(word)
        assert (cost, "".join(x for x, _ in chosen)) == cheapest(word), word


def repair_rows():
    rng = random.Random(3)
    rows = []
    for c in range(300):
        for k in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            rows.append((c, k * 2 if c % 7 == 0 else k, "system" if k == 0 and c % 3 == 0 else role, rng.choice(["Yes.", "No", "What? ", " \t", "Ünd so weiter!\n"]) + "x." * (k % 2)))
    rows += [(400, None, None, None), (400, None, "user", "a."), (400, 1, "", "b."), (400, 1, "user", "c" * 200_000 + "."), (401, None, "user", "a."), (None, 0, "user", "n."), (None, None, "assistant", "m.")]
    rows += [(500, 0, "user", "q."), (500, 0, "user", "q."), (500, 1, "assistant", "r.")]
    return rows


def plain_repair(rows):
    own = defaultdict(list)
    for c, at, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if at is None else at}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own[c] += [(at, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, kinds = [], []
        for i, (_, role, text) in enumerate(turns):
            last = re.sub("[\x20\x09-\x0d]", "", text)[-1:]
            f = "blank" if not last else "duplicate" if (role, text) in [t[1:] for t in turns[:i]] else "" if last in ".!?" else "truncated"
            k = role[:1] if role[:1] in ("s", "u", "a") else "x" if role else "e"
            faults.append(f)
            kinds.append("d" if f in ("blank", "duplicate") else k.upper() if f else k)
        # Least (cost, edits, result) from each place and last initial on
        memo = {}

        def best(i, q, spare=2):
            if (i, q, spare) not in memo:
                ways = [(0, "", ())] if i == len(turns) and q in ("", "a") else []
                ok = lambda r: (q + r) in ("s", "u", "su", "ua", "au")  # noqa: B023, E731
                step = lambda cost, letter, line, rest: (cost + rest[0], letter + rest[1], (*line, *rest[2]))
                if spare:
                    ways += [step(5, "I", (n + ":",), best(i, r, spare - 1)) for r, n in (("u", "user"), ("a", "assistant")) if ok(r)]  # noqa: B023
                if i < len(turns):
                    _, role, text = turns[i]
                    ways.append(step(2, "D", (), best(i + 1, q)))
                    if kinds[i] != "d":
                        more = 5 if kinds[i].isupper() else 0
                        if role == "" or role[:1] in ("s", "u", "a") and ok(role[:1]):
                            ways.append(step(more, "K", (f"{role}:{text}",), best(i + 1, role[:1] or q)))
                        ways += [step(1 + more, "R", (f"{n}:{text}",), best(i + 1, r)) for r, n in (("u", "user"), ("a", "assistant")) if ok(r)]  # noqa: B023
                memo[i, q, spare] = min(ways, default=(1 << 40, "", ()))
            return memo[i, q, spare]

        cost, audit, result = best(0, "")
        at = {t for t, _, _ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((c, max(at) - min(at) + 1 - len(at) if at else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(result))))
    return out


def test_repair(spark, tmp_path):
    rows = repair_rows()
    table = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, gone string, kind int, copy int").repartition(4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()]
    want = plain_repair(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # No insertion is ever among the cheapest: a deletion next to it mends the same for less
    assert any(w[7] == "" and w[6] == 0 for w in want) and all(any(x in w[7] for w in want) for x in "DKR")


def test_rows_that_are_given_are_repaired_as_they_are(spark):
    table = spark.createDataFrame([(1, 0, "user", "a.", False), (1, 2, "user", "b.", False), (1, 3, "assistant", "c.", False), (2, 0, "", "", True)], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: r for r in repair.repair(table).collect()}
    assert (got[1].gaps, got[1].illegal, got[1].cost, got[1].audit) == (1, 1, 2, "DKK")
    assert [tuple(t) for t in got[1].repaired] == [("user", "b."), ("assistant", "c.")] and got[2].repaired == [] and got[2].audit == ""


def test_empty_tables(spark, tmp_path):
    for t, schema in (("documents", "doc_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for q in (queries.op11_line_dedup, queries.op12_conversation_trie, queries.op13_conversation_repair):
        assert q(spark, str(tmp_path)).collect() == []
