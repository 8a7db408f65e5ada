"""Conversation repair, whitening and mixing next to brute force, on given and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import fair_mix, queries, turn_repair, whitening
from nomenlink.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TALKS = "conv_id long, turn long, role string, text string, ending string, seq int, open boolean"


# --- conversations ---------------------------------------------------------------------------------------------------


def _plain(rows):
    """Report of one conversation's (turn, role, text), by one pass that keeps every state's whole audit."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                to = after[state]
                found = (cost + 5, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to]))
                out[to] = min(out.get(to, found), found)
        return out

    for (_, role, text), fault in zip(rows, faults):
        fresh = {}
        ways = [(s, v) for s, v in best.items()]
        for state, (cost, audit, lines) in best.items():  # insertions before this row
            here, c, a, l = state, cost, audit, lines
            for _ in range(2):
                here = after[here]
                c, a, l = c + 5, a + "I", (*l, {"u": "user:", "a": "assistant:"}[here])
                ways.append((here, (c, a, l)))
        for state, (cost, audit, lines) in ways:
            offers = [(state, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = after[state]
                name = {"u": "user", "a": "assistant"}[to]
                offers.append((to, cost + 1 + more, audit + "R", (*lines, f"{name}:{text}")))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    offers.append((role[0], cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for to, *found in offers:
                fresh[to] = min(fresh.get(to, tuple(found)), tuple(found))
        best = fresh
    best = inserted(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        "\n".join(lines),
    )


def _hurt(rows):
    """Rows of (conv_id, turn, role, text) by conversation, after the damage, in order."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def _talks():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Well", "", " \n", "What?", "Go on", None, "é.", "Same."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "sudo", "", None]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts)))
    # A conversation that fills several tasks, one that is only repeats, one whose only row is dropped, a very long text.
    rows += [(1000, i, rng.choice(roles[:4]), f"{rng.choice('abcdef')}{rng.choice('.!x')}") for i in range(700)]
    rows += [(1001, 5, "user", "Again.")] * 90
    gone = next(i for i in range(10**4) if zlib.crc32(f"{i + 5000}:0".encode()) % 20 == 0) + 5000
    rows += [(gone, 0, "user", "Lost."), (1002, 0, "user", "x" * 200_000 + "."), (1003, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(*r, "clash", 1, None) for r in _talks()]
    return spark.createDataFrame(rows, TALKS).repartition(5)


@pytest.mark.parametrize("held", [turn_repair.HELD_CHARS, 2000])
def test_repair_against_one_pass_over_whole_audits(talks, held, monkeypatch):
    inside = turn_repair._inside

    def short(*args):  # runs in the worker: long conversations leave the task early
        turn_repair.HELD_CHARS = held
        return inside(*args)

    monkeypatch.setattr(turn_repair, "_inside", short)
    rows = _talks()
    found = turn_repair.repair_conversations(turn_repair.damaged(talks), texts=True)
    got = {r["conv_id"]: tuple(r[1:]) for r in found.collect()}
    hurt = _hurt(rows)
    assert set(got) == {r[0] for r in rows} and found.count() == len(got)
    for conv in got:
        assert got[conv] == _plain(hurt.get(conv, [])), conv


def test_hirschberg_gives_the_least_audit():
    rng = random.Random(8)
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(400):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(0, 14)))
        # Texts that have the fault which the code names.
        rows = [(i, roles[c // 3], ["%d." % i, "", "%d" % i][c % 3]) for i, c in enumerate(codes)]
        vector = turn_repair.over(codes, turn_repair.start(0))
        cost, end = turn_repair.last_state(vector)
        edits = turn_repair.letters(codes, 0, end) if codes else []
        assert (cost, "".join(edits) + turn_repair._TAIL[end]) == _plain(rows)[5:7]


def test_slices_join_to_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(2, 40)))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randint(1, 4))))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        steps = [tuple(turn_repair.over(p, turn_repair.start(s)) for s in range(4)) for p in pieces]
        cost, end = turn_repair.last_state(turn_repair._over_steps(steps, turn_repair.start(0)))
        states = turn_repair.crossings(steps, 0, end)
        joined = [turn_repair.letters(p, a, b) for p, a, b in zip(pieces, states, states[1:])]
        assert (cost, end) == turn_repair.last_state(turn_repair.over(codes, turn_repair.start(0)))
        assert sum(joined, []) == turn_repair.letters(codes, 0, end)


def test_repair_of_the_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = _hurt(rows)
    got = {r["conv_id"]: tuple(r[1:]) for r in queries.QUERIES["op11_turn_repair"](spark, sf).collect()}
    assert got == {conv: _plain(hurt.get(conv, []))[:8] for conv in {r[0] for r in rows}}


# --- embeddings ------------------------------------------------------------------------------------------------------


def _whole(vectors):
    return np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000


def _check_whitened(found, ids, x, most=32):
    n = len(x)
    sums = x.sum(axis=0)
    apart = n * x - sums
    centred = apart / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-13 * values[0]).sum()))
    rows = collections.defaultdict(list)
    for r in found:
        rows[r["component"]].append(r)
    assert sorted(rows) == list(range(1, rank + 1))
    deviation = (apart.astype(object) ** 2).sum(axis=1)
    for j, part in rows.items():
        assert collections.Counter((r["vec_id"], r["deviation"]) for r in part) == collections.Counter(zip(ids, deviation))
        assert all(r["n"] == n for r in part)
        assert part[0]["explained"] == pytest.approx(values[j - 1] / values.sum(), rel=1e-9)
        gap = np.abs(np.delete(values, j - 1) - values[j - 1]).min()
        if gap > 1e-4 * values[0]:
            expected = centred @ vectors[:, j - 1] / math.sqrt(values[j - 1])
            mine = np.array([r["whitened"] for r in sorted(part, key=lambda r: (r["vec_id"], r["whitened"]))])
            sign = 1 if abs(np.sort(expected) - np.sort(mine)).max() < abs(np.sort(-expected) - np.sort(mine)).max() else -1
            assert np.allclose(np.sort(sign * expected), np.sort(mine), atol=1e-7)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_of_the_given_embeddings(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    found = queries.QUERIES["op12_whitening"](spark, sf).collect()
    assert len(found) == 32 * len(given)
    _check_whitened(found, [r["vec_id"] for r in given], _whole([r["embedding"] for r in given]))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    good[:100] = good[0]  # a very common vector
    good[:, 7] = good[:, 3]  # an entry without variance of its own
    rows = [(i if i % 9 else None, v.tolist()) for i, v in enumerate(good)]
    ids = [r[0] if r[0] is not None else -1 for r in rows]
    bad = [None, [], [1.0] * 11, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e30] * 12]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    rows = [(a, b, "x", 1.0, "y") for a, b in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n double, vector string").repartition(7)
    found = whitening.whiten(df).fillna(-1, ["vec_id"]).collect()
    _check_whitened(found, ids, _whole(good))
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(good[100:104])], "vec_id long, embedding array<float>")
    _check_whitened(whitening.whiten(few).collect(), range(4), _whole(good[100:104]))
    for empty in (df.limit(0), few.limit(1), df.where("vec_id >= 1000")):
        assert whitening.whiten(empty).collect() == []


@pytest.mark.parametrize("kind", ["plain", "equal", "close", "graded", "flat"])
def test_singular_values_and_directions(kind):
    rng = np.random.default_rng(6)
    rows = np.linalg.qr(rng.standard_normal((90, 40)))[0]
    stretch = {
        "plain": rng.random(40) + 0.1, "equal": np.repeat([1.0, 2, 3, 4], 10), "close": 1 + 1e-9 * np.arange(40),
        "graded": np.logspace(0, -8, 40), "flat": np.repeat([1.0, 0.0], 20),
    }[kind]
    factor = np.linalg.qr(rows * stretch, mode="r") if kind != "equal" else np.diag(stretch)
    squares, vectors, every = whitening.directions(factor, 40)
    expected = np.sort(stretch**2)[::-1]
    assert np.allclose(every, expected, rtol=0, atol=1e-13 * expected[0])
    assert np.allclose(squares, expected[: len(squares)], rtol=1e-8) and len(squares) == (20 if kind == "flat" else 40)
    assert np.abs(vectors.T @ vectors - np.eye(len(squares))).max() < 1e-10
    assert np.abs(factor.T @ (factor @ vectors) - vectors * squares).max() < 1e-12 * expected[0]


def test_differences_beyond_64_bits_are_exact():
    x = np.array([[3 * 10**17], [5]], dtype=np.int64)
    assert whitening._differences(x, 100, [3 * 10**17 + 5]).tolist() == [[3 * 10**19 - 3 * 10**17 - 5], [500 - 3 * 10**17 - 5]]


# --- mixing ----------------------------------------------------------------------------------------------------------


def _mixed(rows):
    """Queues by source, merged one document at a time."""
    sizes = [len(WORD.findall(text or "")) for _, _, text in rows]
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(z for z, r in zip(sizes, rows) if r[1] == s) for s in names}
    budget, open_, target = 1.5 * sum(sizes), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2 * total[s] for s in above}
        open_ -= above
    digest = lambda i: hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
    taken, queue = [0] * len(rows), []
    for place, s in enumerate(names):
        mine = [i for i, r in enumerate(rows) if r[1] == s]
        mine.sort(key=lambda i: (digest(rows[i][0]), rows[i][0] is not None, rows[i][0] or 0, sizes[i]))
        used = 0
        for turn, i in enumerate(mine * 2):
            used += sizes[i]
            queue.append((used * 6 // weight[s], place, turn % len(mine), i))
    left = 3 * sum(sizes) // 2
    for _, _, _, i in sorted(queue):
        take = min(left, sizes[i])
        taken[i] += take
        left -= take
    return [(r[0], z, total[r[1]], target[r[1]], t) for r, z, t in zip(rows, sizes, taken)]


def _same_mix(got, expected):
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])


def test_mix_of_the_given_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = queries.QUERIES["op13_fair_mix"](spark, sf).collect()
    _same_mix(got, _mixed(rows))


def test_mix_of_odd_rows(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        source = rng.choice(["hot"] * 6 + ["b", "é", "Z", "", None])
        rows.append((i, source, rng.choice([None, "", " \n", "one", "a b\tc", "w " * rng.randint(1, 90)])))
    rows += [(7, "hot", "a b")] * 200 + [(None, "hot", "x y z"), (None, None, "x"), (8, "long", "word " * 50_000), (9, "none", "")]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id long, source string, text string, size int, weight string, target double")
    mix = lambda d: fair_mix.mix_sources(d).select("doc_id", "size", "source_size", "target", "taken")
    got = mix(df.repartition(6)).collect()
    _same_mix(got, _mixed(rows))
    assert collections.Counter(got) == collections.Counter(mix(df.repartition(3)).collect())  # reruns agree
    assert sum(r["taken"] for r in got) == 3 * sum(r["size"] for r in got) // 2
    assert mix(df.limit(0)).collect() == []
    blank = mix(df.where("source = 'none'")).collect()
    assert [tuple(r) for r in blank] == [(9, 0, 0, 0.0, 0)]


def test_hot_source_is_summed_in_parts(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("source"), "id", F.lit(1).cast("long").alias("size")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        placed = materialise(fair_mix.in_order(rows, "source", "id"), "placed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.select("part").distinct().count() > 1
    totals = fair_mix.running_sums(placed, "size", ["source"])
    assert totals.where("total <> id + 1").isEmpty()
