"""Periodic runs against all periods tried one by one."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("docloom.llm")

import __spark_entry__ as entry
from docloom.llm import periods

SF = "/root/testdata/sf0.001"


def brute(w, least=24, exponent=3):
    made = {}
    for q in range(1, len(w) // exponent + 1):
        k, last = 0, len(w) - q
        while k < last:
            j = k
            while j < last and w[j] == w[j + q]:
                j += 1
            if j > k and j - k + q >= max(least, exponent * q):
                made.setdefault((k, j + q), q)
            k = j + 1
    return sorted(((s, e - s, q) for (s, e), q in made.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 30])
    w = [b"%d" % x for x in rng.integers(0, letters, rng.integers(0, 120))]
    for _ in range(rng.integers(0, 4)):
        part = [b"%d" % x for x in rng.integers(0, letters, rng.integers(1, 14))] * int(rng.integers(2, 20))
        at = int(rng.integers(0, len(w) + 1))
        w[at:at] = part[: len(part) - int(rng.integers(0, 3))]
    return w


@pytest.mark.parametrize("least, exponent", [(24, 3), (1, 2), (8, 2), (24, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = np.random.default_rng(least)
    texts = [repetitive(rng) for _ in range(250)] + [[], [b"a"], [b"a"] * 24, [b"a"] * 23, [b"a", b"b", b"c"] * 8]
    assert [[tuple(r) for r in f.tolist()] for f in periods.runs_of(texts, least, exponent)] == [brute(w, least, exponent) for w in texts]


def test_reading_word_by_word_gives_the_same_runs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        w = repetitive(rng)
        codes = np.unique(np.array(w, dtype="S4"), return_inverse=True)[1].astype(np.int64) if w else np.empty(0, np.int64)
        reader = periods.SquareCatcher()
        seen = 0
        for i in range(len(codes)):
            seen += len(reader.append(codes[i : i + 1]))
            if i % 40 == 0:
                assert [tuple(r) for r in reader.runs().tolist()] == brute(w[: i + 1])
        assert [tuple(r) for r in reader.runs().tolist()] == brute(w) and (seen > 0 or not brute(w))


def test_every_square_is_reported_when_its_last_word_comes():
    w = [b"%d" % i for i in range(9)]
    w += w
    reader = periods.SquareCatcher(1, 2)
    reader.append(np.arange(9))
    found = np.concatenate([reader.append(np.array([i])) for i in range(9)])
    assert set(found[:, 1].tolist()) == {9}


def test_equal_sums_by_chance_do_not_matter(monkeypatch):
    """With sums that always agree only the words themselves decide."""
    monkeypatch.setattr(periods.SquareCatcher, "_mark", lambda self, at, size: np.zeros(len(self.sums[at]), np.uint64))
    w = [b"x", b"y"] * 20 + [b"%d" % i for i in range(30)] + [b"z"] * 30
    assert all(tuple(r) in brute(w) for r in periods.runs_of([w])[0].tolist())


def test_very_long_repetitive_texts_stay_cheap():
    for w in ([b"a"] * 300_000, [b"%d" % (i % 7) for i in range(300_000)], [b"%d" % (i.bit_count() % 2) for i in range(200_000)]):
        got = periods.runs_of([w])[0]
        assert len(got) == (0 if w[:3] == [b"0", b"1", b"1"] else 1)


def test_query_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in entry.queries()["op13_square_catching"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = (d["text"] or "").encode().split()
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, r = brute(w), got[d["doc_id"]]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_awkward_and_empty_tables(spark):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, start string, runs int, `_id` int"
    rows = [(1, None, "s", 1, 1), (2, "", None, None, None), (None, "a " * 30, "s", 1, 1), (3, "b c " * 20, "s", 1, 1), (3, "b c " * 20, "s", 1, 1), (4, " ".join("x" * 40), "s", 1, 1)]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    got = periods.find_runs(docs, F.col("doc_id")).collect()
    assert sorted((str(r["doc_id"]), r["n_runs"], r["start"], r["length"], r["period"], r["collapsed_text"][:9]) for r in got) == sorted([
        ("1", 0, None, None, None, ""), ("2", 0, None, None, None, ""), ("None", 1, 0, 30, 1, "a"), ("3", 1, 0, 40, 2, "b c"), ("3", 1, 0, 40, 2, "b c"), ("4", 0, None, None, None, "x x x x x"),
    ])
    assert periods.find_runs(docs.where("false"), F.col("doc_id")).count() == 0
