"""Personal data: patterns against plain regular expressions, the field against all paths, held-out sentences, whole texts."""

import hashlib
import itertools
import re

import numpy as np
import pytest

pytest.importorskip("docloom.llm")

import __spark_entry__ as entry
from docloom.llm import crf

SF = "/root/testdata/sf0.001"
PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)]


def brute(text):
    made = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            good = (True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15)
            if good[kind]:
                made.append((m.start(), kind, m.end()))
    return sorted(made)


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in crf.examples(spark).collect()]


@pytest.fixture(scope="module")
def model(spark):
    return crf.train(crf.examples(spark))


def test_patterns_equal_plain_expressions():
    rng = np.random.default_rng(1)
    parts = np.array(["a", "B", "1", "2", "45", "123", "4111 1111 1111 1111", "4242424242424242", "@", "@", ".", " ", "-", "+", "+1", "(", ")", "é", "\n", "_", "%", "12.34.", "a@b.c", "555-1234"])
    for _ in range(15_000):
        text = "".join(rng.choice(parts, rng.integers(0, 18)))
        assert crf.base_spans(text) == brute(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a.b", "+1", "+1(", "1 ", "a@b", "٣"])
def test_patterns_are_linear_in_very_long_texts(unit):
    crf.base_spans(unit * 300_000)


def test_viterbi_and_expectations_equal_all_paths():
    rng = np.random.default_rng(2)
    k, sizes = crf.LABELS, np.array([3, 1, 2])
    score, move, begin, finish = rng.normal(size=(6, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k)
    got = crf.viterbi(score, sizes, move, begin, finish)
    one, two = crf._expected(score, sizes, move, begin, finish)
    pairs, at = np.zeros((k, k)), 0
    for n in sizes:
        total, share, best = 0.0, np.zeros((n, k)), (-np.inf, None)
        moves = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            s = begin[path[0]] + finish[path[-1]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))
            best = max(best, (s, path))
            total += np.exp(s)
            for i, y in enumerate(path):
                share[i, y] += np.exp(s)
            for a, b in itertools.pairwise(path):
                moves[a, b] += np.exp(s)
        assert tuple(got[at : at + n]) == best[1]
        assert np.allclose(one[at : at + n], share / total)
        pairs += moves / total
        at += n
    assert np.allclose(two, pairs)


def test_sentences_not_learned_from_are_labelled_right(rows):
    """Sentences of other rounds of the same rule, with other numbers and other words."""
    n = len(crf.SENTENCES)
    field = crf.fit(rows[: 4 * n])
    right = sum(",".join(f"{crf.KINDS[k]}:{s}:{e}" for s, k, e in crf.added_spans([t], field)[0]) == spans for t, spans in rows[4 * n :])
    assert right >= 0.97 * (len(rows) - 4 * n)


def test_what_patterns_miss_is_added(spark, model):
    texts = ["call me at 0170 1234567 please", "anna at gmail dot com", "my card 4111-1111-1111-1112 ok", "dial (555) 123-4567 now", "order 123456 from 2024", "version 1.2 of 12.05.2023, 10%", "plain words only", "été à Paris: (555) 123-4567!"]
    schema = "doc_id long, text string, spans string, n_ip string"
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], schema)
    got = {r["doc_id"]: r["spans"] for r in crf.scan(docs, model, crf.F.col("doc_id")).collect()}
    assert got == {0: "crf_phone:11:23", 1: "crf_email:0:21", 2: "crf_card:8:27", 3: "crf_phone:5:19", 4: "", 5: "", 6: "", 7: "crf_phone:13:27"}


def test_added_spans_never_touch_base_spans():
    base = [(5, 0, 10), (12, 1, 15)]
    text = "abcd1efgh2klmn3op4rstuvwx5"
    assert crf.uncovered(text, [(0, 3, 20)], base) == [(0, 3, 5), (15, 3, 20)]
    assert crf.uncovered(text, [(5, 0, 10), (20, 2, 26)], base) == [(20, 2, 26)] and crf.uncovered(text, [(4, 0, 11)], base) == []


def test_query_rows_hold_all_base_spans(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op11_crf_personal_data"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        base, r = brute(text), got[i]
        shown = ",".join(f"{crf.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in crf.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and ",".join(s for s in r["spans"].split(",") if s and not s.startswith("crf_")) == shown


def test_awkward_and_empty_tables(spark, model):
    rows = [(1, None, "s"), (2, "", None), (None, "a@b.cd", "s"), (3, "x@y.zz " * 20_000, "s"), (4, "a@b.cd", "s"), (4, "a@b.cd", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = crf.scan(docs, model, crf.F.col("doc_id")).collect()
    assert sorted((str(r["doc_id"]), r["n_email"]) for r in got) == [("1", 0), ("2", 0), ("3", 20_000), ("4", 1), ("4", 1), ("None", 1)]
    assert crf.scan(docs.where("false"), model, crf.F.col("doc_id")).count() == 0
    none = crf.train(spark.createDataFrame([], "text string, spans string"))
    assert all(r["n_added"] == 0 for r in crf.scan(docs, none, crf.F.col("doc_id")).collect())
