"""The pipeline's decisions, stage by stage, and the registered queries next to their SQL."""

import pytest

pytest.importorskip("docloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def firsts_of_groups(texts):
    """The smallest id of each group of texts with 0.8 of their five-word shingles in common, one pair at a time."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "a", None), (10**6 + 1, "123 456", None, "a", 7), (10**6 + 2, "token = \"abcdefgh1234\" und so weiter", "de", "a", 38)], docs.schema)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    leak = spark.createDataFrame([(10**6 + 3, f"Before it stands {item} and after it", "en", "a", 9)], docs.schema)
    at = docs.union(extra).union(leak)
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, SF).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert at.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in at.collect()}
    assert not {10**6, 10**6 + 1} & set(seen["language_id"]) and {10**6 + 2, 10**6 + 3} <= set(seen["language_id"])
    judged = {i: r["text"] for i, r in seen["language_id"].items()}
    assert set(seen["jaccard_join"]) == firsts_of_groups(judged)
    assert 10**6 + 3 in seen["jaccard_join"] and 10**6 + 3 not in seen["decontamination"]
    hit = {r["doc_id"] for r in entry.queries()["op7_winnowing"](spark, SF).collect() if r["contaminated"]}
    assert set(seen["decontamination"]) == set(seen["jaccard_join"]) - hit - {10**6 + 3}
    assert set(seen["secret_scan"]) == set(seen["decontamination"]) and seen["secret_scan"][10**6 + 2]["text"] == "[SECRET]\" und so weiter"
    assert set(seen["packing"]) == set(seen["secret_scan"])


def test_near_copies_of_eight_tenths_go(spark):
    """Two of 100 words replaced far apart: 86 of 106 five-word shingles (a copy), but 92 of 104 three-word ones."""
    w = [f"word{i}" for i in range(100)]
    near, far = w.copy(), w.copy()
    near[30], near[70] = "other", "another"
    far[20], far[50], far[80] = "one", "two", "three"  # 81 of 111
    rows = [(i, " ".join(t), "en", "a", len(" ".join(t))) for i, t in enumerate((w, near, far), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.keep_one_of_each_group(spark, docs, SF).collect()) == [1, 3]


def test_language_stage_without_labels_and_with_a_foreign_script(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bare = docs.withColumn("lang", docs["lang"].substr(9, 1).cast("string")).replace("", None, ["lang"])
    assert pipeline.keep_known_language(spark, bare, SF).count() == docs.count()
    foreign = spark.createDataFrame([(10**6, "це зовсім інша мова та інше письмо " * 5, None, "a", 175)], docs.schema)
    kept = {r["doc_id"] for r in pipeline.keep_known_language(spark, docs.union(foreign), SF).collect()}
    assert 10**6 not in kept and len(kept) == docs.count()


def test_run_equals_its_stages(spark, tmp_path):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.groupBy("doc_id").count().count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op7_winnowing", "op10_glob_automaton"])
def test_oracles(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "pages"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda d: sorted(tuple(None if v != v else v for v in r) for r in d.astype(object).itertuples(index=False))
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_and_empty_tables(spark, k):
    """Nulls in every column, empty and long texts, repeated rows, ties, more columns with clashing names."""
    name, stage = pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, text_key string, held_out boolean, rank int"
    same = "the same words stand here " * 6
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", None, 10), (3, same, "en", "a", 150), (3, same, "en", "a", 150), (4, same, None, "a", 150),
            (5, "a lone long word " * 4000, "en", "b", 68_000), (6, "token: abcdef1234 token: abcdef1234", "de", "b", 35), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, None, "k", None, 1) for r in rows], schema).repartition(2)
    got = stage(spark, docs, SF)
    if name != "packing":
        assert got.columns == pipeline.COLUMNS
    ids = [r["doc_id"] for r in got.collect()]
    want = {
        "language_id": [None, 3, 3, 4, 5, 6], "jaccard_join": [None, None, 1, 2, 3, 5, 6], "decontamination": [None, None, 1, 2, 3, 3, 4, 5, 6],
        "secret_scan": [None, None, 1, 2, 3, 3, 4, 5, 6],
    }
    key = lambda i: (i is not None, i or 0)
    assert name == "packing" and {1, 2, 3, 4, 5, 6, None} == set(ids) or sorted(ids, key=key) == sorted(want[name], key=key)
    assert stage(spark, docs.where("false"), SF).count() == 0
