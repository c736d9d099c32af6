"""Each operator against a brute-force version or an exact round trip, on small tables with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("docloom.llm")

from pyspark.sql import functions as F

from docloom.llm import base, hilbert, hmm, langid, licenses, multiprobe, packing, partenum, secrets, urlglob, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def table(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source) with two more columns, one of a clashing name."""
    full = [(i, t, g, s, len(t) if t is not None else None, "x") for i, t, g, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


AWKWARD = [
    (0, None, None, None), (1, "", "en", "a"), (2, "one", "en", "a"), (3, "One two", "de", "b"), (4, "...", "en", None),
    (5, prose(5, 60), "en", "a"), (5, prose(5, 60), "en", "a"), (6, prose(5, 60).upper(), "en", "a"), (None, prose(7, 40), None, "b"),
    (8, prose(8, 3000), "de", "b"), (9, "é ü\tß\x0bK ſ " + prose(9, 30), "fr", "c"), (10, prose(5, 60), "en", "a"),
]


@pytest.fixture(scope="module")
def scratch(spark):
    s = base.Scratch(spark)
    yield s
    s.drop()


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower_words(text):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


# 1: language model

def test_hmm_base_scores_and_counts(awkward, scratch):
    got = hmm.score_documents(awkward, scratch).collect()
    assert len(got) == len(AWKWARD)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = collections.Counter(w for i, t, *_ in AWKWARD if not held(i) for w in [*lower_words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t, *_ in AWKWARD:
        own = [*lower_words(t), "end"]
        want[i].append((len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    for r in got:
        size, known, score = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0


def test_hmm_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    k = hmm.STATES
    norm = lambda a: a / a.sum(-1, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, 5))).T)
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 3)]
    for s, got in zip(sequences, hmm.forward(model, sequences), strict=True):
        total = 0.0
        for path in np.ndindex(*[k] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert got == pytest.approx(math.log10(total), rel=1e-9)
    emit, move, start = hmm.expected(model, sequences, 5)
    assert emit.sum() == pytest.approx(8, rel=1e-4) and move.sum() == pytest.approx(5, rel=1e-4) and start.sum() == pytest.approx(3, rel=1e-4)


def test_hmm_training_raises_held_out_likelihood(spark, scratch):
    """Two word worlds that never mix inside a text: states beat single-word shares on texts not learned from."""
    rng = np.random.default_rng(3)
    worlds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    docs = table(spark, [(i, " ".join(rng.choice(worlds[i % 2], 60)), None, None) for i in range(300)])
    r = hmm.score_documents(docs, scratch).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.2


@pytest.mark.parametrize("seed", range(3))
def test_hmm_separates_states_on_few_distinct_texts(spark, scratch, seed):
    """Runs of two word groups in one text, forty copies: the states tell the groups apart, which single words can't."""
    text = " ".join([f"{g}{seed}{k % 3}" for g in "ab" * 3 for k in range(30)])
    r = hmm.score_documents(table(spark, [(i, text, "en", "a") for i in range(40)]), scratch).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.15


def test_hmm_probabilities_of_all_words_add_up_to_one(awkward, scratch):
    lex = hmm.lexicon(hmm.word_counts(base.documents(awkward).select("text")))
    model = hmm.first_model(lex)
    total = sum(10 ** hmm.forward(model, [np.array([lex.symbols[i]])])[0] * 10 ** lex.inner[i] for i in range(len(lex.counts)))
    rest = sum(model.emit[lex.heads + c] @ model.start * hmm.ALPHA / (lex.class_tokens[c] + hmm.ALPHA * (lex.class_words[c] + 1)) for c in range(hmm.CLASSES))
    assert total + rest == pytest.approx(1.0, rel=1e-6)


def test_hmm_empty(empty, scratch):
    assert hmm.score_documents(empty, scratch).count() == 0


# 2: Jaccard join

def brute_links(rows, percent=90):
    sets = []
    for _, t, *_ in rows:
        w = lower_words(t)
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(ids[find(i)], default=None), links[i]) for i in range(len(rows))]


def edited(text, n, seed):
    rng = np.random.default_rng(seed)
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"w{rng.integers(1000)}"
    return " ".join(w)


def test_partenum_matches_brute_force(spark, scratch):
    rows = list(AWKWARD)
    for n in (12, 13, 25, 60, 150, 400):
        for c in range(8):
            rows.append((100 * n + c, edited(prose(n, n), c * max(1, n // 200), c), "en", "a"))
    for c in range(60):  # one family of near copies that only chains connect
        rows.append((90_000 + c, edited(prose(77, 120), c % 7, 500 + c), "en", "a"))
    got = partenum.jaccard_links(table(spark, rows), scratch).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute_links(rows)))


@pytest.mark.parametrize("nodes, elements", [(9, 10**6), (1024, 150)])
def test_partenum_blocks_give_the_same(spark, scratch, monkeypatch, nodes, elements):
    rows = [(c, edited(prose(78, 100), c % 6, c), "en", "a") for c in range(70)]
    monkeypatch.setattr(partenum, "BLOCK_NODES", nodes)
    monkeypatch.setattr(partenum, "BLOCK_ELEMENTS", elements)
    got = partenum.jaccard_links(table(spark, rows), scratch).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows))


@pytest.mark.parametrize("percent", [80, 90])
def test_partenum_signatures_never_miss(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        t = s
        for _ in range(int(rng.integers(0, max(1, n // 8) + 1))):
            t = np.delete(t, rng.integers(len(t))) if rng.random() < 0.5 and len(t) > 1 else np.unique(np.append(t, rng.integers(0, 1 << 63).astype(np.uint64)))
        both = len(np.intersect1d(s, t))
        if 100 * both >= percent * (len(s) + len(t) - both) and not np.array_equal(s, t):
            assert set(partenum.signatures(s, percent)) & set(partenum.signatures(t, percent))


def test_partenum_keeps_one_of_each_component(awkward, scratch):
    r = partenum.jaccard_links(awkward, scratch).collect()
    same = [x for x in r if x["component_id"] == 5]
    assert len(same) == 4 and {(x["doc_id"], x["keeper"]) for x in same} == {(5, True), (6, False), (10, False)}
    assert all(x["keeper"] for x in r if x["component_id"] != 5)


def test_partenum_empty(empty, scratch):
    assert partenum.jaccard_links(empty, scratch).count() == 0


# 3: packing

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER_FILE)), public_tokenizers.path(packing.TOKENIZER_FILE)


ODD = [
    "Plain words, and MORE!! words.", "it's we'll I'D don't 'twas", "Ünïcode É À ß ÿ × ÷ µ", "e\u0301 \u0301 a\u0301b", "<|endoftext|> a<|startoftext|>b", "İstanbul ſ K ΣΑΣ",
    "tab\tnew\nline\r\nform\x0cfeed\u00a0nbsp\u2003em \u200bzero", "12345 3.14 a1b2 x_y", "漢字 かな 한국어", "x" * 3000, "...", "", "\x00 \x1f \x85", "ab---cd e-f -", "🙂 a🙂b",
]


def test_plain_words_encode_like_the_tokenizer(tokenizer):
    model, path = tokenizer
    for text, raw in zip(ODD, packing.WordEncoder(path).encode(ODD), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, got, model, limits):
    want = collections.Counter()
    ids_of = {}
    for i, t, *_ in rows:
        ids_of[i] = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] += len(ids_of[i])
    used = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["length"] > 0
        used[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append(r)
    assert used == want
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss_tokens
        assert at == limits.tokens or at & (at - 1) == 0


def test_packing_loses_no_token(awkward, tokenizer):
    model, path = tokenizer
    check_packing(AWKWARD, packing.pack_documents(awkward, path).collect(), model, packing.Limits())


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(128, 8, 100), packing.Limits(256, 3, 200)])
def test_packing_keeps_every_limit(spark, tokenizer, limits):
    model, path = tokenizer
    rows = [(i, prose(i, 1 + i * 7 % 90), "en", "a") for i in range(120)]
    check_packing(rows, packing.pack_documents(table(spark, rows, 2), path, limits=limits, buffer=20).collect(), model, limits)


def test_packing_empty(empty, tokenizer):
    assert packing.pack_documents(empty, tokenizer[1]).count() == 0


# 4: nearest neighbours

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)


def test_multiprobe_recall_order_and_defined_cases(spark, scratch):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((1500, 24)).astype(np.float32)
    points[100:140] = points[20]  # equal vectors, one of them a query
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0] * 3), (None, [1.0] * 24), (2080, []), (2100, [None] * 24), rows[40]]
    got = collections.defaultdict(list)
    for r in multiprobe.nearest(vectors(spark, rows), scratch).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    exact = points.astype(float) @ points.astype(float).T
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(f[2] == pytest.approx(exact[q, f[1]], abs=1e-12) for f in found)
        order = [j for j in np.lexsort((np.arange(1500), -exact[q])) if j != q][:20]
        hit += len(set(order) & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(got)
    assert [f[1] for f in got[20]] == list(range(100, 120))


def test_multiprobe_few_candidates(spark, scratch):
    got = multiprobe.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), scratch).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 1)]
    assert multiprobe.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


def test_probe_order_is_by_cost_and_valid():
    sets = multiprobe.probe_order(5, 60)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets)
    assert all(not (s[j] and s[9 - j]) for s in sets for j in range(5))


# 5: secrets

SECRET_ROWS = [
    (0, None, None, None), (1, "", None, None), (2, 'Token = "abc123DEF" and password:short pass api_key=\'AAAA-BBBB\'', None, None),
    (3, "secret=token=abcdefgh token: token = \"abcdefgh\"", None, None), (4, "AKIA" + "A1" * 8 + " xAKIA" + "B2" * 10 + " AKIASHORT", None, None),
    (5, "é " + "0123456789abcdef" * 2 + "G deadbeef", None, None), (6, "ſecret=abcdefghi \u212aey toKen=12345678", None, None),
    (7, "passwd \n = abcdef1 passwd   :  'abcdef1'", None, None),
]


def brute_spans(t):
    out = []
    for k, name, p in (
        (0, "assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), (1, "access", r"AKIA[A-Z0-9]+"), (2, "hex", r"[0-9a-f]+"),
    ):
        for m in re.finditer(p, t, re.ASCII):
            if (len(m[2]) >= 6) if k == 0 else m.end() - m.start() >= (20, 24)[k - 1]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_secret_base_spans(spark):
    docs = table(spark, SECRET_ROWS)
    got = {r["doc_id"]: r for r in secrets.scan(docs, secrets.train(docs), F.col("doc_id")).collect()}
    assert len(got) == len(SECRET_ROWS)
    for i, t, *_ in SECRET_ROWS:
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("markov")] == want


def test_markov_models_add_random_strings_only(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    draw = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, f"{prose(i, 80)} token={draw(32)} someLongIdentifierNameInCamelCase connection_pool_size_limit", None, None) for i in range(80)]
    hidden = draw(40)
    rows += [(900, f"see {hidden} here", None, None), (901, "see connection_pool_size_limit_for_all_someLongIdentifierName here", None, None)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.train(docs), F.col("doc_id")).collect()}
    assert got[900] == "markov:4:44" and got[901] == "" and "markov" not in "".join(got[i] for i in range(80))
    clean = {r["doc_id"]: r for r in secrets.masked(docs, secrets.train(docs)).collect()}
    assert clean[900]["text"] == "see [SECRET] here" and clean[900]["n_chars"] == 17 and clean[900]["word"] == "x" and clean[901]["text"] == rows[-1][1]


def test_secrets_empty(empty):
    assert secrets.scan(empty, secrets.train(empty), F.col("doc_id")).count() == 0


def test_ends_of_a_run_that_a_pattern_covers_are_reported():
    every = secrets.Model(np.full(secrets.SYMBOLS**3, 9.0, np.float32))
    middle = "0123456789abcdef0123456789abcd"
    text = "é Zx9Qw7Lr2Tn5" + middle + "Vb8Yc3Mk6Pj1Hd4GfQ."
    assert secrets.all_spans(text, every) == [(2, 3, 13), (13, 2, 44), (44, 3, 62)]  # the last digit before them is a hex digit too
    none = secrets.Model(np.full(secrets.SYMBOLS**3, -9.0, np.float32))
    assert secrets.all_spans(text, none) == [(13, 2, 44)]
    # only characters of the random alphabet gain: a word beside a secret is no secret
    ratio = np.full((secrets.SYMBOLS,) * 3, -1.0, np.float32)
    ratio[:, :, [i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") if c in "0123456789abcdef"]] = 5.0
    mixed = "slow_run/" + middle + "/9f8e7d6c"
    assert secrets.all_spans(mixed, secrets.Model(ratio.reshape(-1))) == [(9, 2, 39), (39, 3, 48)]
    # two overlapping patterns count as one cover; every character is reported once
    both = "password=AKIA" + "Z" * 20 + " " + "Q" * 20
    spans = secrets.all_spans(both, every)
    assert [k for _, k, _ in spans] == [0, 1, 3] and spans[2][0] == both.index("Q" * 20)


# 6: sharding

def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side**dims).select(*[((F.col("id") / side**j).cast("long") % side).cast("int").alias(f"c{j}") for j in range(dims)])
        rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"c{j}") for j in range(dims)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**dims))
        assert all(sum(abs(a[f"c{j}"] - b[f"c{j}"]) for j in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_hilbert_shards(awkward, spark, scratch):
    more = table(spark, [*AWKWARD, *[(1000 + i, prose(i, 1 + i % 50), ["en", "de"][i % 2], f"s{i % 5}") for i in range(400)], *[(5000 + i, "same text", "en", "hot") for i in range(150)]])
    got = hilbert.curve_shards(more, scratch, bucket_rows=16).collect()
    assert len(got) == more.count()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in more.collect())
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(8)) and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(r["size"] for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order)


def test_hilbert_empty(empty, scratch):
    assert hilbert.curve_shards(empty, scratch).count() == 0


# 7: decontamination

def brute_contamination(docs, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    out = []
    for i, t, *_ in docs:
        w, hit, own = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    hit.update(range(p, p + n))
                    own |= found
        own.discard(None)
        out.append((i, len(w), len(hit), len(own), ",".join(sorted(map(str, own))), bool(hit)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_winnowing_matches_brute_force(spark, scratch, short):
    rng = np.random.default_rng(7)
    items = [(i, prose(700 + i, 10 + 3 * i)) for i in range(12)] + [(3, prose(703, 25)), (50, None), (51, "..."), (None, prose(799, 14)), (60, prose(704, 22))]
    if short:
        items += [(70, "alpha beta gamma"), (71, "Gamma-delta"), (72, "unseen words here"), (73, prose(90, 9))]
    rows = list(AWKWARD)
    for i in range(60):
        w = prose(i, 40).split()
        source = (items[i % 12][1] or "").split()
        n = int(rng.integers(6, 14))
        at, p = int(rng.integers(0, 40)), int(rng.integers(0, max(1, len(source) - n)))
        rows.append((100 + i, " , ".join([*w[:at], *source[p : p + n], *w[at:]]).title(), "en", "a"))
    rows.append((999, prose(799, 14), "en", "a"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = winnow.decontaminate(table(spark, rows), bench, scratch).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, brute_contamination(rows, items)))


def test_winnowing_empty(awkward, empty, spark, scratch):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not winnow.decontaminate(awkward, none, scratch).where("contaminated or n_items > 0").count()
    assert winnow.decontaminate(empty, none, scratch).count() == 0


# 8: language

def test_language_id_on_held_out_rows(spark):
    worlds = {"aa": "lorem ipsum dolor amet", "bb": "über straße schön größe", "cc": "été garçon naïve cœur"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(worlds[g].split(), 12)), g, g) for i, g in enumerate(list(worlds) * 60)]
    rows += [(900, None, "aa", "a"), (901, "123 ...", "bb", "b"), (902, "straße", None, None), (None, "garçon", "cc", None)]
    got = {r["doc_id"]: r for r in langid.predict_languages(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, g, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if i in (900, 901) else g or "bb")


def test_language_id_without_labels(empty, spark):
    assert langid.predict_languages(empty).count() == 0
    r = langid.predict_languages(table(spark, [(1, "words", None, None), (2, None, None, None)])).collect()
    assert {(x["lang_pred"], x["score"]) for x in r} == {("und", 0.0)}


def test_temperature_and_elastic_net():
    logits = np.array([[4.0, 0.0], [0.0, 4.0], [4.0, 0.0], [4.0, 0.0]])
    hot = langid.temperature(logits, np.array([0, 1, 0, 1]))
    assert hot > langid.temperature(logits, np.array([0, 1, 0, 0])) and langid.temperature(logits[:0], np.zeros(0, int)) == 1.0
    x = np.array([1.0, 0.001])
    w = langid.ftrl([(np.array([0, 1]), x, y) for y in (0, 0, 0)], 2, langid.Training(l1=0.05))
    assert w[0].any() and not w[1].any()


# 9: licenses

def test_license_spans_and_coverage(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    long = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    w = long.split()
    rows = [
        (0, None, None, None), (1, "", None, None), (2, f"{prose(1, 50)}\n{mit}", None, None), (3, f"é {mit} x {gpl} {mit}", None, None),
        (4, " ".join(w[:6] + ["also"] + w[6:12] + w[13:]), None, None), (5, " ".join(w[:10]), None, None), (6, "under the license of version 3 the work", None, None), (7, mit.upper(), None, None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, rows), F.col("doc_id")).collect()}
    text = {i: t for i, t, *_ in rows}
    spans = lambda i: [(m.split(":")[0], float(m.split(":")[1]), text[i][int(m.split(":")[2]) : int(m.split(":")[3])]) for m in got[i]["matches"].split(",") if m]
    assert len(got) == len(rows) and [got[i]["n_matches"] for i in (0, 1, 5, 6)] == [0, 0, 0, 0]
    assert spans(2) == [("MIT", 1.0, mit[:-1])] and spans(7) == [("MIT", 1.0, mit[:-1].upper())]
    assert spans(3) == [("MIT", 1.0, mit[:-1]), ("GPL-3.0", 1.0, gpl[:-1]), ("MIT", 1.0, mit[:-1])] and got[3]["licenses"] == "GPL-3.0,MIT"
    (name, coverage, span), = spans(4)
    assert name == "BSD-3-Clause" and 0.9 < coverage < 1 and span == text[4]


def slow_align(template, ids, low, high, required):
    """Cell by cell: (matched, first, last, score, bits) of the best local alignment inside the band."""
    best, above = (0, 0, 0, 0, 0), {}
    for r, t in enumerate(template):
        row = {}
        for j in range(max(0, low[r]), min(len(ids), high[r])):
            points, matched, first, seen = above.get(j - 1, (0, 0, j, 0))
            cell = (points + 2, matched + 1, first, seen | required.get(t, 0)) if ids[j] == t else (points - 1, matched, first, seen)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
            if cell[:2] > best[:2] and cell[0] > 0:
                best = (*cell, j)
        above = row
    return best[1], best[2], best[4], best[0], best[3]


def test_license_alignment_equals_cell_by_cell():
    rng = np.random.default_rng(4)
    for _ in range(300):
        t, ids = rng.integers(1, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 40))
        low = np.arange(len(t)) + np.cumsum(rng.integers(-1, 2, len(t))) - 4
        high = low + rng.integers(0, 14, len(t))
        required = {1: 1, 3: 2}
        assert licenses.align(t, ids, low, high, required) == slow_align(t.tolist(), ids.tolist(), low.tolist(), high.tolist(), required)


def test_license_candidates_equal_aligning_everything():
    """The best template by a whole alignment, without index, chains or band, is what a scan finds."""
    scanner = licenses.Scanner()
    rng = np.random.default_rng(9)
    notices = [(n, w) for n, t in licenses.TEMPLATES if len(w := licenses.words(t)) <= licenses.NOTICE]
    for i in range(60):
        _, w = notices[i % len(notices)]
        w = [x.decode() for x in w]
        if len(w) > 12:
            del w[int(rng.integers(len(w)))]
        text = " ".join([prose(i, int(rng.integers(0, 30))), *w, prose(i + 1, 5)])
        ids = np.array([scanner.vocabulary.get(x, 0) for x in licenses.words(text)])
        best = []
        for n, t in enumerate(scanner.templates):
            if len(t) <= licenses.NOTICE:
                matched, first, last, score, seen = licenses.align(t, ids, np.zeros(len(t), int), np.full(len(t), len(ids)), scanner.required[n])
                others = [x for x in ids[first : last + 1].tolist() if x in scanner.marks and x not in scanner.required[n]]
                if matched >= licenses.COVERAGE * len(t) and seen == (1 << len(scanner.required[n])) - 1 and not others:
                    best.append((score, matched / len(t), scanner.names[n]))
        top = max(best)[:2] if best else None
        assert {m.license for m in scanner.scan(text)} & {n for *a, n in best if tuple(a) == top} or not best


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 3.0", "CC-BY-NC-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
    ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("Licensed under the Apache License, Version 1.1", None), ("This work is licensed under the GNU General Public License, version 4", None),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", None),
])
def test_license_siblings(text, want):
    assert [m.license for m in licenses.Scanner().scan(f"Words before. {text}. More after")] == ([want] if want else [])


@pytest.mark.parametrize("name", licenses.BODIES)
def test_license_bodies(name):
    """Whole, with a gap, and (whole licenses) with a long insertion or without a tenth of it."""
    body = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    w = body.split()
    half, third, some = len(w) // 2, len(w) // 3, len(w) // 10
    cases = [w, w[:half] + w[half + 2 :]]
    if len(w) > 500:
        cases += [w[:half] + ["und"] * some + w[half:], w[:third] + w[third + some :]]
    for cut in cases:
        assert {m.license for m in licenses.Scanner().scan("Before it. " + " ".join(cut))} == {name}


def test_license_work_grows_with_the_text(monkeypatch):
    """A body several times in one text: each time one match, and cells in proportion."""
    body = max((t for n, t in licenses.TEMPLATES if n == "GPL-3.0"), key=len)
    scanner, cells, plain = licenses.Scanner(), [0], licenses.align
    monkeypatch.setattr(licenses, "align", lambda t, ids, low, high, req: (cells.__setitem__(0, cells[0] + int((high - low).sum())), plain(t, ids, low, high, req))[1])
    made = {}
    for times in (1, 2, 8):
        cells[0] = 0
        found = scanner.scan(" Then. ".join([body] * times))
        assert [(m.license, m.coverage) for m in found] == [("GPL-3.0", 1.0)] * times
        made[times] = cells[0]
    assert made[2] <= 2.2 * made[1] and made[8] <= 8.8 * made[1]
    notices = scanner.scan(" ".join(["Released under the MIT License."] * 3000))
    assert len(notices) == 3000 and {m.license for m in notices} == {"MIT"}


# 10: URLs

def slow_glob(g, s):
    return re.fullmatch("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g, re.S)), s, re.S) is not None


def test_glob_automaton_equals_regular_expressions():
    rng = np.random.default_rng(10)
    alphabet = list("ab/.é*?")
    globs = ["".join(rng.choice(alphabet, rng.integers(0, 8))) for _ in range(120)]
    texts = ["".join(rng.choice(list("ab/.éx"), rng.integers(0, 9))) for _ in range(300)] + ["", "a" * 500]
    assert np.array_equal(urlglob.GlobSet(globs).match(texts), [[slow_glob(g, t) for g in globs] for t in texts])


def test_url_rules(spark):
    urls = {
        1: None, 2: "no scheme.com/x", 3: "http://com/", 4: "http://EXAMPLE.com/en/a?b#c", 5: "https://www.Example.com/en/", 6: "https://x.www.example.com/en/z", 7: "http://a.net/es/1",
        8: "http://a.net/fr", 9: "http://org/x.com/", 10: "http://a.com", 11: "http://a.com?x=/", 12: "http://notexample.com/en/", 13: "http://spam-farm.example.org/en/1", 14: "x://y://z.net/fr/" + "q" * 2000, 15: "",
    }
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in urls.items()], "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlglob.judge_urls(pages).collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    for i, u in urls.items():
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.lower(), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i][:3] == (host, path, max(fits)[1] if fits else None), u
        assert got[i][3] == (max(fits)[2] if fits else "block" if i == 13 else "allow"), u
    assert urlglob.judge_urls(pages.where("false")).count() == 0


def test_copies_of_one_text_take_no_place_in_the_language_sample(spark):
    """20,000 copies of one text before the others change nothing, and learning twice gives the same model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    copies = spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("doc_id"), F.lit(docs.first()["text"]).alias("text"), F.lit(docs.first()["lang"]).alias("lang"))
    small = langid.Training(per_class=20)
    right = lambda m: langid.identify(docs, m, F.col("lang")).where("lang = lang_pred").count()
    one, two = langid.fit(copies.union(docs), small), langid.fit(copies.union(docs).repartition(7), small)
    assert right(one) >= right(langid.fit(docs, small)) - 2 and (one.weights == two.weights).all() and one.floor == two.floor > 0
