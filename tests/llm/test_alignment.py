"""Cross-tokenizer alignment against a two-pointer walk over single texts, and corpus counts against a dictionary."""

import collections
import hashlib

import pytest

pytest.importorskip("docloom.llm")
P = pytest.importorskip("public_tokenizers")

import numpy as np

from docloom.llm import alignment, base

PATHS = [P.path(f) for f in (alignment.A_FILE, alignment.B_FILE)]
DOCS = "doc_id long, text string, lang string, n_a string, pair int"
ODD = [" a", "a ", "a  b", "\ta b", "a\nb c", "a \n b", "日本 語テキスト😀 x", "x y z", "it's we'll don't", "<|endoftext|> </s> <unk> <0x41>", "▁a b", "\x01 b",
       "ﬁ ﬂ", "é é", "1234 5678.9", "²³ x²", "a　b", "'s 't", "​   a", "A\x1cB c", "a\x85 b", "one two, three. Four\nfive", "A" * 5000, "many words " * 3000]


@pytest.fixture(scope="module")
def plain():
    return alignment.TwoTokenizers(*PATHS)


def walk(both, text):
    """(groups as text, links as (a, b), number of groups, A tokens, B tokens), or None without tokens."""
    if not text:
        return None
    a, b, raw = both.a_ids(text), both.b.encode(text), (" " + text).encode()
    size = [[len(both.bytes[k][i]) for i in ids] for k, ids in enumerate((a, b))]
    if any(b"".join(both.bytes[k][i] for i in ids) != raw for k, ids in enumerate((a, b))):
        return None
    i = j = 0
    ends, groups, own, links = [size[0][0], size[1][0]], [], ([a[0]], [b[0]]), [(a[0], b[0])]
    while True:
        if ends[0] == ends[1]:
            groups.append("|".join(",".join(map(str, x)) for x in own))
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups), links, len(groups), len(a), len(b)
            ends, own = [ends[0] + size[0][i], ends[1] + size[1][j]], ([a[i]], [b[j]])
        elif ends[0] < ends[1]:
            i += 1
            ends[0] += size[0][i]
            own[0].append(a[i])
        else:
            j += 1
            ends[1] += size[1][j]
            own[1].append(b[j])
        links.append((a[i], b[j]))


def texts():
    rng = np.random.default_rng(4)
    alphabet = np.array(["a", "b", " ", " ", "\n", "'", "s", "1", ".", "é", "ß", "日", "\t", " ", "▁", "É", ",", "-", "<s>"])
    return ODD + ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(800)]


@pytest.mark.parametrize("ranks", [None, P.path(alignment.RANKS_FILE)])
def test_pieces_join_to_what_whole_texts_give(plain, ranks):
    both = alignment.TwoTokenizers(*PATHS, ranks)
    all_texts = texts()
    for at in range(0, len(all_texts), 40):
        part = all_texts[at : at + 40]
        for t, found in zip(part, both.texts(part), strict=True):
            want = walk(plain, t)
            assert (want is None) == (not found), t
            if want:
                got = np.frombuffer(b"".join(p.links for p in found), "<u4")
                assert ";".join(p.shown for p in found) == want[0] and [(int(x) >> 16, int(x) & 0xFFFF) for x in got] == want[1], t


def test_coalesce_and_overlaps_on_ranges_with_gaps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        kinds = []
        for _ in range(2):
            edges = np.sort(rng.choice(40, 2 * rng.integers(1, 9), replace=False))
            kinds.append((edges[::2], edges[1::2]))
        (a0, a1), (b0, b1) = kinds
        got = set(zip(*(x.tolist() for x in alignment.overlaps(a0, a1, b0, b1)), strict=True))
        assert got == {(i, j) for i in range(len(a0)) for j in range(len(b0)) if a0[i] < b1[j] and b0[j] < a1[i]}
        start, end = np.r_[a0, b0], np.r_[a1, b1]
        order, group = alignment.coalesce(start, end, np.repeat([0, 1], [len(a0), len(b0)]))
        ranges = [set(range(s, e)) for s, e in zip(start[order], end[order], strict=True)]
        for k in range(1, len(ranges)):
            assert (group[k] != group[k - 1]) == (not any(start[order[k]] < end[order[i]] for i in range(k)))


@pytest.mark.parametrize("kept", [1 << 20, 50, 0])
def test_documents_with_corpus_counts(spark, plain, kept):
    """Equal rows, nulls, long texts; all pairs travel, some of them, none."""
    rows = [(i, t, None, "x", 1) for i, t in enumerate(ODD)] + [(3, "one two three", "en", "x", 1), (3, "one two three", "en", "x", 1), (None, "three two one", None, None, None), (7, None, "en", None, 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    scratch = base.Scratch(spark)
    got = alignment.align_documents(docs, scratch, *PATHS, P.path(alignment.RANKS_FILE), kept_pairs=kept).collect()
    scratch.drop()
    found = [(i, walk(plain, t)) for i, t, *_ in rows]
    count = collections.Counter(p for _, w in found if w for p in w[1])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = []
    for i, w in found:
        if w is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            want.append((i, w[3], w[4], w[2], len(w[1]), sum(count[p] == top[p[1]] for p in w[1]), sum(count[p] for p in w[1]), hashlib.sha256(w[0].encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    empty = base.Scratch(spark)
    assert alignment.align_documents(docs.where("false"), empty, *PATHS, kept_pairs=kept).count() == 0
    empty.drop()
