"""Filter audit, lattice language model and resampling against plain versions."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.llm import filter_audit, lattice_lm, queries, resampling
from chatlake.llm.common import read

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, score string, part string, fails int, n_words string, word string"
ODD = [(1, None, None, "s", "p", 1, "w", "x"), (2, "", "", "s", "p", 1, "w", "x"), (None, "no id here at all", "en", None, None, None, None, None),
       (None, "no id here at all", "en", None, None, None, None, None), (3, "one two three four", "en", "s", "p", 1, "w", "x"),
       (3, "one two three four", "en", "s", "p", 1, "w", "x"), (4, "ONE # two THREE four", "de", None, None, None, None, None),
       (5, "\n\t  \x0b", "de", "s", "p", 1, "w", "x"), (6, "long text " * 20000 + "é▁" * 5000, "fr", "s", "p", 1, "w", "x"),
       (7, "one two three four", None, "s", "p", 1, "w", "x"), (8, " ".join(f"w{i}" for i in range(150)), "fr", "s", "p", 1, "w", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# ---- 11 filter audit ----
def plain_audit(docs, labels):
    """Every order applied to every document, one after the other."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = collections.defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            re.search(r"[#$%&*|]", t), d is not None and first[t] < d]) if bad}
        q, x = labels.get(d, (0, 0)) if d is not None else (0, 0)
        parts[lang or ""].append((fails, q == 1, x == 1))
    out = {}
    for part, rows in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                out[part, order, k + 1] = [len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows),
                                           sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audited(rows):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}


def test_audit_equals_every_order_run(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in read(spark, SF, "documents").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in read(spark, SF, "labels").collect()}
    assert audited(queries.QUERIES["op11_filter_audit"](spark, SF).collect()) == plain_audit(docs, labels)


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.flagged(odd, labels)).collect()
    want = plain_audit([r[:3] for r in ODD], {1: (1, 1), 3: (1, 0), 4: (0, 1)})
    assert len(got) == 4 * 600 and audited(got) == want
    assert filter_audit.audit(filter_audit.flagged(odd.limit(0), labels.limit(0))).collect() == []


def test_audit_without_labels_keeps_zeros(odd):
    spark = odd.sparkSession
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(filter_audit.flagged(odd, none)).collect())
    assert got == plain_audit([r[:3] for r in ODD], {})


def test_path_counts_are_factorials():
    reach, leave = filter_audit.path_counts(5)
    for s in range(32):
        k = s.bit_count()
        assert (reach[s], leave[s]) == (math.factorial(k), math.factorial(5 - k))


def test_audit_rejects_too_many_filters(odd):
    with pytest.raises(ValueError):
        filter_audit.audit(odd, "ABCDEFGH")


# ---- 12 lattice language model ----
SMALL = {b" a": -1.0, b" ": -2.0, b"a": -1.5, b"ab": -1.0, b"b": -2.5, b"ba": -0.7, b"\n": -1.2}


def spellings(s, pieces):
    if not s:
        return [0.0]
    return [pieces[s[:n]] + rest for n in range(1, min(3, len(s)) + 1) if s[:n] in pieces for rest in spellings(s[n:], pieces)]


@given(st.lists(st.text("ab", max_size=7), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_marginals_sum_all_segmentations(words):
    words = [w.encode() for w in words]
    names = sorted(SMALL)
    lattice = lattice_lm.Lattice(names, [SMALL[p] for p in names])
    want = [math.log(sum(map(math.exp, spellings(b" " + w + b"\n", SMALL)))) for w in words]
    assert np.allclose(lattice.marginals(words), want)
    assert np.allclose([lattice.long_marginal(w) for w in words], want)


def paths(s, pieces):
    if not s:
        return [[]]
    return [[s[:n], *rest] for n in range(1, min(3, len(s)) + 1) if s[:n] in pieces for rest in paths(s[n:], pieces)]


def test_expected_uses_are_posterior_counts():
    names = sorted(SMALL)
    lattice = lattice_lm.Lattice(names, [SMALL[p] for p in names])
    words = [b"", b"abab", b"ba", b"bab"]
    want = collections.Counter()
    for w in words:
        own = paths(b" " + w + b"\n", SMALL)
        p = [math.exp(sum(SMALL[x] for x in path)) for path in own]
        for path, share in zip(own, p):
            for x in path:
                want[x] += share / sum(p)
    assert np.allclose(lattice.expected(words), [want[p] for p in names])


def test_spellings_are_a_distribution():
    # all words of up to 9 letters of a closed alphabet: their mass stays below one and nears it
    names = [b" ", b" a", b"a", b"ab", b"b", b"\n"]
    lattice = lattice_lm.Lattice(names, lattice_lm.normalised(names, [1, 1, 1, 1, 1, 4]))
    words = ["".join(w).encode() for n in range(10) for w in itertools.product("ab", repeat=n)]
    assert 0.97 < np.exp(lattice.marginals(words)).sum() < 1 + 1e-9


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def plain_scores(docs, rounds):
    """One document after the other, with whole-corpus counts in a dict."""
    split = lambda t: lattice_lm.words_of((t or "").encode())
    c = collections.Counter(w for d, t in docs if not held(d) for w in split(t))
    ends = sum(not held(d) for d, _ in docs)
    words, kinds = sum(c.values()), len(c)
    tokens, distinct = words + ends, kinds + (ends > 0)
    prior = lattice_lm.vocabulary(VOCABULARY)
    names = sorted(prior)
    start = np.exp(lattice_lm.normalised(names, np.exp([prior[p] for p in names])))
    weights = np.log(start)
    for _ in range(rounds if kinds else 0):
        parts = [w[i:i + lattice_lm.LONG] for w in c for i in range(0, len(w), lattice_lm.LONG)]
        weights = lattice_lm.normalised(names, start * lattice_lm.PRIOR / 2 + lattice_lm.Lattice(names, weights).expected(parts))
    lattice = lattice_lm.Lattice(names, weights)
    once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
    cut = once / (once + 2 * twice) if once and twice else 0.5
    stop = (ends + 0.5) / (tokens + 1)
    out = []
    for d, t in docs:
        own = split(t)
        base = sum(math.log10((c[w] + 1) / (tokens + distinct + 1)) for w in own) + math.log10((ends + 1) / (tokens + distinct + 1))
        score = math.log10(stop)
        for w in own:
            spelled = lattice.long_marginal(w)
            if words:
                whole = max(c[w] - cut, 0) / words
                score += (math.log(whole + cut * kinds / words * math.exp(spelled)) if whole else math.log(cut * kinds / words) + spelled) / math.log(10)
            else:
                score += spelled / math.log(10)
            score += math.log10(1 - stop)
        out.append((d, held(d), len(own) + 1, sum(c[w] > 0 for w in own) + (ends > 0), tokens, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6)


def test_lm_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    got = queries.QUERIES["op12_lattice_lm"](spark, SF).collect()
    assert len(got) == len(docs)
    close(got, plain_scores(docs, lattice_lm.ROUNDS))


def test_lm_learns_spelling(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    mean = {}
    for rounds in (0, 2):
        rows = [r for r in lattice_lm.lm_scores(docs, VOCABULARY, rounds=rounds).collect() if r["held_out"]]
        mean[rounds] = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert mean[2] > mean[0] + 0.5


def test_lm_of_odd_rows(spark, odd):
    got = lattice_lm.lm_scores(odd, VOCABULARY, rounds=1).collect()
    close(got, plain_scores([r[:2] for r in ODD], 1))
    assert lattice_lm.lm_scores(odd.limit(0), VOCABULARY).collect() == []
    # nothing but held-out rows: the vocabulary's own scores
    alone = [d for d in range(100) if held(d)][:2]
    rows = spark.createDataFrame([(alone[0], "a text of words"), (alone[1], None)], "doc_id long, text string")
    close(lattice_lm.lm_scores(rows, VOCABULARY).collect(), plain_scores([(alone[0], "a text of words"), (alone[1], None)], 0))


def test_lm_blocks_share_counts(spark, monkeypatch):
    rows = [(i, f"common word{i % 7} own{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    close(lattice_lm.lm_scores(df, VOCABULARY, rounds=1).collect(), plain_scores(rows, 1))


# ---- 13 resampling ----
def plain_resample(docs, target, percent=10, least=20, seed=2024, n=1, buckets=10_000):
    def grams(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [grams(t) for _, t in docs]
    s, t = collections.Counter(b for _, g in own for b in g), collections.Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for (d, _), (words, g) in zip(docs, own):
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'NULL' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resample_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    target = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    assert drawn(queries.QUERIES["op13_resampling"](spark, SF)) == plain_resample(docs, target)


@pytest.mark.parametrize("n,percent", [(1, 50), (3, 100)])
def test_resample_of_odd_rows(spark, odd, n, percent):
    target = spark.createDataFrame([("one two THREE",), (None,), ("",)], "text string")
    got = resampling.resample(odd, target, percent=percent, least_words=4, most_words=n, buckets=50)
    assert set(odd.columns) <= set(got.columns)
    assert drawn(got) == plain_resample([r[:2] for r in ODD], ["one two THREE"], percent, 4, n=n, buckets=50)
    none = resampling.resample(odd.limit(0), target.limit(0))
    assert none.collect() == [] and none.columns == got.columns


def test_resample_with_one_hot_score(spark):
    # a third of the rows are one id and text, so they tie in score and id
    rows = [(0, "same words here")] * 400 + [(i, f"word{i % 5} here and there") for i in range(1, 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("here and word1",)], "text string")
    assert drawn(resampling.resample(df, target, percent=60, least_words=1)) == plain_resample(rows, ["here and word1"], 60, 1)


@given(st.text(st.sampled_from("aB1 \n.é-"), max_size=40), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_overlapped_scan_is_every_run_of_words(text, n):
    flat = resampling.folded(text.encode())
    w = flat.split()
    want = [zlib.crc32(b" ".join(w[i:i + k])) % 97 for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    assert resampling.buckets_of(flat, resampling.scanners(n), 97).tolist() == want
