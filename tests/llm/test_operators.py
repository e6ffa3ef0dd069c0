"""The training-data operators against plain versions, on the small tables and on
rows with NULLs, empty and repeated texts, ties and clashing column names."""

import gzip
import hashlib
import io
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlake.llm import (ball_tree, chat_format, decontaminate, line_dedup, mixing, queries, sharding, simhash,
                          token_records, toxicity, warc)
from chatlake.llm.common import read, word_count
from chatlake.sources.tables import TEST_TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, shard int, score string, n_hit string, host string"
ODD = [(1, None, "a", "x", 9, "s", "h", "q"), (2, "", "a", "x", 9, "s", "h", "q"), (None, "no id here at all", None, None, None, None, None, None),
       (3, "one two three four", "b", "x", 9, "s", "h", "q"), (3, "one two three four", "b", "x", 9, "s", "h", "q"),
       (4, "One TWO three four", "b", None, 9, "s", "h", "q"), (5, "\n\t  \x0b", None, "x", 9, "s", "h", "q"),
       (6, "long text " * 20000, "é", "x", 9, "s", "h", "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(queries.ORACLE[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


# ---- 1 line dedup ----
def test_lines_on_odd_pages(spark):
    rows = [(i, "http://Site.example/x", f"<p>menu</p><p>text {i}</p>", "c") for i in range(8)]
    rows += [(8, None, "<p>menu</p>", "c"), (9, "no url", None, "c"), (10, "http://u@other.example:80/", "", "c"), (None, "http://other.example", "<p>menu", "c"),
             (11, "http://other.example/", "<p>a</p>" * 3000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in line_dedup.line_dedup(pages).collect()}
    assert len(got) == len(rows)
    assert (got[3]["clean_text"], got[3]["n_dropped"], got[3]["host"]) == ("text 3", 1, "site.example")
    assert (got[8]["clean_text"], got[8]["host"]) == ("menu", None)
    assert (got[9]["clean_text"], got[9]["n_lines"]) == ("", 0)
    assert got[None]["clean_text"] == "menu" and got[10]["host"] == "other.example"
    assert got[11]["n_lines"] == 3000 and got[11]["n_dropped"] == 0
    assert line_dedup.line_dedup(pages.limit(0)).collect() == []


# ---- 2 sharding ----
def check_shards(rows, shards, largest):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * largest + 0.01 * sum(sizes) / shards


def test_shards_are_even(spark):
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    check_shards(rows, 8, max(r["size"] for r in rows))


def test_shards_split_a_group_of_equal_texts(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "same words").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    check_shards(sharding.shard_by_bytes(docs).collect(), 8, 12)


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {c.split()[0] for c in DOCS.split(", ")} | {"slot"}
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard_by_bytes(empty).collect() == []


# ---- 3 top k ----
def test_top_k_with_ties_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(700)] + [(i, [3, 3, 3, 3, 3, 3]) for i in range(700, 1000)]
    rows += [(1000, None), (1001, [1, None, 2, 3, 4, 5]), (None, [3, 3, 3, 3, 3, 3]), (1002, [1, 2]), (1050, [3, 4])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = ball_tree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard_rows=200).collect()
    want = set()
    whole = [(i, x) for i, x in rows if i is not None and x is not None and None not in x]
    for q, x in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(x) == len(y))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ball_tree.top_k(v.limit(0), v.limit(0), 5).collect() == []


def test_usable_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan")],), ([float("inf")],), ([None],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(ball_tree.usable(F.col("v"))).collect()] == [True, False, False, False, False]


# ---- 4 token records ----
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(vocabulary, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_records_equal_the_library(spark, vocabulary):
    rows = queries.QUERIES["op4_token_records"](spark, SF).orderBy("start").collect()
    docs = sorted((r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect())
    start = 0
    for r, (doc_id, _), ids in zip(rows, docs, plain_ids(vocabulary, [t for _, t in docs]), strict=True):
        ids = ids + [0]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return token_records.Encoder(vocabulary)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab Z.,'\n\té 1\xa0!–" + chr(0x200b) + "你", max_size=40)), max_size=6))
def test_pieces_equal_whole_texts(encoder, texts):
    assert encoder.encode(texts) == [encoder.whole([t])[0] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "ab", "é", "."]), max_size=8).map("".join), max_size=4))
def test_added_tokens_equal_the_library(vocabulary, encoder, texts):
    texts = [*texts, "a <|endoftext|> b", "<|endoftext|>", "no token here"]
    assert encoder.encode(texts) == [np.array(ids, "<u2").tobytes() for ids in plain_ids(vocabulary, texts)]
    assert np.frombuffer(encoder.encode(["<|endoftext|>"])[0], "<u2").tolist() == [50256]


def test_records_of_odd_rows_and_shuffled_reads(spark, odd, empty, vocabulary, monkeypatch):
    path = token_records.write_records(odd, vocabulary)
    index = token_records.write_index(spark, path)
    rows = index.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6] and rows[1]["n_tokens"] == 1
    got = token_records.read_shuffled(spark, path, index, seed=3).collect()
    want = {(r[0], tuple([*ids, 0])) for r, ids in zip(ODD, plain_ids(vocabulary, [r[1] for r in ODD]))}
    assert {(r["doc_id"], tuple(r["ids"])) for r in got} == want and len(got) == len(ODD)
    assert token_records.write_index(spark, token_records.write_records(empty, vocabulary)).collect() == []


def test_damage_is_found():
    data = token_records.frame(b"abc") + token_records.frame(b"") + token_records.frame(b"de")
    assert [p for _, _, p in token_records.frames(data)] == [b"abc", b"de"]
    for i in range(len(data)):
        bad = data[:i] + bytes([data[i] ^ 4]) + data[i + 1:]
        with pytest.raises(ValueError):
            list(token_records.frames(bad))


# ---- 5 decontamination ----
def test_windows_on_odd_rows(spark, empty):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([("a", " ".join(words[:12])), ("b", "Short ITEM"), ("c", None), ("d", "..."), ("a", "other words"), (None, "no name")], "item_id string, text string")
    texts = [" ".join(words), "x " + ", ".join(words[1:12]).upper() + " y", " ".join(words[:9]), "a short--item é", "shorts item", None, "", "no name; OTHER words"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in decontaminate.scan_documents(docs, bench).collect()}
    assert [got[i]["n_hit"] for i in range(8)] == [12, 11, 0, 2, 0, 0, 0, 4]
    assert [got[i]["n_words"] for i in range(8)] == [30, 13, 9, 4, 2, 0, 0, 4]
    s = got[1]["spans"][0]
    assert texts[1][s["start"]:s["end"]] == texts[1][2:-2]
    assert got[7]["items_sha256"] == hashlib.sha256(b"a,null").hexdigest() and got[7]["n_items"] == 2
    parts = {r["doc_id"]: r for r in decontaminate.scan_documents(docs, bench, part_bytes=20).collect()}
    assert parts == got
    assert decontaminate.clean(docs, bench).orderBy("doc_id").collect() == [r for r in docs.collect() if got[r["doc_id"]]["n_hit"] == 0]
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan_documents(empty, bench).collect() == []


def test_short_window_inside_a_long_one(spark):
    words = [f"w{i}" for i in range(14)]
    bench = spark.createDataFrame([("long", " ".join(words[:12])), ("short", "w5 w6"), ("end", "w10 w11 w12")], "item_id string, text string")
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[3:8])), (2, " ".join(words[1:13]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan_documents(docs, bench).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in range(3)] == [(13, 3), (2, 1), (12, 3)]
    assert [[s["end"] for s in got[i]["spans"]] for i in (0, 2)] == [[len(" ".join(words[:13]))], [len(" ".join(words[1:13]))]]


# ---- 6 chat ----
_PARTS = st.lists(st.sampled_from([chat_format.START, chat_format.END, "<", "\\", "|", "\n", "a", "<|", "assistant", "im_end|>"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(_PARTS, _PARTS), max_size=4))
def test_turns_parse_back(turns):
    text = "".join(chat_format.render(r, t) for r, t in turns)
    got = chat_format.parse(text)
    assert [g[:2] for g in got] == turns
    assert [chat_format.unescape(text[a:z]) for _, _, a, z in got] == [t for _, t in turns]


def test_chat_of_odd_rows(spark, monkeypatch):
    rows = [(1, 2, "assistant", "yes", 1), (1, 1, "user", None, 1), (None, 1, None, "x", 1), (2, 1, "assistant", "a", 1), (2, 1, "assistant", "a", 1), (2, None, "user", "<|im_end|>", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nyes\n") and got[1]["loss_sha256"] == sha("yes")
    assert got[2]["turns_sha256"] == sha("user\n<|im_end|>\nassistant\na\nassistant\na\n") and got[2]["loss_chars"] == 2
    assert got[None]["n_turns"] == 1 and len(got) == 3
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).collect() == []


# ---- 7 WARC ----
def test_ranges_of_any_size_give_each_record_once():
    records = [warc.encode_record(i, "http://x/é", zlib.compress(b"%d" % i) * i + warc.MAGIC, None) for i in range(40)]
    data = b"".join(warc.member(r) + warc.EMPTY_MEMBER for r in records)
    assert gzip.decompress(data) == b"".join(records)
    for n in (7, 100, 999, len(data)):
        got = [r for a in range(0, len(data), n) for r in warc.read_range(io.BytesIO(data), a, min(a + n, len(data)), len(data))]
        assert got == records
    with pytest.raises(ValueError):
        list(warc.read_range(io.BytesIO(data[:-40]), 0, len(data) - 40, len(data) - 40))


def test_archives_of_other_writers():
    """Versions other than 1.0, gzip headers with long names, loose header lines;
    what is no archive is an error, not an empty result."""
    def named(record, name):
        plain = warc.member(record)
        return plain[:3] + b"\x08" + plain[4:10] + name + b"\0" + plain[10:]
    records = [b"WARC/1.1\r\nWARC-Type:response\r\nloose\r\nX-Note: a\r\n b\r\nContent-Length: 9\r\n\r\nh\r\n\r\nbody\r\n\r\n" for _ in range(6)]
    data = b"".join(named(r, b"n" * n) for r, n in zip(records, (0, 1, 1500, 70_000, 5, 200_000)))
    for n in (50, 4096, 100_000, len(data)):
        got = [r for a in range(0, len(data), n) for r in warc.read_range(io.BytesIO(data), a, min(a + n, len(data)), len(data))]
        assert got == records
    fields = warc.decode_record(records[0])
    assert (fields["warc-type"], fields["x-note"], fields["payload"]) == ("response", "a b", b"body")
    for other in (b"WARC/1.0\r\nplain", warc.member(b"WARC/2.0\r\nother"), warc.member(b"text"), b"\x1f"):
        with pytest.raises(ValueError):
            list(warc.read_range(io.BytesIO(other), 0, len(other), len(other)))


def test_warc_of_odd_rows(spark):
    rows = [(1, "u", "same", "c"), (2, None, "same", "c"), (3, "u", None, "c"), (4, "u", "", "c"), (None, "a b", "same", "c"), (None, "u", "x", "c"), (None, "u", "x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.read_warc(spark, warc.write_warc(pages), range_bytes=64).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=key) == sorted(
        [(1, "revisit", 2, 4), (2, "response", None, 4), (None, "revisit", 2, 4), (3, "revisit", 4, 0), (4, "response", None, 0),
         (None, "response", None, 1), (None, "response", None, 1)], key=key)
    few = warc.read_warc(spark, warc.write_warc(pages, min_bytes=5)).where("record_type = 'revisit'")
    assert few.count() == 0 and warc.read_warc(spark, warc.write_warc(pages.limit(0))).collect() == []


# ---- 8 mixing ----
def reshared(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            return target


def test_mix_meets_its_targets(spark):
    rows = queries.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(texts) and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = reshared(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * want[s] and r["source_size"] == sizes[s] for r in own)
        rate = want[s] / sizes[s]
        assert all(int(rate) <= r["copies"] <= int(np.ceil(rate)) and r["taken"] == r["copies"] * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
    again = queries.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_keeps_every_documents_mean(spark):
    rows = spark.createDataFrame([(i, s, 1 + i % 7) for i in range(40) for s in ("a", "b")], "doc_id long, source string, size long")
    total, runs = {}, 5
    for seed in range(runs):
        for r in mixing.plan_mix(rows, seed).collect():
            total[r["source"]] = total.get(r["source"], 0) + (r["copies"] - r["target"] / r["source_size"])
    assert all(abs(v) / (40 * runs) < 0.15 for v in total.values())


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.plan_mix(mixing.sized(odd)).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(0 <= r["copies"] <= 2 for r in rows) and len({r["row"] for r in rows}) == len(ODD)
    want = {}
    for r in rows:
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    count = {}
    for r in out.select("doc_id", "source", word_count(F.col("text")).alias("n")).collect():
        count[tuple(r)] = count.get(tuple(r), 0) + 1
    assert count == {k: v for k, v in want.items() if v}
    assert mixing.mix(empty).collect() == [] and mixing.plan_mix(mixing.sized(empty)).collect() == []


# ---- 9 SimHash ----
def plain_fingerprint(text):
    import xxhash
    words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_all_pairs(spark):
    docs = {r["doc_id"]: plain_fingerprint(r["text"]) for r in read(spark, SF, "documents").collect()}
    want = reach(sorted(docs), lambda a, b: (docs[a] ^ docs[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {d: (f"{docs[d]:016x}", want[d]) for d in docs}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_reach_what_all_pairs_reach(spark, distance):
    rng = np.random.default_rng(distance)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 62)) * 4
        for _ in range(14):
            fps.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)).collect()}
    want = reach(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
    assert {f: got.get(f, f) for f in signed} == want


def test_long_chains_contract(spark):
    edges = spark.range(1, 300).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).collect() == []


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("4", 3), ("5", 1), ("6", 6), ("None", None)]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "None"]
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


# ---- 10 toxicity ----
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op10_toxicity"](spark, sf).join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    rank = np.argsort(np.argsort([r["score"] for r in held])) + 1
    y = np.array([r["toxic"] for r in held])
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.02


def test_held_out_labels_and_odd_rows_do_not_matter(spark, odd, empty):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    labels = read(spark, SF, "labels").select("doc_id", "toxic")
    w, b = toxicity.train(docs, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    w2, b2 = toxicity.train(docs, turned.unionAll(spark.createDataFrame([(None, 1), (10**9, 1), (2, None), (3, 7)], labels.schema)))
    assert np.allclose(w, w2, atol=1e-5) and abs(b - b2) < 1e-5
    out = toxicity.score(odd, (w, b))
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) <= set(out.columns)
    assert toxicity.clean(odd, labels).columns == odd.columns and toxicity.clean(odd, labels).first()["score"] == "s"
    assert toxicity.clean(empty, labels).collect() == []
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).where("predicted = 1").count() == 0


def test_toxicity_of_a_rare_class_in_a_bounded_sample(spark):
    words = ["green", "river", "paper", "window", "garden", "seven", "market", "silent"]
    rows = [(i, " ".join(words[(i * k + k) % 8] for k in range(1, 9)) + (" vile wretched scum" if i % 500 == 7 else ""), int(i % 500 == 7))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), max_rows=40)
    scored = toxicity.score(df, model).collect()
    assert np.any(model[0]) and min(r["score"] for r in scored if r["toxic"]) > max(r["score"] for r in scored if not r["toxic"])
    only = toxicity.train(df.where("toxic = 0"), df.select("doc_id", "toxic"), max_rows=40)
    assert not np.any(only[0]) and only[1] < 0


def test_sample_rates_of_the_classes():
    assert toxicity.rates({0: 900, 1: 100}, 12_000) == {0: 1, 1: 1}
    got = toxicity.rates({0: 11_999_988, 1: 12}, 12_000)
    assert got[1] == 1 and got[0] == 11_988 / 11_999_988
    assert toxicity.rates({0: 60_000, 1: 24_000}, 12_000) == {0: 0.1, 1: 0.25}


def test_toxicity_counts_what_few_rows_hold(spark):
    rows = [(i, f"a plain line number {i} of the garden" + (" vile wretched scum" if i % 20 == 0 else ""), int(i % 20 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = df.where("toxic = 1").where(~toxicity.held_out(F.col("doc_id"))).count()
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    scored = toxicity.score(df, model).collect()
    assert 2 <= seen <= 7 and model[0][toxicity.grams("vile wretched scum")].max() > 0
    assert min(r["score"] for r in scored if r["toxic"]) > max(r["score"] for r in scored if not r["toxic"])


def test_toxicity_recall_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    held = queries.QUERIES["op10_toxicity"](spark, sf).where("held_out").join(
        read(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id").collect()
    assert len(held) > 50 and np.mean([r["predicted"] for r in held]) > 0.6


def test_a_vocabulary_with_another_splitter_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = token_records.Encoder(path), Tokenizer.from_file(path)
    texts = ["", "Hello, World. hello", "two  blanks", "line\nfeed Café", "<|endoftext|> end"]
    ids = [np.frombuffer(x, dtype=f"<u{encoder.width}").tolist() for x in encoder.encode(texts)]
    assert not encoder.by_pieces and ids == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_a_full_piece_table_changes_no_ids(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}. next, WORD{chr(97 + i % 26)}... é{chr(97 + i % 7)},\nline" for i in range(300)]
    want = token_records.Encoder(path).whole(texts)
    monkeypatch.setattr(token_records, "TABLE_BYTES", 2000)
    encoder = token_records.Encoder(path)
    assert [x for a in range(0, 300, 7) for x in encoder.encode(texts[a:a + 7])] == want


def test_files_are_ordered_by_number(spark):
    import shutil

    import public_tokenizers

    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(4)], "doc_id long, text string")
    path = token_records.write_records(docs.where("doc_id < 2"), public_tokenizers.path("byte_bpe_50k.json"))
    later = token_records.write_records(docs.where("doc_id >= 2"), public_tokenizers.path("byte_bpe_50k.json"))
    fs = spark.sparkContext._jvm.java.io.File
    for folder, number in ((path, "99999"), (later, "100000")):
        own, = [n for n in fs(folder).list() if n.startswith("part-")]
        shutil.copy(f"{folder}/{own}", f"{path}/part-{number}{own[10:]}")
    first, = [n for n in fs(path).list() if n.startswith("part-00000")]
    assert fs(f"{path}/{first}").delete()
    index = token_records.write_index(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in index] == [0, 1, 2, 3]


# ---- repeated rows and large numbers ----
def test_shards_part_repeated_rows(spark):
    # 600 equal rows of 1,000, and 300 rows without an id
    same = F.col("id") < 600
    docs = spark.range(1000).select(F.when(same, 7).when(F.col("id") < 900, None).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(same, "twenty bytes of text").otherwise(F.concat(F.lit("t"), F.col("id") % 10)).alias("text"))
    rows = sharding.shard_by_bytes(docs).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert len(rows) == 1000 and max(abs(x - sum(sizes) / 8) for x in sizes) <= 21 + 0.01 * sum(sizes) / 8
    check_shards(rows, 8, 21)


def test_mix_parts_repeated_rows(spark):
    # fractional rates, and 200 of 300 rows a source without an id
    rows = [(None if i < 200 else i, s, 5) for s in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in (0, 1):
        got = mixing.plan_mix(df, seed).collect()
        assert len(got) == 900
        for s in ("a", "b", "c"):
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
            rate = own[0]["target"] / own[0]["source_size"]
            assert all(int(rate) <= r["copies"] <= np.ceil(rate) for r in own)


def test_mix_copies_repeated_documents(spark):
    docs = spark.createDataFrame([(None, "a", "one two three")] * 40 + [(1, "b", "four five")] * 40, "doc_id long, source string, text string")
    count = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    want = reshared({"a": 120, "b": 80})
    assert abs(3 * count["a"] - want["a"]) <= 3 and abs(2 * count["b"] - want["b"]) <= 2


def test_top_k_with_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 8)]) for i in range(300)]
    big = (1 << 63) - 1
    rows += [(300, [153600] * 8), (301, [-153600] * 8), (302, [1 << 40] * 8), (303, [big] * 8), (350, [-big] * 8), (351, [1 << 21] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = ball_tree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard_rows=100).collect()
    want = set()
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:5]
            want |= {(q, n + 1, i, max(-big, min(big, -s))) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pieces_are_encoded_once_a_group_and_punctuation_runs_by_the_word():
    import random
    import string
    import public_tokenizers
    from chatlake.llm import token_records as tr

    rnd = random.Random(4)
    encoder = tr.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["the", "Heather", "x9", "épa", "don't", "we'll", "日本", "", "I'd", "µ"]
    runs = ["", *string.punctuation, "$$$", ".***", "'s", "''", "!'", "_a", "--'ll", ",%%%", "\n"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(runs) + rnd.choice(["", "", "\nAn"]) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    texts += [w + r for w in words for r in runs]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [list(memoryview(x).cast(encoder.kind)) for x in encoder.encode(texts)]
    assert got == want

    encoder = tr.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    sent, looked, whole, get = [], [], encoder.whole, tr.Pieces.__getitem__
    encoder.whole = lambda texts: sent.append(texts) or whole(texts)

    class Counted(tr.Pieces):
        def __getitem__(self, piece):
            looked.append(piece)
            return get(self, piece)

    encoder.pieces = Counted(encoder, {})
    encoder.encode(["here " + " ".join(w + r for w in ("rock", "sand", "lime") for r in ("$$$", "%%%", "***"))] * 5)
    # all heads in one call, and each run once; each distinct piece and its word's stem
    assert sorted(map(tuple, sent)) == sorted([("here",) * 5, ("$$$",), ("%%%",), ("***",)]) or \
        sorted(map(tuple, sent)) == sorted([(), ("here",) * 5, ("$$$",), ("%%%",), ("***",)])
    assert len(looked) <= 18
    assert [z - a for a, z in tr._groups(["x" * tr.GROUP_CHARS, None, "", "y"])] == [1, 3]
