"""The corpus pipeline against a plain version, stage by stage."""

import corpus_pipeline
from chatlake.llm import queries
from chatlake.llm.common import read
from tests.llm.test_operators import check_shards

SF = "/root/testdata/sf0.001"


def test_run_keeps_what_the_stages_decide(spark):
    docs = {r["doc_id"]: r for r in read(spark, SF, "documents").collect()}
    toxic = {r["doc_id"] for r in queries.QUERIES["op10_toxicity"](spark, SF).collect() if r["predicted"]}
    near = queries.QUERIES["op9_simhash"](spark, SF).collect()
    first = {}
    for d, fp in sorted((r["doc_id"], r["component_id"]) for r in near):
        if d not in toxic:
            first.setdefault(fp, d)             # no class of these rows hangs on a toxic one
    bad = {r["doc_id"] for r in queries.QUERIES["op5_decontamination"](spark, SF).collect() if r["contaminated"]}
    clean = set(first.values()) - bad
    rows = corpus_pipeline.run(spark, SF).collect()
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        assert all(r[c] == docs[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars"))
    assert set(taken) <= clean and max(taken.values()) <= 2
    words = lambda d: len((docs[d]["text"] or "").split())
    total = sum(words(d) for d in clean)
    assert abs(sum(words(d) * n for d, n in taken.items()) - 1.5 * total) < 0.1 * total
    check_shards(rows, 8, 2 * max(r["size"] for r in rows))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).collect() == []
        assert stage(spark, docs, SF).columns == docs.columns
