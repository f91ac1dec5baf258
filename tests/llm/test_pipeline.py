"""The pipeline's stages on small corpora, each against a plain version of its rule."""

import hashlib
import random

import corpus_pipeline
from quirefold.llm import bpe, queries
from test_operators import WORDS, brute_components, brute_hits, frame, rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert kept.items() <= before.items(), name
        if name == "exact dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(last.get(t, i), i)
            assert set(kept) == set(last.values())
        elif name == "n-gram Jaccard join":
            assert set(kept) == {i for i, (_, c) in brute_components(list(before.values()), list(before)).items() if i == c}
        else:
            held = brute_hits(list(before.items()), items)  # all items of this table are longer than a window
            assert set(kept) == {i for i, h in held.items() if not h[1]} and len(kept) < len(before)


def tables(spark, folder, docs, bench, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, tmp_path):
    r = random.Random(11)
    good = [" ".join(r.choices(WORDS, k=60)) for _ in range(60)]
    near = good[0] + " changed"
    leak = "alpha one two three four five six seven eight nine"
    junk = "".join(r.choices("#$%&*!?@{}[]", k=300))
    texts = [*good, good[1], near, f"{good[2]} {leak}", junk, None, "", good[3], good[3]]
    ids = [*range(60), 60, 61, 62, 63, 64, 65, None, 3]
    sf = tables(spark, tmp_path, frame(spark, texts, ids), [(1, leak, 5), (2, None, 5), (None, "the", 5)], [(k, 1, 0, "x") for k in range(50)] + [(None, None, None, None)])
    got = rows(corpus_pipeline.run(spark, sf))
    # 1 equals 60, 64 equals 65, 61 is near 0, 62 holds the passage, 63 is junk; 3 is there twice and without an id
    assert sorted(str(x["doc_id"]) for x in got) == sorted([*(str(i) for i in range(61) if i not in (1,)), "3", "65", "None"])
    own = next(x for x in got if x["doc_id"] == 5)
    ids = next(iter(bpe.load(bpe.default_path()).encode([good[5]])))
    assert own["n_tokens"] == len(ids) and own["decoded_sha256"] == hashlib.sha256(good[5].encode()).hexdigest()


def test_run_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, frame(spark, []), [], [])
    out = corpus_pipeline.run(spark, sf)
    assert out.collect() == [] and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
