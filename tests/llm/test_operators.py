"""The training-data operators on small tables with odd rows, against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirefold.llm import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, quality, sharding, shingles, substring_dedup, token_file, toxicity
from quirefold.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, h string"
WORDS = "the of and to in is it on as by at or an be we he so no up my alpha beta gamma delta omega sigma kappa lambda".split()


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "k", "h") for i, t in zip(ids, texts)], DOC)


def odd_texts(n=120, seed=5):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(n // 3)]
    near = []
    for t in base[: n // 3]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:10] + [None, "", " \t\n", "A", "a", "one two", "ONE two", "x" * 5000, "é " * 40, "word\x0bword\x1cword"] + [base[0]] * 30


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("texts", [odd_texts(), []])
def test_exact_dedup(spark, texts):
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_dedup(frame(spark, texts)))}
    assert len(got) == len(texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert got[i] == {"doc_id": i, "keep_id": max(g), "group_size": len(g), "kept": i == max(g), "text_sha256": sha(t or "")}
    if texts:
        assert sorted(r["doc_id"] for r in rows(exact_dedup.keep_one(frame(spark, texts)))) == sorted(max(g) for g in groups.values())


def test_fuse_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    f = exact_dedup.FuseFilter.build(keys)
    assert f.contains(keys).all() and f.contains(keys + np.uint64(1)).mean() < 0.001
    assert exact_dedup.FuseFilter.build(keys[:0]).contains(keys[:0]).shape == (0,)


def test_dedup_of_nulls_and_repeats(spark):
    df = frame(spark, ["a", "a", "a", "b"], [1, 1, None, 2])
    got = rows(exact_dedup.exact_dedup(df))
    assert [r["keep_id"] for r in got if r["doc_id"] != 2] == [1, 1, 1] and {r["group_size"] for r in got} == {3, 1}


def test_sharding(spark):
    texts = odd_texts()
    got = rows(sharding.shard(frame(spark, texts)))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_growth_confines_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    now = sharding.Topology.balanced(10, 5, 1)
    got = rows(sharding.place(sharding.place(ids, now, "doc_id", "a"), now.grown().grown(), "doc_id", "b"))
    sizes = np.bincount([r["a"] for r in got])
    assert sizes.min() > 1700 and sizes.max() < 2300
    assert all(r["b"] in (r["a"], 10, 11) for r in got)


def test_html(spark):
    pages = [
        "<nav>menu</nav><article class='post'><h1>T &amp; U</h1><p>One<p>Two&nbsp; x<br>y<aside>no</aside><div class='comments'><p>no</p></div></article><footer>f</footer>",
        None,
        "",
        "<p>open <!-- gone",
        "plain text",
        "<script>var a='</p>'</script><div id=cookie-banner>no</div><p>yes</p>",
    ]
    df = spark.createDataFrame([(i, None if i == 4 else f"http://h{i}/", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: r for r in rows(html_extract.extract(df))}
    assert [got[i]["text"] for i in range(6)] == ["T & U\nOne\nTwo x y", "", "", "open", "plain text", "yes"]
    assert got[0]["n_chars"] == 17 and set(got[0]) == {"page_id", "url", "text", "n_chars"}


def test_articles_inside_named_elements():
    got = lambda page: html_extract.blocks(page)[0]
    assert got("<div class='related-work'><p>x</p><article><p>one</p></article></div>") == ["one"]
    assert got("<div class='related'><article>teaser</article></div><main><p>one</p></main>") == ["one"]
    assert got("<article><p>one</p><section class='discussion'><p>two</p></section><div class='comments'>no</div></article>") == ["one", "two"]
    assert got("<div hidden><article>no</article></div><p>one</p>") == ["one"] and got("<nav><article>no</article></nav>") == []


def test_html_of_an_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    assert rows(html_extract.extract(spark.createDataFrame([], schema))) == []
    got = rows(html_extract.extract(spark.createDataFrame([(1, None, "<article>a</article>", "x", 9)] * 3 + [(None, "http://h/", None, None, None)], schema)))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "a", 1)] * 3 + [("None", "", 0)]


def test_host_runs_are_removed(spark):
    notice = "all of our pages repeat this same long notice to every reader"
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<div>{notice}</div><p>own{i} words{i}</p>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in rows(html_extract.extract(df))} == {f"own{i} words{i}" for i in range(9)}


def test_host_copies_and_quotes_stay(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CHUNK_PAGES", 3)
    body = "this body of an unmarked page has more than eight tokens in it"
    quote = "a paragraph that two of the pages quote word for word is text as well"
    notice = "all of our pages repeat this same long notice to every reader"
    pages = [(i, "http://copies/", f"<p>{body}</p>") for i in (1, 2, 2)]
    pages += [(i, f"http://many/{i}", f"<div>{notice}</div><p>own{i} words{i}</p>" + f"<p>{quote}</p>" * (i < 12)) for i in range(10, 20)]
    pages += [(i, f"http://many/{i}", f"<div>{notice}</div><p>{body}</p>") for i in range(20, 30)]
    got = sorted((r["page_id"], r["text"]) for r in rows(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))))
    want = [(i, body) for i in (1, 2, 2)] + [(i, f"own{i} words{i}" + f"\n{quote}" * (i < 12)) for i in range(10, 20)] + [(i, body) for i in range(20, 30)]
    assert got == want


def test_pages_with_marked_articles_tell_what_their_host_repeats(spark, monkeypatch):
    notice = "all of our pages repeat this same long notice to every reader"
    quote = "a paragraph that every article of this host has is text in all of them"
    article = lambda i: f"<nav>{notice}</nav><article><p>own{i} words{i}</p><p>{quote}</p></article>"
    pages = [(i, f"http://h/{i}", article(i)) for i in range(12)] + [(i, "http://h/x", article(3)) for i in (20, 21)]
    pages += [(30, "http://h/30", f"<div>{notice}</div><p>the only page without a marked article</p>")]
    pages += [(31, "http://other/", f"<div>{notice}</div><p>another host</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = [(i, f"own{i} words{i}\n{quote}") for i in range(12)] + [(i, f"own3 words3\n{quote}") for i in (20, 21)]
    want += [(30, "the only page without a marked article"), (31, f"{notice}\nanother host")]
    assert sorted((r["page_id"], r["text"]) for r in rows(html_extract.extract(df))) == want
    monkeypatch.setattr(html_extract, "CHUNK_PAGES", 3)
    assert sorted((r["page_id"], r["text"]) for r in rows(html_extract.extract(df.repartition(4)))) == want


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    texts = [*odd_texts(30), "a<|endoftext|>b", "aaaaaaaa " * 9, "don't we'll", "日本語 😀 naïve\r\n\t x"]
    own = list(bpe.load(bpe.default_path()).encode(texts))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert own == want
    got = {r["doc_id"]: r for r in rows(bpe.encode_decode(frame(spark, texts)))}
    for i, (x, ids) in enumerate(zip(texts, want)):
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(t.decode(ids, skip_special_tokens=False))}
    back = {r["doc_id"]: r["text"] for r in rows(bpe.decode(bpe.encode(frame(spark, texts))))}
    assert [back[i] for i in range(len(texts))] == [x or "" for x in texts]


def brute_substring(texts, ids, width=13):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(ids, split):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in zip(ids, split):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("texts", [odd_texts(150, 3), []])
def test_substring_dedup(spark, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.substring_dedup(frame(spark, texts)))}
    assert got == brute_substring(texts, range(len(texts)))


def test_substrings_of_repeats_nulls_and_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 200)
    common = " ".join(f"c{k}" for k in range(20))
    texts = [f"{common} own{k} {' '.join(f'w{k}x{j}' for j in range(9))} {common}" for k in range(60)] + [common, common, None]
    ids = [*range(60), 60, 60, 61]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.substring_dedup(frame(spark, texts, ids).repartition(7))))
    want = brute_substring(texts, ids)
    assert got == sorted((i, *want[i]) for i in ids)
    last = rows(substring_dedup.substring_dedup(frame(spark, [common, common + " x"], [None, 5])))
    assert {str(r["doc_id"]): r["n_removed"] for r in last} == {"None": 20, "5": 0}


def test_texts_that_share_a_hash_are_renamed(spark):
    sets = spark.createDataFrame([(77, 10), (77, 10), (77, 11), (78, 10)], "k long, k2 long")
    moved = substring_dedup.renamed(sets)
    assert [(r["k"], r["k2"]) for r in moved.collect()] == [(77, 11)]
    assert sorted(r["k"] for r in substring_dedup.named(sets, moved).collect())[:1] != [11] and substring_dedup.named(sets, moved).distinct().count() == 3


def test_spans_double(spark):
    w = " ".join(f"w{k}" for k in range(60))
    got = rows(substring_dedup.spans(frame(spark, [w, "x " + w, "other words"])))
    assert max(r["length"] for r in got) == 52 and {r["doc_id"] for r in got} == {0, 1}


def test_bpe_holds_little_for_finished_words():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    encoder = bpe.Bpe(bpe.default_path())
    tracemalloc.start()
    list(encoder.encode([" ".join(words)]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # a worker keeps them through the later stages of a pipeline
    assert len(encoder.known) >= 20_000 and held < 200 * len(words)


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_file.default_path())
    texts = odd_texts(30) + ["a<|endoftext|>B"]
    got = {r["doc_id"]: r for r in rows(token_file.read(token_file.write(frame(spark, texts))))}
    at = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def test_token_files_of_odd_tables(spark):
    assert rows(token_file.read(token_file.write(frame(spark, [])))) == []
    texts, ids = ["one two", "one two", None, "three", "zero"], [5, 5, 7, 5, None]
    got = rows(token_file.read(token_file.write(frame(spark, texts, ids))))
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "5", "7", "None"]
    by_start = sorted(got, key=lambda r: r["start"])
    assert by_start[0]["doc_id"] is None and [r["start"] for r in by_start] == list(np.cumsum([0] + [r["n_tokens"] for r in by_start])[:-1])
    assert (by_start[-1]["doc_id"], by_start[-1]["n_tokens"]) == (7, 1) and len({r["ids_crc32"] for r in got if r["doc_id"] == 5}) == 2


def test_ids_beyond_the_format_are_refused():
    with pytest.raises(ValueError):
        token_file.encode_blocks([np.array([1 << token_file.ID_BITS], np.uint32)])


@pytest.mark.parametrize("run", [
    lambda d: sharding.shard(d),
    lambda d: bpe.encode_decode(d),
    lambda d: toxicity.toxicity(d, toxicity.train(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"))),
    lambda d: quality.keep_good(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda d: jaccard_join.keep_one(d),
    lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    lambda d: exact_dedup.keep_one(d),
])
def test_empty_tables_and_repeated_rows(spark, run):
    assert rows(run(frame(spark, []))) == []
    got = rows(run(frame(spark, ["one two three", "one two three", None, "four"], [1, 1, 2, None])))
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]
    assert len({str(r) for r in got if r["doc_id"] == 1 and "slot" not in r}) <= 1


def test_ids_are_coded_whole(monkeypatch):
    steps, predict = [], token_file._Lanes.predict
    monkeypatch.setattr(token_file._Lanes, "predict", lambda self, *a: steps.append(1) or predict(self, *a))
    draw, most = np.random.default_rng(3), (1 << token_file.ID_BITS) - 1
    blocks = [draw.integers(0, most + 1, 4000), np.full(3000, most), np.arange(2500) % 3, draw.zipf(1.3, 2000) % 5000, np.array([most, 0, most]), np.zeros(1, int), np.zeros(0, int)]
    payloads = token_file.encode_blocks([b.astype(np.uint32) for b in blocks])
    # one step an id, each way, where there were 16
    assert len(steps) == 4000
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(blocks, token_file.decode_blocks(payloads[::-1])[::-1]))
    assert len(steps) == 8000 and len(payloads[1]) < 400
    assert token_file.PRIOR[-1] == 1 << token_file.PRIOR_BITS and (token_file.PRIOR[1:] > token_file.PRIOR[:-1]).all()


def test_token_blocks_are_checked():
    ids = np.arange(300, dtype=np.uint32) % 7
    (payload,) = token_file.encode_blocks([ids])
    assert (token_file.decode_blocks([payload])[0] == ids).all() and len(payload) < 300
    broken = payload[:20] + bytes([payload[20] ^ 255]) + payload[21:]
    with pytest.raises(ValueError):
        token_file.decode_blocks([broken])
    assert token_file.encode_blocks([]) == []


def test_lanes_of_a_block_share_its_tables(monkeypatch):
    steps, predict = [], token_file._Lanes.predict
    monkeypatch.setattr(token_file._Lanes, "predict", lambda self, *a: steps.append(1) or predict(self, *a))
    draw = np.random.default_rng(4)
    blocks = [(draw.zipf(1.2, n) % 50_000).astype(np.uint32) for n in (40_000, 1, 0, 33, 4097)] + [np.tile(np.arange(37, dtype=np.uint32) * 997, 1000)]
    payloads = token_file.encode_blocks(blocks, 100)
    assert len(steps) == 100
    # each block can be read alone, and beside others
    assert all((x == token_file.decode_blocks([p])[0]).all() for x, p in zip(blocks, payloads))
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(blocks, token_file.decode_blocks(payloads[::-1])[::-1]))
    # what one lane has seen, all expect
    assert 2 * len(payloads[-1]) < sum(map(len, token_file.encode_blocks(np.split(blocks[-1], 370))))
    for broken in (payloads[0][:-2], payloads[0][:12], b"QTB2" + payloads[0][4:], payloads[0][:12] + bytes(4) + payloads[0][16:]):
        with pytest.raises(ValueError):
            token_file.decode_blocks([broken])


def test_words_cut_as_arrays_are_the_library_s(monkeypatch):
    tokens = token_file.WordTokens(token_file.default_path())
    r = random.Random(11)
    signs = [*"aZsStTrReEvVlLmMdD'\u2019\"<|>=,.- \n\t\x0b\x0c\r\x1c\x1f\x00\x7f\x8509", *"\u00b2\u00bd\u00f1\u00e9\u00c9\u00df\u0178\u00c0\u00d7\u00f7\u0153\u201c\u2014\u0338\u0301\u0345\u00a0\u3000\u03a3\u0130\u0131\u017f\u212a\u2126\u65e5\ud55c\u0627\U0001f600\u200d", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "abcdefghijklmnop", "\u00e9\u00c9"]
    texts = ["", None, "don't'S'sure 'x", "n\u00e9,\u2014's", "a" * 40, "1<\u0338", "long text, on it's \u00e9" * 900, "x " * 6000, "y" * 9000, ""]
    for _ in range(12):
        some = r.sample(signs, 7)
        texts += ["".join(r.choices(some if k % 2 else signs, k=r.randint(0, 30))) for k in range(200)]
    want = [[*e.ids, 1] for e in tokens.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    # a table that has to grow, and words that are forgotten between slices, change nothing
    for slots, words in ((token_file.SLOT_BITS, token_file.KNOWN_WORDS), (3, 50)):
        monkeypatch.setattr(token_file, "SLOT_BITS", slots)
        monkeypatch.setattr(token_file, "KNOWN_WORDS", words)
        monkeypatch.setattr(token_file, "SLICE_CHARS", 2000)
        tokens._forget()
        parts = list(tokens.ids(texts, 1))
        counts = np.concatenate([c for _, c in parts])
        got = np.split(np.concatenate([i for i, _ in parts]), np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == want and len(parts) > 5
    # the library is asked for many words at once
    asked = []
    monkeypatch.setattr(tokens, "_learn", lambda texts, learn=tokens._learn: asked.extend(texts) or learn(texts))
    tokens._forget()
    assert sum(c.sum() for _, c in tokens.ids(["The cat don't sit, se\u00f1or 12."] * 500, 1)) == 500 * len(tokens.tokenizer.encode("The cat don't sit, se\u00f1or 12.", add_special_tokens=False).ids) + 500
    assert not asked


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(2)
    texts = [" ".join(r.choices(WORDS, k=30)) + (" you horrible idiotic fool" if k % 5 == 0 else "") for k in range(400)] + [None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in rows(toxicity.toxicity(docs, toxicity.train(docs, labels)))}
    assert len(got) == 402 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.95
    none = toxicity.train(docs, labels.limit(0))
    assert {x["predicted"] for x in rows(toxicity.toxicity(docs, none))} == {0}


def test_quality_rejects_garbage(spark):
    r = random.Random(4)
    good = [" ".join(r.choices(WORDS, k=80)) for _ in range(150)]
    bad = ["".join(r.choices("#$%&*!?@{}[]", k=200)) for _ in range(20)]
    docs = frame(spark, [*good, *bad, None, "", "ok"])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(150, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in rows(quality.score(docs, labels))}
    assert [got[k]["kept"] for k in range(150)] == [True] * 150
    assert not any(got[k]["kept"] for k in range(150, 170)) and got[170]["kept"] and got[171]["kept"]
    assert all(x["kept"] for x in rows(quality.score(docs, labels.limit(0))))


def counted(spark, texts):
    docs = spark.createDataFrame([(t, 0) for t in texts], "text string, lid int")
    raw = docs.mapInPandas(quality._count, "g long, c long")
    return quality.counts_by_order(raw.groupBy("g").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c"))


def test_kneser_ney_sums_to_one(spark):
    counts = counted(spark, ["abracadabra", "banana band", "cabbage"])
    context = int.from_bytes(b"\xffban", "big")
    wanted = spark.createDataFrame([((context << 8) | b,) for b in range(256)], "g long")
    assert abs(sum(r["p"] for r in rows(quality.probabilities(counts, wanted))) - 1) < 1e-9


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, by its definition."""

    def __init__(self, texts, order):
        self.order = order
        grams = Counter()
        for t in texts:
            raw = b"\xff" * (order - 1) + t.encode()
            grams.update(raw[k : k + order] for k in range(len(raw) - order + 1))
        self.counts = {order: grams}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts = {}
        for n, c in self.counts.items():
            of = Counter(c.values())
            y = of[1] / (of[1] + 2 * of[2])
            d = [0.0]
            for k in (1, 2, 3):
                d.append(min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.05), k - 0.05) if of[k] and of[k + 1] else 0.75 * k)
            self.discounts[n] = d
        self.followers = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, v in c.items():
                self.followers[n][g[:-1]].append(v)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        lower, own = self.p(gram[1:]), self.followers[n].get(gram[:-1])
        if not own:
            return lower
        d = self.discounts[n]
        c = self.counts[n][gram]
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(v, 3)] for v in own) / sum(own) * lower


def test_kneser_ney_equals_its_definition(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices(WORDS, k=20)) for _ in range(20)]
    plain = PlainKneserNey(texts, quality.ORDER)
    seen = [" ".join(r.choices(WORDS, k=9)) + " unseen zebra" for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", 0, i) for i, t in enumerate(seen)], "doc_id long, text string, lang string, lid int, k long")
    wanted = docs.select("text", "lid").mapInPandas(quality._count, "g long, c long").select("g").distinct()
    got = {x["doc_id"]: x["cost"] for x in rows(quality.costs(docs, quality.probabilities(counted(spark, texts), wanted)))}
    for i, t in enumerate(seen):
        raw = b"\xff" * (quality.ORDER - 1) + t.encode()
        assert got[i] == pytest.approx(-sum(math.log(plain.p(raw[k : k + quality.ORDER])) for k in range(len(t.encode()))), rel=1e-5)


def test_quality_slices_and_languages(spark, monkeypatch):
    r = random.Random(4)
    made = [(k, " ".join(r.choices(WORDS, k=40)), [None, "", "en"][k % 3]) for k in range(120)] + [(500, "the of and", "xx"), (None, "the of and", "en"), (501, "the of and", None), (501, "the of and", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(90)], "doc_id long, quality int, toxic int")
    whole = sorted(map(str, rows(quality.score(docs, labels))))
    monkeypatch.setattr(quality, "SLICE", 300)
    parts = rows(quality.score(docs, labels))
    key = lambda x: (str(x["doc_id"]), str(x["lang"]), x["n_bytes"])
    assert len(parts) == len(whole) == len(made) and {(str(x["lang"]), x["threshold"] is None) for x in parts} == {("None", False), ("", False), ("en", False), ("xx", True)}
    once = {key(x): x for x in rows(quality.score(docs, labels))}
    for x in parts:
        assert x["kept"] == once[key(x)]["kept"] and (x["perplexity"] is None or x["perplexity"] == pytest.approx(once[key(x)]["perplexity"]))
    assert rows(quality.score(docs.limit(0), labels)) == []


def test_thresholds_are_quantiles_of_each_language(spark):
    r = random.Random(6)
    made = [(i, i % 2, 50 + i, r.uniform(1, 3) * (50 + i)) for i in range(400)]
    scored = spark.createDataFrame(made, "doc_id long, lid int, size long, cost double")
    trusted = spark.range(0, 300).withColumnRenamed("id", "doc_id")
    held = {x["doc_id"] for x in rows(trusted.where(quality.tested()))}
    for x in rows(quality.thresholds(scored, trusted)):
        own = [(s, c) for i, lid, s, c in made if lid == x["lid"] and i in held]
        middle = math.ceil(sorted(c / s for s, c in own)[math.ceil(0.5 * len(own)) - 1] * quality.GRID) / quality.GRID
        upper = sorted((c + quality.PRIOR * middle) / (s + quality.PRIOR) for s, c in own)[math.ceil(quality.UPPER * len(own)) - 1]
        assert x["middle"] == pytest.approx(middle) and x["upper"] == pytest.approx(math.ceil(upper * quality.GRID) / quality.GRID)


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(texts, ids):
    """By tuples of words, with nothing of the engine."""
    sets = [word_shingles(t) for t in texts]
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, i in enumerate(ids):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(ids[b])
                head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("boundary", [None, 0, 16])
@pytest.mark.parametrize("texts", [odd_texts(150, 7), []])
def test_jaccard_join(spark, monkeypatch, texts, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes: boundary)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_join(frame(spark, texts)))}
    assert got == brute_components(texts, list(range(len(texts))))


def test_near_copies_of_repeats_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = frame(spark, [text, text, text + " more", None, "", text], [3, 3, 5, None, 7, None])
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_join(df)))
    assert got == [("3", 36, 3), ("3", 36, 3), ("5", 37, 3), ("7", 0, 7), ("None", 0, None), ("None", 36, 3)]
    kept = rows(jaccard_join.keep_one(df))
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3", "7", "None", "None"] and set(kept[0]) == set(df.columns)


def test_a_list_that_all_share_is_not_paired_with_itself(spark):
    """300 texts share a passage; comparisons grow with texts, not with their pairs."""
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{passage} {' '.join(f'own{i}x{k}' for k in range(4))}" for i in range(300)]
    join = jaccard_join.Join(frame(spark, texts))
    made = []
    real = join.verify
    join.verify = lambda pairs: made.append(pairs.count()) or real(pairs)
    assert {r["component"] for r in rows(join.run())} and sum(made) < 10 * len(texts)


def test_sets_that_share_an_id_are_renamed(spark, monkeypatch):
    real = jaccard_join.set_ids
    monkeypatch.setattr(jaccard_join, "set_ids", real)
    sets = spark.createDataFrame([(1, 5, 77, 10), (2, 5, 77, 10), (3, 6, 77, 11), (4, 5, 78, 10)], "doc_id long, n long, sid long, sid2 long")
    moved = jaccard_join.renamed(sets)
    assert list(moved) == [(77, 11)] and moved[77, 11] not in (77, 78)


def test_shingles_are_the_contracts_words():
    texts = [t for t in odd_texts() if t is not None]
    for t, h in zip(texts, shingles.hash_texts(texts, lower=False), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


def test_small_sets_share_a_subset():
    for n in range(1, 17):
        for m in range(n, 17):
            least = -(-3 * (n + m) // 7)
            if least <= n:
                assert jaccard_join.least_overlap(m) in jaccard_join.subset_sizes(n) and least >= jaccard_join.least_overlap(m)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in rows(components(edges))}
    assert {got[k] for k in range(61)} == {0} and got[101] == got[100] == 100 and len(got) == 63


def test_components_never_end_half_way(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges, max_rounds=1)
    assert components(edges.limit(0)).count() == 0


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            wins.setdefault(tuple(w[k : k + 8]), set()).add(i)
    out = {}
    for d, t in texts:
        w, hit, held = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    held |= own
        out[d] = (len(w), len(hit), len(held), sha(",".join(sorted(map(str, held)))), len(held) >= 2)
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_decontaminate(spark, empty):
    r = random.Random(9)
    items = [] if empty else [(k, " ".join(r.choices(WORDS, k=12))) for k in range(12)] + [(12, None), (13, ""), (14, "Short Item"), (15, "ONE"), (2, "again and again")]
    texts = odd_texts(60) + [f"before {t} after {u}" for (_, t), (_, u) in zip(items[:11], items[1:12])] + ["a short item, one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in rows(decontaminate.decontaminate(frame(spark, texts), bench))}
    want = brute_hits(list(enumerate(texts)), items)
    assert got == want
    long_items = [(i, t) for i, t in items if len((t or "").split()) >= 8]
    leaked = {i for i, w in brute_hits(list(enumerate(texts)), long_items).items() if w[1]} | {i for i, w in want.items() if w[4]}
    kept = rows(decontaminate.clean(frame(spark, texts), bench))
    assert {r["doc_id"] for r in kept} == set(range(len(texts))) - leaked and (empty or len(leaked) >= 11)


def test_one_planted_passage_drops_a_document(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta omega sigma kappa lambda end"), (2, "the")], "item_id long, text string")
    docs = frame(spark, ["x alpha beta gamma delta omega, SIGMA kappa lambda y", "the beta gamma delta", None, "", "clean"], [1, 2, 3, 4, None])
    assert sorted(str(r["doc_id"]) for r in rows(decontaminate.clean(docs, bench))) == ["2", "3", "4", "None"]
    got = {r["doc_id"]: (r["n_items"], r["contaminated"], r["leaked"]) for r in rows(decontaminate.decontaminate(docs, bench))}
    assert got[1] == (1, False, True) and got[2] == (1, False, False)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "p q r s t u v w")], "item_id long, text string")
    docs = frame(spark, ["x p q r z s t u v w x", "p q r s t u v w", "p q r"])
    _, found, _ = decontaminate.match(docs, items, slop=1)
    kinds = sorted(r["kind"] for r in rows(found.select("k1", "kind").distinct()))
    assert kinds == ["phrase", "proximity"]
