import json

from quirefold.plans.request import respond
from quirefold.streaming import pages


def box(text, left, top, width=0.08, line=None):
    return {"text": text, "bounds": {"left": left, "top": top, "width": width, "height": 0.02}, "normalized_conf": 1.0, "line_id": line}


def answer(spark, words, lines, language="english"):
    df = spark.createDataFrame([(1, "blocks", lines, json.dumps(words), 1000, 1000)], pages.REQUESTS)
    return respond(df, language).first()


def test_hyphenated_boxes_are_matched(spark):
    text = "a well-known state-of-the-art method of 12-13 steps is the co-worker of all the others here and now"
    words = [box(w, 0.05 + 0.09 * (k % 10), 0.05 + 0.03 * (k // 10), line=str(k // 10)) for k, w in enumerate(text.split())]
    got = answer(spark, words, [text.replace("co-worker", "coworker")])
    tokens = [t["text"] for t in got["document"]["paragraphs"][0]["tokens"]]
    assert got["stats"]["lines_found"] == 1 and got["unhandled"] == []
    assert tokens[:8] == ["a", "well", "known", "state", "of", "the", "art", "method"]
    assert "12-13" in tokens and "co-worker" in tokens


def test_vertical_pages_are_read_by_columns(spark):
    text = "春はあけぼのやうやう白くなりゆく山際少し明かりて紫だちたる雲の細くたなびきたる夏は夜月の頃はさらなり"
    for line in (True, False):
        cells = [box(c, 0.9 - 0.05 * (k // 12), 0.05 + 0.03 * (k % 12), 0.02, str(k // 12) if line else None) for k, c in enumerate(text)]
        df = spark.createDataFrame([(1, "blocks", [" ".join(text[:12]), " ".join(text[12:24])], json.dumps(cells), 1000, 1000)], pages.REQUESTS)
        got = respond(df, "japanese").first()
        assert got["stats"]["lines_found"] == 2


def test_one_line_is_cut_at_sentence_ends(spark):
    text = "One two three four. Five six seven eight! Nine ten of Dr. Smith"
    words = [box(w, 0.05 + 0.09 * (k % 10), 0.05 + 0.03 * (k // 10)) for k, w in enumerate(text.split())]
    got = answer(spark, words, [text])
    assert got["stats"]["canonical_lines"] == 1
    assert got["document"]["text"] == "One two three four.\nFive six seven eight!\nNine ten of Dr. Smith"


def test_lines_in_leftovers_are_handled(spark):
    words = [box("alpha", 0.05, 0.05, line="0"), box("beta", 0.85, 0.05, line="0"), box("delta", 0.05, 0.5, line="1"), box("gamma", 0.85, 0.5, line="1")]
    got = answer(spark, words, ["alpha beta", "gamma delta"])
    assert got["unhandled"] == ["gamma delta"] and (got["stats"]["lines_found"], got["stats"]["lines_unhandled"]) == (0, 1)
