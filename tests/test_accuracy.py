"""Scores of whole pages against recorded ones, over a folder of page fixtures named by PAGE_FIXTURES.

The folder holds ``baselines.json`` ({"<case>/<engine>": percent}) and for each case ``canonical.txt``, ``test-info.json``
(language, width, height) and ``<engine>-ocr.json``.
"""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirefold.operators import evaluate
from quirefold.plans.request import respond
from quirefold.streaming import pages

FOLDER = Path(os.environ.get("PAGE_FIXTURES", ""))
TOLERANCE = 0.05
NAMES = {"pdftext": "blocks"}

pytestmark = pytest.mark.skipif(not os.environ.get("PAGE_FIXTURES"), reason="PAGE_FIXTURES names no folder")


def cases():
    if not os.environ.get("PAGE_FIXTURES"):
        return {}
    out = {}
    for name, score in json.loads((FOLDER / "baselines.json").read_text()).items():
        case, engine = name.split("/")
        if (FOLDER / case / f"{engine}-ocr.json").exists():
            out.setdefault(json.loads((FOLDER / case / "test-info.json").read_text())["language"], []).append((name, case, engine, score))
    return out


@pytest.mark.parametrize("language", sorted(cases()))
def test_scores(spark, language):
    rows, want, texts = [], {}, []
    for k, (name, case, engine, score) in enumerate(cases()[language]):
        info = json.loads((FOLDER / case / "test-info.json").read_text())
        text = (FOLDER / case / "canonical.txt").read_text()
        rows.append((k, NAMES.get(engine, engine), text.split("\n"), (FOLDER / case / f"{engine}-ocr.json").read_text(), info["width"], info["height"]))
        texts.append((k, text))
        want[k] = (name, score)
    got = respond(spark.createDataFrame(rows, pages.REQUESTS), language)
    own = spark.createDataFrame(texts, "page_id long, canonical string").join(got.select("page_id", F.coalesce("document.text", F.lit("")).alias("sorted")), "page_id", "left")
    scores = {r["page_id"]: r["accuracy"] for r in evaluate.accuracy(own).collect()}
    report = {want[k][0]: (round(s, 2), want[k][1]) for k, s in scores.items()}
    print(report)
    assert not {n: s for n, s in report.items() if s[0] < s[1] - TOLERANCE}
