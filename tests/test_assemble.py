from quirefold.operators import assemble, prepare
from quirefold.operators.search import MATCHES

BOX = "page_id long, index int, text string, left double, top double, width double, height double, line_id string, reading_order int, handler string"


def row(words, line, top):
    return [(w, 0.05 * k, top, line) for k, w in enumerate(words.split())]


def boxes(spark, pages, orders=None):
    """Each list of ``(text, left, top, line)`` is a page."""
    orders = orders or [0] * len(pages)
    return spark.createDataFrame([(p, k, t, x, y, 0.02, 0.02, line, orders[p], "english") for p, rows in enumerate(pages) for k, (t, x, y, line) in enumerate(rows)], BOX).coalesce(1)


LONG, NEXT = "one two three four five six", "x y z u v w"
DASH = [("-", 0.5, 0.1, None)]
#: Boxes of an island, and its sentences.
HEADERS = [
    (row(LONG + ".", "a", 0.1) + row(NEXT, "b", 0.12), [LONG + ".", NEXT]),
    (row(LONG, "a", 0.1) + DASH + row(NEXT, "b", 0.12), [f"{LONG} - {NEXT}"]),
    (row(LONG, "a", 0.1) + [("end.", 0.5, 0.1, None)] + row(NEXT, "b", 0.12), [f"{LONG} end.", NEXT]),
    (row("Short head", "a", 0.1) + DASH + row(NEXT, "b", 0.12), ["Short head -", NEXT]),
    (row(LONG, "a", 0.1) + DASH + row("Next Head", "b", 0.12), [f"{LONG} -", "Next Head"]),
    (row(LONG, "a", 0.1) + [("of", 0.5, 0.1, None)] + row("Next Head", "b", 0.12), [f"{LONG} of Next Head"]),
    (row(LONG, "a", 0.1) + DASH + row("next head", "b", 0.12), [f"{LONG} - next head"]),
    (row(LONG, "a", 0.1) + DASH + row("Next x y z u", "b", 0.12), [f"{LONG} - Next x y z u"]),
    ([("a", 0.1, 0.1, None), ("b", 0.2, 0.1, None)], ["a b"]),
    ([], []),
]


def test_islands_are_cut_at_headers(spark):
    got = [{} for _ in HEADERS]
    for r in sorted(prepare.cut_headers(prepare.islands(boxes(spark, [rows for rows, _ in HEADERS]))).collect(), key=lambda r: r["index"]):
        got[r["page_id"]].setdefault(r["island"], []).append(r["text"])
    assert [[" ".join(page[k]) for k in sorted(page)] for page in got] == [want for _, want in HEADERS]


DOWN = [("right", 0.8, 0.1, "1"), ("left", 0.2, 0.1, "2")]
#: Lines with their paths, boxes, reading order, and the lines that come out.
PAGES = [
    ([("", []), ("a b", [0, 1]), ("", []), ("", []), ("c d", [2, 3]), ("", [])], row("a b", "1", 0.1) + row("c d", "2", 0.2), 0, ["a b", "", "", "c d"]),
    ([("a b", [0, 1]), ("zzz", [])], row("a b", "1", 0.1) + row("p q", "2", 0.2) + row("r s", "3", 0.225) + row("t u", "4", 0.5), 0, ["a b", "p q", "r s", "", "t u"]),
    ([("a b", [2, 3]), ("zzz", [])], row("low", "1", 0.8) + row("high", "2", 0.2) + row("a b", "3", 0.1), 0, ["a b", "high", "", "low"]),
    ([("yyy", []), ("zzz", [])], DOWN, 2, ["right", "", "left"]),
    ([("yyy", []), ("zzz", [])], DOWN, 3, ["left", "", "right"]),
    ([("zzz", [])], row("a b.", "1", 0.1) + row("p q", "2", 0.5), 0, ["a b.", "p q"]),
]


def test_sorted_lines_keep_blanks_and_gaps(spark):
    found = [(p, no, 0, text, bool(path) or not text, False, not text, path, None, None) for p, (lines, *_) in enumerate(PAGES) for no, (text, path) in enumerate(lines)]
    got = assemble.sorted_lines(spark.createDataFrame(found, MATCHES).coalesce(1), boxes(spark, [rows for _, rows, _, _ in PAGES], [order for _, _, order, _ in PAGES])).collect()
    for p, (*_, want) in enumerate(PAGES):
        assert [(r["no"], r["text"]) for r in sorted((r for r in got if r["page_id"] == p), key=lambda r: r["no"])] == list(enumerate(want))
