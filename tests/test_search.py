import random
from dataclasses import replace

from quirefold.config import for_language
from quirefold.functions.geometry import Box
from quirefold.operators.evaluate import lcs_length
from quirefold.operators.search import Line, Page, ends_sentence, split_paragraph

EN = replace(for_language("english"), min_words_for_early_passes=2)


def norm(text):
    return text.lower().replace(".", "")


def page(words, lines, config=EN):
    boxes = [Box(0.05 + 0.09 * (k % 10), 0.05 + 0.03 * (k // 10), 0.08, 0.02, index=k, text=w, norm=norm(w)) for k, w in enumerate(words)]
    return Page(boxes, [Line(k, t, norm(t).split(), not t.strip()) for k, t in enumerate(lines)], config, norm).run()


def test_lines_are_found_in_order():
    words = "the quick brown fox jumps over the lazy dog today and then some more words follow here".split()
    got = page(words, [" ".join(words)])
    assert got.lines[0].found and got.lines[0].path == list(range(len(words)))


def test_a_missing_word_is_a_hole():
    words = "one two three four five six seven eight nine ten".split()
    read = [w if w != "five" else "f1ve" for w in words]
    got = page(read, [" ".join(words)])
    assert got.lines[0].found and got.lines[0].path[4] == -1 and got.lines[0].path[5] == 5


def test_claimed_boxes_are_gone():
    got = page("a b c a b c".split(), ["a b c", "a b c"])
    paths = sorted(line.path for line in got.lines if line.found)
    assert paths == [[0, 1, 2], [3, 4, 5]]


def test_absent_words_split_a_line():
    got = page("a b c d".split(), ["a b x y z c d"])
    assert any(line.split for line in got.lines)
    assert sorted(n for line in got.lines if line.found for n in line.path) == [0, 1, 2, 3]


def test_sentences():
    assert split_paragraph("One two. Three four.") == ["One two.", "Three four."]
    assert split_paragraph("Dr. Smith went") == ["Dr. Smith went"]
    assert ends_sentence('He said "no."') and not ends_sentence("U.S.")


def test_lcs():
    assert lcs_length(list("abcde"), list("ace")) == 3 and lcs_length([], ["a"]) == 0 and lcs_length(list("aab"), list("baa")) == 2


def test_rejected_steps_would_cost_too_much():
    """The early rejection in ``step`` takes no step away that its cost and the wrap rule admit."""
    rng = random.Random(5)
    for bridging in (True, False):
        config = replace(EN, wrap_bridging=bridging)
        got = Page([], [], config, norm)
        for _ in range(20000):
            a, b = (Box(rng.uniform(0, 0.9), rng.choice([0.1, 0.12, 0.15, rng.uniform(0, 0.9)]), rng.uniform(0.01, 0.3), rng.uniform(0.005, 0.05)) for _ in range(2))
            g = got.geometry
            cost = g.distance(a, b)
            want = cost if cost <= config.max_word_distance or (bridging and g.wraps_line(a, b)) else None
            assert got.step(a, b, 0) == want, (a, b)
