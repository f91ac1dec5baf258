"""The greedy page search: canonical lines claim paths through the boxes of a page.

One page is one group: the work of a page is sequential, since a line's match takes boxes away from later lines. All
else around it is relational (see ``prepare`` and ``assemble``).
"""

from __future__ import annotations

import math
import re
import time
from bisect import bisect_right
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import ReadingOrder, SorterConfig
from quirefold.functions.geometry import Box, Geometry
from quirefold.functions.text import ABBREVIATIONS, CLOSERS

HOLE = -1
EARLY_PASSES, SWEEPS, MIN_FILL = 3, 5, 4
_INITIAL = re.compile(r"(?<![A-Za-z0-9_])[A-Z]\.([A-Z]\.)*$")


@dataclass
class Line:
    number: int
    text: str
    tokens: list[str]
    blank: bool = False
    found: bool = False
    split: bool = False
    path: list[int] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(" ".join(self.tokens).encode())


@dataclass
class Path:
    length: float
    nodes: list[int]


class Stop(Exception):
    """Ends the whole search of a line."""


def ends_sentence(text: str) -> bool:
    core = text.strip().rstrip(CLOSERS)
    if core.endswith(("!", "?")):
        return True
    return core.endswith(".") and not _INITIAL.search(core) and not core.endswith(ABBREVIATIONS)


def split_paragraph(text: str) -> list[str]:
    """In two at the sentence end nearest to the middle, counted in bytes."""
    words, at, ends = text.split(), 0, []
    for k, word in enumerate(words[:-1]):
        at += len(word.encode()) + 1
        if ends_sentence(" ".join(words[max(0, k - 1) : k + 1])):
            ends.append((at, k + 1))
    if not ends:
        return [text]
    middle = len(text.encode()) / 2
    _, cut = min(ends, key=lambda e: (abs(e[0] - middle), e[0]))
    return [" ".join(words[:cut]), " ".join(words[cut:])]


class Page:
    def __init__(self, boxes: list[Box], lines: list[Line], config: SorterConfig, normalize, characters: bool = False):
        self.config, self.lines, self.normalize, self.characters = config, lines, normalize, characters
        self.boxes = {b.index: b for b in boxes}
        self.geometry = Geometry(config.reading_order, config.column_jump_penalty)
        self.free: dict[str, list[int]] = {}
        for b in sorted(boxes, key=lambda b: b.index):
            if " " not in b.norm:
                self.free.setdefault(b.norm, []).append(b.index)
        self.claimed: set[int] = set()
        self.stats = dict.fromkeys(("passes", "permutations", "lines_found", "lines_split", "holes_bridged", "holes_filled", "holes_empty", "anchored", "reconciled", "blanks_found"), 0)

    def candidates(self, word: str) -> list[int]:
        return [i for i in self.free.get(word, ()) if i not in self.claimed]

    def claim(self, nodes: list[int]) -> None:
        self.claimed.update(n for n in nodes if n != HOLE)

    # steps

    def step(self, a: Box | None, b: Box, holes: int) -> float | None:
        """The cost of going from ``a`` to ``b`` over ``holes`` missing words; None if that is no step."""
        if a is None:
            return 0.0
        g, c = self.geometry, self.config
        if not holes and c.reading_order == 0 and not (b.left < a.left + a.width and b.top > a.top) and (b.top + b.height < a.top or a.top + a.height < b.top or b.left < a.left or b.left - (a.left + a.width) > c.max_word_distance):
            return None  # neither on the line nor a wrap to the next
        cost = g.distance(a, b)
        if cost <= c.max_word_distance:
            return cost
        if holes:
            if g.same_line(a, b) and g.sequential(a, b):
                gap = g.gap(a, b)
                if gap >= 0 and 0.1 + gap <= c.max_word_distance + 0.2 * holes:
                    return 0.1 + gap
            if c.wrap_bridging and g.wraps_line(a, b):
                return 1.0 + g.line_gap(a, b)
        elif c.wrap_bridging and g.wraps_line(a, b):
            return cost
        return None

    def search(self, chain: list[list[int] | None], budget: int) -> list[Path]:
        """Paths through the chain, best first. An exhausted budget or a path over the best length ends the search."""
        n, found, used = len(chain), [], 0
        best = math.inf
        nodes: list[int] = []
        inside: set[int] = set()

        # steps of this search: equal words share their candidates, so a step is judged once
        steps: dict[tuple, list[tuple[int, float]]] = {}

        def options(pos: int, prev: int | None, holes: int):
            cands = chain[pos]
            key = (prev, id(cands), holes, pos > 0)
            if (out := steps.get(key)) is None:
                if self.config.rotation and pos > 0:
                    cut = bisect_right(cands, prev if prev is not None else 0)
                    cands = cands[cut:] + cands[:cut]
                a = self.boxes[prev] if prev is not None else None
                out = steps[key] = [(c, cost) for c in cands if (cost := self.step(a, self.boxes[c], holes)) is not None]
            return iter(out)

        # a frame: position, previous box, length so far, holes before it, iterator, whether the node is a hole
        stack: list[list] = []

        def enter(pos: int, prev: int | None, length: float, holes: int) -> None:
            nonlocal best, used
            if pos == n:
                found.append(Path(length, list(nodes)))
                best = min(best, length)
                if length < 0.001:
                    raise Stop
                return
            if chain[pos] is None:
                stack.append([pos, prev, length, holes, None, True])
                return
            used += 1
            if used > budget or length > best:
                raise Stop
            stack.append([pos, prev, length, holes, options(pos, prev, holes), False])

        try:
            enter(0, None, 0.0, 0)
            while stack:
                frame = stack[-1]
                pos, prev, length, holes, rest, hole = frame
                while len(nodes) > pos:
                    inside.discard(nodes.pop())
                if hole:
                    if frame[4] == "done":
                        stack.pop()
                        continue
                    frame[4] = "done"
                    nodes.append(HOLE)
                    enter(pos + 1, prev, length + self.config.hole_path_penalty, holes + 1)
                    continue
                for c, cost in rest:
                    if c not in inside:
                        nodes.append(c)
                        inside.add(c)
                        enter(pos + 1, c, length + cost, 0)
                        break
                else:
                    stack.pop()
        except Stop:
            pass
        self.stats["permutations"] += used
        return sorted(found, key=lambda p: p.length)

    # lines

    def tokens(self, key: str) -> list[str]:
        """Of a normalized text: its characters on CJK pages, its words on all others."""
        return [c for c in key if not c.isspace()] if self.characters else key.split()

    def chain(self, words: list[str]) -> tuple[list[list[int] | None], set[str]]:
        """Candidates of each word; missing words are holes if there are few enough, and are returned otherwise."""
        known = {w: self.candidates(w) for w in dict.fromkeys(words)}
        cands = [known[w] for w in words]
        missing = [w for w, c in zip(words, cands) if not c]
        if not missing:
            return cands, set()
        c = self.config
        if c.enable_holes and len(missing) <= int(c.max_hole_fraction * len(words)) and len(words) - len(missing) >= 2:
            return [x or None for x in cands], set()
        return cands, set(missing)

    def split_line(self, line: Line, missing: set[str]) -> None:
        """At a sentence end, or else at the missing words; a line of which nothing but itself comes out stays."""
        parts = split_paragraph(line.text)
        if len(parts) == 1 and missing:
            parts, held, glue = [], [], "" if self.characters else " "
            for word in line.text if self.characters else line.text.split():
                keys = self.tokens(self.normalize(word))
                if keys and keys[0] in missing:
                    parts.append(glue.join(held))
                    held = []
                else:
                    held.append(word)
            parts.append(glue.join(held))
        made = [Line(line.number, p, t) for p in parts if (t := self.tokens(self.normalize(p)))]
        if not made or (len(made) == 1 and made[0].tokens == line.tokens):
            return
        self.stats["lines_split"] += 1
        line.split = True
        self.lines.extend(made)

    def anchors(self, line: Line) -> list[int]:
        """Boxes of the nearest found lines."""
        near = [(abs(o.number - line.number), o) for o in self.lines if o.found and o.path and o is not line]
        if not near:
            return []
        least = min(d for d, _ in near)
        return [n for d, o in near if d == least for n in o.path if n != HOLE]

    def distance_to(self, anchors: list[int], path: list[int]) -> float:
        first = next((n for n in path if n != HOLE), None)
        if first is None or not anchors:
            return math.inf
        return min(self.geometry.centre_distance(self.boxes[a], self.boxes[first]) for a in anchors)

    def rerank(self, line: Line, paths: list[Path]) -> Path:
        close = [p for p in paths if p.length <= paths[0].length + self.config.anchor_tie_epsilon]
        anchors = self.anchors(line)
        if len(close) < 2 or not anchors:
            return paths[0]
        self.stats["anchored"] += 1
        return min(close, key=lambda p: self.distance_to(anchors, p.nodes))

    def fill_holes(self, path: Path, words: list[str]) -> None:
        """Free boxes between the nearest real neighbours of a hole: on their line, in order, the tightest first.

        Words of ``MIN_FILL`` characters or more must be the box's own; shorter ones go by place alone.
        """
        g, taken = self.geometry, {n for n in path.nodes if n != HOLE}
        for k, node in enumerate(path.nodes):
            if node != HOLE:
                continue
            before = next((n for n in reversed(path.nodes[:k]) if n != HOLE), None)
            after = next((n for n in path.nodes[k + 1 :] if n != HOLE), None)
            fits = []
            if before is not None and after is not None:
                a, b = self.boxes[before], self.boxes[after]
                names = [words[k]] if len(words[k]) >= MIN_FILL else list(self.free)
                for i in (i for name in names for i in self.free.get(name, ())):
                    if i in self.claimed or i in taken:
                        continue
                    box = self.boxes[i]
                    if g.same_line(a, box) and g.sequential(a, box) and g.same_line(box, b) and g.sequential(box, b):
                        fits.append((g.gap(a, box) + g.gap(box, b), i))
            if fits:
                path.nodes[k] = min(fits)[1]
                taken.add(path.nodes[k])
                self.stats["holes_filled"] += 1
            else:
                self.stats["holes_empty"] += 1

    def accept(self, line: Line, path: Path) -> None:
        line.found, line.path = True, path.nodes
        self.claim(path.nodes)

    def passes(self) -> None:
        c = self.config
        budget, first = c.permutations_per_pass or c.max_permutations, 4 if c.enable_anchoring else 0
        hits, before = 1, -1
        for number in range(c.max_passes + 1):
            if number > first and hits == 0 and before == len(self.lines):
                break
            self.stats["passes"] += 1
            hits, before = 0, len(self.lines)
            self.lines.sort(key=lambda x: (-x.size, x.number))
            at = 0
            while at < len(self.lines):
                line = self.lines[at]
                at += 1
                words = line.tokens
                if line.split or line.found or line.blank or (number <= EARLY_PASSES and len(words) < c.min_words_for_early_passes):
                    continue
                chain, missing = self.chain(words)
                if missing:
                    self.split_line(line, missing)
                    continue
                if len(chain) <= 1:
                    continue
                if 0 < c.precurse_length < len(chain) and chain[0]:
                    ahead = self.search(chain[: c.precurse_length], budget)
                    start = ahead[0].nodes[0] if ahead else HOLE
                    if start in chain[0]:
                        cut = chain[0].index(start)
                        chain[0] = chain[0][cut:] + chain[0][:cut]
                paths = self.search(chain, budget)
                if not paths:
                    self.split_line(line, set())
                    continue
                path = self.rerank(line, paths) if c.enable_anchoring and len(words) < c.min_words_for_early_passes else paths[0]
                if c.enable_holes:
                    self.stats["holes_bridged"] += path.nodes.count(HOLE)
                    self.fill_holes(path, words)
                self.accept(line, path)
                hits += 1
                self.stats["lines_found"] += 1

    def reconcile(self) -> None:
        """Lines that are left, if they lie near their neighbours."""
        c = self.config
        for _ in range(SWEEPS):
            hits = 0
            for line in self.lines:
                if line.found or line.split or line.blank or not line.tokens:
                    continue
                anchors = self.anchors(line)
                chain, missing = self.chain(line.tokens)
                if not anchors or missing:
                    continue
                if len(chain) == 1:
                    if c.recon_min_exact_anchors > 1 or not chain[0]:
                        continue
                    best, pick = c.recon_spatial_window, None
                    for i in chain[0]:
                        if (d := self.distance_to(anchors, [i])) <= best:
                            best, pick = d, i
                    if pick is None:
                        continue
                    path = Path(0.0, [pick])
                else:
                    best, path = c.recon_spatial_window, None
                    for p in self.search(chain, c.permutations_per_pass or c.max_permutations):
                        if sum(n != HOLE for n in p.nodes) >= c.recon_min_exact_anchors and (d := self.distance_to(anchors, p.nodes)) <= best:
                            best, path = d, p
                    if path is None:
                        continue
                self.accept(line, path)
                self.stats["reconciled"] += 1
                hits += 1
            if not hits:
                break

    def rescue_blanks(self) -> None:
        """Blank lines between found ones, with a found one within five lines."""
        numbers = sorted({x.number for x in self.lines if x.found and not x.blank})
        if not numbers:
            return
        for line in self.lines:
            if line.blank and numbers[0] < line.number < numbers[-1] and any(1 <= abs(n - line.number) <= 5 for n in numbers):
                line.found = True
                self.stats["blanks_found"] += 1

    def run(self) -> Page:
        self.passes()
        if self.config.enable_reconciliation:
            self.reconcile()
        self.rescue_blanks()
        return self


def _plain_normalize(cache: dict[str, str]):
    """Keys of words, from the table that the plan has computed; a part of a line is made of the line's words."""
    return lambda text: " ".join(filter(None, (cache.get(w, "") for w in text.split())))


def _character_normalize(cache: dict[str, str]):
    return lambda text: "".join(cache.get(c, "") for c in text)


COUNTS = ("passes", "lines_split", "lines_reconciled", "holes_bridged", "holes_filled")
MATCHES = "page_id long, line_no int, part int, original string, found boolean, split boolean, is_blank boolean, path array<int>, counts array<long>, elapsed_ms long"


def match_pages(boxes: DataFrame, lines: DataFrame, words: DataFrame, config: SorterConfig) -> DataFrame:
    """Matched lines of every page: ``MATCHES``.

    ``boxes`` are normalized, ``lines(page_id, line_no, text, norm, is_blank)``, ``words(page_id, word, key)`` gives the
    normalized form of each word of the lines, of each character where ``handler`` says that the page is CJK. A
    ``reading_order`` of the boxes overrules the config's, page by page. The first row of a page has the page's
    ``counts`` of the search (``COUNTS``) and its milliseconds.
    """
    config = config.validate()
    order = F.max("reading_order") if "reading_order" in boxes.columns else F.lit(int(config.reading_order))
    packed = boxes.groupBy("page_id").agg(order.alias("reading_order"), F.collect_list(F.struct("left", "top", "width", "height", "page_width", "page_height", "index", "text", "norm", "line_id")).alias("boxes"))
    kind = F.max("handler") if "handler" in lines.columns else F.lit("english")
    text = lines.groupBy("page_id").agg(kind.alias("handler"), F.collect_list(F.struct("line_no", "text", "norm", "is_blank")).alias("lines"))
    keys = words.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "key"))).alias("keys"))
    pages = text.join(packed, "page_id", "left").join(keys, "page_id", "left")
    # a page is much work for few bytes: sizes say nothing about how many tasks it takes
    pages = pages.repartition(8 * boxes.sparkSession.sparkContext.defaultParallelism, "page_id")

    def run(frames):
        for rows in frames:
            out = []
            for page in rows.itertuples(index=False):
                got = [] if page.boxes is None else [Box(**b) for b in page.boxes]
                began = time.perf_counter()
                characters, keys = page.handler == "cjk", dict(page.keys or {})
                cut = (lambda key: [c for c in key if not c.isspace()]) if characters else str.split
                own = [Line(x["line_no"], x["text"], cut(x["norm"]), x["is_blank"]) for x in sorted(page.lines, key=lambda x: x["line_no"])]
                settings = config if page.boxes is None else replace(config, reading_order=ReadingOrder(int(page.reading_order)))
                done = Page(got, own, settings, (_character_normalize if characters else _plain_normalize)(keys), characters).run()
                stats = [done.stats["reconciled" if c == "lines_reconciled" else c] for c in COUNTS]
                spent = int(1000 * (time.perf_counter() - began))
                counts: dict[int, int] = {}
                for line in done.lines:
                    counts[line.number] = counts.get(line.number, -1) + 1
                    out.append((page.page_id, line.number, counts[line.number], line.text, line.found, line.split, line.blank, line.path, stats, spent))
                    stats = spent = None
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCHES.split(", ")]).astype({"elapsed_ms": "Int64"})

    return pages.mapInPandas(run, MATCHES)
