"""Main text of web pages, with a suffix array for each host.

A page is cut into blocks. Of every page, all of its blocks go into the token streams of its host: those of its main text,
and those that its markup speaks against. The streams of a host are concatenated, their suffixes ranked by prefix doubling
up to ``RUN`` tokens, and runs on more than ``PAGES`` and at least ``SHARE`` of the host's different texts are boilerplate; so
are those on that share of the texts that the markup leaves open. Longer repeats need no longer ranks: every run of
``RUN`` tokens inside one is on those texts as well, so that what they cover is the same.

Two things overrule the ranks. Where a page marks its article (``article`` or ``main``), all blocks inside it are the
text, for paragraphs repeat and are to be kept; an article inside an element that only a class or id speaks against is
the text where the page has no other. And scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and
reader comments that are declared as such go, for they may be unique to a page. Of the other pages, the tokens that
boilerplate covers are removed, and the other runs stay: a paragraph that some pages quote is text, and copies of a main
text are one text, whatever stands around it.

The different texts of a host are dealt into chunks, so that a host of any size is many tasks. A run on a share of the
texts is on that share of a chunk's at least once; so each chunk ranks its own suffixes and names the runs that are, and
these are counted in all chunks.

White space is what ``str.split`` splits at. Defined cases: null and empty html, and pages without text, give the empty
string; null urls are one host; repeated rows and copies count once and each give a row; pages of one host that differ
in little more than a date are different texts, so what they share is boilerplate where they are ``SHARE`` of the host;
broken markup is read as far as it goes (an unclosed comment or script runs to the end); further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import materialize
from quirefold.llm.shingles import windows
from quirefold.shared import release
from quirefold.tables import table

#: A run of so many tokens, a power of two, on more than so many different texts of a host may be boilerplate.
RUN, PAGES = 8, 2
#: And it is, if it is on this share of them.
SHARE = 0.5
#: What counts an element that only its class or id speaks against, while those that go for certain count 1.
AROUND = 1 << 20
#: Pages of a host that one task ranks at once, about.
CHUNK_PAGES = 500
BLOCK = "\n"

RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "math", "select", "xmp", "noembed", "noframes")
GONE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "audio", "video", "canvas", "fieldset"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "link", "meta"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class names and ids that declare what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu\w*|breadcrumbs?|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|replies|reply|disqus|footer|header|masthead|toolbar|widget\w*|pagination|pager|skip|toc)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def _hidden(rest: str) -> bool:
    """Declared as no text at all, whatever stands inside."""
    at = _attributes(rest)
    return at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", at.get("style", ""), re.I))


def _unwanted(name: str, rest: str) -> bool:
    if name in GONE:
        return True
    if not rest.strip() or name in ("html", "body", *MAIN) and "class" not in rest:
        return False
    if _hidden(rest):
        return True
    at = _attributes(rest)
    return name not in ("html", "body", "main") and bool(NAMES.search(at.get("class", "")) or NAMES.search(at.get("id", "")))


def sorted_blocks(page: str | None) -> tuple[list[str], list[str], bool]:
    """The blocks of a page's main text in page order, all other blocks, and whether the markup settles the text."""
    page = page or ""
    inside: list[str] = []  # blocks of an article
    named: list[str] = []  # blocks of an article that only the name of an element around it speaks against
    outside: list[str] = []
    gone: list[str] = []  # what the markup speaks against
    held: list[str] = []
    lost: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, unwanted (AROUND: by its name only, and in no article), main
    drop = main = 0

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                (named if drop else inside if main else outside).append(text)
        if lost:
            text = " ".join(html.unescape("".join(lost)).split())
            lost.clear()
            if text:
                gone.append(text)

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        (lost if drop % AROUND or drop and not main else held).append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in ENDS and not m["close"]:
            if not m["rest"].endswith("/"):
                stop = ENDS[name].search(page, at)
                at = stop.end() if stop else len(page)
            held.append(" ")
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            if name in VOID or not (m["rest"].strip() or any(o[0] == name for o in open_)):
                continue
        else:
            end()
        if name in VOID:
            continue
        if m["close"]:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if depth is not None:
                for _, bad, good in open_[depth:]:
                    drop, main = drop - bad, main - good
                del open_[depth:]
        elif name not in INLINE or _unwanted(name, m["rest"]):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_ and open_[-1][0] == name:
                _, bad, good = open_.pop()
                drop, main = drop - bad, main - good
            bad = _unwanted(name, m["rest"])
            if bad and not main and name not in GONE and not _hidden(m["rest"]):
                bad = AROUND
            good = name in MAIN or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", m["rest"], re.I))
            open_.append((name, bad, good))
            drop, main = drop + bad, main + good
    end()
    if inside:
        return inside, named + outside + gone, True
    if named and not outside:
        return named, gone, True
    return outside, named + gone, not outside


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks of a page's main text in page order, and whether the markup settles it."""
    main, _, settled = sorted_blocks(page)
    return main, settled


def _frame(rows: pd.DataFrame, texts: list[str | None]) -> pd.DataFrame:
    return pd.DataFrame({"page_id": list(rows["page_id"]), "url": pd.Series([u if isinstance(u, str) else None for u in rows["url"]], dtype=object), "text": pd.Series(texts, dtype=object)})


def _packed(main: list[str], rest: list[str]) -> bytes:
    return BLOCK.join([str(len(main)), *main, *rest]).encode("utf-8", "surrogatepass")


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts for the ranks: a page goes on if none of this task with its main text has had as small a ``key`` before."""
    pack = zstandard.ZstdCompressor(level=3)
    best: dict[tuple[str, bytes], bytes] = {}
    for rows in frames:
        out = []
        for page, host, chunks in zip(rows["html"], rows["host"], rows["chunks"]):
            main, rest, settled = sorted_blocks(page)
            raw = _packed(main, rest)
            own = xxhash.xxh3_128_digest(BLOCK.join(main).encode("utf-8", "surrogatepass"))
            key = bytes([settled]) + xxhash.xxh3_128_digest(raw)
            if main and key < best.get((host, own), b"\xff"):
                best[host, own] = key
                out.append((host, chunks, own, key, settled, pack.compress(raw)))
        yield pd.DataFrame(out, columns=["host", "chunks", "own", "key", "settled", "packed"])


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for rows in frames:
        parsed = [blocks(page) for page in rows["html"]]
        yield rows.drop(columns="html").assign(settled=[settled for _, settled in parsed], packed=[pack.compress(_packed(main, [])) for main, _ in parsed])


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        yield _frame(rows, [BLOCK.join(main) for main, _ in _unpacked(rows["packed"])])


def _unpacked(packed: Iterable[bytes]) -> Iterator[tuple[list[str], list[str]]]:
    """The blocks of the main text, and all others."""
    unpack = zstandard.ZstdDecompressor()
    for p in packed:
        count, *found = unpack.decompress(p).decode("utf-8", "surrogatepass").split(BLOCK)
        yield found[: int(count)], found[int(count) :]


def _stream(found: list[str]) -> list[str]:
    return f" {BLOCK} ".join(found).split(" ") if found else []


def suffix_ranks(tokens: np.ndarray, run: int, least: int = 1) -> np.ndarray:
    """Equal numbers for suffixes that agree on their first ``run`` tokens: prefix doubling, stopped at ``run``.

    Suffixes of which fewer than ``least`` agree have 0, from the first length on at which that is so.
    """
    rank, length = _often(tokens, np.ones(len(tokens), bool), least), 1
    while length < run:
        later = np.concatenate((rank[length:], np.zeros(min(length, len(rank)), np.int64)))
        alive = (rank > 0) & ((later > 0) | (least == 1))
        rank, length = _often(rank << 32 | later, alive, least), 2 * length
    return rank


def _often(values: np.ndarray, alive: np.ndarray, least: int) -> np.ndarray:
    rank = np.zeros(len(values), np.int64)
    _, at, counts = np.unique(values[alive], return_inverse=True, return_counts=True)
    rank[alive] = np.where(counts >= least, np.arange(1, len(counts) + 1), 0)[at]
    return rank


class _Chunk:
    """Tokens of streams, the stream of each, the hash of the run at each, and the positions of runs inside a stream."""

    def __init__(self, streams: list[list[str]]):
        lengths = np.array([len(s) + 1 for s in streams], np.int64)
        names: dict[str, int] = {}
        self.tokens = np.empty(int(lengths.sum()), np.int64)
        self.starts = np.cumsum(lengths) - lengths
        for k, (stream, start) in enumerate(zip(streams, self.starts.tolist())):
            self.tokens[start : start + len(stream)] = [names.setdefault(t, len(names)) for t in stream]
            self.tokens[start + len(stream)] = -1 - k  # separators are all different
        self.owner = np.repeat(np.arange(len(streams)), lengths)
        hashes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in names] or [0], np.uint64)
        self.runs = windows(hashes[np.maximum(self.tokens, 0)], RUN).view(np.int64)
        place = np.arange(len(self.runs))
        self.place = place[place + RUN <= (self.starts + lengths - 1)[self.owner[: len(place)]]]


def _counted(classes: np.ndarray, owner: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes, and how many texts, and how many open ones, hold each."""
    names, at = np.unique(classes, return_inverse=True)
    at, text = np.divmod(np.unique(at * len(is_open) + owner), max(1, len(is_open)))
    return names, np.bincount(at, minlength=len(names)), np.bincount(at, is_open[text], minlength=len(names)).astype(np.int64)


def _texts(rows: pd.DataFrame, hosts: set[str] | None = None) -> Iterator[tuple[str, _Chunk, np.ndarray, np.ndarray]]:
    """For each host of a part: its different texts, the text of each token, and which texts the markup leaves open."""
    rows = rows.sort_values(["own", "key"]).drop_duplicates(["host", "own"])
    for host, own in rows.groupby("host"):
        if hosts is not None and host not in hosts:
            continue
        # what is not the main text has a stream of its own
        chunk = _Chunk([_stream(found) for page in _unpacked(own["packed"]) for found in page])
        yield host, chunk, chunk.owner[chunk.place] // 2, ~own["settled"].to_numpy(bool)


def _rows(host: str, runs, pages, is_open) -> pd.DataFrame:
    return pd.DataFrame({"host": pd.Series([host] * len(runs), dtype=object), "run": pd.array(runs, dtype="Int64"), "pages": pages, "open": is_open})


NO_RUNS = pd.DataFrame({"host": pd.Series([], dtype=object), "run": pd.array([], dtype="Int64"), "pages": np.zeros(0, np.int64), "open": np.zeros(0, np.int64)})


def _runs(rows: pd.DataFrame) -> pd.DataFrame:
    """The numbers of texts of a part (without a run), and the runs that are on a ``SHARE`` of them."""
    out = [NO_RUNS]
    for host, chunk, owner, is_open in _texts(rows):
        # a run that is on so many texts is at as many places
        least = min(SHARE * len(is_open), SHARE * is_open.sum() or len(is_open))
        rank = suffix_ranks(chunk.tokens, RUN, max(1, math.ceil(least)))[chunk.place]
        place, owner, rank = chunk.place[rank > 0], owner[rank > 0], rank[rank > 0]
        names, pages, opened = _counted(rank, owner, is_open)
        first = place[np.unique(rank, return_index=True)[1]]
        often = (pages >= SHARE * len(is_open)) | (opened >= max(1, SHARE * is_open.sum()))
        out += [_rows(host, [None], [len(is_open)], [int(is_open.sum())]), _rows(host, chunk.runs[first[often]], pages[often], opened[often])]
    return pd.concat(out, ignore_index=True)


def _count(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many texts of a part hold each of these runs."""
    out = [NO_RUNS]
    for host, chunk, owner, is_open in _texts(rows, set(asked["host"])):
        runs = chunk.runs[chunk.place]
        held = np.isin(runs, asked.loc[asked["host"] == host, "run"].to_numpy(np.int64))
        out.append(_rows(host, *_counted(runs[held], owner[held], is_open)))
    return pd.concat(out, ignore_index=True)


def _cut(rows: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
    """Texts that the markup leaves open, without what repeated runs cover."""
    texts = []
    known = {host: own["run"].to_numpy(np.int64) for host, own in repeated.groupby("host")}
    for host, (main, _) in zip(rows["host"], _unpacked(rows["packed"])):
        if host in known:
            stream = _stream(main)
            chunk = _Chunk([stream])
            covered = np.zeros(len(stream) + RUN, bool)
            for k in chunk.place[np.isin(chunk.runs[chunk.place], known[host])]:
                covered[k : k + RUN] = True
            main = [b for b in (" ".join(block) for block in _blocks(stream, covered)) if b]
        texts.append(BLOCK.join(main))
    return _frame(rows, texts)


def _blocks(stream: list[str], covered: np.ndarray) -> Iterator[list[str]]:
    block: list[str] = []
    for token, c in zip(stream, covered):
        if token == BLOCK:
            yield block
            block = []
        elif not c:
            block.append(token)
    yield block


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    # at most a row for each CHUNK_PAGES pages
    large = pages.groupBy("host").agg(F.ceil(F.count("*") / CHUNK_PAGES).cast("int").alias("chunks")).where("chunks > 1")
    dealt = pages.join(F.broadcast(large), "host", "left").select("page_id", "url", "html", "host", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    part = lambda chunk: F.xxhash64("host", chunk).alias("part")
    deal = lambda *by: part(F.pmod(F.xxhash64(*by), F.col("chunks")).cast("int"))
    # copies of a text are in one part; pages are read anew for each pass, so that their texts are held once at a time
    texts = dealt.select("host", "chunks", "html").mapInPandas(_candidates, "host string, chunks int, own binary, key binary, settled boolean, packed binary")
    texts = texts.select("host", "own", "key", "settled", "packed", deal("own")).groupBy("part")
    schema = "host string, run long, pages long, open long"
    # a run on a share of a host's texts is on that share of a part's at least once, so that no other need be counted
    found = materialize(texts.applyInPandas(_runs, schema), "runs")
    release(pages.sparkSession)
    hosts = found.where("run is null").groupBy("host").agg(F.sum("pages").alias("all_pages"), F.sum("open").alias("all_open"))
    asked = _theirs(found.where("run is not null").select("host", "run").distinct(), large, part)
    counts = texts.cogroup(asked.groupBy("part")).applyInPandas(_count, schema)
    counts = materialize(counts.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("open").alias("open")), "counts")
    release(pages.sparkSession)
    least = lambda n: F.greatest(F.lit(PAGES + 1), F.ceil(F.col(n) * F.lit(SHARE)))
    repeated = counts.join(hosts, "host").where((F.col("pages") >= least("all_pages")) | (F.col("open") >= least("all_open"))).select("host", "run")
    parsed = materialize(dealt.mapInPandas(_parse, "page_id long, url string, host string, chunks int, settled boolean, packed binary"), "parsed")
    out = "page_id long, url string, text string"
    left = parsed.where("not settled").select("page_id", "url", "host", "packed", deal("page_id", "url"))
    cut = left.groupBy("part").cogroup(_theirs(repeated, large, part).groupBy("part")).applyInPandas(_cut, out)
    whole = parsed.where("settled").select("page_id", "url", "packed").mapInPandas(_settled, out)
    return whole.unionByName(cut).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _theirs(runs: DataFrame, large: DataFrame, part) -> DataFrame:
    """``host, run, part`` for all parts of the host."""
    of = runs.join(F.broadcast(large), "host", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    return of.select("host", "run", part("chunk"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
