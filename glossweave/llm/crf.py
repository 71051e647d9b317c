"""Operator 1: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: maximal runs of text within one block-level element. Each block has binary features, hashed: the
tags and class names of its ancestors, and what its text looks like (length, share of it in links, punctuation,
capitals, digits), alone and beside its neighbours. A chain of two labels, main and rest, scores a labelling by the
weights of the blocks' features and of the transitions; it is trained by maximum likelihood (forward-backward) on
labelled pages and decoded by Viterbi (Lafferty et al. 2001).

Labelled pages are those whose author marked the main text: what is within <article> or <main> is main text, all else
isn't. These two tags, and where blocks lie within them, are left out of the features, so that the model has to learn
from the rest what it applies to pages without such markup. At most ``max_pages`` pages are used for the fit, those of
the least hashes of page_id; all pages are decoded, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

MAX_PAGES = 1500
FEATURES = 1 << 12
ROUNDS, RATE, DECAY = 80, 0.25, 1e-3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|([^<]+)|<", re.S | re.I)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([\w -]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_MARKED = frozenset(("article", "main"))
#: Tags that end an open <p>, and those that end an open one of their own kind.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_UNSEEN = frozenset(("head", "title", "svg", "iframe", "object", "textarea", "select"))
#: What can stand in a head; anything else ends it. Start tags that end an open <svg>, and those that end an open <select>.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_ENDS_SELECT = frozenset(("input", "keygen", "select", "textarea"))
_OF_TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
_WORD = re.compile(r"\w+")
_PUNCT = re.compile(r"[.,;:!?]")


_HASHED: dict[str, int] = {}


def _feature(name: str) -> int:
    at = _HASHED.get(name)
    if at is None:
        at = zlib.crc32(name.encode()) % FEATURES
        if len(_HASHED) < 100_000:
            _HASHED[name] = at
    return at


@dataclass(slots=True, frozen=True)
class Place:
    """What a block's features take from its ancestors. Elements share it with their children but for what they add, so a page costs as
    much memory as it has elements, however deep they are nested."""

    parent: str
    last: tuple[str, ...]
    depth: int
    features: frozenset[int]

    def within(self, tag: str, mark: str) -> Place:
        if tag in _MARKED:
            return self
        new = {_feature("mark=" + w) for w in mark.split()[:4]}
        outer = tag not in _INLINE
        counted = outer and tag not in ("html", "body")
        if counted:
            new.add(_feature("in=" + tag))
        features = self.features if new <= self.features else self.features | new
        last = (*self.last, tag)[-3:] if counted else self.last
        if features is self.features and last == self.last and not outer:
            return self
        return Place(tag if outer else self.parent, last, self.depth + counted, features)


_ROOT = Place("", (), 0, frozenset())


@dataclass(slots=True)
class Block:
    place: Place
    text: str
    linked: int
    main: bool


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Any input is taken: tags may be left open, or closed that aren't."""
    blocks: list[Block] = []
    tags: list[str] = []
    places: list[Place] = [_ROOT]
    open_ones: Counter[str] = Counter()
    held: list[str] = []
    linked = in_link = unseen = marked = 0
    raw_entities = False

    def flush() -> None:
        nonlocal linked, raw_entities
        if held:
            text = "".join(held)
            if raw_entities:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append(Block(places[-1], text, min(linked, len(text)), marked > 0))
            held.clear()
        linked, raw_entities = 0, False

    def close(at: int) -> None:
        nonlocal in_link, unseen, marked
        for t in tags[at:]:
            in_link -= t == "a"
            unseen -= t in _UNSEEN
            marked -= t in _MARKED
            open_ones[t] -= 1
        del tags[at:], places[at + 1 :]

    def last_of(name: str) -> int:
        at = len(tags) - 1
        while tags[at] != name:
            at -= 1
        return at

    def end_unseen(name: str) -> None:
        """Closes what a start tag ends of the unseen elements, by HTML's rules."""
        if open_ones["head"] and name not in _IN_HEAD and (unseen == 1 or name == "body"):
            close(tags.index("head"))
        if open_ones["textarea"] or open_ones["iframe"]:
            return
        if open_ones["select"]:
            at = tags.index("select")
            if name in _ENDS_SELECT or (name in _OF_TABLE and "table" in tags[:at]):
                close(at)
        if open_ones["svg"]:
            at = tags.index("svg")
            if name in _ENDS_SVG and not any(t in ("foreignobject", "desc", "title") for t in tags[at:]):
                close(at)

    for found in _TOKEN.finditer(page):
        text = found[5]
        if text is not None:
            if unseen == 1 and tags[-1] == "head" and text.strip():
                close(len(tags) - 1)  # text ends a head, too
            if not unseen:
                held.append(text)
                if "&" in text:
                    raw_entities = True
                if in_link:
                    linked += len(text.strip())
            continue
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if found[2]:
            if open_ones[name]:
                at = last_of(name)
                if name not in _INLINE or any(t not in _INLINE for t in tags[at:]):
                    if name in _INLINE:
                        continue  # it was opened outside of the block that is open now
                    flush()
                close(at)
            continue
        if unseen:
            end_unseen(name)
        if name in _VOID:
            if name in ("br", "hr"):
                held.append(" ")
            continue
        if name not in _INLINE:
            flush()
            if name in _ENDS_P and open_ones["p"]:
                close(tags.index("p"))
            for own in _ENDS_OWN.get(name, ()):
                if own in tags[-3:]:
                    close(last_of(own))
            while tags and tags[-1] in _INLINE:
                close(len(tags) - 1)
        mark = _CLASS.search(found[4]) if "=" in found[4] and name not in _INLINE else None
        tags.append(name)
        open_ones[name] += 1
        places.append(places[-1].within(name, mark[1].lower() if mark else ""))
        in_link += name == "a"
        unseen += name in _UNSEEN
        marked += name in _MARKED
        if found[4].endswith("/") and name not in _INLINE:
            close(len(tags) - 1)
    flush()
    return blocks


def block_features(block: Block) -> list[int]:
    """Hashed features of a block by itself."""
    place, text = block.place, block.text
    n = len(text)
    spaces = text.count(" ") + 1
    names = ["bias", "parent=" + (place.last[-1] if place.last else ""), "path=" + ">".join(place.last), f"words={min(9, spaces.bit_length())}", f"links={int(4.999 * block.linked / n)}", f"depth={min(6, place.depth)}"]
    names.append(f"stops={min(4, 20 * len(_PUNCT.findall(text)) // spaces)}")
    names.append("ends" if text[-1] in ".!?" else "open")
    if not text[0].isalnum():
        names.append("odd")
    elif text[0].isdigit():
        names.append("digit")
    elif text[0].isupper():
        names.append("capital")
    return [*(_feature(x) for x in names), *sorted(place.features)]


def page_features(blocks: list[Block]) -> tuple[list[int], list[int]]:
    """Features of all blocks in a row, and how many each has: its own, and its neighbours' length and parent."""
    own = [block_features(b) for b in blocks]
    short = [(min(4, (len(b.text) // 8).bit_length()), b.place.parent) for b in blocks]
    flat: list[int] = []
    counts: list[int] = []
    last = len(blocks) - 1
    for i, f in enumerate(own):
        before = f"{short[i - 1][0]}{short[i - 1][1]}" if i else "start"
        after = f"{short[i + 1][0]}{short[i + 1][1]}" if i < last else "end"
        flat += f
        flat.append(_feature("before=" + before))
        flat.append(_feature("after=" + after))
        counts.append(len(f) + 2)
    return flat, counts


@dataclass
class Chain:
    """Weights of features for main (against rest), of transitions [from, to], and of the first label."""

    weight: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def emissions(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(blocks, 2) scores of the labels rest and main."""
        out = np.zeros((len(counts), 2))
        if len(counts):
            out[:, 1] = np.add.reduceat(self.weight[flat], np.concatenate(([0], np.cumsum(counts)[:-1])))
        return out


def _groups(lengths: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Pages of like numbers of blocks together, so that padding stays small."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * lengths[order[to]] <= most and lengths[order[to]] <= 2 * lengths[order[at]] + 8:
            to += 1
        yield order[at:to]
        at = to


def viterbi(emission: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """The best labels (True: main) of all blocks; the blocks of a page are in a row."""
    begin = np.concatenate(([0], np.cumsum(lengths)))
    out = np.zeros(len(emission), bool)
    for pages in _groups(lengths):
        n = lengths[pages]
        longest = int(n.max())
        where = begin[pages][:, None] + np.arange(longest)
        there = np.arange(longest) < n[:, None]
        e = emission[np.where(there, where, 0)]
        score = chain.first + e[:, 0]
        back = np.zeros((longest, len(pages), 2), np.int8)
        for t in range(1, longest):
            step = score[:, :, None] + chain.move
            back[t] = step.argmax(axis=1)
            score = np.where(there[:, t, None], step.max(axis=1) + e[:, t], score)
        label = score.argmax(axis=1)
        labels = np.zeros((len(pages), longest), bool)
        for t in range(longest - 1, -1, -1):
            live = there[:, t]
            labels[live, t] = label[live] == 1
            if t:
                label = np.where(live, back[t][np.arange(len(pages)), label], label)
        out[where[there]] = labels[there]
    return out


def marginals(e: np.ndarray, there: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward over padded pages: label marginals, expected transitions, log partition of each page."""
    pages, longest, _ = e.shape
    forward = np.zeros_like(e)
    forward[:, 0] = chain.first + e[:, 0]
    for t in range(1, longest):
        step = forward[:, t - 1, :, None] + chain.move
        forward[:, t] = np.where(there[:, t, None], np.logaddexp(step[:, 0], step[:, 1]) + e[:, t], forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros_like(e)
    moves = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        ahead = chain.move + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
        live = there[:, t + 1]
        backward[:, t] = np.where(live[:, None], np.logaddexp(ahead[:, :, 0], ahead[:, :, 1]), 0)
        moves += np.exp(forward[live, t][:, :, None] + ahead[live] - total[live, None, None]).sum(axis=0)
    return np.exp(forward + backward - total[:, None, None]) * there[:, :, None], moves, total


def fit(pages: list[tuple[list[int], list[int], list[bool]]], rounds: int = ROUNDS) -> Chain:
    """Maximum likelihood with decay, by Adagrad over all pages. Without a block, a chain that takes nothing for main text."""
    pages = [p for p in pages if p[1]]
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        chain.first[0] = 1.0
        return chain
    flat = np.concatenate([p[0] for p in pages]).astype(np.int64)
    counts = np.concatenate([p[1] for p in pages]).astype(np.int64)
    gold = np.concatenate([p[2] for p in pages]).astype(np.int64)
    lengths = np.array([len(p[1]) for p in pages])
    begin = np.concatenate(([0], np.cumsum(lengths)))
    of = np.repeat(np.arange(len(counts)), counts)
    inner = np.ones(len(gold), bool)
    inner[begin[:-1]] = False
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    seen_first = np.bincount(gold[begin[:-1]], minlength=2)
    past = [np.full(x.shape, 1e-8) for x in (chain.weight, chain.move, chain.first)]
    for _ in range(rounds):
        emission = chain.emissions(flat, counts)
        expected, moves, first = np.zeros(len(gold)), np.zeros((2, 2)), np.zeros(2)
        for some in _groups(lengths):
            longest = int(lengths[some].max())
            where = begin[some][:, None] + np.arange(longest)
            there = np.arange(longest) < lengths[some][:, None]
            p, m, _ = marginals(emission[np.where(there, where, 0)], there, chain)
            expected[where[there]] = p[:, :, 1][there]
            moves += m
            first += p[:, 0].sum(axis=0)
        slopes = (np.bincount(flat, (gold - expected)[of], FEATURES) / len(pages) - DECAY * chain.weight, (seen_moves - moves) / len(pages) - DECAY * chain.move, (seen_first - first) / len(pages))
        for x, g, h in zip((chain.weight, chain.move, chain.first), slopes, past):
            h += g * g
            x += RATE * g / np.sqrt(h)
    return chain


_SAMPLE = "flat array<int>, counts array<int>, main array<boolean>"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.column(0).to_pylist():
            blocks = leaf_blocks(page)
            flat, counts = page_features(blocks)
            rows.append((flat, counts, [b.main for b in blocks]))
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["flat", "counts", "main"])


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Chain:
    """Fits the chain to pages (page_id, html) whose main text is marked."""
    marked = pages.select("page_id", "html").where(F.lower("html").rlike("<(article|main)[ >]"))
    # the hashes alone are sorted; then the pages of the sample are read
    top = marked.select(F.xxhash64("page_id").alias("h")).orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    sample = marked.where(F.xxhash64("page_id") <= F.lit(top)).orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(max_pages).select("html") if top is not None else marked.select("html")
    rows = sample.mapInArrow(_labelled, _SAMPLE).collect()
    return fit(sorted((list(r.flat), list(r.counts), list(r.main)) for r in rows))


def extract(pages: list[str], chain: Chain) -> list[tuple[int, int, str]]:
    """(blocks, blocks of main text, main text) of each page."""
    parsed = [leaf_blocks(p) for p in pages]
    flat: list[int] = []
    counts: list[int] = []
    for blocks in parsed:
        f, c = page_features(blocks)
        flat += f
        counts += c
    lengths = np.array([len(b) for b in parsed], np.int64)
    labels = viterbi(chain.emissions(np.array(flat, np.int64), np.array(counts, np.int64)), lengths, chain)
    out, at = [], 0
    for blocks in parsed:
        own = labels[at : at + len(blocks)]
        at += len(blocks)
        out.append((len(blocks), int(own.sum()), "\n".join(b.text for b, m in zip(blocks, own.tolist()) if m)))
    return out


def extract_pages(pages: DataFrame, max_pages: int = MAX_PAGES, chain: Chain | None = None) -> DataFrame:
    """Each row of ``pages`` (page_id, html, any others) as (page_id, n_blocks, n_main, text), text being its main text.

    Blocks of the main text are joined by line feeds, white space within them is single. A null or empty page, or one
    without text, has no blocks and an empty text. Repeated rows fare alike. Where no page's main text is marked, nothing is taken
    for main text. Very long and very deep pages are read whole, in time and memory that follow their length. An empty table gives an empty result. Other columns, whatever their names, have no effect.
    """
    model = chain or train(pages, max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                found = extract(batch.column(1).to_pylist(), model)
                kinds = (pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["page_id", "n_blocks", "n_main", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, n_blocks int, n_main int, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
