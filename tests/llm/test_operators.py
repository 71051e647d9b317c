"""The ten training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from glossweave.llm import _common, components, crf, imatch, licenses, mixing, packing, simhash, substrings, topk, toxicity, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, th string, score double, gw_th string, gw_batch int, gw_score int, kept string, key int"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))


def prose(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text, source) with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 3, "x", 0.5, "y", 1, 2, "z", 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    pool = [word(rng) for _ in range(3000)]
    texts = [prose(rng, rng.randint(60, 200), pool) for _ in range(40)]
    passage = prose(rng, 70, pool)
    out = [(i, t, rng.choice(["web", "books", None])) for i, t in enumerate(texts)]
    for i in range(100, 110):  # near copies: a word in 40 is another
        own = texts[i - 100].split()
        for at in range(5, len(own), 40):
            own[at] = word(rng)
        out.append((i, " ".join(own), "web"))
    out += [(i, f"{prose(rng, 30, pool)} {passage} {prose(rng, 40, pool)}", "web") for i in range(200, 206)]
    out += [(300, texts[0], "web"), (300, texts[0], "web"), (None, texts[1], None), (None, texts[1], None), (301, None, None), (302, "", "web"), (303, " \n\t ", "web"), (None, None, None), (304, "Short.", "books"), (305, "Short.", "books")]
    out.append((306, prose(rng, 30_000, pool), "books"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(map(tuple, df.collect()))


# 1 HTML extraction


def test_crf_beats_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    chain = crf.train(pages.where("page_id % 2 = 0"))
    held = [r.html for r in pages.where("page_id % 2 = 1 and html is not null").collect()]
    gold = [b.main for p in held for b in crf.leaf_blocks(p) if "<article" in p.lower() or "<main" in p.lower()]
    parsed = [crf.leaf_blocks(p) for p in held if "<article" in p.lower() or "<main" in p.lower()]
    lengths = np.array([len(b) for b in parsed])
    flat, counts = [], []
    for b in parsed:
        f, c = crf.page_features(b)
        flat += f
        counts += c
    found = crf.viterbi(chain.emissions(np.array(flat), np.array(counts)), lengths, chain)
    gold = np.array(gold)
    precision, recall = (gold & found).sum() / max(1, found.sum()), (gold & found).sum() / gold.sum()
    assert precision > 0.9 and recall > 0.9


def test_pages_without_marks_are_decoded(spark):
    """The held-out pages again, with the tags that mark their main text taken away: what the chain is for."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").where("html is not null")
    chain = crf.train(pages.where("page_id % 2 = 0"))
    right = found = there = 0
    for r in pages.where("page_id % 2 = 1").collect():
        gold = Counter(b.text for b in crf.leaf_blocks(r.html) if b.main)
        bare = re.sub(r"</?(article|main)\b[^>]*>", "\n", r.html, flags=re.I)
        got = Counter(crf.extract([bare], chain)[0][2].split("\n")) if gold else Counter()
        got.pop("", None)
        right, found, there = right + (got & gold).total(), found + got.total(), there + gold.total()
    assert right > 0.8 * found and right > 0.8 * there


def test_deep_pages():
    """Text at every one of forty thousand levels: no block has a path of its own."""
    import time

    began = time.time()
    blocks = crf.leaf_blocks("".join(f"<div class=c{i % 7}>x{i}" for i in range(40_000)) + "</p></b></div>" * 40_000)
    flat, counts = crf.page_features(blocks)
    assert len(blocks) == 40_000 and len(flat) == sum(counts) < 40_000 * 30 and time.time() - began < 30
    assert len({id(b.place.features) for b in blocks}) < 20


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    chain = crf.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    e = rng.normal(size=(5, 2))
    value = lambda y: chain.first[y[0]] + sum(e[i, l] for i, l in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, E741
    paths = list(itertools.product((0, 1), repeat=5))
    best = max(paths, key=value)
    assert tuple(crf.viterbi(e, np.array([5]), chain).astype(int)) == best
    weight = np.exp([value(y) for y in paths])
    p, _, total = crf.marginals(e[None], np.ones((1, 5), bool), chain)
    assert total[0] == pytest.approx(np.log(weight.sum()))
    assert p[0, :, 1] == pytest.approx([(weight * [y[i] for y in paths]).sum() / weight.sum() for i in range(5)])


def test_html_awkward_rows(spark):
    body = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title here</h1><p>A long sentence of text, with commas, and an end.</p></article></body></html>"
    pages = spark.createDataFrame([(1, body, "u"), (1, body, "u"), (2, None, "u"), (3, "", "u"), (4, "<p>open <b>never</i> closed", "u"), (None, "plain text &amp; more", "u"), (5, "<div>" * 3000 + "deep", "u")], "page_id long, html string, n_main string")
    out = crf.extract_pages(pages)
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == 7 and found[2].n_blocks == found[3].n_blocks == 0 and found[2].text == ""
    assert found[1].n_blocks == 3 and "Home" not in found[1].text
    assert crf.extract_pages(pages.limit(0)).count() == 0
    assert {r.n_main for r in crf.extract_pages(pages.where("page_id in (2, 3, 4)")).collect()} == {0}


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><body><p>one</p></body>", ["one"]),
        ("<head><title>a <b>b</b> c</title><meta x=y><p>one<p>two", ["one", "two"]),
        ("<head><link href=x>one<p>two", ["one", "two"]),
        ("<head><title>t<body><p>one", ["one"]),
        ("<div><svg><path d=x><p>one</p></div>", ["one"]),
        ("<div><svg><title>t</title><foreignObject><p>in</p></foreignObject></svg>one</div>", ["one"]),
        ("<table><tr><td><select><option>o<td>one</table>", ["one"]),
        ("<div><select><option>o<input>one</div>", ["one"]),
    ],
)
def test_unseen_elements_left_open(page, texts):
    assert [b.text for b in crf.leaf_blocks(page)] == texts


# 2 SimHash


def test_simhash_against_all_pairs(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    texts = sorted({t for _, t, _ in rows if t and t.strip()})
    import pyarrow as pa

    fp = np.stack([np.frombuffer(x, np.uint64) for x in simhash.fingerprints(pa.array(texts))])
    near = simhash.distances(fp[:, None], fp[None]) <= simhash.RADIUS
    group = np.arange(len(texts))
    while True:
        new = np.array([group[n].min() for n in near])
        if (new == group).all():
            break
        group = new
    of = {t: group[i] for i, t in enumerate(texts)}
    want = defaultdict(list)
    for i, t, _ in rows:
        if t in of:
            want[of[t]].append(math.inf if i is None else i)
    by_id = {i: sorted(v) for v in want.values() for i in v}
    pairs = sum(len(v) * (len(v) - 1) // 2 for v in want.values())
    groups = defaultdict(list)
    for r in got:
        if r.group_size > 1:
            groups[r.group_id].append(math.inf if r.doc_id is None else r.doc_id)
    hit = sum(len(v) * (len(v) - 1) // 2 for v in groups.values() if sorted(v) == by_id.get(v[0]))
    assert hit >= 0.9 * pairs and sum(r.kept for r in got if r.group_size > 1) == len(groups)
    for i in range(100, 110):
        assert {r.group_id for r in got if r.doc_id == i} == {i - 100 if i - 100 != 1 else 1}


def test_simhash_drop(docs, rows, empty):
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert not set(range(100, 110)) & set(kept) and kept.count(300) == 0 and {301, 302, 303, 304, 306, *range(40)} <= set(kept) and 305 not in kept
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_repeated_rows(spark):
    same = frame(spark, [(7, "the very same words here", "a")] * 5 + [(8, "nothing in common at all", "a")])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(same).collect()) == [7, 8]


def at_the_radius(seed):
    """Pairs of texts whose fingerprints differ in about as many bits as near copies may, and each text's group by all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    texts = []
    for k in range(200):
        own = [f"w{k}x{i}" for i in range(100)]
        texts += [" ".join(own), " ".join([f"v{k}x{i}" for i in range(rng.integers(9, 20))] + own[20:])]
    fp = np.stack([np.frombuffer(x, np.uint64) for x in simhash.fingerprints(pa.array(texts))])
    apart = simhash.distances(fp[:, None], fp[None])
    assert (np.abs(apart[np.arange(0, 400, 2), np.arange(1, 400, 2)] - simhash.RADIUS) <= 4).sum() > 50
    u, v = np.nonzero(apart <= simhash.RADIUS)
    group = np.arange(len(texts))
    for _ in range(len(texts)):
        new = group.copy()
        np.minimum.at(new, u, group[v])
        if (new == group).all():
            return texts, group.tolist()
        group = new


def test_op2_simhash_near_dedup_misses_no_neighbours(spark):
    texts, group = at_the_radius(1)
    got = simhash.near_duplicates(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    assert {r.doc_id: r.group_id for r in got.collect()} == dict(enumerate(group))


def test_pipeline_near_dedup_leaves_no_neighbours(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, group = at_the_radius(3)
    out = corpus_pipeline.near_dedup(spark, frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(group))


def all_components(fp, radius):
    u, v = np.nonzero(simhash.distances(fp[:, None], fp[None]) <= radius)
    return simhash.joined(np.arange(len(fp)), u, v)


@pytest.mark.parametrize("radius", [0, 1, 7, 20, 44, 70])
def test_simhash_parts_against_all_pairs(radius, monkeypatch):
    rng = np.random.default_rng(radius)
    bits = (rng.random((60, 256)) < 0.5).repeat(10, axis=0) ^ (rng.random((600, 256)) < radius / 512 + 0.001)
    bits = np.concatenate([bits, bits[:1].repeat(300, axis=0) ^ (rng.random((300, 256)) < radius / 1024 + 0.002)])
    fp = rng.permutation(np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0))
    want = all_components(fp, radius)
    assert len(set(want.tolist())) < len(fp) or not radius
    for crowd in (simhash.CROWD, 50):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "CHUNK", 1 << 9)
        assert (simhash.components_of(fp, len(fp), simhash.search_parts(radius), radius) == want).all()
        half = len(fp) // 2
        root = np.arange(len(fp))
        for a, b, split in ((0, half, half), (half, len(fp), len(fp) - half), (0, len(fp), half)):
            root = simhash.joined(root, np.arange(a, b), a + simhash.components_of(fp[a:b], split, simhash.search_parts(radius), radius))
        assert (root == want).all()


def test_simhash_blocks(spark):
    texts, group = at_the_radius(2)
    fps = simhash.fingerprint_table(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).persist()
    for block in (1000, 150, 40):
        root = dict(components.connected_components(simhash.neighbour_edges(fps, block=block)).collect())
        found = defaultdict(set)
        for r in fps.collect():
            found[root.get(r.fp, r.fp)].add(r.doc_id)
        assert {i: min(s) for s in found.values() for i in s} == dict(enumerate(group))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 201), (200, 202)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


# 3 licenses


def test_licenses_against_brute_force(spark, rows):
    extra = [(900, "x\nReleased under the MIT License.\nLicensed under CC BY 4.0 and more", "a"), (900, "x\nReleased under the MIT License.\nLicensed under CC BY 4.0 and more", "a"), (901, "license MIT the under released", "a")]
    docs = frame(spark, rows + extra)
    import re

    want = Counter()
    for i, t, _ in rows + extra:
        for at, line in enumerate((t or "").split("\n")):
            own = {w for w in re.split(licenses.SPLIT, line.lower()) if w}
            for name, text in licenses.TEMPLATES.items():
                words = set(licenses.tokens(text))
                if len(words & own) >= licenses.required(len(words), licenses.THRESHOLD):
                    want[(i, at, name, len(words & own), len(words & own) / len(words))] += 1
    assert bag(licenses.license_blocks(docs)) == want and len(want) >= 3
    assert licenses.license_blocks(docs.limit(0)).count() == 0 and licenses.license_blocks(docs, {"none": ""}).count() == 0


def test_wrapped_licenses(spark):
    """A notice at 40 columns is found where it begins; a line that matches alone isn't reported with its neighbours."""
    import textwrap

    notice = "\n".join(textwrap.wrap(licenses.TEMPLATES["mit-grant"], 40, initial_indent="# ", subsequent_indent="# "))
    far = "Released\nunder" + "\nword" * 60 + "\nthe MIT\nLicense"
    docs = frame(spark, [(1, f"first line\n{notice}\nlast", "a"), (2, "x\nReleased under the MIT License.\nthe license", "a"), (3, far, "a"), (4, "Released under\nthe MIT License", "a")])
    found = {(r.doc_id, r.template): r for r in licenses.license_blocks(docs).collect()}
    assert set(found) == {(1, "mit-grant"), (2, "mit"), (4, "mit")}
    assert found[1, "mit-grant"].block in (1, 2) and found[1, "mit-grant"].containment >= licenses.THRESHOLD
    assert (found[2, "mit"].block, found[4, "mit"].block, found[4, "mit"].containment) == (1, 0, 1.0)


# 4 mixing


def test_mixing_takes_what_is_due(docs, rows, empty):
    out = mixing.mixture(docs).collect()
    size = lambda t: max(1, len(t or ""))
    sources = defaultdict(list)
    for i, t, s in rows:
        sources[s or ""].append(size(t))
    weight = {s: math.floor(sum(v) ** mixing.TEMPERATURE * 1024) for s, v in sources.items()}
    total = sum(map(sum, sources.values()))
    for s, sizes in sources.items():
        power = [math.floor(x**mixing.LENGTH_POWER * 1024) for x in sizes]
        rate = total * weight[s] / sum(weight.values()) / sum(p * x for p, x in zip(power, sizes))
        due = [p * rate for p in power]
        want = sum(map(math.floor, due)) + round(sum(m - math.floor(m) for m in due))
        assert abs(sum(r.copies for r in out if (r.source or "") == s) - want) <= 1
    assert mixing.mix_sources(docs).columns == [c for c in docs.columns]
    assert mixing.mix_sources(docs).count() == sum(r.copies for r in out)
    assert mixing.mixture(empty).count() == 0
    assert {r.source for r in mixing.mixture(docs, {"books": 1.0}).collect()} == {"books"}


def test_mixing_keeps_columns_of_any_name(spark):
    """Columns named like the operator's own come out as they went in, and ties between equal rows are cut where they are due."""
    names = ["gw_key", "gw_q", "gw_p", "gw_u", "gw_m", "gw_bin", "gw_id", "gw_copies", "gw_copy", "gw_last", "column_0", "Copies"]
    rows = [(None if i % 3 else i, "same words" if i % 3 else f"text {i}", "a" if i % 2 else None, 10, *[f"{n}{i}" for n in names]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    own = {r[4:] for r in rows}
    for share in (0.5, 1.7):
        out = mixing.mix_sources(docs, {"a": 2.0, "": 1.0}, share)
        assert out.columns == docs.columns
        found = out.collect()
        assert {tuple(r)[4:] for r in found} <= own
        assert {k: sum((r.source or "") == k for r in found) for k in ("a", "")} == {"a": round(900 * share * 2 / 3 / 10), "": round(900 * share / 3 / 10)}
        most = Counter(tuple(r) for r in found)
        assert max(most.values()) <= math.ceil(2 * share)


# 5 substrings


def covered(found, lengths):
    out = defaultdict(set)
    for r in found:
        out[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    return out


def test_repeats_against_every_window(spark, docs, rows):
    from pyspark.sql import functions as F

    unique = [(i, t) for i, t, _ in rows if i is not None and t is not None]
    unique = list(dict.fromkeys(unique))
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text").dropDuplicates()
    order = {r.doc_id: r.h % 2**64 for r in own.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    unique.sort(key=lambda x: (order[x[0]], x[0]))
    seen, want = {}, defaultdict(set)
    for place, (i, t) in enumerate(unique):
        w = t.split()
        for at in range(len(w) - substrings.LEAST + 1):
            key = tuple(w[at : at + substrings.LEAST])
            if key in seen:
                if seen[key][0] != place or at - seen[key][1] >= substrings.LEAST:
                    want[i] |= set(range(at, at + substrings.LEAST))
            else:
                seen[key] = (place, at)
    for parts, heavy in ((1, None), (3, None), (3, 1)):
        got = covered(substrings.repeated_passages(own, parts=parts, heavy=heavy).collect(), None)
        assert got == want
    assert sum(200 <= i < 206 for i in want) == 5


def test_repeats_are_cut(docs, rows, empty):
    out = substrings.drop_repeated_passages(docs)
    assert out.columns == docs.columns
    left = out.collect()
    texts = [r.text for r in left if r.doc_id is not None and 200 <= r.doc_id < 206]
    assert sum(len(t.split()) == 140 for t in texts) == 1 and sum(len(t.split()) == 70 for t in texts) == 5
    assert sum(r.text == rows[0][1] for r in left) == 1 and {301, 302, 303, 304, 305, 306} <= {r.doc_id for r in left}
    assert all(r.n_chars == len(r.text) for r in left if r.text)
    assert substrings.repeated_passages(empty).count() == 0 and substrings.drop_repeated_passages(empty).count() == 0


def test_heavy_copies(spark, rows):
    """A text of which there are very many copies is searched once; the result is that of searching them all."""
    text = rows[3][1]
    copies = [(1000 + i, text, "web") for i in range(300)] + [(1000, text, "web")] * 3 + [(None, text, "web")] * 2 + [(2000 + i, "too short to be a passage " * 5, "web") for i in range(50)]
    docs = frame(spark, [*rows[:30], *rows[30:60], *copies])
    plain, spread = (bag(substrings.repeated_passages(docs, parts=2, heavy=h)) for h in (None, 1))
    assert plain == spread and sum(plain.values()) >= 305
    left = [bag(substrings.drop_repeated_passages(docs, parts=2, heavy=h).select("doc_id", "text", "n_chars")) for h in (None, 1)]
    assert left[0] == left[1] and sum(n for (_, t, _), n in left[0].items() if t == text) == 1


# 6 packing


@pytest.mark.parametrize("octets", [4_000, 50_000_000])
def test_packing_round_trip(docs, rows, empty, octets):
    """The pieces of each document make up its text, repeated rows and rows without an id too; every window has its own id."""
    out = packing.packed_windows(docs, capacity=256, most_open=4, octets=octets).collect()
    assert len({r.window_id for r in out}) == len(out)
    found = defaultdict(list)
    for r in out:
        assert r.n_tokens == sum(r.lengths) <= 256 and r.n_docs == len(r.doc_ids) == len(r.starts) == len(r.texts)
        for i, at, n, t in zip(r.doc_ids, r.starts, r.lengths, r.texts):
            assert len(t.split()) in (n, n - 1)
            found[i, at].append((n, t))
    want = Counter((i, t) for i, t, _ in rows if t is not None)
    wanted = Counter()
    for (i, t), times in want.items():
        words = t.split()
        starts = range(0, len(words) + 1, 256)
        wanted.update({(i, at, min(256, len(words) + 1 - at), " ".join(words[at : at + 256])): times for at in starts})
    assert Counter((i, at, n, " ".join(t.split())) for (i, at), x in found.items() for n, t in x) == wanted
    long = "".join(found[306, at][0][1] for at in sorted(at for i, at in found if i == 306))
    assert long == next(t for i, t, _ in rows if i == 306)
    assert packing.packed_windows(empty).count() == 0


def test_packing_leftovers_are_merged(docs, rows):
    """However many partitions the packing begins with, in the end no two windows of one round's leftovers fit together worse than best fit has it."""
    sizes = {o: packing.packed_windows(docs, capacity=256, most_open=4, octets=o).collect() for o in (2_000, 20_000, 10**9)}
    total = sum(len(t.split()) + 1 for _, t, _ in rows if t is not None)
    for out in sizes.values():
        assert sum(r.n_tokens for r in out) == total
        # without the merge, each of the partitions would leave up to four windows open
        assert sum(r.n_tokens < 128 for r in out) <= 8 and len(out) <= 1.15 * len(sizes[10**9])


def test_packing_is_bounded_best_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    open_, done = [], []
    for i, n in enumerate(sizes):
        if n >= 100:
            done.append([i])
            continue
        fits = [(100 - sum(sizes[j] for j in w) - n, w[0], w) for w in open_ if sum(sizes[j] for j in w) + n <= 100]
        if fits:
            w = min(fits)[2]
        else:
            if len(open_) == 5:
                fullest = min(open_, key=lambda w: (100 - sum(sizes[j] for j in w), w[0]))
                open_.remove(fullest)
                done.append(fullest)
            w = []
            open_.append(w)
        w.append(i)
        if sum(sizes[j] for j in w) == 100:
            open_ = [x for x in open_ if x is not w]
            done.append(w)
    got, left = packing.pack(sizes, 100, 5)
    assert got == done and sorted(left) == sorted(open_)


# 7 toxicity


def test_interaction_is_learnt(spark):
    """Neither the insult nor the group's name is toxic alone."""
    rng = random.Random(5)
    pool = [word(rng) for _ in range(400)]
    rows, labels, gold = [], [], {}
    for i in range(2400):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = prose(rng, 25, pool).split() + ["vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "web"))
        gold[i] = insult and group
        if i < 1600:
            labels.append((i, int(gold[i])))
    labels += [(0, None), (None, 1), (99_999, 1)]
    docs = frame(spark, rows + [(5000, None, None), (5001, "", None)])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxic_documents(docs, known).collect()}
    held = [out[i].toxic == gold[i] for i in range(1600, 2400)]
    assert sum(held) / len(held) > 0.97
    assert out[5000].score == 0 and not out[5000].toxic and not out[5001].toxic
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out.values())
    assert not any(r.toxic for r in toxicity.toxic_documents(docs, known.where("toxic = 0")).collect())
    assert toxicity.toxic_documents(docs.limit(0), known).count() == 0


def test_machine_against_the_double_sum():
    """Scores by the sum over pairs of terms, the gradient by differences."""
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.arange(7, dtype=np.uint32), 0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    rows = [sorted(rng.choice(7, n, replace=False).tolist()) for n in (0, 1, 3, 7)]
    row, term = np.array([i for i, t in enumerate(rows) for _ in t]), np.array([x for t in rows for x in t])

    def value(m, t):
        return m.w0 + sum(m.w[i] for i in t) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(t, 2))

    assert machine.scores(row, term, 4) == pytest.approx([1 / (1 + math.exp(-value(machine, t))) for t in rows])
    error, theta = rng.normal(size=4), np.concatenate([machine.w[:, None], machine.v], axis=1)
    total = lambda x: sum(e * value(toxicity.Machine(machine.terms, 0.3, x[:, 0], x[:, 1:]), t) for e, t in zip(error, rows))
    slope = toxicity.gradient(row, term, error, theta)
    for at in np.ndindex(theta.shape):
        up, down = theta.copy(), theta.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert slope[at] == pytest.approx((total(up) - total(down)) / 2e-5, abs=1e-6)


def test_training_rows_are_bounded(spark):
    docs = frame(spark, [(1, "bad words", "a")] * 500 + [(2, "good words", "a"), (3, "fine words", "a")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels, 2)[0]) == 2 and len(toxicity.training_rows(docs, labels, 10)[0]) == 10
    assert len(toxicity.training_rows(docs, labels)[0]) == 502
    assert not any(r.toxic for r in toxicity.toxic_documents(docs, labels.limit(0)).collect())


# 8 top-k


@pytest.mark.parametrize(("k", "every"), [(1, 1), (3, 1), (50, 1), (3, 7)])
def test_top_k_against_all_products(spark, k, every):
    """Vectors of two other dimensions are searched among their own kind; the one of the least id is no model for the rest."""
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(120, 6)) * np.exp(rng.normal(size=(120, 1)) * 1.5), 3)
    v[10] = v[11] = v[12]
    v[13] = 0
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(3, rows[3][1], "x"), (None, [1.0] * 6, "x"), (500, None, "x"), (501, [], "x"), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (503, [math.nan] * 6, "x"), (504, [1.0], "x"), (-7, [1.0, 2.0], "x"), (-14, [2.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    want = set()
    for q in range(0, 120, every):
        s = np.round(v @ v[q], topk.PLACES)
        best = sorted((-s[i], i) for i in range(120) if i != q)[:k]
        want |= {(q, r + 1, i, round(-x, 6) + 0.0) for r, (x, i) in enumerate(best)}
    want |= {(-7, 1, -14, 6.0), (-14, 1, -7, 6.0)}
    got = {(r.query_id, r.rank, r.neighbor_id, r.score + 0.0) for r in topk.top_k(df, k, bucket=8, buckets=3, every=every).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), k).count() == 0 and topk.top_k(df.where("vec_id = 1"), k).count() == 0


# 9 URL filter


def test_rules_against_enumeration(spark):
    rng = random.Random(9)
    pages, labels = [], []
    for i in range(600):
        host = rng.choice(["good.example.org", "spam.example.net", "shop.example.com"])
        path = "/".join(rng.choice(["win", "news", "casino", "item", "7"]) for _ in range(3))
        bad = (host.startswith("spam") and "casino" in path) if rng.random() > 0.02 else True
        pages.append((i, f"https://{host}/{path}?id={i}", "x"))
        labels.append((i, bad))
    pages += [(700, None, "x"), (701, "", "x"), (702, "HTTPS://SPAM.example.net/casino", "x"), (None, "not a url", "x"), (5, pages[5][1], "x")]
    p = spark.createDataFrame(pages, "page_id long, url string, blocked string")
    known = spark.createDataFrame(labels + [(None, True), (1, None)], "page_id long, bad boolean")
    rules = {tuple(r.tokens): (r.rows, r.confidence) for r in urls.mine_rules(p, known).collect()}
    tokens = {r.page_id: set(r.t) for r in p.where("page_id < 600").select("page_id", urls.url_tokens(p.url).alias("t")).collect()}
    items = [(tokens[i], b) for i, b in labels] + [(tokens[5], labels[5][1])]
    bad_rows, n = sum(b for _, b in items), len(items)
    every = sorted(set().union(*(t for t, _ in items)))
    good = {}
    for size in (1, 2, 3):
        for c in itertools.combinations(every, size):
            both = sum(b for t, b in items if t.issuperset(c))
            total = sum(t.issuperset(c) for t, _ in items)
            if both < max(urls.SUPPORT_ROWS, urls.SUPPORT * n) or both / total < urls.CONFIDENCE or both / total <= bad_rows / n:
                continue
            cells = [(both, total * bad_rows / n), (total - both, total * (n - bad_rows) / n), (bad_rows - both, (n - total) * bad_rows / n), (n - bad_rows - total + both, (n - total) * (n - bad_rows) / n)]
            if 2 * sum(o * math.log(o / e) for o, e in cells if o) >= urls.EVIDENCE:
                good[c] = (both, both / total)
    want = {c: v for c, v in good.items() if not any(set(d) < set(c) and good[d][1] >= v[1] for d in good)}
    assert rules == want and want
    out = urls.filter_urls(p, urls.mine_rules(p, known))
    found = {r.page_id: r.blocked for r in out.collect()}
    assert out.count() == len(pages) and found[702] and not found[700] and not found[701]
    assert urls.filter_urls(p.limit(0), urls.mine_rules(p, known)).count() == 0
    assert urls.mine_rules(p, known.where("not bad")).count() == 0


def test_url_query_keeps_rules_of_confidence_and_support(spark, tmp_path):
    """Five bad pages of a host and no good one make a rule, whatever chance would have made of them."""
    hosts = ["casino.example.com"] * 5 + ["news.example.org"] * 15
    spark.createDataFrame([(i, f"https://{h}/{'abcdefghijklmnopqrst'[i]}", "") for i, h in enumerate(hosts)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, int(i >= 5), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.page_id: r.blocked for r in urls.op9_url_filter(spark, str(tmp_path)).collect()}
    assert out == {i: i < 5 for i in range(20)}


def test_rule_of_four_tokens(spark):
    """Bad pages have all four tokens; each three of them are on twice as many good pages."""
    every = ["aa", "bb", "cc", "dd"]
    paths = [every] * 10 + [[t for t in every if t != out] for out in every for _ in range(20)]
    pages = spark.createDataFrame([(i, f"https://x.org/{'/'.join(p)}") for i, p in enumerate(paths)], "page_id long, url string")
    known = spark.createDataFrame([(i, i < 10) for i in range(len(paths))], "page_id long, bad boolean")
    found = {tuple(r.tokens): (r.rows, r.confidence) for r in urls.mine_rules(pages, known).collect()}
    assert found == {tuple(f"p:{t}" for t in every): (10, 1.0)}


def test_rules_of_a_long_url_that_is_repeated(spark):
    """Forty tokens on the same pages: a rule for each, not one for each of their subsets."""
    long = "https://spam.example.net/" + "/".join(f"word{i}" for i in range(37))
    pages = spark.createDataFrame([(i, long) for i in range(30)] + [(i, f"https://x.example.net/{i % 7}") for i in range(30, 90)], "page_id long, url string")
    rules = urls.mine_rules(pages, spark.createDataFrame([(i, i < 30) for i in range(90)], "page_id long, bad boolean"), evidence=0.0).collect()
    assert {tuple(r.tokens) for r in rules} == {("h:spam",), *((f"p:word{i}",) for i in range(37))} and {r.rows for r in rules} == {30}
    found = urls.filter_urls(pages, urls.mine_rules(pages, spark.createDataFrame([(0, True)], "page_id long, bad boolean"))).collect()
    assert not any(r.blocked for r in found)


# 10 I-Match


def test_imatch_sent_and_joined_agree(docs, rows, empty):
    sent = imatch.document_fingerprints(docs, low=0.01, high=0.5)
    joined = imatch.document_fingerprints(docs, low=0.01, high=0.5, max_lexicon=0)
    assert bag(sent) == bag(joined) and sent.count() == len(rows)
    by = defaultdict(set)
    for r in sent.collect():
        by[r.doc_id].add(r.signature_0)
    assert by[300] == by[0] and by[301] == by[302] == {None}
    assert imatch.document_fingerprints(empty).count() == 0


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_mixing", "op8_exact_topk", "op10_imatch"])
def test_queries_equal_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    plain = lambda r: tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)
    rows = want.fetchall()
    place = [[d[0] for d in want.description].index(c) for c in columns]
    a = sorted(repr(plain(r)) for r in got.select(*columns).collect())
    b = sorted(repr(plain([r[i] for i in place])) for r in rows)
    assert a == b


# the pipeline


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    at = docs.select(*columns)
    for name, stage in pipeline.STAGES[:-1]:
        after = _common.stored(stage(spark, at, DATA))
        assert after.columns == columns
        if name == "near_dedup":
            assert not {r.doc_id for r in after.collect()} & set(range(100, 110))
        at = after
    windows = pipeline.STAGES[-1][1](spark, at, DATA)
    packed = Counter(i for r in windows.collect() for i in r.doc_ids)
    assert set(packed) == {r.doc_id for r in at.where("text is not null").collect()}
    texts = Counter((r.doc_id, r.text) for r in at.where("text is not null").collect())
    pieces = defaultdict(list)
    for r in windows.collect():
        for i, start, text in zip(r.doc_ids, r.starts, r.texts):
            pieces[i].append(text)
    assert {i: sum(map(len, x)) for i, x in pieces.items()} == {i: sum(len(t) * n for (j, t), n in texts.items() if i == j) for i, _ in texts}


def test_pipeline_end_to_end(spark):
    """What comes out is what the stages' definitions leave of the table: no toxic text, no copy, each word of a kept text once a copy."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    windows = pipeline.run(spark, DATA).collect()
    kept = Counter(i for r in windows for i, s in zip(r.doc_ids, r.starts) if s == 0)
    clean = {r.doc_id for r in toxicity.toxic_documents(docs, labels).where("not toxic").collect()}
    assert kept and set(kept) <= clean
    copies = defaultdict(set)
    for r in docs.where("text is not null").collect():
        copies[" ".join(sorted(set(r.text.lower().split())))].add(r.doc_id)
    assert all(len(set(kept) & ids) <= 1 for words, ids in copies.items() if words)
    words = Counter(w for r in docs.where("text is not null").collect() for w in r.text.split())
    assert {w for r in windows for t in r.texts for w in t.split()} <= set(words)
    assert all(r.n_tokens <= packing.CAPACITY for r in windows) and sum(r.n_tokens == packing.CAPACITY or r.n_tokens > 1500 for r in windows) >= len(windows) - 20


def test_pipeline_of_no_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
