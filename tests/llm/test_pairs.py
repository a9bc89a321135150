"""Near-duplicates, lines and repeats against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutsites.llm import components, line_dedup, near_duplicates, suffix_dedup
from cutsites.llm.arrays import Texts


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def joined(texts):
    raw = [(t or "").encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def copies():
    """Texts with exact copies, near copies in chains, and shared passages."""
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            other = list(base)
            for _ in range(rng.randrange(4)):
                other[rng.randrange(len(other))] = "changed"
            base = other if rng.random() < 0.5 else base
            texts.append(" ".join(other))
    passage = " ".join(words(rng, 40))
    texts += [" ".join(words(rng, 60)) + " " + passage for _ in range(15)]
    texts += ["a b c", "a b c", "a b d", "A, b. C!"]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark, make_docs, copies):
    docs = make_docs(list(enumerate(copies)))
    weigh = near_duplicates.frequent(docs)
    n = len(copies)
    sets = Sets(n)
    for i in range(n):
        sims = near_duplicates.similarities(joined([copies[i]] * n), joined(copies), weigh)
        for j in np.flatnonzero(sims >= 0.8 - 1e-9):
            sets.join(i, int(j))
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert got == {i: sets.find(i) for i in range(n)}
    assert len(set(got.values())) < n - 10


def test_similarity_is_weighted_jaccard():
    weigh = near_duplicates.Weights(np.zeros(0, np.uint64), np.zeros(0), 10)
    a, b = "a b c d e f a b c d e", "a b c d e g"
    # Shingles of a: abcde twice, bcdef, cdefa, defab, efabc, fabcd; of b: abcde, bcdeg.
    assert near_duplicates.similarities(joined([a]), joined([b]), weigh)[0] == pytest.approx(1 / 8)


def test_frequent_shingles_are_counted_over_all_documents(make_docs):
    docs = make_docs([(i, "one two three four five" + (f" six{i} seven{i}" if i % 3 else "")) for i in range(30)] + [(99, None)])
    weigh = near_duplicates.frequent(docs)
    _, hashes, _ = near_duplicates.counted(*near_duplicates.shingles(joined(["one two three four five"])))
    at = int(np.searchsorted(weigh.hashes, hashes[0]))
    assert weigh.hashes[at] == hashes[0]
    assert weigh.idf[at] == pytest.approx(1 + np.log(31 / 30))


def test_samples_agree_as_often_as_the_sets():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 2**63, 60, dtype=np.uint64), rng.integers(0, 2**63, (2, 20), dtype=np.uint64)
    sets = [np.sort(np.concatenate([shared, o])) for o in own]
    first = np.array([0, 80, 160])
    drawn = near_duplicates.samples(first, np.concatenate(sets), np.full(160, 2.5), 4000)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(0.6, abs=0.03)


@pytest.mark.parametrize("n", [80, 5_000, 20_000, 100_000])
@pytest.mark.parametrize("kind", ["two weights", "many weights"])
def test_samples_follow_the_law_for_unequal_weights(n, kind):
    """Two sets agree as often as their weighted Jaccard similarity, within 3.5 standard errors, however long they are."""
    rng, draws = np.random.default_rng(n), 1200
    hashes = near_duplicates.mix(rng.integers(1, 1 << 62, 2 * n).astype(np.uint64)) >> np.uint64(16) << np.uint64(16)
    a_weight = np.where(rng.random(2 * n) < 0.5, 7.9, 15.8) if kind == "two weights" else np.exp(rng.normal(0, 1.5, 2 * n))
    b_weight = np.where(rng.random(2 * n) < 0.05, 2 * a_weight, a_weight)
    in_a = rng.random(2 * n) < 0.55
    in_b = in_a ^ (rng.random(2 * n) < 0.1)
    x, y = np.where(in_a, a_weight, 0), np.where(in_b, b_weight, 0)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    a, b = (own[np.argsort(hashes[own])] for own in (np.flatnonzero(in_a), np.flatnonzero(in_b)))
    first = np.array([0, len(a), len(a) + len(b)])
    drawn = near_duplicates.samples(first, np.concatenate([hashes[a], hashes[b]]), np.concatenate([a_weight[a], b_weight[b]]), draws)
    assert abs((drawn[0] == drawn[1]).mean() - want) < 3.5 * np.sqrt(want * (1 - want) / draws)


def test_a_sample_depends_on_its_set_only():
    """The quick bounds choose what is drawn exactly, not what comes out."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 50)
    first = np.concatenate([[0], np.cumsum(sizes)])
    hashes = near_duplicates.mix(np.arange(1, first[-1] + 1, dtype=np.uint64)) >> np.uint64(16) << np.uint64(16)
    weights = np.exp(rng.normal(0, 2, first[-1]))
    together = near_duplicates.samples(first, hashes, weights, 30)
    for i in range(50):
        own = slice(first[i], first[i + 1])
        assert (near_duplicates.samples(np.array([0, sizes[i]]), hashes[own], weights[own], 30)[0] == together[i]).all()
        for k in (0, 7, 29):  # all elements drawn
            ln_a, t = near_duplicates._drawn(hashes[own] * near_duplicates._multipliers[k], np.log(weights[own]))
            at = int(np.argmin(ln_a))
            assert together[i, k] == near_duplicates.mix(hashes[own][at : at + 1] ^ near_duplicates.mix(t[at : at + 1].view(np.uint64)))[0]


def test_classes_hold_all_similar_pairs(spark):
    """All pairs of a table, with words, shingles, weights and similarity computed anew."""
    import math
    import re
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    df = Counter(s for c in sets.values() for s in c)
    idf = {s: 1 + math.log(len(sets) / max(n, len(sets) / 1000)) for s, n in df.items()}
    weighted = {i: {s: n * idf[s] for s, n in c.items()} for i, c in sets.items()}
    where = {}
    for i, c in weighted.items():
        for s in c:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    near = set()
    for a, b in pairs:
        x, y = weighted[a], weighted[b]
        both = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
            near.add((a, b))
    root = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows)).collect()}
    found = sum(root[a] == root[b] for a, b in near)
    assert near and found >= 0.97 * len(near)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near:
        parent[top(a)] = top(b)
    assert all(top(i) == top(root[i]) for i in sets)  # no class holds what is not connected


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_duplicates.classes(odd).collect()
    assert len(rows) == 11
    assert sorted(r.class_size for r in rows) == [1] * 9 + [2, 2]
    assert near_duplicates.classes(empty).count() == 0
    kept = near_duplicates.one_of_each(odd, near_duplicates.classes(odd))
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 4").count() == 1 and kept.count() == 10


def test_one_of_each_class_whatever_its_ids(spark, make_docs):
    rng = random.Random(4)
    text = lambda: " ".join(words(rng, 80))
    near = lambda t: t + " tail"
    x, y, p, q, twice = text(), text(), text(), text(), text()
    rows = [(None, x), (None, x), (None, y), (None, y), (7, p), (8, near(p)), (7, q), (9, near(q))]
    rows += [(1, twice, "s"), (1, twice, "t"), (2, near(twice)), (3, ""), (3, ""), (4, None), (4, None)]
    docs = make_docs(rows)
    kept = near_duplicates.one_of_each(docs, near_duplicates.classes(docs))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, x), (None, y), (7, p), (7, q), (1, twice), (3, ""), (3, ""), (4, None), (4, None)], key=str)


@pytest.mark.parametrize("most", [2, 12, 100])
def test_bucket_links_connect_what_pairs_would(spark, most):
    """Points on a line: |x - y| is a metric; buckets of mixed neighbourhoods."""
    rng = random.Random(1)
    points = {i: rng.random() * 6 for i in range(60)}
    rows = [(b, i) for b in range(9) for i in rng.sample(range(60), 25)]
    buckets = spark.createDataFrame(rows, "bucket long, node long").distinct().withColumn("size", F.lit(1))
    values = spark.createDataFrame(list(points.items()), "k long, v double")

    def distances(pairs):
        a, b = values.toDF("a", "va"), values.toDF("b", "vb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", F.abs(F.col("va") - F.col("vb")).alias("d"))

    def inside(groups):
        task = ["bucket", "i", "j"]
        other = groups.select(*task, F.col("node").alias("b"), F.col("root").alias("rb"), F.col("second").alias("sb"))
        pairs = groups.withColumnRenamed("node", "a").join(other, task).where("root <> rb and (i = j and a < b or not second and sb)")
        return distances(pairs.select("a", "b")).where("d <= 0.1").select("a", "b")

    links = components.link_buckets(buckets, distances, 0.1, inside, max_members=most)
    got = {r.node: r.root for r in components.connected(links).collect()}
    sets = Sets(60)
    in_bucket = {}
    for b, i in rows:
        in_bucket.setdefault(b, set()).add(i)
    for members in in_bucket.values():
        for i in members:
            for j in members:
                if abs(points[i] - points[j]) <= 0.1:
                    sets.join(i, j)
    want = {i: sets.find(i) for i in range(60)}
    assert all(got.get(i, i) == want[i] for i in range(60))


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[-1] + 1, last[j] + (x != y)))
    return row[-1]


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "q", "é漢"[rng.randrange(2)]])
    return "".join(out)


def test_edit_distance_in_a_band():
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(1, 50))), rng.randrange(7)) for _ in range(400)]
    a = [x for x, _ in pairs]
    b = [edited(rng, x, n) for x, n in pairs]
    code = lambda xs: [np.array([ord(c) for c in x], np.int64) for x in xs]
    got = line_dedup.edit_distances(code(a), code(b))
    assert got.tolist() == [min(brute_distance(x, y), 5) for x, y in zip(a, b, strict=True)]


def test_line_classes_equal_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", 3000)
    monkeypatch.setattr(line_dedup, "RANGE_BYTES", 2000)
    rng = random.Random(8)
    lines = []
    for _ in range(25):
        base = " ".join(words(rng, rng.randrange(3, 30)))
        lines += [base] + [edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(6))]
    lines += ["", "  ", "short", "short", "shorty"] * 2
    rng.shuffle(lines)
    texts = ["\n".join(lines[k : k + 7]) for k in range(0, len(lines), 7)]
    place = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = Sets(len(place))
    for i, (_, _, x) in enumerate(place):
        for j in range(i):
            y = place[j][2]
            limit = min(min(len(x), len(y)) // 32, 2)
            if x == y or (limit and abs(len(x) - len(y)) <= limit and brute_distance(x, y) <= limit):
                sets.join(i, j)
    want = {place[i][:2]: place[sets.find(i)][:2] for i in range(len(place))}
    docs = make_docs(list(enumerate(texts)), clash=True)
    found = line_dedup.classes(docs)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in found.collect()}
    assert got == want
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(docs, found).collect()}
    for i, t in enumerate(texts):
        assert cleaned[i].split("\n") == [x for k, x in enumerate(t.split("\n")) if want.get((i, k), (i, k)) == (i, k)] or not any(
            want.get((i, k), (i, k)) == (i, k) for k in range(len(t.split("\n")))
        )


def test_lines_of_odd_rows(odd, empty):
    cleaned = line_dedup.clean(odd)
    assert set(cleaned.columns) == {*odd.columns, "n_removed_lines"} and cleaned.count() == 11
    assert line_dedup.classes(empty).count() == 0
    assert line_dedup.clean(empty).count() == 0


def test_lines_are_cut_from_their_own_text(make_docs):
    docs = make_docs([(5, "a\nb"), (5, "c\na"), (None, "d\ne"), (None, "f\nd"), (None, "g\nh")])
    cleaned = sorted((r.doc_id or 0, r.text, r.n_removed_lines) for r in line_dedup.clean(docs).collect())
    assert cleaned == [(0, "d\ne", 0), (0, "f", 1), (0, "g\nh", 0), (5, "a\nb", 0), (5, "c", 1)]


def test_copies_do_not_fill_a_text_group(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    rng = random.Random(6)
    hot, near = "x" * 40 + "y" * 60, "x" * 40 + "z" + "y" * 60
    rows = [(None, hot)] * 300 + [(i, " ".join(words(rng, 20))) for i in range(100)] + [(100, near)]
    docs = make_docs(rows)
    lines = line_dedup.text_groups(docs)[0]
    rows_of = suffix_dedup.text_groups(docs, docs.columns)[0]
    for grouped, g in ((lines, "g"), (rows_of, "__g")):
        assert grouped.groupBy(g).agg(F.sum(F.octet_length("__text")).alias("b")).agg(F.max("b")).first()[0] < 3 * 4000
    assert lines.count() == 102 and rows_of.count() == 401
    found = line_dedup.classes(docs).where(F.col("class_size") > 1)
    assert {r.class_size for r in found.collect()} == {301} and found.count() == 301
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.count() == 401
    assert {r.n for r in cut.where("doc_id is null").selectExpr("n_bytes - octet_length(kept_bytes) as n").collect()} == {60}
    assert [len(r.kept_bytes) for r in cut.where("doc_id = 100").collect()] == [101]


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            first = seen.setdefault(t[s : s + 50], i)
            if first < i:
                gone[s : s + 50] = True
        out[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats_equal_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 3000)
    rng = random.Random(2)
    passages = ["".join(rng.choices("abcé ", k=rng.randrange(45, 140))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("xyzw", k=rng.randrange(60))) for _ in range(6)) for _ in range(60)]
    texts += ["aaaa" * 40, "aaaa" * 60, "ab" * 25, "ab" * 25, texts[3], texts[3]]
    docs = make_docs(list(enumerate(texts)))
    found = suffix_dedup.remove_repeats(docs).withColumn("h", F.sha2("kept_bytes", 256)).collect()
    want = brute_repeats([(i, t.encode()) for i, t in enumerate(texts)])
    assert {r.doc_id: (r.n_bytes - len(r.kept_bytes), r.h) for r in found} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept_bytes) for r in found)
    assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    for trial in range(60):
        data = rng.integers(97, 99 + trial % 3, rng.integers(60, 300)).astype(np.uint8)
        if trial % 3 == 0:
            data = np.tile(data[: rng.integers(1, 40)], 20)[:300]
        if len(data) < 50:
            continue
        starts = rng.permutation(len(data) - 49)
        order, begins = suffix_dedup.deep_shallow(data, starts)
        got = [data[s : s + 50].tobytes() for s in starts[order]]
        assert got == sorted(got)
        assert begins.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_repeats_of_odd_rows(odd, empty):
    found = suffix_dedup.remove_repeats(odd)
    assert found.count() == 11 and set(odd.columns) <= set(found.columns)
    assert [r.n_bytes for r in found.where("text is null").collect()] == [0, 0, 0]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_distances_of_long_lines_stay_small():
    """A line of a million code points among two thousand short ones: no table of all pairs by the longest line."""
    import tracemalloc

    rng = np.random.default_rng(1)
    big = rng.integers(0, 50, 1_000_000)
    changed, shorter = big.copy(), np.delete(big, [5])
    changed[500_000], shorter[-9] = 99, 77
    a = [rng.integers(0, 50, 100) for _ in range(1998)] + [big, big]
    b = [x.copy() for x in a[:1998]] + [changed, shorter]
    tracemalloc.start()
    found = line_dedup.edit_distances(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:1998].sum() == 0 and found[1998:].tolist() == [1, 2] and peak < 500 << 20


def test_distances_one_by_one_and_in_blocks(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for n in (3, 5, 6, 9, 40, 70, 1100) * 5:
        a = [rng.randrange(4) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        pairs.append((np.array(a, np.int64), np.array(b, np.int64)))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist()):
            new = [i + 1]
            for j, y in enumerate(b.tolist()):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    a, b = zip(*pairs)
    want = [min(plain(x, y), line_dedup.REACH + 1) for x, y in pairs]
    for few in (0, 10**6):
        monkeypatch.setattr(line_dedup, "FEW", few)
        assert line_dedup.edit_distances(a, b).tolist() == want
    monkeypatch.setattr(line_dedup, "AT_ONCE", 100)
    assert line_dedup.edit_distances(a, b).tolist() == want
