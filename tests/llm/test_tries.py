"""Block anchors, text tries and burst tries against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutsites.llm import block_anchors, burst_tries, text_tries
from cutsites.llm.arrays import BYTE_CODES, NOT_SPACE, texts_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Repeated word sequences ----------------------------------------------------------


def removed(texts: list[str | None], n: int = 35) -> list[tuple[int, list[str]]]:
    """Per text: number of words removed, and the others."""
    words = [WORD.findall(t or "") for t in texts]
    places = defaultdict(list)
    for k, w in enumerate(words):
        for s in range(len(w) - n + 1):
            places[tuple(w[s : s + n])].append((k, s))
    gone = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for k, s in found:
                gone[k].update(range(s, s + n))
    return [(len(gone[k]), [x for i, x in enumerate(w) if i not in gone[k]]) for k, w in enumerate(words)]


def repeated_texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, exact, short = new(90), new(35), new(34)
    texts = [" ".join(new(rng.randrange(0, 160))) for _ in range(12)]
    for k in range(8):  # at every offset to the blocks
        texts.append(" ".join([*new(k * 5 % 23), *shared[k : 90 - k], *new(11)]))
    texts += [" ".join([*new(7), *exact, *new(3)]), "\t".join([*new(20), *exact]), " ".join([*short, *new(9)]), " ".join([*new(2), *short])]
    inside = new(40)
    texts += [" ".join([*inside, *new(5), *inside]), " ".join(["na"] * 34), " ".join(["la"] * 36), " ".join(["ha", "ho"] * 30)]
    texts += [texts[3], texts[3], "  ".join(texts[4].split()), None, "", " \n "]
    return texts


def test_block_anchors_against_brute_force(spark, make_docs):
    texts = repeated_texts()
    got = block_anchors.remove_repeats(make_docs([(i, t) for i, t in enumerate(texts)], clash=True))
    assert {"size", "kept", "spans", "lang"} <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    for i, (n, kept) in enumerate(removed(texts)):
        row = rows[i]
        assert (row.n_removed, row.kept_text, row.n_words) == (n, " ".join(kept), n + len(kept)), i
        words = WORD.findall(texts[i] or "")
        assert [w for k, w in enumerate(words) if not any(s.start <= k < s.end for s in row.spans)] == kept
        assert sum(s.end - s.start for s in row.spans) == n


def test_many_groups_and_ranges_give_the_same(spark, make_docs, monkeypatch):
    texts = repeated_texts(5)
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    monkeypatch.setattr(block_anchors, "GROUP_BYTES", 900)
    monkeypatch.setattr(block_anchors, "RANGE_BYTES", 700)
    got = {r.doc_id: r.kept_text for r in block_anchors.remove_repeats(docs).collect()}
    assert got == {i: " ".join(kept) for i, (_, kept) in enumerate(removed(texts))}


def test_block_anchors_odd_rows(spark, odd, empty, make_docs):
    rows = block_anchors.remove_repeats(odd).select("doc_id", "text", "n_words", "n_removed").collect()
    assert len(rows) == odd.count() and all(r.n_removed == 0 for r in rows) and max(r.n_words for r in rows) == 60_000
    assert block_anchors.remove_repeats(empty).count() == 0
    text = " ".join(f"x{i}" for i in range(50))
    same = block_anchors.remove_repeats(make_docs([(1, text)] * 3 + [(None, text)]))  # repeated rows are copies
    assert [r.n_removed for r in same.collect()] == [50] * 4


def test_a_third_of_all_rows_alike(spark, make_docs, monkeypatch):
    monkeypatch.setattr(block_anchors, "GROUP_BYTES", 4000)
    hot = " ".join(f"h{i}" for i in range(60))
    docs = make_docs([(7, hot)] * 40 + [(i, f"{i} " + " ".join(f"{i}a{j}" for j in range(50))) for i in range(60)])
    source, _ = block_anchors.spread(docs, ["doc_id"], "text", "doc_id")
    assert source.where("doc_id = 7").select("__g").distinct().count() > 2  # not one group
    got = block_anchors.remove_repeats(docs).groupBy("doc_id").agg(F.sum("n_removed").alias("n")).where("n > 0").collect()
    assert [(r.doc_id, r.n) for r in got] == [(7, 40 * 60)]


def test_packed_numbers_round_trip():
    numbers = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (block_anchors.unpack(block_anchors.pack(numbers)) == numbers).all()
    assert len(block_anchors.unpack(block_anchors.pack(numbers[:0]))) == 0


def test_every_sequence_holds_a_block():
    """A window of 35 words holds a block of 18 at any offset, so probing with all windows misses none."""
    texts = texts_of(pa.array([" ".join(f"q{i}" for i in range(200))]))
    words = words_of(texts, NOT_SPACE, BYTE_CODES)
    at, _, block = block_anchors.probes(words)
    found, _ = block_anchors.around(words, at[block])
    assert (found == np.arange(200 - 34)).all()


# Filters and text tries -------------------------------------------------------------


def mask(text: str) -> int:
    w = WORD.findall(text)
    tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search(r"[#$%&*|]", text)]
    return sum(bool(t) << k for k, t in enumerate(tests))


def audited(rows: list[tuple], labels: dict) -> set[tuple]:
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = defaultdict(list)
    for i, text, source in rows:
        m = mask(text or "") | (16 if i is not None and i > least[text or ""] else 0)
        found[source or ""].append((m, labels.get(i, (0, 0))))
    out = set()
    for part, docs in found.items():
        gone = Counter()
        steps = []
        for order in permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order, 1):
                own = 1 << "ABCDE".index(f)
                here = [x for x in docs if x[0] & own and not x[0] & before]
                gone[f] += len(here)
                steps.append((part, "".join(order), step, f, sum(not m & (own | before) for m, _ in docs), len(here), sum(bool(m & own and m & before) for m, _ in docs),
                              sum(m == own for m, _ in docs), sum(x[1][0] == 1 for x in here), sum(x[1][1] == 1 for x in here)))
                before |= own
        out |= {(*s[:3], *s[4:], gone[s[3]]) for s in steps}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    texts = ["", None, "Short", "a #b", "X" * 50, "same " * 300, " ".join(f"v{i}" for i in range(250)), " ".join(f"V{i}" for i in range(250)), "über 漢字 😀 Ü" * 40]
    texts += [texts[6] + f" tail{i} %" for i in range(4)] + [texts[6][:k] for k in (500, 700, 701)]
    ids = [rng.randrange(60) if rng.random() < 0.9 else None for _ in range(150)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in ids]
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 60, 2)}
    label_rows = spark.createDataFrame([(i, q, t, "x") for i, (q, t) in labels.items()] + [(0, 0, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, n string")
    docs = make_docs(rows, clash=True)
    want = audited(rows, labels)
    for quota in (text_tries.RANGE_BYTES, 300):  # with few bytes a range, prefixes grow to whole texts
        rows_ = text_tries.failing(docs, quota=quota)
        got = text_tries.interactions(text_tries.mask_counts(rows_, label_rows)).select(*COLUMNS).collect()
        assert len(got) == 3 * 600 and {tuple(r) for r in got} == want


def test_prefixes_adapt(spark, make_docs):
    shared = "p" * 200
    rows = [(i, shared + str(i % 7) * 50) for i in range(40)] + [(99, "other"), (100, "p")]
    docs = make_docs(rows).selectExpr("doc_id as id", "text", "xxhash64(text) as key")
    prefixes = {len(r.prefix) for r in text_tries.ranged(docs, 3000).select("prefix").distinct().collect()}
    assert prefixes == {1, 4, 250}  # 4 is light; below the shared 200 characters 256 are needed, which is all of the text
    one = make_docs([(i, shared * 30) for i in range(50)]).selectExpr("doc_id as id", "text", "xxhash64(text) as key")
    assert {r.prefix for r in text_tries.ranged(one, 3000).select("prefix").collect()} == {"pppp"}  # copies of one text are no reason to go on


def test_radix_trie():
    rng = random.Random(2)
    trie, least = text_tries.RadixTrie(), {}
    for n in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        number = rng.randrange(1000)
        trie.insert(text, (number, n))
        least[text] = min(least.get(text, (number, n)), (number, n))
    assert sorted(trie.walk()) == sorted(least.values())
    deep = text_tries.RadixTrie()
    for n in range(2000):
        deep.insert(b"x" * n, (n, 0))
    assert len(list(deep.walk())) == 2000


def test_filter_audit_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = text_tries.audit(odd, labels)
    assert got.count() == 600 * odd.select(F.coalesce("source", F.lit(""))).distinct().count()
    first = got.where("filter_order = 'EABCD' and step = 1").agg(F.sum("kept") + F.sum("removed"), F.sum("removed")).first()
    assert tuple(first) == (odd.count(), 2)  # of 1, 2 and one more with the empty text: ids 2 and 7; both rows of 4 have the smallest id
    assert text_tries.audit(empty, labels).count() == 0


# Conversations ---------------------------------------------------------------------


def tree(rows: list[tuple]) -> set[tuple]:
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5(text or ""), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = set()
    for key, own_ in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(own_) if len(full[c]) == len(key))
        out.add((min(own_), len(key), min(members[key[:-1]]) if key else None, len(own_), children[key], sum(children[k] == 0 for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(-25, 120):
        if c in (40, 60):
            continue  # blocks without a first conversation
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["hi there", "ok", None, "", f"one {rng.randrange(3)}", "long\ttext with five words"])))
    for c in range(1000, 1040):  # equal conversations, and a long common beginning
        rows += [(c, t, "user", f"t{t}") for t in range(8)] + ([(c, 9, "bot", str(c))] if c % 3 == 0 else [])
    rows += [rows[0], rows[0], (None, 1, "user", "nobody"), (5000, None, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("container_bytes", [1 << 18, 2000, 100])
def test_burst_tries_against_brute_force(spark, container_bytes):
    rows = told()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("n", F.lit("x")).withColumn("depth", F.lit("y"))
    got = burst_tries.nodes(frame, container_bytes).collect()
    assert got[0].asDict().keys() == {x.split()[0] for x in burst_tries.NODE.split(", ")}
    want = tree(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_containers_burst_by_next_turn(spark):
    sequences = burst_tries.distinct_sequences(burst_tries.rebuilt(spark.createDataFrame(told(), SCHEMA)))
    containers, heads = burst_tries.burst(sequences, 2000)
    sizes = containers.groupBy("c").agg(F.sum(F.expr("64 + 24 * (size(ids) - d)")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 2000 for r in sizes) and heads.count() > 1
    assert heads.selectExpr("max(size(words))").first()[0] > 3  # turns that all members share are one head
    assert burst_tries.burst(sequences, 1 << 18)[1] is None


def test_burst_tries_without_rows(spark):
    assert burst_tries.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert burst_tries.nodes(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    one = burst_tries.nodes(spark.createDataFrame([(7, 1, None, None)], SCHEMA)).collect()
    # 7 takes its first turns from 0, which is absent; its own turn is among its first ones
    h = zlib.crc32(b"7") % 4
    assert len(one) == (1 if h else 2) and one[0].n_convs == 1


def test_very_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("if(id < 19000, 20L, 21L) as conv_id", "id as turn", "'user' as role", "concat('t', id % 5) as text")
    got = burst_tries.nodes(rows, 1 << 12).agg(F.max("depth"), F.count("*"), F.max("n_convs")).first()
    assert got[0] == 19_000 and got[2] == 2
