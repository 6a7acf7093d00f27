"""Jaccard join, suffix dedup, decontamination, line dedup: against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wardhall.llm import jaccard
from wardhall.llm.decontaminate import decontaminate, without_contaminated, winnow
from wardhall.llm.jaccard import CountTree, one_of_each, similar_components, spanning_links
from wardhall.llm.linededup import deduplicated_lines, without_boilerplate
from wardhall.llm.shared import components
from wardhall.llm.suffixdedup import suffix_dedup


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def corpus(seed=1, n=60, size=80):
    """Texts with exact copies, near copies at about the threshold, and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    out, passage = [], " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(n):
        kind = i % 5
        if kind in (1, 2) and out:
            base = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            t = " ".join(base)
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, size)))
            if kind == 3:
                t = f"{t} {passage} {rng.choice(vocabulary)}"
        out.append(t)
    return list(enumerate(out))


def brute_components(rows, k=4, similarity=85):
    sets = {i: ({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_similar_texts(frame, seed):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in similar_components(frame(rows)).collect()}
    want = brute_components(rows)
    assert got == want and any(v[1] != k for k, v in want.items())


def test_components_in_tiles(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "_TILE_ROWS", 3)
    rows = [(i, " ".join(f"v{j}" for j in range(100) if j != i)) for i in range(12)] + [(50, "something else entirely here")]
    assert {r[0]: (r[1], r[2]) for r in similar_components(frame(rows)).collect()} == brute_components(rows)


def test_similar_edges(frame, edges, empty):
    got = similar_components(edges)
    rows = {(r[0], r[1], r[2]) for r in got.collect()}
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == edges.count()
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (5, 1, 5), (6, 1, 6), (7, 1, 7)} == rows
    assert similar_components(empty).count() == 0
    assert one_of_each(frame([(9, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (2, None)])).orderBy("doc_id").select("doc_id").collect() == [(None,), (2,), (4,)]
    assert one_of_each(edges).columns == edges.columns and one_of_each(empty).count() == 0


def test_tree_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 300, 1).astype(np.uint64)])) for s in sets[:40]]
    points = np.stack([jaccard.count_vector(s, 16) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], int(sizes[i]), 70).tolist())
        assert all(j in near for j, o in enumerate(sets) if jaccard.linked(s, o, 70))
    found = spanning_links(sets, 70)
    assert all(jaccard.linked(sets[a], sets[b], 70) for a, b in found)
    side = rng.random(len(sets)) < 0.4
    partner = jaccard.with_partner(points, sizes, 70, side)
    cross = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if side[a] and not side[b] and jaccard.linked(sets[a], sets[b], 70)]
    assert cross and all(partner[a] and partner[b] for a, b in cross)
    found = spanning_links(sets, 70, side=side)
    assert all(side[a] != side[b] and jaccard.linked(sets[a], sets[b], 70) for a, b in found)
    root = list(range(len(sets)))
    for a, b in found:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert all(root[a] == root[b] for a, b in cross)


def test_steps_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from wardhall.llm.shared import shared_folder, spent, written

    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    step = written(spark.range(3))
    assert step.count() == 3
    spent(step)
    import os

    assert not os.path.exists(step._step_folder)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)] + [(7, 7), (300, 301), (300, 301)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffixes(rows, length=50):
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in rows:
        cover = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                cover[k : k + length] = [True] * length
        spans = sum(c and not (j and cover[j - 1]) for j, c in enumerate(cover))
        out[i] = (len(t), sum(cover), spans, bytes(c for c, x in zip(t, cover, strict=True) if not x))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é", "a"])
def test_suffix_dedup(frame, alphabet):
    rng = random.Random(len(alphabet))
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(n) for n in (49, 50, 51, 60, 84, 120, 300)]
    rows = [(i, make(rng.randint(0, 80)) + rng.choice(shared) + make(rng.randint(0, 80)) + rng.choice(["", rng.choice(shared)])) for i in range(40)]
    rng.shuffle(rows)
    want = brute_suffixes([(i, t.encode()) for i, t in rows])
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup(frame(rows)).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_suffix_edges(frame, edges, empty, monkeypatch):
    got = [(r[0], r[1], r[2], r[3]) for r in suffix_dedup(edges).orderBy("doc_id", "n_bytes").collect()]
    assert [g for g in got if g[0] is not None] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 3, 0, 0), (5, 8, 0, 0), (5, 8, 0, 0), (6, 150000, 0, 0), (7, 30, 0, 0)]
    assert suffix_dedup(empty).count() == 0
    twice = frame([(5, "x" * 60), (5, "x" * 60), (None, "x" * 60), (8, "x" * 60), (None, "y" * 60), (9, "y" * 60)])
    assert sorted((r[0] or 0, r[2]) for r in suffix_dedup(twice).collect()) == [(0, 0), (0, 0), (5, 0), (5, 0), (8, 60), (9, 0)]
    from wardhall.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "_FILTER_BITS", 8)  # a full bitmap: every key brings its context
    assert [r[2] for r in suffix_dedup(frame([(1, "ab" * 40), (2, "ab" * 40)])).orderBy("doc_id").collect()] == [0, 80]


def test_suffix_dedup_takes_ids_of_any_type(spark):
    rows = [("b", "x" * 60), ("a", "x" * 70), (None, "x" * 60), ("c", "y" * 60)]
    got = {r[0]: r[2] for r in suffix_dedup(spark.createDataFrame(rows, "name string, text string"), "name").collect()}
    assert got == {"a": 0, "b": 60, None: 0, "c": 0}


@pytest.mark.parametrize("bits", [8, 1 << 29])
def test_suffix_dedup_of_a_hot_anchor(frame, monkeypatch, bits):
    """Thousands of different contexts of one gram, some of them shared: small buckets, against brute force."""
    from wardhall.llm import suffixdedup

    for name, value in (("_FILTER_BITS", bits), ("_BUCKET_BYTES", 50_000), ("_AT_ONCE", 100), ("_HELD", 500), ("_FLUSH", 2_000)):
        monkeypatch.setattr(suffixdedup, name, value)
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    tails = [word(17) for _ in range(40)]
    rows = [(i, " ".join(word(rng.randint(10, 20)) + "-" * 16 + (rng.choice(tails) if rng.random() < 0.3 else word(17)) + word(rng.randint(0, 20)) for _ in range(12))) for i in range(400)]
    rng.shuffle(rows)
    want = brute_suffixes([(i, t.encode()) for i, t in rows])
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup(frame(rows)).collect()}
    assert got == want
    assert max(suffixdedup.Anchors([t.encode() for _, t in rows], 50).halves(1)[0].tolist().count(k) for k in set(suffixdedup.Anchors([rows[0][1].encode()], 50).halves(1)[0].tolist()) - {0}) < 400  # the gram's places are many keys


def test_anchors_are_the_least_grams():
    import numpy as np

    from wardhall.llm.suffixdedup import Anchors, _grams

    rng = random.Random(3)
    for letters in ("ab", "abcdefgh \n"):
        texts = ["".join(rng.choice(letters) for _ in range(n)).encode() for n in (0, 1, 16, 49, 50, 51, 52, 300, 0, 700, 50)]
        for some in (texts, *([t] for t in texts)):
            want = set()
            for i, t in enumerate(some):
                h = _grams(np.ndarray((len(t) + 9,), dtype="<u8", buffer=t + b"\0" * 16, strides=(1,)), max(0, len(t) - 15))
                for k in range(len(t) - 49):
                    want |= {(i, k + int(j)) for j in np.flatnonzero(h[k : k + 35] == h[k : k + 35].min())}
            a = Anchors(some, 50)
            assert set(zip(a.doc.tolist(), a.place.tolist(), strict=True)) == want


def test_anchors_take_little_time_for_each_byte():
    """Best of five against a fixed piece of numpy work; three passes over the text each pay this."""
    import time

    import numpy as np
    import pyarrow as pa

    from wardhall.llm.suffixdedup import _anchored
    from wardhall.llm.words import _mix

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)).encode() for _ in range(240)]
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    block = np.arange(1 << 14, dtype=np.uint64)

    def best(work):
        took = []
        for _ in range(5):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    unit = best(lambda: [_mix(block) for _ in range(size >> 14)])  # one 64-bit hash for each byte, in the cache
    assert best(lambda: [a.place for _, a in _anchored(batch, 50)]) < 6.5 * unit


def test_joined_spans_cover_the_same_places():
    import numpy as np
    import pyarrow as pa

    from wardhall.llm import suffixdedup

    rng = np.random.default_rng(4)
    for n in (0, 1, 500):
        doc, tag, lo = rng.integers(-2, 3, n), rng.integers(0, 2, n), rng.integers(0, 900, n)
        hi = lo + rng.integers(1, 12, n)
        want = {}
        for d, t, a, b in zip(doc.tolist(), tag.tolist(), lo.tolist(), hi.tolist(), strict=True):
            want.setdefault((d, t), set()).update(range(a, b))
        got = {}
        for d, t, a, b in zip(*(c.tolist() for c in suffixdedup.join_spans(doc, tag, lo, hi)), strict=True):
            assert not {a - 1, *range(a, b + 1)} & got.setdefault((d, t), set())  # whole runs only
            got[d, t].update(range(a, b))
        assert got == want
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, tag, lo, hi)], names=["doc_id", "tag", "lo", "hi"])
        parts = {}
        for b in suffixdedup._joined(iter([batch.slice(i, 50) for i in range(0, n, 50)])):
            for d, t, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault((d, t), set()).update(range(a, z))
        assert parts == want


def test_refined_buckets_are_equal_strings():
    import numpy as np

    from wardhall.llm.suffixdedup import refine

    rng = np.random.default_rng(2)
    for width, length, letters in ((34, 17, 2), (34, 17, 1), (60, 40, 2), (16, 8, 3)):
        rows = rng.integers(1, letters + 1, (80, width)).astype(np.uint8)
        rows[40:] = rows[:40]
        rows[40:, rng.integers(0, width, 40)] = 7
        group = rng.integers(0, 3, 80)
        for runs in (1, 16):
            ids = refine(group, rows, length, runs)
            classes = {}
            for i in range(80):
                for s in range(width - length + 1):
                    assert classes.setdefault((group[i], s, rows[i, s : s + length].tobytes()), ids[i, s]) == ids[i, s]
            assert len(set(classes.values())) == len(classes)


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_hits(rows, items, window=10):
    known = {}
    for item, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            known.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for m in {len(k) for k in known}:
            for a in range(len(w) - m + 1):
                if x := known.get(tuple(w[a : a + m])):
                    hit |= set(range(a, a + m))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("vocabulary", [2, 30])
def test_decontamination(spark, frame, vocabulary):
    rng = random.Random(vocabulary)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789")[: 1] + str(rng.randrange(vocabulary)) for _ in range(n)) if vocabulary > 2 else " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.choice((3, 5, 9, 10, 11, 25)))) for i in range(12)] + [(3, text(12)), (99, None), (100, " ,. ")]
    rows = []
    for i in range(40):
        a, b = rng.choice(items[:12])[1].split(), text(rng.randint(0, 30))
        lo = rng.randrange(len(a))
        rows.append((i, b + "! " + ", ".join(a[lo : lo + rng.randint(1, 25)]).upper() + " " + text(rng.randint(0, 9))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate(frame(rows), bench).collect()}
    assert got == brute_hits(rows, items) and any(v[4] for v in got.values())
    kept = {r[0] for r in without_contaminated(frame(rows), bench).collect()}
    assert kept == {i for i, v in got.items() if not v[4]}


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "same row"), (2, "a row without an id"), (None, "long")], "item_id long, text string")
    got = sorted(((r[0] or 0), r[2], r[3]) for r in decontaminate(edges, bench).collect())
    assert got == [(0, 5, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 2, 1), (5, 2, 1), (6, 30000, 0), (7, 0, 0)]
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(edges, bench.limit(0)).filter("contaminated").count() == 0
    kept = without_contaminated(edges, bench.filter("item_id is not null"))
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7]
    assert without_contaminated(empty, bench).count() == 0 and without_contaminated(edges, bench.limit(0)).count() == edges.count()


def test_winnowing_keeps_one_of_every_window():
    import numpy as np

    g = np.random.default_rng(3).integers(0, 5, 200).astype(np.uint64)
    at = set(winnow(g, 6).tolist())
    assert all(at & set(range(i, i + 6)) for i in range(195))


def test_documents_with_items_without_an_id_go(spark, frame):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, passage), (None, "two words"), (3, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    docs = frame([(1, f"before {passage} after"), (2, "these two words"), (3, "none of them")])
    assert [r["doc_id"] for r in without_contaminated(docs, bench).collect()] == [3]


def test_unsettled_components_raise(spark):
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)


def test_line_dedup(frame, edges, empty):
    common, local = "this line is on every site", "this line is on few sites"
    body = lambda i: "\n".join(f"its own line number {j} of document {i}" for j in range(6))
    rows = [(i, f"{body(i)}\n  {common} \t" + (f"\n{local}" if i < 9 else "") + "\nto") for i in range(12)] + [(90, common), (91, None)]
    docs = frame(rows, {i: f"s{i}" for i in range(12)})
    got = {r["doc_id"]: r for r in deduplicated_lines(docs).collect()}
    for i in range(12):
        assert (got[i]["n_removed"], got[i]["removed_chars"]) == (2, len(common) + 6)
        assert got[i]["kept_text"] == body(i) + (f"\n{local}" if i < 9 else "")
    assert got[90]["n_removed"] == 1 and got[90]["kept_text"] == "" and got[91]["kept_text"] is None
    assert without_boilerplate(edges).columns == edges.columns and without_boilerplate(edges).count() == edges.count()
    assert sorted(str(r["text"]) for r in without_boilerplate(edges).collect()) == sorted(str(r["text"]) for r in edges.collect())
    assert without_boilerplate(empty).count() == 0


def test_short_lines_and_scripts_without_spaces_are_judged(frame):
    body = lambda i: f"its own line of document {i} " * 5
    rows = [(i, f"{body(i)}\nAll rights reserved.\n版权所有未经许可不得转载\n\n" + ("on few sites" if i < 9 else f"own {i}")) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in without_boilerplate(frame(rows, {i: f"s{i}" for i in range(12)})).collect()}
    assert got == {i: f"{body(i)}\n\n" + ("on few sites" if i < 9 else f"own {i}") for i in range(12)}


def test_boilerplate_leaves_short_documents_and_only_copies_keep_their_lines(frame):
    notice = "all rights reserved by the owner of this site"
    copy = "first line of a copied text\nsecond line of a copied text\n" + notice
    rows = [(i, f"short {i}\n{notice}") for i in range(12)] + [(20 + i, copy if i else f"  {copy} ") for i in range(11)] + [(40, "twice\n" + notice), (41, "twice\n" + notice), (42, notice), (None, "no id\n" + notice)]
    got = {r["doc_id"]: r["text"] for r in without_boilerplate(frame(rows, {i: f"s{i}" for i in range(40)})).collect()}
    assert got == {**{i: f"short {i}" for i in range(12)}, **{20 + i: copy.removesuffix("\n" + notice) for i in range(1, 11)}, 20: "  " + copy.removesuffix("\n" + notice), 40: "twice", 41: "twice", 42: "", None: "no id"}


def test_lines_near_the_threshold_are_counted_exactly(frame):
    rows, sources = [], {}
    for n in range(6, 15):
        for s in range(n):
            i = 100 * n + s
            rows.append((i, f"a line that {n} sites have\n" + f"filler of document {i} " * 20))
            sources[i] = f"site{s}"
    got = deduplicated_lines(frame(rows, sources)).filter("n_removed > 0").select(F.floor(F.col("doc_id") / 100)).distinct().collect()
    assert sorted(r[0] for r in got) == [10, 11, 12, 13, 14]
