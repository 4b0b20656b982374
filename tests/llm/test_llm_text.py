"""Scoring, near-duplicates, decontamination and quality against plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, elias_fano, near_dup, ngram_trie, quality
from tidemark.llm.queries import fold

np = pytest.importorskip("numpy")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2**40, 2**40, 2**63], list(range(1000))])
def test_elias_fano_round_trip(values):
    coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, dtype=np.uint64)))
    assert coded.all().tolist() == values
    for wanted in {0, 1, 7, 2**40, *values[:3]}:
        place = coded.successor(np.array([0]), np.array([len(values)]), np.array([wanted], dtype=np.uint64))[0]
        assert place == sum(v < wanted for v in values)


@pytest.mark.parametrize("n, top", [(1, 0), (1000, 10), (5000, 5000), (70_000, 2**62), (40_000, 2**40), (4096, 0)])
def test_elias_fano_select_and_successor_match_a_plain_search(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top + 1, n, dtype=np.uint64))
    data = elias_fano.encode(values)
    coded = elias_fano.EliasFano(b"before" + data + b"\xff" * 9, 6)
    places = draw.integers(0, n, 500)
    assert (coded.select(places) == values[places]).all()
    wanted = np.concatenate([draw.integers(0, top + 2, 2000, dtype=np.uint64), values[:300], values[-1:] + np.uint64(1)])
    lo = draw.integers(0, n + 1, len(wanted))
    hi = np.maximum(lo, draw.integers(0, n + 1, len(wanted)))
    expected = np.clip(np.searchsorted(values, wanted, side="left"), lo, hi)
    assert (coded.successor(lo, hi, wanted) == expected).all()


def test_an_opened_elias_fano_sequence_keeps_samples_alone():
    values = np.cumsum(np.random.default_rng(5).integers(0, 9000, 300_000)).astype(np.uint64)
    data = elias_fano.encode(values)
    coded = elias_fano.EliasFano(data)
    own = [x for x in vars(coded).values() if isinstance(x, np.ndarray) and x.base is None]
    assert sum(x.nbytes for x in own) * 8 <= coded.words.nbytes + 64 * 8
    assert np.concatenate(list(coded.runs(1000))).tolist() == values.tolist()


def test_trie_finds_exactly_what_it_holds():
    contexts = np.array([3, 9, 2**63 + 5], dtype=np.uint64)
    successors = np.array([1, 4, 2, 0, 2**40 - 1], dtype=np.uint64)
    data = ngram_trie.Trie.build(contexts, np.array([2, 1, 2]), successors, np.array([10, 20, 30, 40, 50], dtype=np.uint8))
    trie = ngram_trie.Trie(data)
    asked = [(3, 1), (3, 4), (3, 2), (9, 2), (9, 1), (4, 1), (2**63 + 5, 2**40 - 1), (2**64 - 1, 0)]
    v, w = (np.array(x, dtype=np.uint64) for x in zip(*asked))
    assert trie.lookup(v, w).tolist() == [10, 20, 0, 30, 0, 0, 50, 0]


def test_scores_match_plain_counts(docs):
    mu = 50.0
    rows = [(r.doc_id, [*blank_words(r.text), "\0"]) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    for i, w in rows:
        if not held(i):
            words.update(w), pairs.update(zip(["\0", *w[:-1]], w))
    total, distinct = sum(words.values()), len(words)
    got = sorted(map(tuple, ngram_trie.score_documents(docs, fold(7) != 2, mu).collect()), key=repr)
    expected = []
    for i, w in rows:
        p1 = [(words[x] + 1) / (total + distinct + 1) for x in w]
        p2 = [(pairs[v, x] + mu * p) / (words[v] + mu) for v, x, p in zip(["\0", *w[:-1]], w, p1)]
        expected.append(
            (i, held(i), len(w), sum(words[x] > 0 for x in w), total, sum(map(math.log10, p1)), sum(map(math.log10, p2)))
        )
    expected.sort(key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert abs(g[6] - e[6]) <= 0.02 * e[2]  # a byte of quantisation


def test_rare_successors_of_very_frequent_words_are_not_raised(spark, monkeypatch):
    real, mu = ngram_trie.common_words, 1e-12
    monkeypatch.setattr(ngram_trie, "common_words", lambda blocks: {w: n * 10**9 for w, n in real(blocks).items()})
    docs = spark.createDataFrame([(1, "the rare"), (2, "the other")], "doc_id long, text string")
    got = ngram_trie.score_documents(docs, F.lit(True), mu).collect()
    # an occurrence or two after contexts seen 1e9 or 2e9 times: 2 / 2e9, 1 / 2e9, 1 / 1e9
    assert [r.score for r in got] == [pytest.approx(-9 - 9.30103 - 9, abs=0.06)] * 2


def test_scores_of_nothing(no_docs):
    assert ngram_trie.score_documents(no_docs, F.lit(True)).collect() == []


def test_a_better_model_than_single_words(spark, sample):
    got = ngram_trie.score_documents(sample("documents"), fold(7) != 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def components_by_hand(rows, size, percent):
    sets = []
    for _, text in rows:
        w = blank_words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        low = min(ids) if ids and sets[a] else i
        out.append((i, len(sets[a]), low, i == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_by_hand(docs, size):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, near_dup.near_duplicates(docs, size).collect()), key=repr)
    assert got == components_by_hand(rows, size, 80)


def family(seed, n, changes):
    random = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(100)]
    for k in range(n):
        words = list(base)
        for j in random.choice(100, changes, replace=False):
            words[j] = f"c{seed}x{k}x{j}"
        yield " ".join(words)


def test_near_duplicates_of_large_families(spark):
    """Families whose members are near the threshold, so that buckets hold several components."""
    texts = [t for seed, changes in ((1, 3), (2, 6), (3, 9)) for t in family(seed, 40, changes)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, 2, 80)


def test_links_of_a_family_grow_with_its_members(spark, monkeypatch):
    """The hubs are unlike their family, whose members are linked where their changes meet: rows stay linear."""
    monkeypatch.setattr(near_dup, "CHUNK", 64)
    counts = []
    confirmed = near_dup.confirmed
    monkeypatch.setattr(
        near_dup, "confirmed", lambda pairs, sets, percent: (counts.append(pairs.count()), confirmed(pairs, sets, percent))[1]
    )
    seen = {}
    for n in (60, 240):
        counts.clear()
        far = " ".join(f"b6x{i}" if i % 8 else f"far{i}" for i in range(100))
        rows = [(i, t) for i, t in enumerate([far, *family(6, n, 3), far + " end"])]
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
        assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, 2, 80)
        seen[n] = sum(counts)
    assert seen[240] < 6 * seen[60] and seen[240] < 240 * 12


def test_forest_joins_what_its_pairs_join():
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        pairs = np.array([p for p in rng.integers(0, n, (40, 2)) if p[0] != p[1]]).reshape(-1, 2)
        alike, labels = rng.random(len(pairs)), rng.integers(0, n, n)
        chosen = near_dup.forest(pairs, alike, labels)
        tops = [near_dup.forest(np.array([[a, b]]), np.ones(1), labels) for a, b in chosen]
        assert len(chosen) < len(set(labels.tolist())) and all(len(t) for t in tops)

        def joined(some):
            parent = {x: x for x in labels.tolist()}
            root = lambda x: x if parent[x] == x else root(parent[x])
            for a, b in some:
                parent[root(labels[a])] = root(labels[b])
            return [[root(x) == root(y) for y in parent] for x in parent]

        assert joined(chosen) == joined(pairs)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "CHUNK", 7)
    rows = [(i, t) for i, t in enumerate([*family(4, 45, 8), *family(5, 20, 4)])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, 2, 80)


def test_one_of_each_group_stays(docs, no_docs):
    kept = near_dup.without_near_duplicates(docs, 2).collect()
    texts = [r.text for r in kept]
    assert sum((t or "").startswith("term0 ") for t in texts) == 1
    assert texts.count("same row") == 1
    assert sum(lowered(t) == "one two" for t in texts) == 1
    assert {4, 5, 6, 7, 10, 11, None} <= {r.doc_id for r in kept}
    assert near_dup.without_near_duplicates(docs, 2).columns == docs.columns
    assert near_dup.near_duplicates(no_docs).collect() == []


def marked_by_hand(docs, items, size):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t)) if w]
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in windows[tuple(w[s : s + n])] if x is not None}
        import hashlib

        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_by_hand(spark, docs, no_docs):
    items = [
        (1, " ".join(f"TERM{i}" for i in range(20, 45))), (2, "one, two"), (2, "one two"), (10, "same row!"),
        (3, None), (4, "..."), (None, "single"), (5, "word1 w1 word1"), (6, "ünïcode ßtraße"),
    ]
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()), key=repr)
    assert got == marked_by_hand(rows, items, 10)
    clean = decontaminate.uncontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not g[-1] for g in got)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.contamination(no_docs, benchmark).collect() == []


def test_quality_on_held_out_labels(spark, sample_folder):
    folder = sample_folder.replace("0.001", "0.01")  # the smallest sample has 19 held-out labels
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    got = quality.quality(documents, labels, fold(5) != 0).join(labels, "doc_id").filter(fold(5) == 0)
    right, rejected, good, n = got.agg(
        F.sum((F.col("predicted") == F.col("quality")).cast("int")),
        F.sum(((F.col("predicted") == 0) & (F.col("quality") == 1)).cast("int")),
        F.sum("quality"),
        F.count("*"),
    ).first()
    assert right >= 0.93 * n and rejected <= 0.02 * good


def test_repetition_does_not_depend_on_length():
    import pyarrow as pa

    junk = [" ".join(f"w{i * i % 23}" for i in range(n)) for n in (300, 999, 1000, 5000)]
    varied = " ".join(f"v{i % 400}" for i in range(5000))
    got = quality.frequencies(pa.array([*junk, varied, "one two one"]))[:, -1]
    assert got[:4].min() > 0.9 and np.ptp(got[1:3]) < 0.001 and np.ptp(got[:4]) < 0.05
    assert got[4] == 0 and got[5] == pytest.approx(1 / 3)


def test_quality_of_awkward_rows(spark, docs, no_docs):
    kinds = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 0, "x"), (7, 1, 0, "x"), (8, 0, 0, "x"), (8, 1, 0, "x"), (3, None, 0, "x"), (None, 1, 0, "x")], kinds)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels, F.lit(True)).collect()}
    assert len(got) == 13 and all(0 <= s <= 1 for s in got.values())
    assert got[4] == got[5] == got[6] == 0.0
    none = quality.quality(docs, labels.limit(0), F.lit(True)).collect()
    assert all(r.score == 0 for r in none)
    assert quality.quality(no_docs, labels, F.lit(True)).collect() == []


def test_components_of_random_links(spark):
    random = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (330, 2))] + [(500 + i, 501 + i) for i in range(60)]
    low = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(500):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.id: r.label for r in near_dup.components(df).collect()} == low
    first, rest = spark.createDataFrame(links[:150], "a long, b long"), spark.createDataFrame(links[150:], "a long, b long")
    assert {r.id: r.label for r in near_dup.joined_names(near_dup.components(first), rest).collect()} == low
