"""Link-graph verdicts, lexical search and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import ball_tree, link_graph, periodic_runs
from tidemark.llm.queries import runs_digest, with_planted_runs

np = pytest.importorskip("numpy")


# --- periodic runs


def plain_runs(w, least=12):
    """Rows (start, length, period) by comparing all words at every lag."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic_text(rng):
    n, kinds = rng.randint(0, 140), rng.choice([1, 2, 3, 5, 60])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_plain_comparison(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = [[x.encode() for x in periodic_text(rng)] for _ in range(rng.randint(1, 4))]
        for words, (own, text) in zip(texts, periodic_runs.looked_at(texts, 12)):
            expected = plain_runs(words)
            assert [tuple(r) for r in own.tolist()] == expected
            assert text == b" ".join(plain_collapsed(words, expected))


def test_one_word_without_end_has_one_run_and_no_lags_to_follow():
    words = [b"again"] * 200_000
    [(own, text)] = periodic_runs.looked_at([words], 12)
    assert own.tolist() == [[0, 200_000, 1]] and text == b"again"
    at, rank = periodic_runs.repeated(np.zeros(5000, np.int64))
    assert sum(len(lag) for lag, _ in periodic_runs.matches(at, rank, 8)) == 0


def test_operator_answers_every_row(docs, no_docs):
    got = periodic_runs.periodic_runs(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.collapsed) for r in got))) == sorted(
        repr((d.doc_id, " ".join(plain_collapsed(w := (d.text or "").encode().split(), plain_runs(w) if len(w) < 999 else []) and
                                 [x.decode() for x in plain_collapsed(w, plain_runs(w) if len(w) < 999 else [])] or [])))
        for d in docs.collect()
    )
    assert periodic_runs.periodic_runs(no_docs).collect() == []


def test_query_form_matches_plain_planting(spark):
    rng = random.Random(5)
    texts = {i: " ".join(periodic_text(rng)) for i in range(300)} | {300: None, 301: "", 302: " \t\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in runs_digest(periodic_runs.periodic_runs(with_planted_runs(docs))).collect()}
    planted = 0
    for i, text in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapsed(w, found)).encode()).hexdigest()
    assert planted > 15


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_ranking(documents, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in documents]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in df
            )
            if score > 0:
                scores.append((-score, i is None, i, score))
        for rank, (_, _, i, score) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, i, score))
    return out


def test_ranking_matches_plain_scores(spark, docs, no_docs):
    items = [(1, "One TWO term7 term9, term7"), (2, None), (3, "w5 w17 ünïcode"), (4, "nowhere"), (None, "same ROW"), (1, "text")]
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n long")
    expected = plain_ranking([(d.doc_id, d.text) for d in docs.collect()], items)
    for most_bytes in (1, 1 << 20):  # an item at a time, and all at once
        got = ball_tree.ranked(docs, asked, k=20, most_bytes=most_bytes).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert ball_tree.ranked(no_docs, asked).collect() == []
    assert ball_tree.ranked(docs, asked.limit(0)).collect() == []


def search_of(values, weights, asked, k, leaf=4, block=64):
    counts = [np.array(list(a.values())) for a in asked]
    items = ball_tree.Items(list(range(len(asked))), list(range(len(asked))), np.arange(len(weights)), [np.array(list(a)) for a in asked], counts)
    search = ball_tree.Search(items, weights, k, leaf)
    for start in range(0, len(values), block):
        search.see(np.arange(start, min(start + block, len(values))), values[start : start + block])
    return search


def test_search_is_exact_with_ties_and_copies():
    rng = np.random.default_rng(3)
    for turn in range(20):
        values = rng.integers(0, 10**6, (300, 12)) * (rng.random((300, 12)) < 0.3)
        values[rng.integers(0, 300, 120)] = values[0]
        weights = rng.integers(0, 9000, 12)
        asked = [Counter(rng.integers(0, 12, 4).tolist()) for _ in range(5)]
        search = search_of(values, weights, asked, 20)
        for a, best in zip(asked, search.best):
            scores = sum(values[:, t] * int(weights[t]) * c for t, c in a.items())
            expected = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:20]
            assert sorted(best, reverse=True) == expected


def test_bounds_prune_documents_of_other_subjects():
    """Documents on eight subjects with terms of their own: an item's search leaves most leaves unseen."""
    rng = np.random.default_rng(4)
    values = np.zeros((2048, 80), np.int64)
    for row in range(2048):
        own = row % 8 * 10
        values[row, own : own + 10] = 400_000 + rng.integers(0, 40_000, 10)
    asked = [Counter({s * 10 + t: 1 for t in range(10)}) for s in range(8)]
    search = search_of(values, np.full(80, 5000), asked, 20, leaf=16, block=2048)
    assert search.leaves == 8 * 128 and search.scored < search.leaves / 4


# --- link graph


def plain_graph(pages, seeds, steps=300):
    """Dense matrices instead of joins."""
    hosts = sorted(seeds)
    at = {h: k for k, h in enumerate(hosts)}
    n = np.zeros((len(hosts), len(hosts)))
    for own, targets in pages:
        for t in targets:
            n[at[own], at[t]] += 1
    good, bad = (np.array([seeds[h][k] for h in hosts]) for k in (0, 1))

    def flow(m, seed):
        m = m + np.diag((m.sum(axis=1) == 0).astype(float))
        m = m / m.sum(axis=1, keepdims=True)
        x = seed
        for _ in range(steps):
            x = 0.15 * seed + 0.85 * (x @ m)
        return x

    return dict(zip(hosts, zip(flow(n, good), flow(n.T, bad))))


PAGES = [
    (1, "https://Good.example.org/fr/a", '<a href="https://friend.test/x">f</a> <A class=x HREF=//Friend.TEST>again</A>'),
    (2, "http://friend.test/", "<a href='/own'>o</a><a href='https://spam.net/'>s</a>"),
    (3, "http://hub.test/page?x=1", "".join(f'<a href="http://s{i}.spam.net/a">x</a>' for i in range(8))),
    *[(10 + i, f"http://s{i}.spam.net/a", '<a href="mailto:a@b">m</a><a href="#top">t</a>') for i in range(8)],
    (20, "http://spam.net", None), (21, None, "<a href='http://lost.test/'>"), (22, "no mark", "x"), (23, "", ""),
    (24, "http://en.example.net/en/x#y", '<a data-x="1" href="http://hub.test">'), (24, "http://en.example.net/en/x#y", ""),
    (None, "ftp://user@HOST.example.com:80/de/ü", "<a href=rel>"), (25, "http://host.example.com/de?q", "<a <a href='http://friend.test/'>"),
    (26, "http://only.example.com/dex/", "<a href='https:///nohost'>x</a>"),
]
RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]


def test_rules_and_flow_match_plain_python(spark):
    pages = spark.createDataFrame([(*p, "clash", True) for p in PAGES], "page_id long, url string, html string, host string, allow boolean")
    rules = spark.createDataFrame([*RULES, (None, "/", False)], "host string, path string, allow boolean")
    got = link_graph.judge_urls(pages, rules).collect()
    known = {}
    for page_id, url, _ in PAGES:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups() if "://" in (url or "") else ("", "")
        host = host.lower()
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        known.setdefault((page_id, host, path), []).append(best)
    assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in got) == sorted(
        repr((*k, b and b[0] + b[1])) for k, bs in known.items() for b in bs
    )
    assert all(r.verdict == ("allow" if r.rule in ("example.net/en/", "org/fr/") else "block") for r in got if r.rule)
    by_id = {r.page_id: r for r in got}
    assert by_id[3].verdict == "block" and by_id[3].distrust > 0.5  # links to blocked hosts alone
    assert by_id[2].verdict == "allow" and by_id[2].trust > by_id[2].distrust
    assert {by_id[i].verdict for i in (21, 22, 23)} == {"allow"}


def test_ranks_match_dense_matrices(spark):
    rng = random.Random(2)
    names = [f"h{i}.test" for i in range(12)]
    pages = [(own := rng.choice(names[:9]), sorted(set(rng.choices(names, k=rng.randint(0, 4))))) for _ in range(60)]
    seeds = {h: (rng.choice([0.0, 0.0, 0.5, 1.0]), rng.choice([0.0, 0.0, 0.3])) for h in names}
    urls = spark.createDataFrame(pages, "host string, targets array<string>")
    hosts = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good double, bad double")
    got = link_graph.propagated(link_graph.edges_of(urls, hosts), hosts, steps=60, tolerance=1e-5).collect()
    expected = plain_graph(pages, seeds)
    assert {r.host for r in got} == set(names)
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx(expected[r.host], abs=1e-3)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, allow boolean")
    assert {r.verdict for r in link_graph.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert link_graph.judge_urls(pages.limit(0), rules).collect() == []


def test_longest_rule_and_blocking_win(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y", ""), (2, "http://b.c/z", "")], "page_id long, url string, html string")
    rules = spark.createDataFrame(
        [("c", "/x/y", True), ("B.c", "/x", False), ("b.c", "/z", True), ("b.c", "/z", False), ("a.b.c", None, True)],
        "host string, path string, allow boolean",
    )
    got = {r.page_id: (r.rule, r.verdict) for r in link_graph.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.b.c/", "allow"), 2: ("b.c/z", "block")}
