"""Packing, token files, archives, page text, top-k search, tool calls and the pipeline."""

import base64
import glob
import gzip
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import archives, knn, packing, page_text, token_files, tool_calls
from tidemark.llm.tokens import default_tokenizer


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_give_back_all_ids(spark, docs, no_docs, ids_of, tmp_path):
    odd = docs.select("doc_id", "text").union(
        spark.createDataFrame([(90, "<|endoftext|> a"), (91, "x,,. y.z don't. Á, <|EndOfText|>")], "doc_id long, text string")
    )
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    start, expected = 0, []
    for known, i, text in rows:
        ids = [*ids_of(text), 2]
        expected.append((i if known else None, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(map(tuple, token_files.token_files(odd).collect()), key=lambda r: r[1])
    assert got == expected
    path = str(tmp_path / "small")
    token_files.write_token_files(odd, path, file_tokens=50)
    documents = []
    for name in glob.glob(f"{path}/part*"):
        data = open(name, "rb").read()
        if len(data) > 60:
            file = token_files.TokenFile(data)
            documents += [(file.doc_ids[k], crc(file.document(k))) for k in range(file.documents)]
    assert Counter(documents) == Counter((e[0], e[3]) for e in expected)
    assert token_files.token_files(no_docs).collect() == []


def test_packing_places_every_piece_once(docs, no_docs, ids_of):
    got = packing.pack_documents(docs, capacity=64).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*ids_of(r.text), 1]
        for k in range(0, len(ids), 64):
            expected[r.doc_id, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(no_docs).collect() == []


def test_packing_meets_its_bound_across_groups(spark):
    random = np.random.default_rng(3)
    lengths = np.minimum(1000, 1 + random.exponential(250, 6000).astype(int))
    items = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    got = packing.pack(items, capacity=1000, per_group=500)
    used = got.select("sequence_id").distinct().count()
    assert got.count() == 6000 and used <= packing.lower_bound(lengths, 1000) + 3
    with pytest.raises(Exception, match="between 1 and the capacity"):
        packing.pack(spark.createDataFrame([(2000,)], "length long"), capacity=1000).count()


def test_lower_bound_never_exceeds_a_packing():
    random = np.random.default_rng(5)
    for _ in range(200):
        lengths = random.integers(1, 31, random.integers(1, 25))
        bins, offsets = packing.best_fit_decreasing(lengths, 30)
        assert packing.lower_bound(lengths, 30) <= bins.max() + 1
        assert (np.bincount(bins, weights=lengths) <= 30).all()
    assert packing.lower_bound(np.array([16, 16, 16]), 30) == 3


def test_archives_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a.example/x y", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "", ""),
        (5, "http://c.example/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\n" * 50), (6, "http://ü.example/", "ß\r\n\r\n\n"),
        (None, "http://d.example/", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (7, "u", "z" * 200_000),
    ]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, path string")
    got = archives.archive_pages(pages).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (i, len((h or "").encode()), digest(h)) for i, _, h in rows
    )
    kinds = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds == sorted(
        [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "revisit", 4),
         (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)], key=repr,
    )
    assert len({r.record_id for r in got}) == len(rows)
    large = {r.page_id: r.record_type for r in archives.archive_pages(pages.filter("page_id IN (1, 2, 7)").dropDuplicates(), 100).collect()}
    assert large == {1: "response", 2: "response", 7: "response"}
    assert archives.archive_pages(pages.limit(0)).collect() == []
    path = str(tmp_path / "arc")
    archives.write_arc(pages.repartition(1), path, file_bytes=2000)
    versions = set()
    for name in glob.glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        versions |= {data.split(b"\n")[1][:1]} if data else set()
    assert versions == {b"1", b"2"}


def test_arc_records_of_both_versions():
    for version in (1, 2):
        data = archives.arc_opening("f.arc", version, "20010203040506") + archives.arc_record(
            "http://x/a b", "20010203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n", version, "f.arc", 9
        )
        (at, fields, block), = archives.arc_records(data)
        assert fields["URL"] == "http://x/a%20b" and fields["File"] == "f.arc"
        assert archives.http_parts(block) == ({"a": "b"}, b"body\n")
        with pytest.raises(ValueError, match="cut short"):
            list(archives.arc_records(data[:-3]))
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="layout with-sidebar"><div id=main class="post-{n}"><h2>Head &amp; line</h2><p>First <b>para</b>graph\n goes&nbsp;on
<p>Second, an unclosed one.<br>More of it, long enough to count for something.<div class="ad-slot">Buy!</div>
<form><input><button>Send</button></form><p>Third paragraph, with <a href=x>a link</a> inside.</p></div>
<div class="sidebar"><p>Popular things of the week, all listed here at length.</p></div></div>
<section class="comments"><p>A reader says a great many words that are not part of the article, and more, and more.</p></section>
<footer>Foot</footer></body></html>"""


def test_page_text_leaves_clutter_out():
    expected = "Head & line\n\nFirst paragraph goes on\n\nSecond, an unclosed one. More of it, long enough to count for something.\n\nThird paragraph, with a link inside."
    assert page_text.extract(PAGE.replace("{n}", "7"), None) == expected
    assert page_text.vote(PAGE.replace("{n}", "7"))[0] == page_text.vote(PAGE.replace("{n}", "12"))[0]
    assert page_text.extract("", None) == page_text.extract("<p></p>", "x") == ""
    assert page_text.extract("<article><p>unfinished <script>x", None) == "unfinished"
    kept = (
        "<article><p>Let <math><mi>x</mi></math> be real. <object>Fallback words</object> <svg><title>t</title><text>label</text></svg> "
        "<button>Send</button>End.</p><noscript><p>Shown text.</p></noscript></article>"
    )
    assert page_text.extract(kept, None) == "Let x be real. Fallback words label End.\n\nShown text."


def test_host_paths_are_voted(spark):
    long = "<div class=a><p>" + "main text of the page " * 10 + "</p></div>"
    other = lambda n: "<div class=b><p>" + "something else entirely " * n + "</p></div>"
    rows = [(i, "http://H.example/1", f"<body>{long}{other(2)}</body>", "p") for i in range(5)]
    rows.append((9, "https://h.example:80/2", f"<body>{long}{other(20)}</body>", "p"))
    rows += [(10, None, None, "p"), (11, "odd", "<p>plain</p>", "p"), (12, "http://x/", "plain &lt; text", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.main_text(pages).collect()}
    assert got[9] == (("main text of the page " * 10).strip(), 219)
    assert got[10] == ("", 0) and got[11] == ("plain", 5) and got[12] == ("plain < text", 12)
    assert page_text.main_text(pages.limit(0)).collect() == []


def test_articles_of_the_sample_pages(sample):
    import html
    import re

    pages = sample("pages")
    got = {r.page_id: r.text for r in page_text.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", re.sub("(?s)<!--.*?-->", "", r.html))[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", article)))
        assert got[r.page_id] == "\n\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())


def test_top_k_by_hand(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.normal(size=6)], "l") for i in range(300)]
    rows += [(300 + i, rows[5][1], "l") for i in range(40)] + [(5, rows[5][1], "l")]
    rows += [(400, None, "l"), (401, [float("nan")] * 6, "l"), (402, [None] * 6, "l"), (403, [1.0], "l"), (404, [], "l"), (None, rows[0][1], "l")]
    rows += [(405, [float("inf")] * 6, "l"), (460, [2.0], "l")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    sound = [(i, [int(np.floor(64 * x)) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    expected = []
    for q, e in sound:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, d)), i) for i, d in sound if i != q and len(d) == len(e))[:7]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = knn.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=7, pivots=8)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert knn.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_a_query_repeated_in_a_tight_cell_finds_its_neighbours(spark):
    rows = [(0, [10.0, 0.0])] * 30 + [(1 + i, [5.0 + i / 10, 3.0]) for i in range(10)]
    rows += [(50 + i, [-8.0 - i / 10, 6.0]) for i in range(10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = sorted((-640 * int(np.floor(64 * e[0])), i) for i, e in rows if i)[:7]
    expected = [(0, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    got = knn.top_k(vectors, spark.createDataFrame(rows[:1], vectors.schema), k=7, pivots=3)
    assert sorted(map(tuple, got.collect())) == expected


def test_products_are_exact_beyond_doubles():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]])
    assert knn.products(q, x).tolist() == [[2**60 + 1]]


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"


def test_tool_calls_are_linked(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 1, "search", '{"query": "x", "limit": 3}', None), (1, "b", 3, "search", '{"limit": "3", "zoom": 1}', "a"),
            (1, "c", 5, "lookup", "no json", "b"), (1, "d", 6, "dance", "{}", "c"), (1, "a", 2, "note", "{}", None),
            (2, "a", 1, "note", '{"text": "b\\n\\u00e9", "a": 1}', "z"), (2, "p", 2, "note", '{"text": "t"}', "q"),
            (2, "q", 3, "note", '{"text": "t"}', "p"), (2, "r", 4, "note", '{"text": "t"}', "q"), (None, "x", 1, "note", "{}", None),
            (3, None, 1, "note", "{}", None),
        ],
        CALLS,
    )
    results = spark.createDataFrame(
        [(1, "a", 2, "found"), (1, "b", 1, "too soon"), (1, "n", 4, "nobody asked"), (2, "a", 2, None)],
        "conv_id long, call_id string, turn long, content string",
    )
    tools = spark.createDataFrame(tool_calls.PARAMETERS, "name string, parameter string, type string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, tools).collect()}
    assert {k: (r.depth, r.status) for k, r in got.items()} == {
        (1, "a"): (0, "answered"), (1, "b"): (1, "early"), (1, "c"): (2, "unanswered"), (1, "d"): (3, "unanswered"),
        (1, "n"): (None, "orphan"), (2, "a"): (0, "answered"), (2, "p"): (None, "unanswered"),
        (2, "q"): (None, "unanswered"), (2, "r"): (None, "unanswered"),
    }
    assert got[1, "a"].errors == "" and got[1, "a"].call_copies == 2
    assert got[1, "b"].errors == "missing query;type limit;unknown zoom"
    assert got[1, "c"].errors == "no JSON object" and got[1, "d"].errors == "unknown tool"
    assert got[1, "a"].message == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"found"}'
    assert json.loads(got[2, "a"].message)["arguments"] == {"a": 1, "text": "b\né"}
    assert tool_calls.link(calls.limit(0), results.limit(0), tools).collect() == []


def test_tool_calls_of_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * t) for t in range(40)]
    rows += [(1, 0, "user", ""), (2, 0, "user", None), (None, 1, "user", "x"), (3, None, "user", "x"), (4, 1, "system", "x")]
    got = tool_calls.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.call_turn: r.depth for r in got if r.conv_id == 1} == {t: t // 2 for t in range(0, 40, 2)}
    assert {r.conv_id for r in got} == {1, 2}


def test_whole_conversations_give_back_every_text(spark, sample_folder):
    """Every row and every text, whatever its length, role, conversation, number or copies."""
    said = "Say \"ünï\",\n\ttwo words and "
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", said + "x" * (t // 2)) for t in range(40)]
    rows += [(5, 0, "system", said + "s"), (5, 1, None, said + "n"), (5, 2, "tool", said + "t"), (5, 2, "tool", said + "t")]
    rows += [(None, 1, "user", said + "c"), (3, None, "assistant", said + "d"), (6, 0, "system", None)]
    rows += [(7, 0, "user", said + "first"), (7, 0, "user", said + "other"), (7, 0, "user", said + "other")]
    rows += [(7, 1, "assistant", said + "a"), (7, 1, "assistant", said + "b"), (7, 4, "user", None), (7, 4, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.whole_conversations(table).collect()
    back, kinds, of_one = [], {}, []
    for r in got:
        message = json.loads(r.message)
        assert r.message == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r.status in ("other", "unlinked"):
            back.append((r.conv_id, r.call_turn, message["role"], message["text"]))
            assert message["turn"] == r.call_turn
        else:
            if r.call_copies:
                text = [(message["arguments"] or {}).get(k) for k in ("query", "topic", "text")]
                back.append((r.conv_id, r.call_turn, "user", max(text, key=lambda x: x is not None)))
            if r.result_copies:
                back.append((r.conv_id, r.result_turn, "assistant", message["result"]))
        kinds[r.status] = kinds.get(r.status, 0) + 1
        of_one += [r.errors] if r.conv_id == 1 else []
    assert sorted(set(back), key=repr) == sorted(set(rows), key=repr)
    assert len(back) == len(rows) - 1  # only the two equal rows of a user are one, counted twice
    assert sum(r.call_copies for r in got if r.conv_id == 7 and r.call_turn == 0 and r.status == "copy") == 2
    assert kinds == {"answered": 21, "unanswered": 1, "other": 5, "unlinked": 2, "copy": 3}
    assert set(of_one) == {"", "unknown urgent", "type limit", "missing limit"}
    assert tool_calls.whole_conversations(table.limit(0)).collect() == []
    given = spark.read.parquet(f"{sample_folder}/conversations.parquet").filter("role NOT IN ('user', 'assistant')").count()
    assert entry.queries()["op6_tool_call_linking"](spark, sample_folder).filter("status = 'other'").count() == given > 0


def test_no_python_in_native_plans(spark, docs, tmp_path):
    from tidemark.llm import decontaminate

    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for df in (decontaminate.contamination(docs, items),):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_decisions(spark, sample_folder, ids_of):
    docs = spark.read.parquet(f"{sample_folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sample_folder)
        assert kept.columns == columns, name
        assert 0 < kept.count() < docs.count(), name
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    total = {r.doc_id: len(ids_of(r.text)) + 1 for r in docs.collect()}
    got = corpus_pipeline.run(spark, sample_folder).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in got} == total


def test_one_query_of_each_operator():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
