from datetime import datetime

import pytest
from helpers import canonical_events, event, events_df
from test_replay import by_aggregate, random_log
from tidemark.operators import sequence, stats, timeline
from tidemark.plans.running import event_chunks


@pytest.mark.parametrize("width", [2, 65_536])
def test_pages_match_slices(spark, width):
    rows = random_log(11, 200)
    df = events_df(spark, rows)
    got = {}
    for r in timeline.events_page(df, 4, 3, width).collect():
        got.setdefault(r.aggregate_id, []).append((r.step, r.sequence_number))
    expected = {}
    for aggregate, group in by_aggregate(rows).items():
        ordered = sorted(r[3] for r in group)
        page = [(i + 1, s) for i, s in enumerate(ordered)][3:7]
        if page:
            expected[aggregate] = page
    assert {a: sorted(p) for a, p in got.items()} == expected


def test_copies_of_one_sequence_are_cut_by_position(spark):
    rows = [event("HOT", "T", 5, "X", {"v": i}, position=i) for i in range(1, 60)]
    rows += [event("HOT", "T", 4, "X", {}, 900), event("HOT", "T", 6, "X", {}, 901)]
    df = events_df(spark, rows)
    for width in (65_536, 5):
        numbered = timeline.events_page(df, 100, 0, width).orderBy("step").collect()
        assert [r.global_position for r in numbered] == [900, *range(1, 60), 901]
    chunks = event_chunks(df, 5)(df).groupBy("__chunk").count().collect()
    assert max(r["count"] for r in chunks) <= 5 and len(chunks) > 10


def test_timeline_page_walk(spark):
    df = canonical_events(spark).filter("aggregate_id = 'ACC-001'")
    first = timeline.timeline_page(df, 2).first()
    assert (first.total_events, first.has_more, first.next_after) == (3, True, 2)
    cursors = timeline.timeline_page(df, 2).selectExpr("aggregate_id", "next_cursor as cursor")
    rest = timeline.events_after_cursor(df, cursors, 2).collect()
    assert [r.sequence_number for r in rest] == [3]
    last = timeline.timeline_page(df, 2, after=3).first()
    assert (last.aggregate_type, last.has_more, last.next_after, last.next_cursor) == ("unknown", False, 3, None)


def test_recent_and_polling(spark):
    df = canonical_events(spark)
    assert [r.global_position for r in timeline.recent_events(df, 3).collect()] == [3, 4, 5]
    assert [r.global_position for r in timeline.events_after_position(df, 2, 2).collect()] == [3, 4]


def test_search(spark):
    df = canonical_events(spark)
    assert [r.aggregate_id for r in timeline.search_aggregates(df, "acc").collect()] == ["ACC-001", "ACC-002"]
    assert timeline.search_aggregates(df, "a_c").count() == 0
    assert timeline.search_aggregates(df, "a_c", wildcards=True).count() == 2
    assert {r.event_type for r in timeline.search_summaries(df, "acc").collect()} == {"AccountCreated"}
    with pytest.raises(ValueError):
        timeline.search_aggregates(df, "  ")


def test_filters_and_query_object(spark):
    df = canonical_events(spark)
    assert timeline.filter_events(df, "Order").count() == 1
    with pytest.raises(ValueError):
        timeline.filter_events(df, since=datetime(2026, 2, 1), until=datetime(2026, 1, 1))
    found = timeline.query_events(df, "SEARCH", search="acc", fields="METADATA").collect()
    assert {r.payload for r in found} == {"{}"}
    with pytest.raises(ValueError):
        timeline.query_events(df, "OTHER")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    canonical_events(spark).write.parquet(path)
    df = timeline.metadata_only(timeline.filter_events(spark.read.parquet(path), "Order"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(aggregate_type,Order)" in plan and "payload:string" not in plan.split("ReadSchema")[1]


def plain_segments(types, min_run=4):
    out, i = [], 0
    while i < len(types):
        j = i
        while j < len(types) and types[j] == types[i]:
            j += 1
        if j - i >= min_run:
            out.append(("group", i, j - i))
        else:
            out.extend(("single", k, 1) for k in range(i, j))
        i = j
    return out


@pytest.mark.parametrize("width", [3, 65_536])
def test_runs_match_a_plain_loop(spark, width):
    rows = [
        event(a, "T", s + 1, kind, {}, position=i * 100 + s)
        for i, (a, kinds) in enumerate(
            {"A": "CUUUUP", "B": "X" * 20, "C": "XYXYXXXXYYYYYZ", "D": "Q", "E": "AAABBBBAAA"}.items()
        )
        for s, kind in enumerate(kinds)
    ]
    got = {}
    for r in sequence.collapse_runs(events_df(spark, rows), width=width).collect():
        got.setdefault(r.aggregate_id, []).append((r.kind, r.start_index, r.length))
    for aggregate, group in by_aggregate(rows).items():
        types = [r[4] for r in sorted(group, key=lambda r: r[3])]
        assert sorted(got[aggregate], key=lambda x: x[1]) == plain_segments(types)


def test_expanded_group(spark):
    kinds = ["Created", "Updated", "Updated", "Updated", "Updated", "Published"]
    rows = [event("A", "T", i + 1, k, {}) for i, k in enumerate(kinds)]
    shown = sequence.timeline_rows(events_df(spark, rows), "1-4", 3).orderBy("start_index", "kind").collect()
    assert [r.kind for r in shown] == ["single", "group", "group-item", "group-item", "group-item", "group-item", "single"]
    group = shown[1]
    assert group.row_key == "group-1-4" and group.expanded and group.contains_selection
    assert [r.step_number for r in shown if r.kind == "group-item"] == [2, 3, 4, 5]


def test_statistics(spark):
    df = canonical_events(spark)
    assert tuple(stats.store_totals(df).first()) == (5, 3)
    assert [tuple(r) for r in stats.top_event_types(df, 2).collect()] == [("AccountCreated", 2), ("MoneyDeposited", 1)]
    assert not stats.statistics(df.drop("timestamp")).available
    bundle = stats.statistics(df, as_of=datetime(2026, 3, 24, 12))
    assert [tuple(r) for r in bundle.throughput.collect()] == [("2026-03-24T10:00:00Z", 5)]
    with pytest.raises(ValueError):
        stats.throughput(df, 0)
