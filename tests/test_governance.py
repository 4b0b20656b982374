import json

import pytest
from helpers import T0, canonical_events, event, events_df
from pyspark.sql import functions as F
from tidemark.operators import export, governance as gov


def masked(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    return [r.payload for r in gov.mask_payload(df).orderBy("i").collect()]


def test_masking(spark):
    got = masked(
        spark,
        [
            '{"email":"alice@example.com","status":"active"}',
            '{"user":{"mail":"a@b.co","ssn":"123-45-6789"},"list":["x",5,true,null,"4111 1111 1111 1111"]}',
            '{"card":"4111-1111-1111-1111","card2":"4111111111111111","phone":"+4912345678901"}',
            '{"number":4111111111111111,"flag":true,"none":null}',
            "not json",
            None,
            '["bob@example.com"]',
            '"bob@example.com"',
            '{"bob@example.com":"key"}',
            '{"t":"é4111111111111111é"}',
        ],
    )
    assert json.loads(got[0]) == {"email": "***@***.***", "status": "active"}
    assert json.loads(got[1]) == {
        "user": {"mail": "***@***.***", "ssn": "***-**-****"}, "list": ["x", 5, True, None, "****-****-****-****"],
    }
    assert json.loads(got[2]) == {"card": "****-****-****-****", "card2": "****-****-****-****", "phone": "***-***-****"}
    assert json.loads(got[3]) == {"number": 4111111111111111, "flag": True, "none": None}
    assert got[4] == "not json" and got[5] is None
    assert got[6] == '["***@***.***"]' and got[7] == '"***@***.***"'
    assert json.loads(got[8]) == {"bob@example.com": "key"}
    assert json.loads(got[9]) == {"t": "****-****-****-****"}


def test_nested_masking_is_native_and_keeps_digits(spark):
    exact = '{"a":[12345678901234567.89,0.12345678901234567890123,123456789012345678],"b":{"n":{}}}'
    texts = [
        exact,
        json.dumps({"k": {'a"b@c.de': 'x"y', "back\\\\": "end\\", "n": "a\\\"b\n@"}}),
        json.dumps({"k": ["say \"hi\" to a@b.co \\", "", ":", "\\", "tab\t\u0001\u0002"]}),
        json.dumps([[], {}, "é a@b.co", ["4111 1111 1111 1111", {"x": ":a@b.co"}]]),
        json.dumps({"long": ["\\\"" * 50_000]}),
    ]
    got = masked(spark, texts)
    assert got[0] == exact
    assert json.loads(got[1]) == json.loads(texts[1])
    assert json.loads(got[2]) == {"k": ["***@***.***", "", ":", "\\", "tab\t\u0001\u0002"]}
    assert json.loads(got[3]) == [[], {}, "***@***.***", ["****-****-****-****", {"x": "***@***.***"}]]
    assert json.loads(got[4]) == json.loads(texts[4])
    df = spark.createDataFrame([(texts[3],)], "payload string")
    for plan in (gov.mask_payload(df), df.select(gov.mask_value(F.col("payload")))):
        assert "Python" not in plan._jdf.queryExecution().toString()


def test_rule_order_decides(spark):
    phone_first = [gov.DEFAULT_MASKS[2], gov.DEFAULT_MASKS[1]]
    df = spark.createDataFrame([('{"c":"4111111111111111"}',)], "payload string")
    assert gov.mask_payload(df, phone_first).first().payload == '{"c":"***-***-****"}'


def test_mask_value_nested(spark):
    df = spark.createDataFrame([('{"a":["x@y.zz",1]}',), ('"x@y.zz"',), ("5",), (None,)], "v string")
    got = [r[0] for r in df.select(gov.mask_value(F.col("v"))).collect()]
    assert got == ['{"a":["***@***.***",1]}', '"***@***.***"', "5", None]


def test_reveal(spark):
    requests = spark.createDataFrame(
        [("ACC-001", 2, "ann", "ticket 7"), ("ACC-001", 9, "ann", "ticket 7"), ("ACC-002", 1, "bob", " ")],
        "aggregate_id string, sequence_number long, user_id string, reason string",
    )
    revealed, audit = gov.reveal_events(canonical_events(spark), requests, F.lit(T0))
    assert [(r.event_type, r.user_id) for r in revealed.collect()] == [("MoneyDeposited", "ann")]
    got = {r.resource_id: json.loads(r.details_json)["found"] for r in audit.collect()}
    assert got == {"ACC-001#2": True, "ACC-001#9": False}


POLICY = gov.Policy(
    roles=[gov.Role("r1", ["view timeline"], ["pg"], ["BankAccount"]), gov.Role("r2", ["export-aggregate"])],
    principal_roles={"ann": ["r1"]},
)


def decide(spark, policy, *request):
    schema = "user_id string, roles array<string>, permission string, source_id string, aggregate_type string"
    return gov.authorize_requests(spark.createDataFrame([request], schema), policy).first()


@pytest.mark.parametrize(
    "request_, reason",
    [
        ((None, [], "VIEW_TIMELINE", "pg", "BankAccount"), "DENY_AUTH_REQUIRED"),
        (("ann", [], "VIEW_TIMELINE", "PG", "bankaccount"), "ALLOW"),
        (("ann", [], "VIEW_TIMELINE", "", None), "ALLOW"),
        (("ann", [], "EXPORT_AGGREGATE", "pg", "BankAccount"), "DENY_MISSING_PERMISSION"),
        (("bob", None, "VIEW_TIMELINE", "pg", "BankAccount"), "DENY_MISSING_PERMISSION"),
        (("bob", ["r1"], "view-timeline", "mysql", "Other"), "DENY_SOURCE_SCOPE"),
        (("ann", ["unknown"], "VIEW_TIMELINE", "pg", "Order"), "DENY_AGGREGATE_TYPE_SCOPE"),
        (("ann", ["r2"], "EXPORT_AGGREGATE", "any", "Any"), "ALLOW"),
    ],
)
def test_authorization(spark, request_, reason):
    row = decide(spark, POLICY, *request_)
    assert (row.reason, row.allowed) == (reason, reason == "ALLOW")


def test_disabled_policy_allows(spark):
    assert decide(spark, gov.Policy(enabled=False), None, [], "X", "s", "t").allowed


def test_scope_filter(spark):
    df = canonical_events(spark).withColumn("source_id", F.lit("pg"))
    assert gov.scope_filter(df, POLICY, "ann", "VIEW_TIMELINE").count() == 4
    assert gov.scope_filter(df, POLICY, "bob", "VIEW_TIMELINE").count() == 0
    assert gov.scope_filter(df, POLICY, None, "VIEW_TIMELINE").count() == 0


def test_audit_is_appended(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(3):
        rows = spark.createDataFrame([(f"A{i}", "ann", T0)], "action string, user_id string, created_at timestamp")
        gov.append_audit(rows, path)
    audit = spark.read.parquet(path)
    assert audit.count() == 3
    assert gov.recent_audit(audit, 10, action="A1", user_id="ann").count() == 1
    assert gov.recent_audit(audit, 0).count() == 1


def test_exports(spark, tmp_path):
    df = events_df(
        spark,
        [
            event("ACC-1", "T", 1, "AccountCreated", {"balance": 0, "note": 'say "hi"'}, 1),
            event("ACC-1", "T", 2, "MoneyDeposited", None, 2),
            event("B", "T", 1, "X", {"a": 1}, 3),
        ],
    )

    def lines(exported, aggregate="ACC-1"):
        return [r.line for r in exported.filter(F.col("aggregate_id") == aggregate).orderBy("line_no").collect()]

    csv = lines(export.export_csv(df))
    assert csv[0] == "sequence,event_type,timestamp,payload"
    assert csv[1].startswith('1,"AccountCreated","2026-03-24T10:01:00Z","{""balance"": 0')
    assert csv[2] == '2,"MoneyDeposited","2026-03-24T10:02:00Z",""'
    document = json.loads("".join(lines(export.export_json(df, T0))))
    assert document["eventCount"] == 2 and document["exportedAt"] == "2026-03-24T10:00:00Z"
    assert json.loads(document["events"][0]["payload"])["note"] == 'say "hi"'
    markdown = lines(export.export_markdown(df))
    assert markdown[0] == "# Event History: ACC-1" and markdown[4].startswith("| 1 | AccountCreated | 2026-03-24T10:01:00Z |")
    assert "balance: null → 0" in markdown[4]
    fixture = "\n".join(lines(export.export_fixture(df)))
    assert "public class ACC_1Fixture {" in fixture and '\\"hi\\\\\\"' in fixture.replace('\\\\\\"hi', '\\"hi')
    assert fixture.count("Map.of(") == 2 and fixture.rstrip().endswith("}")
    path = str(tmp_path / "csv")
    export.write_lines(export.export_csv(df), path)
    assert spark.read.text(path).count() == 5
    export.write_json_events(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_bulk_export_is_masked_and_limited(spark):
    df = events_df(spark, [event("A", "T", i, "X", {"mail": "a@b.co"}, i) for i in range(0, 6)])
    got = export.bulk_export(df, 4, width=2).orderBy("sequence_number").collect()
    assert [r.sequence_number for r in got] == [0, 1, 2, 3]
    assert {r.payload for r in got} == {'{"mail":"***@***.***"}'}


def test_ranged_lines_are_written_without_moving_again(spark, tmp_path):
    """The same files' text in the same order, whether lines are dealt by ranges before or when they are written."""
    rows = [event(f"A{i % 23:02d}", "T", i // 23, "X", {"n": i}, i) for i in range(400)]
    rows += [*rows[:7], event(None, "T", 1, "X", {"n": 1}, 900), event("Z", "T", 1, "X", None, 901)]
    df = events_df(spark, rows).repartition(5, "event_id")
    ranged = export.export_csv(df, ranged=True)
    moved = lambda lines: lines.sortWithinPartitions("aggregate_id", "line_no")._jdf.queryExecution().executedPlan().toString()
    assert moved(ranged).count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning(aggregate_id" not in moved(ranged)
    texts = {}
    for name, lines in (("ranged", ranged), ("plain", export.export_csv(df)), ("cut", export.export_csv(df, width=1, ranged=True))):
        export.write_lines(lines, str(tmp_path / name))
        files = sorted((tmp_path / name).glob("part-*"))
        texts[name] = "".join(f.read_text() for f in files).splitlines()
    assert texts["ranged"] == texts["plain"] == texts["cut"]
    assert len(texts["ranged"]) == len(rows) + 25
    # a relation that was changed is dealt anew
    assert not getattr(ranged.filter("line_no > 0"), "ranged", False)
