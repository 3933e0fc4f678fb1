"""Fold, merge, decoding and key changes against literal left folds and small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import codec, fold, ingest, merge
from millrace.schema import CHANGE, ordered_columns, quoted, quoted_table, sql_text

COLUMNS = ["a", "b", "c"]


def frame(spark, events):
    rows = [(e["op"], "t", i + 1, None, {"id": str(e["id"])}, e.get("after"), e.get("unchanged", []), {"id": "bigint"}, e["id"] % 3, i) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, CHANGE)


def left_fold(events):
    """The rule read literally: one event at a time."""
    state = {}
    for e in events:
        e = {"op": e["op"], "id": e["id"], "after": None if e.get("after") is None else dict(e["after"]), "unchanged": list(e.get("unchanged", []))}
        prev = state.get(e["id"])
        if prev and e["op"] != "d" and prev["op"] != "d" and prev["after"] is not None and e["unchanged"] and e["after"] is not None:
            for c in list(e["unchanged"]):
                if c in prev["after"]:
                    e["after"][c] = prev["after"][c]
                    e["unchanged"].remove(c)
        state[e["id"]] = e
    return state


def random_events(rng, n, keys, legal=False):
    seen, out = set(), []
    for _ in range(n):
        i = rng.randrange(keys)
        op = rng.choice("cuuuuud") if not legal else ("c" if i not in seen else rng.choice("uuuuud"))
        if op == "d":
            seen.discard(i)
            out.append({"op": "d", "id": i})
            continue
        seen.add(i)
        after, unchanged = {}, []
        for c in COLUMNS:
            kind = rng.random()
            if op != "c" and kind < 0.35:
                unchanged.append(c)
            elif kind < 0.45 and not legal:
                pass
            else:
                after[c] = None if kind > 0.9 else str(rng.randrange(100))
        out.append({"op": op, "id": i, "after": after, "unchanged": unchanged})
    return out


def test_fold_is_the_left_fold(spark):
    events = random_events(random.Random(4), 4000, 300)
    want = {i: (s["op"], *[(s["after"] or {}).get(c) for c in COLUMNS], sorted(s["unchanged"])) for i, s in left_fold(events).items()}
    got = {int(r.pk["id"]): (r.op, r.a, r.b, r.c, sorted(r.still_unchanged)) for r in fold.fold(frame(spark, events), COLUMNS).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([{"op": "c", "id": 1, "after": {"a": "1"}}, {"op": "u", "id": 1, "after": {"a": "2"}}, {"op": "u", "id": 1, "after": {"a": "3"}}], ("u", "3", [])),
        ([{"op": "c", "id": 1, "after": {"a": "1"}}, {"op": "d", "id": 1}], ("d", None, [])),
        ([{"op": "u", "id": 1, "after": {"a": "big"}}, {"op": "u", "id": 1, "after": {}, "unchanged": ["a"]}], ("u", "big", [])),
        ([{"op": "u", "id": 1, "after": {}, "unchanged": ["a"]}], ("u", None, ["a"])),
        ([{"op": "c", "id": 1, "after": {"a": None}}, {"op": "u", "id": 1, "after": {}, "unchanged": ["a"]}], ("u", None, [])),
    ],
)
def test_fold_cases(spark, events, want):
    (r,) = fold.fold(frame(spark, events), ["a"]).collect()
    assert (r.op, r.a, r.still_unchanged) == want


def applied(spark, events, target=None, ts="2024-01-01"):
    folded = fold.key_columns(fold.fold(frame(spark, events), COLUMNS), {"id": "bigint"})
    start = merge.empty_replica(spark, {"id": "bigint"}, {c: "string" for c in COLUMNS}) if target is None else target
    return merge.merge(start, folded, ["id"], COLUMNS, F.lit(ts))


def plain(df):
    return sorted((r.id, r.a, r.b, r.c) for r in df.collect())


def test_many_batches_are_one(spark):
    events = random_events(random.Random(9), 600, 40, legal=True)
    whole = plain(applied(spark, events))
    state = None
    for part in (events[:200], events[:410], events):
        # each part starts over: changes that were merged before are replayed and change nothing
        state = spark.createDataFrame(applied(spark, part, state).collect(), merge.empty_replica(spark, {"id": "bigint"}, {c: "string" for c in COLUMNS}).schema)
    assert plain(state) == whole


def test_worked_merge(spark):
    target = applied(spark, [{"op": "c", "id": 77, "after": {"a": "x", "b": "notes"}}, {"op": "c", "id": 55, "after": {"a": "y"}}])
    out = applied(spark, [{"op": "c", "id": 101, "after": {"a": "n"}}, {"op": "u", "id": 77, "after": {"a": "z"}, "unchanged": ["b"]}, {"op": "d", "id": 55}, {"op": "d", "id": 5}], target)
    assert plain(out) == [(77, "z", "notes", None), (101, "n", None, None)]


def test_replayed_old_changes_do_not_regress(spark):
    target = applied(spark, [{"op": "c", "id": 1, "after": {"a": "old"}}, {"op": "u", "id": 1, "after": {"a": "new"}}])
    again = applied(spark, [{"op": "c", "id": 1, "after": {"a": "old"}}], target)
    assert plain(again) == [(1, "new", None, None)]


def test_evolution_and_upserts(spark):
    target = merge.evolve(merge.empty_replica(spark, {"id": "bigint"}, {"a": "string"}), {"a": "string", "z": "int"})
    assert target.columns == ["id", "a", "z", *merge.META]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, merge.upsert(t, spark.createDataFrame([(2, "B"), (3, "C")], t.schema), t.where("id = 1"), ["id"]).collect())) == [(2, "B"), (3, "C")]
    assert merge.insert_missing(t, spark.createDataFrame([(2, "X"), (4, "D")], t.schema), ["id"]).count() == 3
    r = merge.reset_or_insert(t, spark.createDataFrame([(2, "X"), (4, "D")], t.schema), ["id"], ["v"])
    assert sorted(map(tuple, r.collect())) == [(1, "a"), (2, "b"), (4, "D")]


def test_large_numbers_and_order_survive_messages(spark):
    events = [{"op": "c", "id": 1, "after": {"a": "9007199254740993", "b": None}}]
    sent = codec.encoded(frame(spark, events).withColumn("pk", F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))))
    (m,) = sent.collect()
    assert m.key == 't:{"a":"2","z":"1"}' and json.loads(m.value)["after"] == {"a": "9007199254740993", "b": None}
    (r,) = codec.decoded(sent).collect()
    assert r.after == {"a": "9007199254740993", "b": None} and r.offset == 0


RELATION = "relation_id long, table string, columns array<struct<name:string,oid:int,is_key:boolean>>"
TUPLE = "xid long, seq long, action string, relation_id long, values array<struct<kind:string,text:string>>, old array<struct<kind:string,text:string>>"


def test_tuples(spark):
    relations = spark.createDataFrame([(1, "public.animals", [("animal_id", 23, True), ("name", 25, False), ("alive", 16, False), ("notes", 25, False)]), (2, "public.keyless", [("x", 25, False)])], RELATION)
    row = lambda *v: [("n", None) if x is None else ("u", None) if x == "~" else ("t", x) for x in v]
    tuples = [
        (1, 1, "insert", 1, row("42", "Ada", "t", None), None),
        (1, 2, "update", 1, row("42", "Ada", "f", "~"), None),
        (1, 3, "update", 1, row("43", "Ada", "f", "~"), row("42", None, None, None)),
        (1, 4, "delete", 1, None, row("42", None, None, None)),
        (1, 5, "insert", 1, row("42", "~", "t", None), None),
        (1, 6, "insert", 1, row("42"), None),
        (1, 7, "insert", 2, row("1"), None),
        (1, 8, "insert", 9, row("1"), None),
        (1, 9, "delete", 1, None, None),
    ]
    out = {r.seq: r for r in ingest.decode_tuples(spark.createDataFrame(tuples, TUPLE), relations).collect()}
    assert out[1].after == {"name": "Ada", "alive": "t", "notes": None} and out[1].pk == {"animal_id": "42"} and out[1].types["alive"] == "boolean"
    assert out[2].unchanged == ["notes"] and "notes" not in out[2].after and out[2].op == "u"
    assert out[4].op == "d" and out[4].pk == {"animal_id": "42"} and out[4].after is None
    assert [out[i].error for i in (1, 5, 6, 7, 8, 9)] == [None, "unchanged value in an insert", "wrong number of values", "no key", "unknown relation", "no row"]
    good = ingest.decode_tuples(spark.createDataFrame(tuples[:4], TUPLE), relations).drop("error")
    split = sorted(((r.seq, r.sub, r.op, r.pk["animal_id"]) for r in ingest.split_key_changes(good).collect()))
    assert split == [(1, 0, "c", "42"), (2, 0, "u", "42"), (3, 0, "d", "42"), (3, 1, "c", "43"), (4, 0, "d", "42")]


def test_moved_rows_keep_unsent_values(spark):
    rows = [("c", "t", 0, {"id": "1"}, {"a": "x", "b": "long"}, [], None), ("c", "t", 2, {"id": "9"}, {"a": "y"}, ["b"], {"id": "1"})]
    changes = spark.createDataFrame(rows, "op string, table string, offset long, pk map<string,string>, after map<string,string>, unchanged array<string>, prev_pk map<string,string>")
    r = {x.offset: x for x in ingest.carry_key_changes(changes).collect()}
    assert r[2].after == {"a": "y", "b": "long"} and r[2].unchanged == []


def test_messages_are_parsed_once(spark):
    """Whether a message is a change is judged on what has been parsed; the plan doesn't parse it anew for each condition."""
    rows = [(0, '{"op":"c","table":"t","lsn":1,"pk":{"a":"1"}}'), (1, "{not json"), (2, '{"op":"","table":"t"}'), (3, '{"op":"u"}'), (4, '{"op":"x","table":"t"}'), (5, None), (6, '{"op":"d","table":"t","lsn":2}')]
    out = codec.decoded(spark.createDataFrame(rows, "offset long, value string"))
    assert [(r.offset, r.op, r.table, r.lsn, r.pk) for r in out.orderBy("offset").collect()] == [(0, "c", "t", 1, {"a": "1"}), (6, "d", "t", 2, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_names():
    assert ordered_columns(["zeta", "id", "alpha", "mid"], ["id"]) == ["id", "alpha", "mid", "zeta"]
    assert quoted("a`b") == "`a``b`" and quoted_table("public.animals") == "`public`.`animals`" and sql_text("it's") == "'it''s'"


def test_moves_join_only_rows_that_lack_values(spark):
    """Raw rows meet their relation by broadcast, and the whole log isn't shuffled to fill the few rows that moved."""
    from millrace.operators import ingest
    from millrace.plans import workload as w
    from tests.conftest import SF

    raw = w.raw_moves(spark, SF)
    rows = ingest.assembled(raw)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    held = rows.localCheckpoint()
    carried = ingest.carry_key_changes(held)
    assert carried.count() == held.count() and sorted(carried.columns) == sorted(held.columns)
    assert carried.where("prev_pk is not null and size(unchanged) > 0").isEmpty()
    assert "Union" in carried._jdf.queryExecution().optimizedPlan().toString()
