"""Histories, running counts, raw reports, sketches and session logs, against plain Python."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from indicata.operators import asof, sketches, versions
from indicata.sources import reports
from indicata.streaming import sessions

START = dt.datetime(2024, 1, 1)


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


# versions

LIST = "k string, part int, name string, rank int"


def test_history_answers_for_every_version(spark):
    rng = random.Random(1)

    def version():
        return [(rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.choice([1, None])) for _ in range(rng.choice([0, 3, 12]))]

    given = [version() for _ in range(5)]
    unique = lambda rows: {(k, p): max((r for r in rows if r[:2] == (k, p)), key=lambda r: [(x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[2:]]) for k, p, *_ in rows}
    frames = [spark.createDataFrame(v, LIST) for v in given]
    history = versions.first_version(frames[0], ["k", "part"], 1)
    for n, df in enumerate(frames[1:], 2):
        history = versions.with_version(history, df, ["k", "part"], n)
    for n, rows in enumerate(given, 1):
        assert _sorted(versions.at_version(history, n).collect()) == _sorted(unique(rows).values()), n
    # a row that stays is one row of the history
    spans = [(r.k, r.part, r.name, r["rank"], r.valid_from) for r in history.collect()]
    want = []
    for n, rows in enumerate(given, 1):
        before = set(unique(given[n - 2]).values()) if n > 1 else set()
        want += [(*r, n) for r in unique(rows).values() if r not in before]
    assert _sorted(spans) == _sorted(want)
    for old, new in zip(given, given[1:]):
        a, b = unique(old), unique(new)
        told = {(r.k, r.part): (r.change, r.old and tuple(r.old), r.new and tuple(r.new)) for r in versions.changes(spark.createDataFrame(old, LIST), spark.createDataFrame(new, LIST), ["k", "part"]).collect()}
        assert told == {key: ("insert" if key not in a else "delete" if key not in b else "update", a[key][2:] if key in a else None, b[key][2:] if key in b else None) for key in a.keys() | b.keys() if a.get(key) != b.get(key)}


# counts up to each row


@pytest.mark.parametrize("hot", [None, 7])
def test_counts_before(spark, hot):
    rng = random.Random(2)
    rows = [(n, rng.choice(["a", "a", "a", "b", "c", None]), START + dt.timedelta(seconds=rng.randint(0, 500)) if rng.random() > 0.05 else None) for n in range(300)]
    rows += [(7, "a", START + dt.timedelta(seconds=30))] * 3
    df = spark.createDataFrame(rows, "n int, api string, ts timestamp").withColumn("upto", F.lit("clash"))
    out = asof.counts_before(df, keys=["api"], time="ts", seconds=(1, 60), hot=hot)
    assert out.columns == ["n", "api", "ts", "upto", "last_1", "last_60"]

    def count(api, ts, s):
        return None if api is None or ts is None else sum(a == api and t is not None and ts - dt.timedelta(seconds=s) <= t <= ts for _, a, t in rows)

    assert _sorted((r.n, r.api, r.ts, r.last_1, r.last_60) for r in out.collect()) == _sorted((n, a, t, count(a, t, 1), count(a, t, 60)) for n, a, t in rows)


# reports


def test_reports_of_any_shape(spark):
    whole = {"data": {"attributes": {"last_analysis_stats": {"malicious": 3, "harmless": "12"}, "tags": ["a", "b"], "last_analysis_date": 17, "reputation": -4}}}
    texts = [json.dumps(whole), "{}", "[1]", '"x"', "null", "", None, "{", '{"data": null}', '{"data": {"attributes": {"last_analysis_stats": [1], "tags": "no", "last_modification_date": "late"}}}', '{"data": {"attributes": {"last_modification_date": 5, "last_analysis_date": 6}}}', json.dumps(whole)[:-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    out = {r.i: r for r in reports.with_report(df, "json").select("i", "broken", reports.fields(F.col("report"), reports.VERDICT).alias("f"), reports.fields(F.col("report"), reports.ABUSE).alias("g")).collect()}
    assert {i for i, r in out.items() if r.broken} == {2, 3, 4, 5, 6, 7, 11}
    assert tuple(out[0].f) == (3, 0, 12, 0, 17, -4, ["a", "b"])
    assert all(tuple(out[i].f) == (0, 0, 0, 0, None, None, []) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11))
    assert out[10].f.last_seen == 5 and tuple(out[0].g) == (0, 0, False, None)


def test_pulses_of_any_shape(spark):
    pulse = {"tags": [" Botnet", "", 5, None, "botnet"], "malware_families": ["X", {"display_name": "", "name": "Y"}, {"id": "Z"}, {}, "", None, "X"]}
    shapes = [
        ({"pulse_info": {"count": 1, "pulses": [pulse]}}, (1, ["X", "Y", "Z"], ["botnet"])),
        ({"pulse_info": {"count": 2}, "general": {"pulse_info": {"count": 1, "pulses": [pulse]}}}, (2, [], [])),
        ({"pulse_info": {"count": 0}, "general": {"pulse_info": {"count": 9, "pulses": [pulse, {}]}}}, (9, ["X", "Y", "Z"], ["botnet"])),
        ({"pulse_info": {"pulses": [pulse, pulse, {"malware_families": ["W"]}]}}, (3, ["X", "Y", "Z", "W"], ["botnet"])),
        ({"general": None}, (0, [], [])), ({}, (0, [], [])), ({"pulse_info": {"count": "many", "pulses": "none"}}, (0, [], [])),
    ]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, (s, _) in enumerate(shapes)], "i int, json string")
    out = {r.i: tuple(r.p) for r in reports.with_report(df, "json").select("i", reports.pulses(F.col("report")).alias("p")).collect()}
    assert out == {i: want for i, (_, want) in enumerate(shapes)}


# sketches


def test_merged_sketches_stay_within_their_bounds(spark):
    rng = random.Random(3)
    rows = [("ab"[n % 2], START + dt.timedelta(days=rng.randrange(20)), rng.randrange(1 + n % 7000), rng.random() ** 3) for n in range(30_000)] + [("c", START, None, None), ("d", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "api string, ts timestamp, caller int, value double").withColumn("day", F.lit("clash"))
    days = sketches.by_day(df, ["api"], "ts", "caller", "value")
    assert days.count() == 41
    day = lambda n: (START + dt.timedelta(days=n)).date()
    for first, last in ((0, 19), (3, 9), (5, 5)):
        told = {r.api: r for r in sketches.estimates(sketches.over_span(days, ["api"], F.lit(day(first)), F.lit(day(last))), ["api"], (0.5, 0.9)).collect()}
        for api in "ab":
            own = [r for r in rows if r[0] == api and r[1] and day(first) <= r[1].date() <= day(last)]
            exact, values = len({r[2] for r in own}), sorted(r[3] for r in own)
            assert told[api].n == len(own) and abs(told[api].n_distinct / exact - 1) <= 4 * sketches.DISTINCT_ERROR
            for share, q in ((0.5, told[api].q_50), (0.9, told[api].q_90)):
                assert abs(sum(v <= q for v in values) / len(values) - share) <= sketches.RANK_ERROR + 1 / len(values)
    # spans are mergeable again, and give what the days give at once
    halves = sketches.over_span(days, ["api"], None, F.lit(day(9))).unionByName(sketches.over_span(days, ["api"], F.lit(day(10)), None)).withColumn("day", F.lit(day(0)))
    again = {r.api: r.n for r in sketches.over_span(halves, ["api"]).collect()}
    assert again == dict(Counter(r[0] for r in rows if r[1]))
    none = {r.api: r for r in sketches.estimates(sketches.over_span(days, ["api"]), ["api"]).collect()}["c"]
    assert (none.n, none.n_distinct, none.q_50) == (1, 0, None)


# session logs


def _logs(calls, ttl, ring):
    """(session, first): total, violations, apis, recent, whether a later call ended it."""
    out = {}
    for sid in {c[1] for c in calls}:
        first = None
        for ts, api, bad in sorted((c[0], c[2], c[3]) for c in calls if c[1] == sid):
            if first is None or ts > first + dt.timedelta(seconds=ttl):
                first = ts
                out[sid, first] = []
            out[sid, first].append((ts, api, bad))
    log = lambda own: (len(own), sum(c[2] for c in own), ",".join(f"{a}={n}" for a, n in sorted(Counter(c[1] for c in own).items())), ",".join(c[1] for c in own[-ring:]))
    return {k: log(own) for k, own in out.items()}


def test_session_logs_over_several_runs_and_late_calls(spark, tmp_path):
    rng = random.Random(4)
    draw = lambda low, high, n: [(START + dt.timedelta(seconds=rng.randint(low, high)), rng.choice("pqr"), rng.choice(["vt", "otx", "whois"]), rng.random() < 0.2) for _ in range(n)]
    early, later = draw(0, 1500, 60), draw(1600, 3000, 60)
    # later than ten minutes behind the latest call: dropped, and no id or time: no call
    late = [(START + dt.timedelta(seconds=5), "p", "vt", True)] * 4
    schema = "ts timestamp, session_id string, api string, violation boolean"
    folder, state = f"{tmp_path}/calls", f"{tmp_path}/state"
    stream = lambda: sessions.session_logs(spark.readStream.schema(schema).parquet(f"{folder}/*"), ttl=300, ring=3)
    end = (START + dt.timedelta(seconds=1500), "z", "vt", False)
    write = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    write([*early, end, (None, "p", "vt", True), (START, None, "vt", True)], 1)
    sessions.run_to_end(stream(), state, 3)
    write([*later, *late], 2)
    rows = sessions.run_to_end(stream(), state, 3)
    got = {(r.session_id, r.first_ts): ((r.total, r.violations, r.apis, r.recent), r.expired) for r in sessions.last_logs(rows).collect()}
    want = _logs([*early, end, *later], 300, 3)
    assert {k: v[0] for k, v in got.items()} == want
    mark = max(c[0] for c in later) - dt.timedelta(minutes=10)
    for (sid, first), (_, expired) in got.items():
        over = first + dt.timedelta(seconds=300)
        assert expired == (over < mark or any(s == sid and f > first for s, f in want)), (sid, first)
    assert {k[0] for k in got} == {"p", "q", "r", "z"}
    # each session ends once
    assert Counter((r.session_id, r.first_ts) for r in rows.where("expired").collect()).most_common(1)[0][1] == 1
