import random

from logsieve.operators.bans import ban_windows, mark_banned, rate_limited
from logsieve.operators.coverage import layered_verdict


def brute_bans(rows, errors, period, ban):
    out = {}
    for ip in {r["ip"] for r in rows}:
        times = sorted(r["event_s"] for r in rows if r["ip"] == ip and 400 <= r["status"] < 500)
        for t in sorted(set(times)):
            if sum(t - period < s <= t for s in times) >= errors:
                own = out.setdefault(ip, [])
                if own and t - (own[-1][1] - ban) < ban:
                    own[-1][1] = t + ban
                else:
                    own.append([t, t + ban])
    return {(ip, s, e) for ip, own in out.items() for s, e in own}


def test_bans_and_interval_join(requests):
    rng = random.Random(3)
    rows = [
        {"ip": rng.choice(["h", "h", "a", "b"]), "event_s": rng.randrange(2000), "status": rng.choice([200, 404, 403, 500])}
        for _ in range(600)
    ]
    for errors, period, ban in ((4, 60, 120), (1, 10, 30), (10, 300, 5000)):
        df = requests(*rows)
        found = ban_windows(df, errors, period, ban)
        expected = brute_bans(rows, errors, period, ban)
        for bans in (found, ban_windows(df, errors, period, ban, bucket=70)):
            assert {(r.ip, r.ban_start, r.ban_end) for r in bans.collect()} == expected
        marked = mark_banned(df, found, slice_seconds=100).collect()
        assert len(marked) == len(rows)
        for r in marked:
            assert r.banned == any(ip == r.ip and s <= r.event_s < e for ip, s, e in expected)


def test_rate_limit(requests):
    df = requests(*[{"event_s": s} for s in (0, 10, 59, 60, 61)], {"event_s": None})
    assert [(r.window_start, r.requests) for r in rate_limited(df, limit=2).collect()] == [(0, 3)]


def test_layers_act_in_order(spark, requests):
    from pyspark.sql import functions as F

    df = requests({"path": "/.env"}, {"path": "/a"}, {"path": "/b"}, {"path": "/c"}, {"path": "/d"})
    states = spark.createDataFrame(
        [(0, 999, 1, 0.9), (1, 201, 1, 0.9), (2, 200, 1, 0.9), (3, 1, 0, 0.4), (4, 1, 0, 0.3)],
        "row_id long, req_count_60s int, banned int, score double",
    )
    got = layered_verdict(df.join(states, "row_id")).orderBy(F.col("row_id")).collect()
    assert [r.verdict for r in got] == ["rule_block", "rate_limit", "banned", "observed", "pass"]
