import random

import pytest

from logsieve.operators.windows import add_previous_path, add_window_features


def brute_force(rows):
    """Replay each client's requests in order."""
    out = {}
    for ip in {r["ip"] for r in rows}:
        own = sorted((r for r in rows if r["ip"] == ip and r["event_s"] is not None), key=lambda r: (r["event_s"], r["row_id"]))
        seen = []
        for r in own:
            path = r["path"] or ""
            same = bool(seen) and (seen[-1]["path"] or "") == path
            seen.append({**r, "same": same})
            frame = [s for s in seen if s["event_s"] > r["event_s"] - 60]
            n, errors = len(frame), sum(s["status"] == 404 for s in frame)
            out[r["row_id"]] = (n, errors, max(1, n - sum(s["same"] for s in frame)))
    return {r["row_id"]: out.get(r["row_id"], (0, 0, 0)) for r in rows}


def spark_values(df, **options):
    rows = add_window_features(df, **options).select("row_id", "req_count_60s", "err_count_60s", "unique_url_60s").collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_ties_and_left_open_frame(requests):
    seconds = [0, 0, 30, 60, 60, 61]
    df = requests(*[{"event_s": s} for s in seconds])
    assert [spark_values(df)[i][0] for i in range(6)] == [1, 2, 3, 2, 3, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replay_with_a_hot_client(requests, seed):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(1200), 900):
        hot = rng.random() < 0.4
        rows.append(
            {
                "row_id": i,
                "ip": "10.9.9.9" if hot else f"10.0.0.{rng.randrange(6)}",
                "event_s": None if rng.random() < 0.03 else (rng.randrange(20) if hot else rng.randrange(400)),
                "path": rng.choice(["/a", "/a", "/b", None]),
                "status": rng.choice([200, 404]),
            }
        )
    df = requests(*rows).repartition(4)
    assert spark_values(df) == spark_values(df, bucket=60) == spark_values(df, bucket=97) == brute_force(rows)


def test_previous_path(requests):
    rows = [("/a", 5), ("/a", 5), ("/b", 5), ("/b", 900), ("/c", 901), (None, 902), (None, 903)]
    for bucket in (60, 86_400):
        got = add_previous_path(requests(*[{"path": p, "event_s": s} for p, s in rows]), bucket).orderBy("row_id").collect()
        assert [r.prev_path for r in got] == [None, "/a", "/a", "/b", "/b", "/c", ""]
        assert [r.same_url for r in got] == [0, 1, 0, 1, 0, 0, 1]


def test_plan_never_partitions_rows_by_client_alone(spark, requests):
    plan = add_window_features(requests({}))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_client = [line for line in exchanges if "_second" not in line and "_bucket" not in line]
    assert len(by_client) <= 2  # the ends of buckets, one row per client and day, read for own and context rows
    assert "Python" not in plan
