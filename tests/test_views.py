"""Lattice views hold all rows of their table."""

import datetime

from gridloom.plans import queries


def test_event_demean_covers_every_event(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(u * 100 + i, day + datetime.timedelta(hours=i), u, float(u + i * i)) for u, n in ((3, 70), (5, 4)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["x"], r["t"]): r["v"] for r in queries.QUERIES["event_demean"](spark, str(tmp_path)).collect()}
    want = {}
    for x, u in enumerate((3, 5)):
        values = [r[3] for r in rows if r[2] == u]
        want |= {(x, t): v - sum(values) / len(values) for t, v in enumerate(values)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
