"""Trials that share a time, against a plain sum over the window."""

from trialspark.operators import monitor


def test_trials_of_one_time_see_each_other(spark):
    times = [0, 0, 0, 30, 60, 60, 61, 200, 200]
    rows = [(i, "m", s * 10**6, 0.5 * (i + 1)) for i, s in enumerate(times)] + [(100, "other", 0, 9.0), (101, "m", 60 * 10**6, None)]
    df = spark.createDataFrame(rows, "trial_id long, model string, ts_us long, cost double")
    got = {r.trial_id: (r.events, round(r.burn_per_minute, 6)) for r in monitor.burn_rate(df, 0.1).collect()}
    want = {}
    for i, m, t, _ in rows:
        window = [c or 0.0 for _, n, u, c in rows if n == m and t - 60 * 10**6 <= u <= t]
        if len(window) > 1 and sum(window) > 0.1:
            want[i] = (len(window), round(sum(window), 6))
    assert got == want and got[0] == got[2] == (3, 3.0)
