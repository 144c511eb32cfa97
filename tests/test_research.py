"""The research operators against values worked out by hand or by plain loops, and a whole discovery run."""

import datetime as dt
import hashlib
import itertools
import json
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import columns, ranges, streams
from panelforge.operators import decision, doctor, evidence, forward, mechanisms, overfit, pit, placebos, registries
from panelforge.plans import discovery, dsl
from panelforge.sources import readers, record_log
from panelforge.streaming import filters

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


# decisions


def test_block_dates_round_up_and_refuse(spark):
    calendar = spark.createDataFrame([(day(k),) for k in range(45)] * 2, "date date").repartition(3)
    got = [(r["replica"], (r["date"] - DAY).days) for r in decision.block_dates(calendar, 0.5, 20, 3, replicas=4).collect()]
    picked = {r: {k // 20 for q, k in got if q == r} for r in range(4)}
    assert all(len(blocks) == 2 for blocks in picked.values())  # ceil(0.5 * 3) whole blocks
    assert sorted(got) == sorted((r, k) for r, blocks in picked.items() for k in range(45) if k // 20 in blocks)
    assert len({tuple(sorted(b)) for b in picked.values()}) > 1  # replicas differ
    assert decision.block_dates(calendar.limit(0), 0.5, 20, 3).collect() == []
    for bad in ((0.0, 20, 1), (1.5, 20, 1), (0.5, 0, 1), (0.5, 20, 0)):
        with pytest.raises(ValueError):
            decision.block_dates(calendar, bad[0], bad[1], 1, bad[2])


PAIRS = "date date, better string, worse string, a double, b double, c double, mass double"


def planted_pairs(spark, n=400, dates=80):
    rng = np.random.default_rng(4)
    rows = [(day(k % dates), "x", "y", *map(float, rng.normal([0.3, 0.1, -0.2], 1)), 1 / n) for k in range(n)]
    return spark.createDataFrame(rows, PAIRS).repartition(5), rows


def test_ensemble_without_pairs(spark):
    none = spark.createDataFrame([], PAIRS)
    prior = np.array([0.6, 0.3, 0.1])
    assert [tuple(r) for r in decision.weight_ensemble(none, list("abc"), prior).orderBy("factor").collect()] == [pytest.approx((f, w, 0.0, w, w)) for f, w in zip("abc", prior)]
    assert decision.fit_pairwise(none, list("abc"), prior) == pytest.approx(prior)
    with pytest.raises(ValueError):
        decision.weight_ensemble(none, ["a"], np.array([1.0]), replicas=0)


def test_simplex():
    rng = np.random.default_rng(2)
    for _ in range(50):
        v = rng.normal(size=4)
        w = decision.bounded_simplex(v, 0.05, 0.6)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0.05 - 1e-9).all() and (w <= 0.6 + 1e-9).all()
        for _ in range(20):  # no feasible point is closer
            u = decision.bounded_simplex(rng.normal(size=4), 0.05, 0.6)
            assert np.linalg.norm(w - v) <= np.linalg.norm(u - v) + 1e-9
    with pytest.raises(ValueError):
        decision.bounded_simplex(np.zeros(3), 0.5, 1.0)


def plain_fit(rows, prior, ridge, low=0.0, high=1.0):
    """Projected gradient in plain numpy, a step by the Lipschitz bound."""
    d, w = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    w = w / w.sum()
    x, step = prior, 1 / (0.25 * np.linalg.eigvalsh((d * w[:, None]).T @ d)[-1] + 2 * ridge)
    for _ in range(20_000):
        g = -(w / (1 + np.exp(d @ x))) @ d + 2 * ridge * (x - prior)
        new = decision.bounded_simplex(x - step * g, low, high)
        if np.abs(new - x).max() < 1e-14:
            break
        x = new
    return x, g


@pytest.mark.parametrize("ridge, low, high", [(0.1, 0.0, 1.0), (0.01, 0.1, 0.5), (3.0, 0.0, 1.0)])
def test_pairwise_weights_meet_their_optimality_conditions(spark, ridge, low, high):
    """Inside the bounds the gradient is the same for all weights; it is no smaller at the lower one and no larger at the upper one."""
    frame, rows = planted_pairs(spark)
    prior = np.full(3, 1 / 3)
    w = decision.fit_pairwise(frame, list("abc"), prior, ridge=ridge, low=low, high=high)
    plain, _ = plain_fit(rows, prior, ridge, low, high)
    assert np.allclose(w, plain, atol=1e-7) and abs(w.sum() - 1) < 1e-9
    d = np.array([r[3:6] for r in rows])
    g = -(1 / (1 + np.exp(d @ w)) / len(rows)) @ d + 2 * ridge * (w - prior)
    inside = (w > low + 1e-6) & (w < high - 1e-6)
    level = g[inside].mean() if inside.any() else (g[w <= low + 1e-6].min() + g[w >= high - 1e-6].max()) / 2
    assert np.allclose(g[inside], level, atol=1e-6) and (g[w <= low + 1e-6] >= level - 1e-6).all() and (g[w >= high - 1e-6] <= level + 1e-6).all()


def test_replicas_are_fitted_on_their_own_dates(spark):
    frame, rows = planted_pairs(spark)
    prior = np.array([0.2, 0.5, 0.3])
    got = decision.replica_weights(frame, list("abc"), prior, replicas=3, share=0.5, block=9, seed=2, ridge=0.05)
    chosen = decision.block_dates(frame.select("date"), 0.5, 9, 2, 3).collect()
    for r in range(3):
        dates = {c["date"] for c in chosen if c["replica"] == r}
        assert np.allclose(got[r], plain_fit([x for x in rows if x[0] in dates], prior, 0.05)[0], atol=1e-7)
    table = {r["factor"]: r for r in decision.weight_ensemble(frame, list("abc"), prior, replicas=3, share=0.5, block=9, seed=2, ridge=0.05).collect()}
    for i, f in enumerate("abc"):
        assert np.allclose([table[f][k] for k in ("mean", "std", "low", "high")], [got[:, i].mean(), got[:, i].std(), got[:, i].min(), got[:, i].max()], atol=1e-9)


# series


def test_change_probability_is_the_hazard_at_gaps():
    got = mechanisms.bocpd(np.array([0.1, np.nan, 0.2, 5.0]), hazard=0.02)
    assert np.allclose(got, 0.02)
    with pytest.raises(ValueError):
        mechanisms.bocpd(np.zeros(3), hazard=1.0)


def test_dmd_residuals_are_signed_and_by_series(spark):
    """An exact linear map leaves no residual; a shock to one series is that series' residual, across ranges of steps."""
    turn = np.array([[0.9, -0.4], [0.3, 0.95]])
    x = np.empty((60, 2))
    x[0] = 1, -2
    for k in range(1, 60):
        x[k] = turn @ x[k - 1] / np.linalg.norm(turn @ x[k - 1]) if k % 9 == 0 else turn @ x[k - 1]
    rows = [(s, t, float(x[t, i])) for i, s in enumerate("ab") for t in range(60)]
    series = spark.createDataFrame(rows, "series_id string, t long, value double")
    one = mechanisms.dmd_residual(series, 12, steps=4096).orderBy("t").collect()
    many = mechanisms.dmd_residual(series, 12, steps=7).orderBy("t").collect()
    same = lambda r: tuple(None if v is None or v != v else round(v, 9) for v in r)
    assert list(map(same, one)) == list(map(same, many)) and one[0].__fields__ == ["t", "dmd_residual_a", "dmd_residual_b"]
    for t in range(60):
        want = (None, None)
        if t > 12:
            past = x[t - 13 : t]
            a, *_ = np.linalg.lstsq(np.vstack([past[:-1], 1e-3 * np.eye(2)]), np.vstack([past[1:], np.zeros((2, 2))]), rcond=None)
            want = tuple(x[t] - x[t - 1] @ a)
        for got, w in zip(many[t][1:], want):
            assert (got is None or got != got) if w is None else abs(got - w) < 1e-6


def test_power_law_takes_the_best_tenth(spark):
    rng = np.random.default_rng(1)
    price = np.exp(np.cumsum(rng.normal(0, 0.02, 130)) + 3)
    price[5] = -1.0
    got = mechanisms.lppls(spark.createDataFrame([("p", k, float(v)) for k, v in enumerate(price)], "series_id string, t long, value double")).orderBy("t").collect()
    for t in (58, 64, 65, 90, 129):
        fits = []
        for n, m, o, k in itertools.product((60, 120), (0.3, 0.5, 0.7), (6.0, 9.0, 12.0), (1.05, 1.15, 1.30)):
            y = price[t - n + 1 : t + 1] if t + 1 >= n else np.zeros(0)
            if len(y) == n and (y > 0).all():
                left = n - 1 + k * n - np.arange(n)
                x = np.stack([np.ones(n), left**m, left**m * np.cos(o * np.log(left)), left**m * np.sin(o * np.log(left))], 1)
                fit, *_ = np.linalg.lstsq(x, np.log(y), rcond=None)
                fits.append((float(np.sqrt(np.mean((np.log(y) - x @ fit) ** 2))), k * n))
        best = sorted(fits, key=lambda z: z[0])[: max(3, len(fits) // 10)]
        if not best:
            assert got[t]["residual"] is None and got[t]["tc_dispersion"] is None
        else:
            assert abs(got[t]["residual"] - np.median([b[0] for b in best])) < 1e-9 and abs(got[t]["tc_dispersion"] - np.std([b[1] for b in best])) < 1e-6


def test_stream_filter_equals_the_batch_filter(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal(0, 1 + 2 * (t > 20)))) for s in "ab" for t in range(40)]
    frame = spark.createDataFrame(rows, "series_id string, t long, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = filters.hmm_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("hmm_test").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["series_id"], r["t"]): r["probability"] for r in spark.table("hmm_test").collect()}
    want = {(r["series_id"], r["t"]): r["probability"] for r in mechanisms.hmm_filter(frame, mean=(0.0, 0.0), sd=(1.0, 2.0)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_filter_is_the_same_over_any_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(s, t, float(rng.normal(0, 1 + 2 * (t > 60))) if t % 7 else [None, math.nan, math.inf][t % 3]) for s in ("a", "b", None) for t in (*range(-9, 120), 500, 501)]
    rows += [("far", t, 1e6 if t == 40 else 0.5) for t in range(60)]  # no state explains the value: nothing is known from there on
    rows += [("ties", 3, 2.0), ("ties", 3, -1.0), ("ties", None, 0.1), ("one", 0, 4.0)]
    frame = spark.createDataFrame(rows, "series_id string, t long, value double").repartition(4)
    for stay in ((0.95, 0.9), (1.0, 1.0)):
        want = []
        for name in {r[0] for r in rows}:
            p = (0.5, 0.5)
            for _, t, x in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is None, r[1] or 0, r[2] if r[2] is not None and math.isfinite(r[2]) else 9e9)):
                p = mechanisms.hmm_step(p, x, stay, (0.0, 0.0), (1.0, 2.0))
                want.append((str(name), str(t), round(p[1], 9)))
        for size in (1, 7, mechanisms.HMM_STEPS):
            got = mechanisms.hmm_filter(frame, stay, size=size).collect()
            assert sorted((str(r["series_id"]), str(r["t"]), round(r["probability"], 9)) for r in got) == sorted(want)
    assert mechanisms.hmm_filter(frame.limit(0)).collect() == []


def test_change_stream_equals_the_batch_however_it_is_cut(spark, tmp_path):
    """Rows out of order within the delay, over several cuts into triggers, with a restart from the checkpoint."""
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(s, t, None if rng.random() < 0.05 else float(rng.normal(3 * (t > 25), 0.3)), base + dt.timedelta(minutes=t)) for s in "ab" for t in range(50)]
    kind = "series_id string, t long, value double, at timestamp"
    want = {(r["series_id"], r["t"]): r["probability"] for r in mechanisms.change_probability(spark.createDataFrame(rows, kind)).collect()}
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))  # out of order by less than the delay
    end = [(s, 10_000, None, base + dt.timedelta(days=9)) for s in "ab"]  # moves the watermark past all
    for cuts in ((100,), (30, 61, 100)):
        folder, out = f"{tmp_path}/in{len(cuts)}", f"{tmp_path}/out{len(cuts)}"
        for low, high in zip((0, *cuts), (*cuts, None)):
            part = shuffled[low:high] if high else end
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
            stream = filters.change_stream(spark.readStream.schema(kind).parquet(folder), delay="10 minutes")
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(90)
            assert not query.isActive and query.exception() is None
        found = [(r["series_id"], r["t"], r["probability"]) for r in spark.read.parquet(out).where("t < 10000").collect()]
        got = {k[:2]: k[2] for k in found}
        assert len(found) == len(got) == 100 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# overfitting and evidence


def plain_pbo(wide, blocks, focus=None):
    parts, failures = np.array_split(np.arange(len(wide)), blocks), []
    for chosen in itertools.combinations(range(blocks), blocks // 2):
        ir = [wide.iloc[np.concatenate([parts[i] for i in range(blocks) if (i in chosen) == side])] for side in (True, False)]
        ir = [x.mean() / x.std() for x in ir]
        winner = ir[0].idxmax()
        if focus in (None, winner):
            failures.append(ir[1].rank(pct=True)[winner] <= 0.5)
    return (len(failures), float(np.mean(failures)) if failures else None)


def test_pbo_with_focus_and_too_little(spark):
    rng = np.random.default_rng(8)
    wide = pd.DataFrame(rng.normal(0, 1, (48, 4)), columns=["primary", "b", "c", "d"])
    long = [(day(t), c, float(wide[c][t])) for t in range(48) for c in wide]
    frame = spark.createDataFrame(long, "date date, candidate string, d double")
    for focus in (None, "primary", "b"):
        got = overfit.pbo(frame, 4, focus=focus).first()
        splits, share = plain_pbo(wide, 4, focus)
        assert got["splits"] == splits and (got["pbo"] is None if share is None else abs(got["pbo"] - share) < 1e-12)
    assert overfit.pbo(frame, 10).first().asDict() == {"splits": 0, "pbo": None}  # under five dates a block
    assert overfit.pbo(frame.where("candidate = 'b'"), 4).first().asDict() == {"splits": 0, "pbo": None}


def test_false_discovery_by_hand(spark):
    frame = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.3), ("d", 0.9)], "candidate string, p double")
    got = {r["candidate"]: (r["q_bh"], r["q_by"]) for r in evidence.false_discovery(frame).collect()}
    h = 1 + 1 / 2 + 1 / 3 + 1 / 4
    for k, q in {"a": 0.004, "b": 0.04, "c": 0.4, "d": 0.9}.items():
        assert math.isclose(got[k][0], q) and math.isclose(got[k][1], min(1, q * h))


def plain_mixed(counter, key):
    x = counter % streams.PRIME
    for c in streams.ROUNDS:
        x = pow((x + key + c) % streams.PRIME, 5, streams.PRIME)
    return x


def test_streams_are_one_to_one_and_even():
    got = streams.mixed(np.arange(200_000), 12345)
    assert len(np.unique(got)) == len(got) and got[:50].tolist() == [plain_mixed(k, 12345) for k in range(50)]
    share = np.bincount(got * 64 // streams.PRIME, minlength=64) / len(got) * 64
    assert abs(share - 1).max() < 0.08 and abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.01
    keys = streams.mixed(np.arange(3000), 7)
    firsts = streams.mixed(0, keys)
    assert abs(np.corrcoef(keys, firsts)[0, 1]) < 0.06 and abs((firsts * 10 < streams.PRIME).mean() - 0.1) < 0.03


def plain_path(n, rep, block, seed):
    key, out = plain_mixed(rep, seed), []
    for k in range(n):
        fresh = k == 0 or plain_mixed(2 * k, key) * block < streams.PRIME
        out.append(plain_mixed(2 * k + 1, key) % n if fresh else (out[-1] + 1) % n)
    return out


def test_bootstrap_equals_a_plain_loop_over_the_same_streams(spark, monkeypatch):
    n, design = 37, evidence.BootstrapDesign(repetitions=120, block_length=5, seed=11)
    paths = [plain_path(n, r, 5, 11) for r in range(120)]
    assert evidence.stationary_paths(n, np.arange(120), 5, 11).tolist() == paths
    monkeypatch.setattr(evidence, "REPS_TOGETHER", 50)
    seen = {r["rep"]: dict(zip(r["t"], r["visits"])) for r in evidence.visit_counts(spark, n, design).collect()}
    assert seen == {r: {t: p.count(t) for t in set(p)} for r, p in enumerate(paths)} and all(sum(v.values()) == n for v in seen.values())
    rng = np.random.default_rng(1)
    d = rng.normal(0, 1, (n, 3))
    cases = spark.createDataFrame([(t, f"c{j}", float(d[t, j])) for t in range(n) for j in range(3)], "t long, candidate string, d double")
    monkeypatch.setattr(evidence, "CANDIDATES_TOGETHER", 1)
    means = {(r["rep"], r["candidate"]): r["mean"] for r in evidence.resampled_means(cases, n, design).collect()}
    assert len(means) == 360 and all(abs(m - d[paths[rep], int(c[1])].mean()) < 1e-12 for (rep, c), m in means.items())


def plain_placebos(rows, horizon, cost, repetitions, seed):
    """Rows (t, symbol, group, bucket, one_day, desired): mean costed return of the book and of each placebo, by dictionaries."""
    number = lambda s, t: int(hashlib.md5(f"{seed}|{s}|{day(t)}".encode()).hexdigest()[:7], 16)
    last, names = max(r[0] for r in rows), sorted({r[1] for r in rows})
    out = []
    for rep in range(repetitions + 1):
        f = 1 + (rep * placebos.STEP_A + placebos.STEP_B) % (placebos.PRIME - 1)
        held = {}
        for t in range(last + 1):
            cells = {}
            for r in (r for r in rows if r[0] == t):
                cells.setdefault((r[2], r[3]), []).append(r)
            for cell in cells.values():
                given = sorted(cell, key=lambda r: r[1])

                def key(r):
                    x = number(r[1], t) * f % placebos.PRIME
                    return (x * x + number(r[1], t)) % placebos.PRIME * f % placebos.PRIME, r[1]

                for a, b in zip(given, given if rep == 0 else sorted(cell, key=key)):
                    held[t, b[1]] = a[5]
        forward, before, days = {(r[0], r[1]): r[4] for r in rows}, dict.fromkeys(names, 0.0), []
        for t in range(last + 1):
            gross = moved = 0.0
            for s in names:
                past = [held[u, s] for u in range(max(0, t - horizon + 1), t + 1) if held.get((u, s)) is not None]
                mean = sum(past) / len(past) if past else None
                if mean is not None and forward[t, s] is not None:
                    gross += mean * forward[t, s]
                if mean is not None and before[s] is not None:
                    moved += abs(mean - before[s])
                before[s] = mean
            days.append(gross - moved * cost / 2)
        out.append(sum(days) / len(days))
    return out


def test_placebos_equal_a_plain_loop(spark, monkeypatch):
    """200 repetitions, cells of one name, null groups, missing weights and returns; ranges shorter than the horizon and longer than all."""
    rng = random.Random(5)
    raw = [(day(t), t, f"s{k:02d}", None if rng.random() < 0.05 else rng.gauss(0, 0.02), None if rng.random() < 0.05 else rng.gauss(0, 0.1), [None, "g0", "g1"][k % 3], float(1 + k * 7 % 12)) for t in range(23) for k in range(12)]
    panel = spark.createDataFrame(raw, "date date, session_index long, symbol string, one_day double, desired double, industry string, market_cap double").repartition(4)
    cells = {(r["session_index"], r["symbol"]): r["bucket"] for r in placebos.placebo_groups(panel).collect()}
    want = plain_placebos([(t, s, g, cells[t, s], r, w) for _, t, s, r, w, g, _ in raw], 4, 0.003, 200, 9)
    for span, together in ((3, 64), (7, 1000), (100, 33)):
        monkeypatch.setattr(placebos, "TOGETHER", together)
        days = placebos.placebo_returns(panel, 4, 0.003, 200, 9, span=span)
        assert days.count() == 23
        found = {r["repetition"]: r["statistic"] for r in placebos.statistics(days).collect()}
        assert sorted(found) == list(range(201)) and all(abs(found[k] - want[k]) < 1e-12 for k in found)
    p = placebos.permutation_p(placebos.permutation_test(panel, 4, 0.003, 200, 9)).first()
    assert p["repetitions"] == 200 and p["p_value"] == (1 + sum(x >= want[0] for x in want[1:])) / 201
    assert {r["repetition"] for r in placebos.by_repetition(days, 3).select("repetition").distinct().collect()} == {0, 1, 2, 3}
    assert placebos.placebo_returns(panel.limit(0), 4, 0.003, 5, 9).collect() == []


def test_placebo_shuffles_are_even():
    """Over many repetitions a row's place in its cell is as often one as another, and neighbours' orders are not tied."""
    own = np.array([int(hashlib.md5(str(k).encode()).hexdigest()[:7], 16) for k in range(6)])
    orders = np.argsort(placebos.shuffle_keys(own, np.arange(1, 6001)), axis=1)
    for k in range(6):
        assert abs(np.bincount(orders[:, k], minlength=6) / 1000 - 1).max() < 0.15
    assert abs(len({tuple(o) for o in orders.tolist()}) - 720) < 5


def test_noise_pays_with_hindsight_alone(spark):
    """The market is no factor's own draw; honest picks of noise earn nothing."""
    sizes = {"factors": 120, "sessions": 400, "symbols": 60, "top": 10, "late": 150}
    found = overfit.selection_artifact(spark, **sizes, seed=3).first()
    days = np.array([overfit.noise_excess(k, 400, 60, 3) for k in range(120)])
    late, early = days[:, -150:], days[:, :-150]
    ratio = lambda x: x.mean(1) / x.std(1, ddof=1)
    for name, picks in (("hindsight", np.argsort(-ratio(late))[:10]), ("honest", np.argsort(-ratio(early))[:10])):
        book = late[picks].mean(0)
        assert abs(found[name] - book.mean()) < 1e-12 and abs(found[f"{name}_ir"] - book.mean() / book.std(ddof=1) * math.sqrt(244)) < 1e-9
    error = days.std() / math.sqrt(150 * 10)
    assert abs(found["honest"]) < 4 * error and found["hindsight"] > 3 * error
    for k in (0, 99):  # no factor is the market
        market = np.random.default_rng(np.random.SeedSequence(0, spawn_key=(0,))).standard_normal((50, 40))
        own = np.random.default_rng(np.random.SeedSequence(0, spawn_key=(k + 1,))).standard_normal((50, 40))
        assert abs(np.corrcoef(market.ravel(), own.ravel())[0, 1]) < 0.1


def test_evidence_finds_what_is_planted_and_nothing_in_noise(spark):
    rng = np.random.default_rng(6)
    rows = [(day(t), c, float(rng.normal(0.006 if c == "planted" else 0.0, 0.01))) for t in range(300) for c in ("planted", "noise_a", "noise_b")]
    found = evidence.report(spark.createDataFrame(rows, "date date, candidate string, d double"), evidence.BootstrapDesign(repetitions=300, block_length=5))
    assert {r["candidate"]: bool(r["rejected"]) for r in found["step_down"]} == {"planted": True, "noise_a": False, "noise_b": False}
    assert found["status"] == "research_only" and found["orders"] == [] and found["automatic_trading_changes"] == []
    low = {r["candidate"]: r["low"] for r in found["intervals"]}
    assert low["planted"] > 0 > low["noise_a"]


def test_evidence_reports_what_it_was_given_and_assumes(spark):
    rng = np.random.default_rng(7)
    rows = [(day(t), c, float(rng.normal(0.0, 0.01))) for t in range(60) for c in ("x", "y")] + [(day(70), "x", math.nan), (day(70), "y", 0.0), (day(71), "x", None), (day(71), "y", -0.0)]
    frame = lambda r: spark.createDataFrame(r, "date date, candidate string, d double")
    design = evidence.BootstrapDesign(repetitions=99, block_length=5)
    found = evidence.report(frame(rows), design)
    checked = found["assumptions"]["checked"]
    assert {k: checked[k] for k in ("without_key", "repeated_keys", "missing_values", "dates", "joint_dates")} == {"without_key": 0, "repeated_keys": 0, "missing_values": 2, "dates": 62, "joint_dates": 60}
    assert checked["first_date"] == day(0) and checked["last_date"] == day(59) and checked["blocks_in_sample"] == 12
    assert len({r["doi"] for r in found["literature"]}) == 5 and len(found["manifest"]["design"]) == 64
    json.dumps(found, default=str)
    of = lambda r: evidence.digests(frame(r).repartition(5)).first()
    own = of(rows)
    assert own.asDict() == found["manifest"]["input"] and own["input_rows"] == 124 and own["joint_rows"] == 120
    assert of(rows[::-1]) == own and of([(t, c, None if d is None or math.isnan(d) else d + 0.0) for t, c, d in rows]) == own
    other = of([(t, c, 1.0 if t == day(70) and c == "y" else d) for t, c, d in rows])
    assert other["input_xor"] != own["input_xor"] and other["joint_xor"] == own["joint_xor"]
    for bad in ((day(3), "x", 0.5), (None, "x", 0.5), (day(3), None, 0.5)):
        with pytest.raises(ValueError):
            evidence.report(frame([*rows, bad]), design)
    assert evidence.assumptions(frame(rows[:0])).first().asDict() == {"without_key": 0, "repeated_keys": 0, "missing_values": 0, "dates": 0, "joint_dates": 0, "first_date": None, "last_date": None}


@pytest.mark.parametrize("case", ["real", "tied", "one value", "one class", "none"])
def test_probability_metrics_equal_plain_loops(spark, case):
    rng = np.random.default_rng(9)
    p = {"real": rng.random(500), "tied": rng.integers(1, 9, 500) / 9, "one value": np.full(30, 0.3), "one class": rng.random(40), "none": np.zeros(0)}[case]
    y = (rng.random(len(p)) < p).astype(float) if case != "one class" else np.ones(40)
    got = decision.probability_metrics(spark.createDataFrame([*zip(p.tolist(), y.tolist())], "p double, event double").repartition(4)).first()
    assert got["n"] == len(p)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert got["auc"] is None if not pairs else abs(got["auc"] - np.mean(pairs)) < 1e-12
    if len(p):
        assert abs(got["brier"] - np.mean((p - y) ** 2)) < 1e-12 and abs(got["log_loss"] + np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) < 1e-9
        k = np.minimum((p * 10).astype(int), 9)
        assert abs(got["ece"] - sum(abs(p[k == b].sum() - y[k == b].sum()) for b in set(k)) / len(p)) < 1e-12


def test_logistic_fit_meets_its_conditions(spark):
    """At the optimum the penalised gradient is zero, and slopes have the signs that the data were made with."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 2)) * [1.0, 50.0] + [0.0, 1000.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.02 * (x[:, 1] - 1000))))).astype(float)
    mass = rng.random(400) + 0.5
    frame = spark.createDataFrame([(*map(float, r), float(e), float(m), 7.0) for r, e, m in zip(x, y, mass)], "a double, b double, event double, mass double, flat double")
    for ridge in (0.5, 20.0):
        model = decision.fit_logistic(frame, ["a", "b", "flat"], ridge=ridge)
        z = np.column_stack([np.ones(400), (x - np.average(x, axis=0, weights=mass)) / np.sqrt(np.average((x - np.average(x, axis=0, weights=mass)) ** 2, axis=0, weights=mass)), np.zeros(400)])
        beta = np.array([model.intercept, *model.slopes])
        p = 1 / (1 + np.exp(-z @ beta))
        assert np.abs(z.T @ (mass * (y - p)) - ridge * np.array([0, *beta[1:]])).max() < 1e-5
        assert model.slopes[0] > 0 > model.slopes[1] and abs(model.slopes[2]) < 1e-9
        got = [r["p"] for r in frame.select(model.predict().alias("p")).collect()]
        assert np.allclose(got, p, atol=1e-9)


def test_masses_sum_to_one_in_their_partitions(spark):
    frame = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "id long, mass double").repartition(7)
    out = decision.normalised_mass(frame)
    assert abs(out.agg(F.sum("mass")).first()[0] - 1) < 1e-12 and out.columns == ["id", "mass"] and out.rdd.getNumPartitions() == 7
    assert {r["id"]: r["mass"] for r in out.collect()} == {i: (i % 5) / 200 for i in range(100)}
    assert decision.normalised_mass(frame.limit(0)).collect() == []


# audits of returns and the command line


def test_returns_are_found_cleaned_and_scaled(spark, tmp_path):
    def read(text):
        path = f"{tmp_path}/{abs(hash(text))}.csv"
        with open(path, "w") as f:
            f.write(text)
        return readers.read_returns(spark, path)

    got = read("Day,a,b,none\n2024-01-02,1.0,-2.5,\n2024-01-03,x,0.5,\n")
    assert got.columns == ["date", "a", "b"] and [(str(r["date"]), r["a"], r["b"]) for r in got.orderBy("date").collect()] == [("2024-01-02", 0.01, -0.025), ("2024-01-03", None, 0.005)]
    assert [tuple(r)[1:] for r in read("dt,a\n2024-01-02,1.5\n2024-01-03,inf\n").orderBy("date").collect()] == [(1.5,), (None,)]  # 1.5 is no percentage yet
    with pytest.raises(ValueError, match="date"):
        read("when,a\n2024-01-02,1\n")


@pytest.mark.parametrize("pbo, dsr, p, word", [(0.51, 0.1, 0.9, "overfit"), (0.5, 0.94, 0.9, "luck"), (0.5, 0.95, 0.11, "snooping"), (0.5, 0.95, 0.10, "no objection"), (None, None, None, "no objection"), (None, None, 0.2, "snooping")])
def test_verdicts_go_by_the_first_objection(pbo, dsr, p, word):
    assert word in overfit.audit_verdict(pbo, dsr, p)


def test_digest_is_of_rows_not_of_their_order(spark):
    frame = spark.createDataFrame([(i, f"v{i % 3}") for i in range(50)], "a long, b string")
    own = doctor.digest(frame)
    assert doctor.digest(frame.repartition(5).orderBy(F.desc("a"))) == own == doctor.digest(frame.select("b", "a"))
    assert len({own, doctor.digest(frame.unionAll(frame.limit(1))), doctor.digest(frame.withColumn("b", F.lit("v0"))), doctor.digest(frame.limit(0))}) == 4


def test_command_line(spark, tmp_path, monkeypatch):
    from panelforge import cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    demo = f"{tmp_path}/demo"
    assert cli.main(["demo", "--output-dir", demo, "--days", "300", "--symbols", "5"]) == 0
    assert cli._json(f"{demo}/config.json")["random_seed"] == 7
    run = ["doctor", "--prices", f"{demo}/prices", "--fundamentals", f"{demo}/fundamentals", "--output", f"{tmp_path}/doctor.json"]
    assert (cli.main(run), cli.main([*run, "--strict-warnings"])) == (0, 3) and cli._json(f"{tmp_path}/doctor.json")["status"] == "ready_with_warnings"
    assert cli.main(["doctor", "--prices", f"{demo}/fundamentals"]) == doctor.EXIT["blocked"] != 0
    rng = np.random.default_rng(1)
    with open(f"{tmp_path}/perf.csv", "w") as f:
        f.write("date,good,base\n" + "\n".join(f"{day(t)},{0.01 + rng.normal() / 500},{rng.normal() / 500}" for t in range(60)))
    design = ["--repetitions", "99", "--expected-block-length", "4"]
    assert cli.main(["evidence", "--performance", f"{tmp_path}/perf.csv", "--benchmark", "base", "--output", f"{tmp_path}/evidence.json", *design]) == 0
    found = cli._json(f"{tmp_path}/evidence.json")
    assert found["design"]["block_length"] == 4 and found["step_down"][0]["rejected"] and found["assumptions"]["checked"]["joint_dates"] == 60
    with pytest.raises(SystemExit):
        cli.main(["evidence", "--performance", "x"])


# expressions, statements, discovery


@pytest.mark.parametrize(
    "expr",
    [
        {"field": "secret"}, {"unary": "exec", "arg": {"field": "close"}}, {"binary": "pow", "left": {"field": "close"}, "right": {"field": "close"}}, {"rolling": "mean", "arg": {"field": "close"}, "window": 7}, {"lag": -1, "arg": {"field": "close"}},
        {"lag": True, "arg": {"field": "close"}}, {"lag": 253, "arg": {"field": "close"}}, {"field": "close", "lag": 1}, {"rolling": "mean", "window": 5}, {}, "close", {"corr": True, "left": {"field": "close"}, "window": 5},
    ],
)
def test_expressions_that_are_refused(expr):
    with pytest.raises(ValueError):
        dsl.validate(expr, {"close"})


def test_expressions_by_name():
    a, b = dsl.roll("mean", dsl.f("close"), 5), {"window": 5, "arg": {"field": "close"}, "rolling": "mean"}
    assert dsl.canonical(a) == dsl.canonical(b) and dsl.identifier(a) == dsl.identifier(b) and dsl.fields_used(a) == {"close"}
    dsl.validate(a, {"close"})
    deep = dsl.f("close")
    for _ in range(9):
        deep = dsl.unary("neg", deep)
    with pytest.raises(ValueError):
        dsl.validate(deep, {"close"})


def test_correlations_by_products_of_matrices(spark):
    """Gaps, a constant and an empty signal; then 500 signals in one job of few rows sent."""
    rng = np.random.default_rng(9)
    x = rng.normal(5, 1, (6, 30, 5))
    x[:, :, 1] += x[:, :, 0]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, :, 3], x[:, :, 4] = 2.0, np.nan
    x[2, 1:, 2] = np.nan  # one name in a session
    clean = lambda v: None if np.isnan(v) else float(v)
    rows = [(day(t), f"s{i}", *map(clean, x[t, i])) for t in range(6) for i in range(30)]
    frame = spark.createDataFrame(rows, "date date, symbol string, a double, b double, `c.d` double, e double, f double")
    got = {(r["a"], r["b"]): r["correlation"] for r in overfit.pairwise_correlations(frame, ["b", "a", "c.d", "e", "f"]).collect()}
    names = ["a", "b", "c.d", "e", "f"]
    assert set(got) == set(itertools.combinations(names, 2))
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        days = [pd.Series(x[t, :, i]).corr(pd.Series(x[t, :, j])) for t in range(6)]
        days = [c for c in days if not np.isnan(c)] if "e" not in (a, b) else []
        assert (got[a, b] is None) if not days else abs(got[a, b] - np.mean(days)) < 1e-9
    wide = frame.select("date", *[(F.col("a") * k + F.col("b")).alias(f"n{k}") for k in range(500)])
    many = overfit.pairwise_correlations(wide, [f"n{k}" for k in range(500)])
    assert many.count() == 500 * 499 // 2
    assert overfit.pairwise_correlations(frame, ["a"]).collect() == []
    long = [(day(t), f"c{j}", clean(x[t % 6, t // 6 % 30, j])) for t in range(170) for j in range(4)]
    table = pd.DataFrame(long, columns=["date", "candidate", "d"]).pivot(index="date", columns="candidate", values="d").astype(float).corr(min_periods=2)
    for together in (7, 1000):
        found = overfit.candidate_correlations(spark.createDataFrame(long, "date date, candidate string, d double"), together=together).collect()
        for r in found:
            want = table.loc[r["a"], r["b"]]
            assert (r["correlation"] is None) if "c3" in (r["a"], r["b"]) else abs(r["correlation"] - want) < 1e-9
        assert len(found) == 6


def test_next_sessions_equal_a_plain_search(spark):
    """Gaps longer than a block, dates before, between and after the sessions, none at all."""
    rng = random.Random(3)
    sessions = sorted({day(rng.choice((0, 400, 900)) + rng.randrange(150)) for _ in range(90)})
    asked = sorted({day(rng.randrange(-300, 1400)) for _ in range(200)} | set(sessions[::7]))
    calendar, dates = spark.createDataFrame([(d,) for d in sessions], "date date"), spark.createDataFrame([(d,) for d in asked] * 2, "x date")
    found = pit.next_sessions(dates, calendar, "x")
    assert {r["x"]: r["session"] for r in found.collect()} == {d: next((s for s in sessions if s > d), None) for d in asked}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {r["session"] for r in pit.next_sessions(dates, calendar.limit(0), "x").collect()} == {None} and pit.next_sessions(dates.limit(0), calendar, "x").collect() == []


def test_statements_show_after_notice_and_update(spark):
    sessions = [dt.date(2026, 1, k) for k in (2, 5, 6, 7, 8)]
    grid = spark.createDataFrame([(d, s) for d in sessions for s in ("A", "B")], "date date, symbol string")
    rows = [("A", dt.date(2025, 12, 31), dt.date(2026, 1, 3), dt.date(2026, 1, 6), 12.0), ("B", dt.date(2025, 12, 31), dt.date(2026, 1, 5), None, 3.0)]
    kind = "symbol string, report_date date, notice_date date, update_date date, roe double"
    got = {(r["symbol"], r["date"].day): r["roe"] for r in pit.align(spark.createDataFrame(rows, kind), grid).collect()}
    assert [got["A", k] for k in (2, 5, 6, 7, 8)] == [None, None, None, 12.0, 12.0] and [got["B", k] for k in (2, 5, 6, 7, 8)] == [None, None, 3.0, 3.0, 3.0]
    with pytest.raises(ValueError):
        pit.align(spark.createDataFrame([("A", sessions[0], None, None, 1.0)], kind), grid)


def test_seeds():
    fields = {"returns", "close", "amount", "market_return", "book_to_price", "earnings_yield_proxy", "quality_composite", "growth_composite", "safety_composite", "cash_to_profit"}
    every = discovery.seeds(fields)
    assert len(every) == 18 and len({c.id for c in every}) == 18 and len(discovery.seeds({"returns", "close", "amount", "market_return"})) == 6
    by = {c.origin.split(":")[1]: c for c in every}
    assert by["quality_momentum"].expr["binary"] == "mul" and len(by["quality_momentum"].counters) == 2
    assert by["growth"].counters == ({"lag": 252, "arg": {"field": "growth_composite"}},)
    for c in every:
        dsl.validate(c.expr, fields)
        own = c.certificate()
        assert own["phenomenon"] and own["mechanism"] and own["generation"] == 0 and own["certificate_sha256"] == c.certificate()["certificate_sha256"]
    young = discovery.child(3, every)
    assert young.generation == 1 and young.certificate()["certificate_sha256"] != own["certificate_sha256"] and young.parents


def plain_values(expr, frame):
    """An expression by pandas, symbol by symbol; ``frame`` is in order of symbol and date."""
    (kind,) = [k for k in ("field", "unary", "binary", "rolling", "lag", "corr") if k in expr]
    if kind == "field":
        return frame[expr["field"]].astype(float)
    by = lambda s: s.groupby(frame["symbol"], sort=False)
    if kind == "binary":
        a, b = plain_values(expr["left"], frame), plain_values(expr["right"], frame)
        return a * b if expr["binary"] == "mul" else a / b.where(b != 0)
    if kind == "corr":
        a, b = plain_values(expr["left"], frame), plain_values(expr["right"], frame)
        n = expr["window"]
        return pd.concat([a[i].rolling(n, min_periods=n).corr(b[i]) for i in frame.groupby("symbol", sort=False).groups.values()]).reindex(frame.index)
    x = plain_values(expr["arg"], frame)
    if kind == "unary":
        return -x if expr["unary"] == "neg" else np.sign(x) * np.log1p(x.abs())
    if kind == "lag":
        return by(x).shift(expr["lag"])
    n = expr["window"]
    return by(x).transform(lambda s: getattr(s.rolling(n, min_periods=max(2, n // 2)), expr["rolling"])())


def test_every_seed_is_scored_as_by_plain_loops(spark, sf_dir):
    from panelforge.sources import testbed

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # on fewer rows most windows lack values
    panel = testbed.panel(spark, sf_dir, testbed.aligned_fundamentals(spark, sf_dir)).withColumn("segment", F.when(F.col("session_index") < 250, "train").otherwise("later")).persist()
    found = discovery.seeds(panel.columns)
    assert len(found) == 18
    got = discovery.train_scores(panel, found)
    frame = panel.toPandas().sort_values(["symbol", "date"], ignore_index=True)
    train = frame["segment"] == "train"
    for c in found:
        rows = pd.DataFrame({"date": frame["date"], "s": plain_values(c.expr, frame), "t": frame["target"].astype(float)})[train].dropna(subset=["t"])
        rows["s"] = rows.groupby("date")["s"].rank()
        rows["t"] = rows.groupby("date")["t"].rank()
        ics = [g["s"].corr(g["t"]) for _, g in rows.groupby("date") if g["s"].notna().sum() > 1 and g["s"].std() > 0 and g.dropna()["t"].std() > 0]
        ics = [x for x in ics if math.isfinite(x)]
        assert got[c.id] is None if len(ics) < 60 else abs(got[c.id] - np.mean(ics)) < 1e-6, (c.origin, got[c.id], len(ics), np.mean(ics) if ics else None)
    assert sum(v is not None for v in got.values()) == 18
    panel.unpersist()


def plain_search(scores_of, first, budget, pool, numeric):
    """Candidate after candidate, each scored alone."""
    known = {c.id: c for c in first[:budget]}
    scores, ledger = {i: scores_of(c) for i, c in known.items()}, list(known)
    for attempt in range(budget * 30):
        if len(known) >= budget:
            break
        new = discovery.child(attempt, sorted(known.values(), key=lambda c: (-abs(scores[c.id] or 0.0), c.id))[:pool])
        if new.id in known:
            continue
        ledger.append(new.id)
        try:
            dsl.validate(new.expr, numeric)
        except ValueError:
            continue
        known[new.id], scores[new.id] = new, scores_of(new)
    return list(known), scores, ledger


@pytest.mark.parametrize("steady", [0.0, 0.5, 1.0])
def test_search_is_that_of_one_job_a_child(monkeypatch, steady):
    """Scores by a digest of the expression, at ``steady`` 1 ever lower so that the ranking stays; any number of guesses gives the same."""

    class Panel:
        dtypes = [(n, "double") for n in ("returns", "close", "amount", "market_return", "volume")]

    def score(c):
        return None if int(c.id[-2:], 16) < 20 else (int(c.id[7:13], 16) / 2**24 - 0.5) * (1 - steady) ** c.generation

    jobs = []
    monkeypatch.setattr(discovery, "train_scores", lambda panel, cs: jobs.append(len(cs)) or {c.id: score(c) for c in cs})
    numeric = [n for n, _ in Panel.dtypes]
    want = plain_search(score, discovery.seeds(numeric), 40, 5, numeric)
    for ahead in (1, 7, 16, 100):
        jobs.clear()
        found, scores, ledger = discovery.generate(Panel, 40, 5, ahead=ahead)
        assert ([c.id for c in found], scores, [r["id"] for r in ledger]) == want
        children = len(want[0]) - 6
        assert children > 0 and (len(jobs) == 1 + children if ahead == 1 else len(jobs) <= 1 + children)
        if steady == 1.0:
            assert len(jobs) <= 3 + children // ahead and children > 10, (jobs, children)


def test_discovery_run(spark):
    prices, statements = readers.synthetic_market(spark, 420, 12, 3)
    config = readers.demo_config() | {"candidate_budget": 7, "stage2_budget": 1, "placebo_repetitions": 4, "validation_days": 60, "shadow_days": 40, "minimum_train_days": 150, "walk_forward_folds": 2}
    found = discovery.run(prices, statements, config)
    assert found["status"] == "research_only" and found["orders"] == [] and found["automatic_trading_changes"] == []
    assert len([r for r in found["trial_ledger"] if "rejected" not in r]) == 7 and len(found["candidates"]) == 1
    row = found["candidates"][0]
    assert len(row["guards"]) == 9 and row["survivor"] == all(row["guards"].values()) and row["permutation_p"] in {k / 5 for k in range(1, 6)}
    assert found["project_pbo"] is None and found["hard_stop"] and found["survivors"] == []  # one candidate has no family
    assert row["factor_pbo"] is None or 0 <= row["factor_pbo"] <= 1
    assert len(found["shadow_commitment"]) == 64 and {r["segment"]: r["sessions"] for r in found["split"]}["shadow"] == 40 and found["research_plan"] and all(k in row for k in ("gross", "turnover_mean", "capacity_median"))
    assert row["dsr"] is not None and len(found["candidates"]) + len(found["pruned"]) <= 4
    assert all(set(r) >= {"horizon", "mean_ic", "t"} for r in row["ic_decay"])
    assert found["declared_trials"] == found["previous_research_trials"] + 7 and len({b["id"] for b in found["births"]}) == 7 and found["train_correlations"] == {}
    json.dumps(found, default=str)
    for bad in ({"status": "live"}, {"orders": [1]}, {"automatic_trading_changes": [1]}, {"purge_days": 9}):
        with pytest.raises(ValueError):
            discovery.run(prices, statements, config | bad)
    with pytest.raises(ValueError, match="industry"):
        discovery.run(prices.drop("industry"), statements, config)
    for k in discovery.REQUIRED:
        with pytest.raises(ValueError, match=k):
            discovery.checked_config({c: v for c, v in config.items() if c != k})


def test_limits_of_a_configuration_change_the_guards():
    row = {"train_ic": 0.01, "mean": 0.1, "ir": 1.0, "counter_correlation": 0.5, "counter_mean": 0.0, "permutation_p": 0.04, "factor_pbo": 0.1, "project_pbo": 0.1, "dsr": 0.96, "positive_folds": 2}
    config = readers.demo_config()
    assert all(overfit.guards(row, discovery.limits_of(config)).values())
    for key, value, guard in [
        ("minimum_train_rank_ic", 0.02, "train_ic"), ("maximum_counter_correlation", 0.4, "distinct_from_counter"), ("permutation_alpha", 0.01, "permutation"), ("pbo_maximum", 0.05, "factor_pbo"), ("pbo_maximum", 0.05, "project_pbo"),
        ("dsr_probability_minimum", 0.99, "deflated_sharpe"), ("minimum_positive_walk_forward_folds", 3, "walk_forward"),
    ]:
        assert not overfit.guards(row, discovery.limits_of(config | {key: value}))[guard]
    assert set(discovery.LIMITS) == set(overfit.GUARDS)


def test_earlier_trials_deflate():
    moments = (250, 0.1, 0.0, 0.0, [0.1, 0.02, -0.05])
    probabilities = [overfit.deflated_sharpe(*moments, declared=n) for n in (0, 10, 1000)]
    assert probabilities[0] > probabilities[1] > probabilities[2]
    assert overfit.deflated_sharpe(250, 0.1, 0.0, 0.0, [0.1]) > 0.9  # one trial has no spread to deflate by


def vendor(folder, slow=(), broken=(), empty=(), odd=(), throttled=()):
    """A made-up vendor: some calls hang, some always fail, some fail once for each symbol, some have nothing, some can't be read."""

    def fetch(symbol):
        import os
        import time

        if symbol in slow:
            time.sleep(30)
        if symbol in broken:
            raise OSError("reset")
        if symbol in odd:
            return [(dt.date(2024, 1, 1), symbol, "x", 1, 1, 1, 1, 1)]
        if symbol in throttled and not os.path.exists(f"{folder}/{symbol}"):
            open(f"{folder}/{symbol}", "w").close()
            raise OSError("too many calls")
        return [] if symbol in empty else [(dt.date(2024, 1, k), symbol, 1, 2, 0.5, 1.5, 100, None) for k in (1, 2)]

    return fetch


def test_every_symbol_has_bars_or_a_problem(spark, tmp_path):
    symbols = [f"s{k:02d}" for k in range(40)]
    limits = readers.Limits(budget_s=60, call_s=0.3, retries=1, chunk=7, least_tried=6)
    fetch = vendor(tmp_path, slow=("s01",), broken=("s09",), empty=("s20",), odd=("s30",), throttled=symbols[33:])
    bars, out = readers.fetched(spark, fetch, symbols + symbols[:3], limits, 0.85)
    problems = {r["symbol"]: r["problem"] for r in out.collect()}
    assert {k: v.split(":")[0] for k, v in problems.items()} == {"s01": "timed out", "s09": "failed", "s20": "no bars", "s30": "unreadable"}
    have = [r["symbol"] for r in bars.collect()]
    assert sorted(have) == sorted(2 * [s for s in symbols if s not in problems]) and bars.columns == ["date", "symbol", "open", "high", "low", "close", "volume", "amount"]
    with pytest.raises(ValueError, match="4 of 40"):
        readers.fetched(spark, fetch, symbols, limits, 0.95)
    assert all(f.collect() == [] for f in readers.fetched(spark, fetch, []))


def test_one_deadline_and_a_circuit_for_a_dead_vendor(spark, tmp_path):
    """All calls hang: the circuit opens in each chunk, and the whole fetch ends by the budget, not by a budget a partition."""
    symbols = [f"s{k:03d}" for k in range(200)]
    began = time.time()
    _, out = readers.fetched(spark, vendor(tmp_path, slow=symbols), symbols, readers.Limits(budget_s=6, call_s=0.2, retries=0, chunk=10, least_tried=3), 0.0)
    kinds = {r["problem"]: r["count"] for r in out.groupBy("problem").count().collect()}
    assert sum(kinds.values()) == 200 and set(kinds) <= {"timed out", "circuit open", "out of time"} and kinds["circuit open"] > 0
    assert time.time() - began < 40
    reader = readers._BySymbolReader(None, tuple(symbols), readers.Limits(chunk=10))
    assert len({p.deadline for p in reader.partitions()}) == 1
    late = readers._Chunk(("a", "b"), time.time() - 1)  # a partition that starts after the deadline asks nothing
    assert [r[1::7] for r in reader.read(late)] == [("a", "out of time"), ("b", "out of time")]


# records and checks


SPEC = {"name": "s", "factors": {"a.b/m": dsl.roll("sum", dsl.f("returns"), 20)}, "book_size": 2, "holding_days": 5, "round_trip_cost": 0.003, "combination": "equal_weight_rank_average", "universe": {"trailing_amount_window": 20, "minimum_prior_observations": 3, "note": "x"}}


def test_frozen_specifications(tmp_path):
    path = f"{tmp_path}/spec.json"
    out = forward.freeze_spec(SPEC, path, "2024-01-01")
    assert forward.load_spec(path) == out and out["spec_sha256"] == forward.spec_digest(SPEC | {"status": "research_only_forward_record_not_trading"}) and out["status"] == forward.STATUS
    with pytest.raises(FileExistsError):
        forward.freeze_spec(SPEC, path, "2024-01-02")
    forward.write_json(out | {"book_size": 3}, path)
    with pytest.raises(ValueError):
        forward.load_spec(path)
    forward.validate_spec(out, {"returns"})
    assert forward.universe_of(SPEC) == {"window": 20, "least_observations": 3}
    for bad in ({"status": "live"}, {"orders": ["buy"]}, {"factors": {}}, {"book_size": 0}, {"holding_days": 0}, {"round_trip_cost": -0.1}, {"combination": "sum"}):
        with pytest.raises(ValueError):
            forward.validate_spec(SPEC | bad, {"returns"})
    for k in forward.REQUIRED:
        with pytest.raises(ValueError, match=k):
            forward.validate_spec({c: v for c, v in SPEC.items() if c != k}, {"returns"})


def log_rows(spark, keys):
    rows = [("s", h, "now", d, 9, [("A", 0.9, 10.0), ("B", 0.8, None)], forward.STATUS, []) for d, h in keys]
    return spark.createDataFrame(rows, record_log.LOG).repartition(3)


def test_predictions_are_appended_once(spark, tmp_path):
    folder = f"{tmp_path}/log"
    three = log_rows(spark, [(day(0), "x"), (day(0), "x"), (day(1), "x"), (day(1), "y")])
    assert record_log.append_predictions(three, folder) == 3
    assert record_log.append_predictions(three, folder) == 0
    assert record_log.append_predictions(log_rows(spark, [(day(1), "x"), (day(2), "x")]), folder) == 1
    with open(f"{folder}/bad.json", "w") as f:
        f.write('{not json\n{"spec_name": "no key"}\n[1]\n\n')
    assert sorted((r["data_as_of"], r["spec_sha256"]) for r in record_log.read_log(spark, folder).collect()) == [(day(0), "x"), (day(1), "x"), (day(1), "y"), (day(2), "x")]
    assert record_log.append_predictions(log_rows(spark, [(day(2), "x")]), folder) == 0
    assert record_log.read_log(spark, folder).first()["picks"][0].asDict() == {"symbol": "A", "composite_rank": 0.9, "close": 10.0}


def test_a_slower_writer_of_a_log_writes_nothing(spark, tmp_path):
    """A writer that planned before another one's commit fails whole, and leaves no drafts."""
    folder = f"{tmp_path}/log"
    none = spark.createDataFrame([], record_log.LOG)
    assert record_log.append_predictions(log_rows(spark, [(day(1), "x")]), folder) == 1
    with pytest.raises(Exception, match="by now"):
        record_log.append_predictions(log_rows(spark, [(day(0), "x"), (day(1), "x")]), folder, none)
    assert record_log.log_keys(folder) == {(str(day(1)), "x")} and not os.listdir(f"{folder}/_drafts")
    with pytest.raises(Exception, match="never overwritten"):
        log_rows(spark, [(day(5), "x")]).write.format("record_log").mode("overwrite").save(folder)


def test_drafts_of_lost_attempts_are_not_part_of_a_log(tmp_path, monkeypatch):
    """An attempt that wrote its draft and then was lost; the one that counts has a draft of its own."""

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def attemptNumber(self):
            return self.attempt

    folder = f"{tmp_path}/log"
    writer = record_log._RecordWriter(folder, ["data_as_of", "spec_sha256"])
    messages = []
    for attempt in (0, 1):
        monkeypatch.setattr(record_log.TaskContext, "get", classmethod(lambda cls, a=attempt: Task(a)))
        messages.append(writer.write(iter([(day(0), "x")])))
    assert record_log.log_keys(folder) == set()  # nothing shows before the commit
    writer.commit([messages[1], None])
    assert record_log.log_keys(folder) == {(str(day(0)), "x")} and len([n for n in os.listdir(folder) if n.startswith("part-")]) == 1


def test_a_log_in_the_public_form_is_scored(spark, tmp_path):
    """One file of JSON lines, picks as objects, with a broken line; entries built here have the same form."""
    prices, _ = readers.synthetic_market(spark, 90, 8, 5)
    spec = SPEC | {"spec_sha256": forward.spec_digest(SPEC)}
    state, _ = forward.build_state(prices, spec)
    state = state.persist()
    rows = forward.entries(state, spec, "2024-01-01T00:00:00+00:00").orderBy("data_as_of").collect()
    assert all(len(r["picks"]) == 2 and r["orders"] == [] and r["status"] == forward.STATUS for r in rows)
    with open(f"{tmp_path}/log.jsonl", "w") as f:
        for r in rows:
            f.write(json.dumps(r.asDict(True) | {"data_as_of": str(r["data_as_of"]), "provenance": "computed"}) + "\n")
        f.write('{"spec_sha256": \n')
    log = record_log.read_log(spark, f"{tmp_path}/log.jsonl")
    assert log.count() == len(rows)
    scored = forward.score_log(state, record_log.logged_picks(log, state, spec["spec_sha256"]), 5, 0.003).collect()
    dates = [r["date"] for r in state.select("date").distinct().orderBy("date").collect()]
    opens = {(r["date"], r["symbol"]): r["open"] for r in state.select("date", "symbol", "open").collect()}
    picked = {r["data_as_of"]: [p["symbol"] for p in r["picks"]] for r in rows}
    plain = [r for r in scored if r["legs"] == 2 and r["carried"] == 0]
    assert len(plain) > 30
    for r in plain:
        at = dates.index(r["date"])
        legs = [opens[dates[at + 6], s] / opens[dates[at + 1], s] - 1 for s in picked[r["date"]]]
        assert abs(r["book"] - sum(legs) / 2) < 1e-12
    assert record_log.logged_picks(log, state, "another").count() == 0


def test_picks_are_published_once(spark, tmp_path):
    prices, _ = readers.synthetic_market(spark, 80, 6, 5)
    prices = prices.persist()
    spec = {"factors": {"m": dsl.roll("sum", dsl.f("returns"), 20)}, "name": "p", "book_size": 1, "holding_days": 1, "round_trip_cost": 0.003, "universe": {"trailing_amount_window": 20}}
    spec |= {"spec_sha256": forward.spec_digest(spec)}
    state, funnel = forward.build_state(prices, spec, 6)
    rows = state.where("eligible and composite is not null").select("date", "symbol", "composite").toPandas()
    last = rows[rows["date"] == rows["date"].max()].sort_values(["composite", "symbol"], ascending=[False, True])
    assert funnel["eligible"] == len(last)

    folder = f"{tmp_path}/record"
    code, entry = forward.publish_pick(state, spec, folder, "now", "here", dry_run=True)
    assert code == 0 and not forward.read_record(f"{folder}/picks.jsonl")
    assert entry["symbol"] == last.iloc[0]["symbol"] and entry["as_of"] == str(last.iloc[0]["date"]) and entry["eligible_names"] == len(last)
    assert forward.publish_pick(state, spec, folder, "now", "here") == (0, entry)
    assert forward.publish_pick(state, spec, folder, "later", "here")[0] == 0  # reproduced, not written again
    assert forward.read_record(f"{folder}/picks.jsonl") == [entry]
    with open(f"{folder}/picks.jsonl", "w") as f:
        f.write("{broken\n" + json.dumps(entry | {"symbol": "another"}) + "\n")
    assert forward.publish_pick(state, spec, folder, "now", "here")[0] == 2
    assert [r["symbol"] for r in forward.read_record(f"{folder}/picks.jsonl")] == ["another"]
    assert forward.publish_pick(state.withColumn("composite", F.lit(None).cast("double")), spec, folder, "now", "here") == (1, None)
    with pytest.raises(ValueError):
        forward.build_state(prices, spec, 7)  # 6 of 7 is under 95 %
    with pytest.raises(ValueError):
        forward.build_state(prices.where("false"), spec)


def test_doctor_blocks_and_warns(spark):
    prices, statements = readers.synthetic_market(spark, 310, 4, 5)
    good = doctor.audit(prices, statements)
    assert good["status"] == "ready_with_warnings" and not good["blocked"]
    assert doctor.audit(prices.drop("close"))["status"] == "blocked"
    assert doctor.audit(prices.unionByName(prices.limit(1)))["status"] == "blocked"
    assert doctor.audit(prices.withColumn("low", F.col("high") * 2))["status"] == "blocked"
    assert doctor.digest(prices) == doctor.digest(prices.repartition(3)) != doctor.digest(prices.where("symbol <> 'S0001'"))


# registries


def a_card(**changes):
    card = {
        "schemaVersion": "v1", "submissionId": "one", "title": "Four", "contributor": "x", "kind": "mechanism", "paper": {"title": "P", "url": "https://p.example", "year": 2001},
        "hypothesis": "h" * 20, "causalBoundary": "c" * 20, "counterfactual": "f" * 10, "implementation": "m:run", "testSelector": "t.py::test_a", "prefixCausalityTested": True, "adversarialTested": True,
    }
    return {k: v for k, v in (card | changes).items() if v != "absent"}


def test_cards_are_scored_or_refused_with_reasons(spark, tmp_path):
    field = {"field": "close"}
    factor = {"kind": "factor", "implementation": "absent", "expression": {"rolling": "mean", "arg": field, "window": 20}, "counterExpression": field, "allowedFields": ["close"], "allowedWindows": [20]}
    want = {
        "one": (a_card(reproductionExample="e.py"), 100, "research-grade", []),
        "two": (a_card(), 95, "research-grade", []),
        "three": (a_card(adversarialTested=False), 85, "causal-tested", []),
        "four": (a_card(testSelector=None), 70, "reproducible-implementation", []),
        "five": (a_card(**factor), 95, "research-grade", []),
        "six": (a_card(**factor | {"expression": {"field": "open"}, "allowedWindows": []}), None, None, ["factor cards need allowedFields and allowedWindows", "expression: field 'open' is not allowed"]),
        "seven": (a_card(title=7, odd=1, hypothesis="absent"), None, None, ["missing fields: hypothesis", "unknown fields: odd", "title needs 4 characters", "hypothesis needs 20 characters"]),
        "eight": (a_card(paper={"title": " ", "url": "http://p", "year": "2001"}), None, None, ["paper.title needs 1 characters", "paper.url must use https", "paper.year is invalid"]),
        "nine": (a_card(implementation="m:gone", expression=field, futureDataRole=None), None, None, ["implementation is not callable", "mechanism cards have no expressions", "invalid futureDataRole"]),
        "ten": (a_card(testSelector="t.py", reproductionExample="none.py", prefixCausalityTested="yes"), None, None, ["testSelector must be path::test_name", "reproductionExample does not exist", "prefixCausalityTested must be boolean"]),
        "eleven": (a_card(testSelector="t.py::test_b", schemaVersion="v0"), None, None, ["unsupported schemaVersion", "test does not exist"]),
        "twelve": (a_card(submissionId="other", kind="idea", paper=[1]), None, None, ["name and submissionId must match", "kind must be mechanism or factor", "paper must be an object", "paper.title needs 1 characters", "paper.url must use https", "paper.year is invalid"]),
    }
    for name, (card, *_) in want.items():
        if card["submissionId"] == "one":
            card["submissionId"] = name
        (tmp_path / f"{name}.json").write_text(json.dumps(card))
    for name, text in (("broken", "{"), ("list", "[1]"), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
        want[name] = (None, None, None, ["no JSON object"])
    surfaces = spark.createDataFrame([("m:run",), ("t.py::test_a",), ("e.py",), ("e.py",), (None,)], "surface string")
    read = registries.read_cards(spark, str(tmp_path)).withColumn("score", F.lit("clash"))
    got = registries.cards(read, surfaces, "v1").collect()
    assert {r["name"]: (r["score"], r["tier"], r["reasons"]) for r in got} == {k: (s, t, why) for k, (_, s, t, why) in want.items()}
    again = registries.cards(read.where("name = 'two'").unionByName(read.where("name in ('two', 'three')")), surfaces, "v1").collect()
    assert sorted((r["name"], r["reasons"]) for r in again) == [("three", []), ("two", ["id repeats"]), ("two", ["id repeats"])]
    assert [r["reasons"] for r in registries.cards(spark.createDataFrame([(None, None)], "name string, document string"), surfaces, "v1").collect()] == [["no JSON object"]]
    assert registries.cards(read.limit(0), surfaces, "v1").count() == 0


def test_literature_is_counted_or_refused_with_reasons(spark, tmp_path):
    def entry(k, **changes):
        texts = {c: "x" * 10 for c in ("systemMapping", "implementationBoundary", "requiredData", "nextFalsifiableStep")}
        return {"paperId": f"p{k}", "title": "A long title", "year": 2020, "url": "https://a.example", "domain": "abc", "status": "deferred", "repositorySurfaces": [], **texts} | changes

    entries = [
        entry(0), entry(1, status="implemented", repositorySurfaces=["m:run", "m:run"]), entry(2, status="implemented"), entry(3, repositorySurfaces=["a.md", "m:run", "b.md"]), entry(4, year=2101, domain=" ab "),
        entry(5, repositorySurfaces=[1]), entry("X"), entry(6, status=None, url=None), entry(7), entry(7), entry(8, extra=1),
    ]
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"schemaVersion": "v1", "purpose": "what the literature says", "entries": entries}))
    surfaces = spark.createDataFrame([("m:run",)], "surface string")
    out = registries.literature(registries.read_literature(spark, str(path), "v1"), surfaces)
    assert Counter((r["paper_id"], tuple(r["reasons"])) for r in out.collect()) == Counter(
        [
            ("p0", ()), ("p1", ()), ("p2", ("a mapping needs a surface",)), ("p3", ("unknown surfaces: a.md, b.md",)), ("p4", ("domain needs 3 characters", "year is invalid")), ("p5", ("repositorySurfaces must be texts",)),
            ("pX", ("invalid paperId",)), ("p6", ("url must use https", "status is invalid")), ("p7", ("id repeats",)), ("p7", ("id repeats",)), ("p8", ("unknown fields: extra",)),
        ]
    )
    counts = {r["status"]: r["entries"] for r in registries.literature_counts(out).collect()}
    assert counts == dict.fromkeys(registries.STATUSES, 0) | {"implemented": 1, "deferred": 1, "refused": 9}
    with pytest.raises(ValueError, match="version"):
        registries.read_literature(spark, str(path), "v0")
    assert registries.literature(out.limit(0).select(F.lit("").alias("document")), surfaces).count() == 0


# ranges


@pytest.mark.parametrize("size", [1, 7, 64, 8192])
def test_rolling_medians_over_ranges_equal_those_over_frames(spark, size):
    """Series that end at, before and after a range's end, with gaps, a null name, columns that other types would spoil."""
    rng = random.Random(21)
    rows = [(name, t, None if rng.random() < 0.3 else rng.choice([rng.random(), 0.5]), 2**60 + t if t % 3 else None, bool(t % 2) if t % 5 else None, day(t)) for name, n in (("a", 64), ("b", 100), ("c", 1), (None, 30)) for t in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, date long, value double, big long, flag boolean, day date")
    for window, least in ((1, 1), (5, 2), (40, 20)):
        got = ranges.rolling_median(frame, "value", window, least, "median", size=size, frames_to=0)
        want = frame.withColumn("median", columns.rolling("median", "value", window, least))
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert ranges.rolling_median(frame.limit(0), "value", 5, 2, "median", frames_to=0).count() == 0
    long = dsl.evaluate(frame.withColumnRenamed("date", "t").withColumnRenamed("day", "date"), {"m": dsl.roll("median", dsl.f("value"), 120)})
    want = frame.withColumn("m", columns.rolling("median", "value", 120))
    assert Counter((r["symbol"], r["date"], r["m"]) for r in want.collect()) == Counter((r["symbol"], r["t"], r["m"]) for r in long.collect())


def test_power_law_is_the_same_over_any_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(name, k, float(np.exp(v))) for name, n in (("p", 300), ("q", 59), ("r", 121)) for k, v in enumerate(np.cumsum(rng.normal(0, 0.02, n)))]
    rows += [("gap", k, None if k == 100 else 2.0 + k % 7) for k in range(240)]
    frame = spark.createDataFrame(rows, "series_id string, t long, value double")
    one, many = ({(r["series_id"], r["t"]): (r["residual"], r["tc_dispersion"]) for r in mechanisms.lppls(frame, size).collect()} for size in (8192, 50))
    assert one.keys() == many.keys() and len(one) == len(rows)
    for k, (a, b) in one.items():
        assert (many[k] == (a, b)) if a is None else (abs(many[k][0] - a) < 1e-12 and many[k][1] == b)
    assert one["q", 58] == (None, None) and one["r", 59][0] is not None and one["gap", 159] == (None, None) and one["gap", 160][0] is not None
