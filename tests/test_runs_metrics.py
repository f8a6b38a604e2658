import itertools
import random

import pytest
from pyspark.sql import functions as F

from saccade.functions.numeric import round_half_even
from saccade.operators import metrics as M
from saccade.operators.ordered import frame_chunk, ranked, running_sum, with_next
from saccade.operators.runs import collapse_runs, expand_runs, fixation_events, label_runs


def codes(spark, sequences):
    rows = [(who, i, c) for who, labels in sequences.items() for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "participant_id string, frame int, code string")


def plain_runs(labels):
    out, at = [], 0
    for label, group in itertools.groupby(labels):
        n = len(list(group))
        out.append((label, at, at + n - 1))
        at += n
    return out


def test_runs_across_chunks_equal_plain_collapse(spark):
    rng = random.Random(5)
    data = {w: [rng.choice("aab") for _ in range(n)] for w, n in {"one": 1, "two": 57, "hot": 400}.items()}
    data["same"] = ["a"] * 90
    for chunk in (1, 7, 16384):
        got = label_runs(codes(spark, data), chunk).collect()
        for who, labels in data.items():
            mine = sorted(((r.code, r.start_frame, r.end_frame) for r in got if r.participant_id == who), key=lambda r: r[1])
            assert mine == plain_runs(labels)
            assert [r.is_last for r in got if r.participant_id == who].count(True) == 1
            assert all(r.is_last == (r.end_frame == len(labels) - 1) for r in got if r.participant_id == who)


def test_expand_is_the_inverse(spark):
    data = {"p": list("aabbbcaab")}
    frames = codes(spark, data)
    assert sorted(expand_runs(label_runs(frames, 4)).collect()) == sorted(frames.collect())


def test_end_modes_and_none(spark):
    frames = codes(spark, {"p": ["None", "a", "a", "none", "None"]})
    inclusive = collapse_runs(frames, 10.0).orderBy("start_frame").collect()
    assert [(r.aoi_name, r.start_frame, r.end_frame, r.duration_ms) for r in inclusive] == [("a", 1, 2, 200.0), ("none", 3, 3, 100.0)]
    assert collapse_runs(frames, 10.0, include_none=True).count() == 4
    shifted = collapse_runs(frames, 10.0, "reference").collect()
    assert sorted((r.name, r.start_frame, r.end_frame) for r in shifted) == [("None", 0, 1), ("None", 3, 4), ("a", 1, 3), ("none", 3, 4)]
    with pytest.raises(ValueError):
        collapse_runs(frames, 0)
    assert collapse_runs(frames.limit(0), 10.0).count() == 0


def test_rounding_matches_python(spark):
    values = [n / fps for fps in (24, 25, 29.96, 30, 200) for n in range(0, 700, 3)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_half_even(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == [round(r.v, 2) for r in got]


def events(spark, rows, fps=10.0):
    frame = spark.createDataFrame(rows, "participant_id string, aoi_name string, start_frame int, end_frame int")
    return fixation_events(frame.withColumn("duration_frames", F.col("end_frame") - F.col("start_frame") + 1), fps)


ROWS = [("p", "a", 0, 2), ("p", "b", 3, 3), ("p", "a", 4, 8), ("p", "a", 9, 9), ("q", "c", 2, 11)]


def test_summary_scores(spark):
    rows = {(r.participant_id, r.aoi_name): r for r in M.summary_scores(events(spark, ROWS), 10.0, 3).collect()}
    a = rows["p", "a"]
    assert a.dwell_time == 900.0 and a.fixation_count == 3
    assert a.fixation_duration_min == 100.0 and a.fixation_duration_max == 500.0
    assert a.mean_fixation_duration_per_aoi == 300.0 and a.latency_to_first_fixation == 0.0
    assert a.proportion_of_dwell_time == 0.9
    assert (a.transition_probability_to_a, a.transition_probability_to_b, a.transition_probability_to_c) == (0.5, 0.5, 0.0)
    assert [a[f"temporal_dynamics_phase{i}"] for i in (1, 2, 3)] == [0.3, 0.4, 0.2]
    c = rows["q", "c"]
    assert c.transition_probability_to_a == 0.0 and c.latency_to_first_fixation == 200.0
    assert rows["p", "b"].transition_probability_to_a == 1.0


def frame_by_frame(rows, phases, low, high):
    total = high - low + 1
    shares = {}
    for who, label, start, end in rows:
        for frame in range(start, end + 1):
            phase = min(int((frame - low) / (total / phases)) + 1, phases)
            shares[who, label, phase] = shares.get((who, label, phase), 0) + 1
    return shares


@pytest.mark.parametrize("phases", [1, 3, 7])
def test_phases_match_frame_by_frame(spark, phases):
    rng = random.Random(phases)
    rows, at = [], 3
    for _ in range(40):
        n = rng.randint(1, 9)
        rows.append(("p", rng.choice("abc"), at, at + n - 1))
        at += n
    total = at - 3
    want = frame_by_frame(rows, phases, 3, at - 1)
    got = M.temporal_dynamics(events(spark, rows), phases).collect()
    assert len(got) == 3 * phases
    for r in got:
        assert r.proportion == want.get(("p", r.aoi_name, r.phase), 0) / total
    assert sum(r.proportion for r in got) == pytest.approx(1.0)


def test_fewer_than_one_phase_mean_three(spark):
    found, three = (sorted(M.temporal_dynamics(events(spark, ROWS), n).collect()) for n in (0, 3))
    assert found == three and {r.phase for r in found} == {1, 2, 3}


def test_latency_grid_and_bounds(spark):
    e = events(spark, ROWS)
    grid = {(r.participant_id, r.aoi_name): r.latency_to_first_fixation for r in M.latency_grid(e, 10.0).collect()}
    assert grid["q", "a"] == -1.0 and grid["q", "c"] == 200.0
    onset = {(r.participant_id, r.aoi_name): r.latency_to_first_fixation for r in M.latency_grid(e, 10.0, True).collect()}
    assert onset["q", "c"] == 0.0
    own = M.temporal_dynamics(e, 2, bounds="participant").filter("participant_id = 'q'").orderBy("phase").collect()
    assert [r.proportion for r in own] == [0.5, 0.5]


def test_transitions_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice("abc"), 3 * i, 3 * i + 2) for i in range(200)]
    want = sorted(M.transition_counts(events(spark, rows)).collect())
    assert sorted(M.transition_counts(events(spark, rows), chunk_frames=10).collect()) == want
    assert sum(r.n for r in want) == 199


def test_probabilities_sum_to_one_or_zero(spark):
    sums = M.transition_matrix(events(spark, ROWS)).groupBy("participant_id", "source_aoi").agg(F.sum("probability").alias("s")).collect()
    assert {round(r.s, 12) for r in sums} == {0.0, 1.0}


def test_ordered_operators(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i * 7) for i in range(9)], "k string, o int")
    got = ranked(df, ["k"], ["o"], frame_chunk(F.col("o"), 4), "r").collect()
    assert all(r.r == (r.o + 1 if r.k == "a" else r.o // 7 + 1) for r in got)
    nxt = {(r.k, r.o): r.n for r in with_next(df, ["k"], ["o"], frame_chunk(F.col("o"), 4), "o", "n").collect()}
    assert nxt["a", 3] == 4 and nxt["a", 49] is None and nxt["b", 7] == 14
    total = {(r.k, r.o): r.s for r in running_sum(df, ["k"], ["o"], frame_chunk(F.col("o"), 4), "o", "s").collect()}
    assert total["a", 10] == 55 and total["b", 14] == 21


def test_scores_of_measured_times(spark):
    rows = [("a", "x", 10.5, 2, 3.0, 0, 1), ("a", "y", 1.0, 4, 9.0, 2, 5), ("a", "x", 2.25, 3, 1.5, 6, 8), ("b", "x", 0.0, 1, 7.0, 3, 3),
            ("c", "x", None, 2, None, 0, 1)]
    table = spark.createDataFrame(rows, "participant_id string, aoi_name string, duration_ms double, duration_frames int, "
                                        "timestamp_ms double, start_frame int, end_frame int")
    got = {(r.participant_id, r.aoi_name): r for r in M.event_scores(table).collect()}
    assert len(got) == 4
    for who, label in got:
        mine = [(r[2] or 0.0, *r[3:]) for r in rows if r[:2] == (who, label)]
        total = sum(r[2] or 0.0 for r in rows if r[0] == who)
        phases = [0.0] * 3
        for ms, frames, _, first, last in mine:
            for frame in range(first, last + 1):
                phases[frame // 3] += ms / frames
        r = got[who, label]
        times = [m[0] for m in mine]
        assert (r.dwell_time, r.fixation_count, r.fixation_duration_min, r.fixation_duration_max) == (sum(times), len(times), min(times), max(times))
        assert r.mean_fixation_duration_per_aoi == sum(times) / len(times)
        assert r.latency_to_first_fixation == min([m[2] for m in mine if m[2] is not None], default=-1.0)
        assert r.proportion_of_dwell_time == pytest.approx(sum(times) / total if total else 0.0)
        found = [r.temporal_dynamics_phase1, r.temporal_dynamics_phase2, r.temporal_dynamics_phase3]
        assert found == pytest.approx([p / total if total else 0.0 for p in phases], abs=1e-6)
    assert M.event_scores(table.limit(0)).count() == 0


def test_frames_by_a_rate_give_the_same_scores(spark):
    events = collapse_runs(codes(spark, {"a": "xxyyyxz", "b": "zzzzx"}), 30.0)
    for bounds in ("global", "participant"):
        plain = {r[:2]: r[2:] for r in M.summary_scores(events, 30.0, wide=False, bounds=bounds).collect()}
        own = {r[:2]: r[2:] for r in M.event_scores(events, bounds=bounds).collect()}
        assert plain.keys() == own.keys()
        assert all(own[k] == pytest.approx(plain[k], abs=1e-5) for k in plain)
