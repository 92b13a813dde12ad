"""State machines over blocks against one fold, and the air states over dense series against a plain fold."""

import random
from collections import Counter

import pytest

from issuetime import registry
from issuetime.operators.machine import run_machine
from issuetime.plans import states as sv

TABLE = [[0, 1, 2], [1, 2, 0], [2, 2, 1]]


@pytest.mark.parametrize("block", [1, 7, 50, 10**6])
def test_blocks_equal_one_fold(spark, block):
    """A hot key, a key of one row, blocks without rows, negative clocks; rows without clock, key or symbol take no part."""
    rng, rows, want = random.Random(block), [], {}
    for k, n in (("hot", 600), ("b", 30), ("one", 1)):
        state = 1
        for t in sorted(rng.sample(range(-900, 1500), n)):
            s = rng.randint(0, 2)
            rows.append((k, t, s))
            state = want[k, t] = TABLE[state][s]
    odd = [("b", None, 1), (None, 3, 1), ("b", 99_999, None)]
    got = run_machine(spark.createDataFrame(rows + odd, "series string, label bigint, symbol int").repartition(3), TABLE, 1, block).collect()
    assert {(r["series"], r["label"]): r["state"] for r in got} == want and len(got) == len(want)
    assert run_machine(spark.createDataFrame([], "series string, label bigint, symbol int"), TABLE, 1, block).count() == 0


def test_all_ten_states_occur_and_equal_a_plain_fold(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.where("event_type in ('click', 'view')").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["series"], r["label"]): r["state"] for r in registry.queries()["e12_air_states"](spark, str(tmp_path)).collect()}
    levels = {}
    for r in sv.bk.closed_series(sv.readings(spark, str(tmp_path))).collect():
        levels.setdefault(r["series"], {})[r["label"]] = r["med"]
    want = {}
    for s, own in levels.items():
        second, state, slow = levels["view" if s == "click" else "click"], 0, None
        for t in sorted(own):
            v = own[t]
            back = [own.get(t - k * sv.B) for k in range(13)]
            d = [None if b is None else v - b for b in back]
            low = min(b for b in back[:12] if b is not None)
            falls = sum(own.get(t - k * sv.B) is not None and own.get(t - (k + 1) * sv.B) is not None and own[t - k * sv.B] < own[t - (k + 1) * sv.B] for k in range(3))
            symbol = sv.GAP if d[1] is None else sv.TRIGGER if d[3] is not None and d[3] <= -15 and falls >= 2 and v <= low + 5 else sv.ABOVE if v > max(low + 10, 1.2 * low) else sv.LOW if v <= low + 5 else sv.PLAIN
            state, slow = sv.MOVES[state][symbol], v if d[1] is None else slow * 0.6 + v * 0.4
            mix = second[t] / (v + second[t]) if t in second else None
            want[s, t] = (
                "collecting" if d[1] is None or d[2] is None else "fast_rise" if d[1] >= 20 else "rebound" if state == sv.REBOUND else "confirmed" if state == sv.CONFIRMED and (mix is None or mix <= 0.8)
                else "forming" if state in (sv.FORMING, sv.HELD_ONCE) else "rapid_improvement" if d[1] <= -20 else "rising" if d[2] >= 10 or v - slow >= 8 else "improving" if d[2] <= -10 or v - slow <= -8 else "stable_high" if v > 55 else "steady"
            )
    assert got == want and len(Counter(got.values())) >= 8, Counter(got.values())
