import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from issuetime.llm import conversations as cv
from issuetime.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, id int"
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain(turns, start=0, ends=(0, 3), tail=True):
    """Least cost and its ASCII-least audit by trying every edit at every turn. turns: (initial, forced, truncated)."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "")] if i == len(turns) and state in ends else []
        if inserts < 3 and (i < len(turns) or tail):
            for role in "ua":
                if (state, role) in AFTER:
                    c, a = best(i, AFTER[state, role], inserts + 1)
                    out.append((c + 3, "I" + a))
        if i < len(turns):
            role, forced, cut = turns[i]
            c, a = best(i + 1, state, 0)
            out.append((c + 4, "D" + a))
            if not forced:
                for given in {role, "u", "a"}:
                    if (state, given) in AFTER:
                        c, a = best(i + 1, AFTER[state, given], 0)
                        out.append((c + 3 * cut + 3 * (given != role), "RK"[given == role] + a))
        return min(out, default=(10**9, ""))

    for i in range(len(turns), 0, -1):  # from the end on, so that no call goes deep
        for state in range(4):
            best(i, state, 0)
    return best(0, start, 0)


def plain_row(rows):
    """The contract's row of one conversation, from its original rows."""
    kept = []
    for c, t, r, x in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        if what:
            x, r = "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x, "user" if what == 4 else r
            kept += [(t, r, x)] * (2 if what == 3 else 1)
    return plain_repair(kept)


def plain_repair(kept):
    kept = sorted(kept, key=lambda k: (k[0] is not None, k[0] or 0, k[1], hashlib.sha256(f"{len(k[1])}:{k[1]}{k[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, r, x in kept:
        body = x.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((r, x))
    cost, audit = plain(tuple((r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(kept, faults)))
    out, state, i = [], 0, 0
    for e in audit:
        if e != "D":
            role, text = (kept[i][1], kept[i][2]) if e == "K" else ("assistant" if state == 2 else "user", "" if e == "I" else kept[i][2])
            state = AFTER[state, role[:1]]
            out.append(f"{role}:{text}")
        i += e != "I"
    turns = {t for t, _, _ in kept if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def collected(df):
    out = {}
    for r in df.collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = tuple(r)[1:]
    return out


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[:4])
    return out


def test_every_short_block_and_pair_of_states():
    kinds = [(r, f) for r in "sua" for f in (0, 1, 2)] + [("x", 0)]
    blocks = [b for n in (1, 2) for b in product(kinds, repeat=n)]
    rng = random.Random(5)
    blocks += [tuple(rng.choice(kinds) for _ in range(rng.randint(3, 12))) for _ in range(300)]
    for block in blocks:
        turns, found = tuple((r, f == 1, f == 2) for r, f in block), cv.align(block)
        for p, q in product(range(4), repeat=2):
            want = plain(turns, p, (q,), tail=False)
            assert found.get((p, q)) == (want if want[0] < 10**9 else None), (block, p, q)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_random_conversations_and_blocks(spark, block):
    rng, rows = random.Random(block), []
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ünknown"], ["Fine.", "cut", "ok!\n", " \t", "", None, "Why?", "a. b", "é.", "x" * 3000 + "."]
    for c in [*range(60), None]:
        usual = ["user", "assistant"] * 20
        for t in range(rng.randint(1, 14)):
            row = (c, rng.choice([t, t, t, t + 2, None, 5]), usual[t] if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Turn {t}.", "x", 1)
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    rows += [(1000, t, "user", f"Text {t}.", None, None) for t in range(70)]
    got = collected(cv.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), block))
    assert got == {c: plain_row(r) for c, r in grouped(rows).items()}


def test_one_conversation_over_all_partitions(spark):
    """A third and more of all turns in one conversation, most of them copies of one turn and without a turn number."""
    rng = random.Random(1)
    rows = [(7, None, "user", "Same.", None, None)] * 400 + [(7, t, rng.choice(["user", "assistant"]), f"T{t}.", None, None) for t in range(900)] + [(c, 0, "user", "Hi.", None, None) for c in range(300)]
    got = collected(cv.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA), 64))
    want = {c: plain_row(r) for c, r in grouped([r for r in rows if r[0] != 7]).items()}
    assert {c: v for c, v in got.items() if c != 7} == {c: v for c, v in want.items() if c != 7}
    assert got[7] == plain_row([r[:4] for r in rows if r[0] == 7])


def test_repaired_turns_are_the_texts(spark):
    rows = [("b", 2, "assistant", "Yes.", "p", 1), ("b", 1, "user", "Q?", "p", 1), ("b", 3, "assistant", "More.", "p", 1), ("b", 4, "user", "cut", "p", 1), (None, 1, "system", "S.", "p", 1), ("c", 1, None, None, "p", 1)]
    table = spark.createDataFrame(rows, SCHEMA.replace("conv_id bigint", "conv_id string"))
    out = sorted(map(tuple, cv.repaired_turns(table).collect()), key=lambda r: (r[0] or "", r[1]))
    assert not [r for r in out if r[0] is None]  # a lone system turn is cheaper deleted than completed
    mine = [r[1:] for r in out if r[0] == "b"]
    assert "\n".join(f"{r}:{x}" for _, _, _, r, x in mine) == "user:Q?\nassistant:Yes.\nuser:\nassistant:More." and not [r for r in out if r[0] == "c"]
    audits = collected(cv.repair_audits(table))
    assert audits["b"] == plain_repair([r[1:4] for r in rows if r[0] == "b"]) and audits["c"][5:7] == (4, "D") and set(audits) == {"b", "c", None}


def test_empty_table_long_text_and_query(spark, sf):
    assert cv.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0 and cv.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, 0, "user", "word " * 1_000_000 + "end.", None, None), (1, 1, "assistant", "Yes.", None, None), (1, 2, "assistant", "." + " " * 500_000, None, None)]
    got = collected(cv.damaged_and_repaired(spark.createDataFrame(long, SCHEMA)))
    assert got == {1: plain_row([r[:4] for r in long])}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op12_conversation_repair(spark, sf)) == {c: plain_row(r) for c, r in grouped(rows).items()}
