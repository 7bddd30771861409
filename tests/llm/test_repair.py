import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from catalogkit.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
DIALOGUE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = " " if conv is None else str(conv), " " if turn is None else str(turn)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(said).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_edit(rows, found):
    """(cost, audit, lines) of all edits with at most one insert before each row and two at the end, by trying all."""
    names = {"u": "user", "a": "assistant"}

    def go(i, cost, audit, roles, lines):
        if i == len(rows):
            for tail in ("", "u", "a", "ua", "au"):
                if DIALOGUE.fullmatch(roles + tail):
                    yield cost + 2 * len(tail), audit + "I" * len(tail), lines + [names[t] + ":" for t in tail]
            return
        _, _, role, text = rows[i]
        for ins in ("", "u", "a"):
            c, a, r, ls = cost + 2 * len(ins), audit + "I" * len(ins), roles + ins, lines + [names[t] + ":" for t in ins]
            if ins and not prefix(r):
                continue
            yield from go(i + 1, c + 3, a + "D", r, ls)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                for op, new, own in (("K", role[:1], role), ("R", "u", "user"), ("R", "a", "assistant")):
                    if new and prefix(r + new):
                        yield from go(i + 1, c + (2 if op == "R" else 0) + more, a + op, r + new, ls + [f"{own}:{text}"])

    def prefix(r):
        return re.fullmatch(r"s?(ua)*u?", r)

    return min(go(0, 0, "", "", []))


def expected(rows):
    """conv_id -> the contract's columns, from all rows of a conversation in order."""
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    left = damaged(rows)
    for conv in {r[0] for r in left}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = every_edit(own, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in repair.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answer(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("CONV", F.lit(1)).repartition(3)
    return {r[0]: tuple(r)[1:] for r in repair.damaged_and_repaired(df, **options).collect()}


def test_equals_trying_every_edit(spark):
    rng, rows = random.Random(5), []
    texts = ["Yes.", "No!", "Why", "", " \t", "Well? ", "a.b", "é", "ok.\n", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "users"]
    for conv in range(400):
        for turn in sorted(rng.sample(range(9), rng.randint(1, 5))):
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (2**60, None, "user", "z."), (2**60, -5, "assistant", "z.")]
    assert answer(spark, rows) == expected(rows)


def test_orderly_and_dropped_conversations(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    calm = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    got = answer(spark, [(gone, 0, "user", "Hm."), *((calm, t, r, "Hm.") for t, r in enumerate(("system", "user", "assistant")))])
    empty = hashlib.sha256(b"").hexdigest()
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[calm][:-1] == (0, 0, 0, 0, 0, 0, "KKK")
    assert answer(spark, []) == {}


def test_a_giant_conversation_spills_and_is_still_exact(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(3000)] + [(1, t, "user", "again") for t in range(3000, 3500)] + [(2, 0, "user", "x" * 300_000)]
    plain, spilled = answer(spark, rows), answer(spark, rows, spill=64)
    assert plain == spilled
    assert plain[1][2] > 400 and len(plain[1][6]) > 3000


def test_repeated_turns_and_batches_of_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = [(7, 1, "user", "a."), (7, 1, "user", "a."), (7, 1, "user", "b."), (7, 2, "assistant", "c.")] * 2
        got = answer(spark, rows)
        assert got[7][2] == len(damaged(rows)) - len({r[1:] for r in damaged(rows)})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trail_reads_back_across_blocks():
    for n in (0, 1, 7, 8, 9, 24, 25):
        trail = repair.Trail(8)
        for i in range(n):
            trail.add(i)
        assert list(trail.back()) == list(range(n))[::-1]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query_against_every_edit(spark, sf):
    from catalogkit.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, f"/root/testdata/{sf}").collect()}
    assert got == expected(rows)
