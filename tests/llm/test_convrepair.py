import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np

from dataprobe.llm import convrepair, queries, registry  # noqa: F401  queries register themselves
from dataprobe.llm.convrepair import BLANK, DUPLICATE, TRUNCATED

_SPACE = " \t\n\x0b\f\r"


def plain_repair(rows):
    """(cost, audit, repaired turns), the least by cost and audit, by search over all edits with up to four insertions
    between two rows; rows are (role, text, fault)."""
    turn = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, last, insertions):
        # last: the initial of the last turn, "" before any
        options = []
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        placed = after.replace("s", "")
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            extra = 1 if fault == "truncated" else 0
            c, a, t = best(i + 1, last, 4)
            options.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                if role and role[0] in after:
                    c, a, t = best(i + 1, role[0], 4)
                    options.append((c + extra, "K" + a, ((role, text), *t)))
                c, a, t = best(i + 1, placed, 4)
                options.append((c + 2 + extra, "R" + a, ((turn[placed], text), *t)))
        if insertions:
            c, a, t = best(i, placed, insertions - 1)
            options.append((c + 2, "I" + a, ((turn[placed], ""), *t)))
        return min(options, key=lambda o: (o[0], o[1]), default=(10**9, "", ()))

    return best(0, "", 4)


def plain_digest(rows):
    """The contract row by row in Python; ``rows`` are (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, judged = set(), []
        for _, role, text in turns:
            body = text.rstrip(_SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        known = [t[0] for t in turns if t[0] is not None]
        count = lambda f: sum(j[2] == f for j in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, fixed = plain_repair(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        result[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return result


def as_dict(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in cols) for r in rows}


def test_tables_against_search():
    rng = random.Random(5)
    t = convrepair.Tables()
    names, faults = ["system", "user", "assistant", "tool"], ["", "truncated", "duplicate", "blank"]
    for _ in range(1500):
        rows = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 14))]
        cost, audit = t.solve(np.array([r * 4 + f for r, f in rows], dtype=np.int64))
        want = plain_repair([(names[r], "x", faults[f]) for r, f in rows])
        assert (cost, audit) == want[:2], rows


def test_vectors_are_few_and_blocks_agree_with_steps():
    t = convrepair.Tables()
    assert len(t.vectors) < 200
    rng = random.Random(2)
    for _ in range(300):
        v, symbols = rng.randrange(len(t.vectors)), [rng.randrange(10) for _ in range(convrepair.BLOCK)]
        now, cost = v, 0
        for s in reversed(symbols):
            cost += t.add[now, s]
            now = t.step[now, s]
        b = int("".join(map(str, symbols)))
        assert (t.block[v][b], t.cost[v][b]) == (now, cost)


def test_every_conversation_of_the_table(spark, sf_dir):
    got = as_dict(registry.QUERIES["op12_conversation_repair"](spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_digest(rows)


def test_odd_rows(spark):
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t\n", None, "A ", "é!", "Well? ", "x" * 200_000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        turns = rng.sample(range(-5, 40), rng.randrange(1, 14))
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for t in turns]
        if rng.random() < 0.3:
            rows.append((conv, None, "user", rng.choice(texts)))
    rows += [(100, t, "user", "same.") for t in range(300)] + [(101, 7, "user", "same.")] * 50 + [(102, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "1 AS h1", "2 AS copies", "'x' AS symbol", "4 AS split")
    got = as_dict(convrepair.digest(convrepair.damage(clash)))
    assert got == plain_digest(rows)
    # the same with every conversation cut over several range splits
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(convrepair.digest(convrepair.damage(df.repartition(3)))) == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_rows_dropped_and_empty_table(spark):
    t = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, t, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    got = as_dict(convrepair.digest(convrepair.damage(df)))
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert convrepair.digest(convrepair.damage(df.limit(0))).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Who?"), (1, 2, "user", "Me."), (1, 3, "user", "Me.")]
    df = convrepair._turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    out = [(r.edit, r.role, r.text) for r in convrepair.repaired(df).orderBy("place").collect()]
    plan = convrepair.edits(df).first()
    assert (plan.duplicate, plan.cost) == (1, 7) and len(plan.audit.replace("I", "")) == 4
    assert "".join(r[1][0] for r in out) in ("ua", "uaua")
    assert {DUPLICATE, BLANK, TRUNCATED} == {1, 2, 3}
