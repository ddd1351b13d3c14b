"""Conversation repair: against a plain dynamic program over strings, long conversations and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import conversations
from shelfspark.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order."""
    found = {}
    for conv_id, turn, role, text in rows:
        held = found.setdefault(conv_id, [])
        n = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 0:
            continue
        text = "" if n == 1 else "".join(c for c in text if c not in ".!?") if n == 2 else text
        held += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(held, key=key) for c, held in found.items()}


def plain_audit(rows, kinds):
    """(cost, audit, repaired lines) least by cost, then audit, from the end backwards."""
    ins = {0: "u", "s": "u", "u": "a", "a": "u"}

    def close(best):
        for _ in range(4):
            for s in best:
                if best[ins[s]] is not None:
                    c, a, lines = best[ins[s]]
                    new = (c + 2, "I" + a, [("user" if ins[s] == "u" else "assistant") + ":"] + lines)
                    if best[s] is None or new[:2] < best[s][:2]:
                        best[s] = new
        return best

    best = close({0: (0, "", []), "s": None, "u": None, "a": (0, "", [])})
    for (turn, role, text), kind in list(zip(rows, kinds))[::-1]:
        now = {}
        for s in best:
            options = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if kind not in ("blank", "duplicate"):
                cut = kind == "truncated"
                to = role[:1]
                if to in {0: "su", "s": "u", "u": "a", "a": "u"}[s] and to:
                    options.append((best[to][0] + cut, "K" + best[to][1], [f"{role}:{text}"] + best[to][2]))
                to = ins[s]
                options.append((best[to][0] + cut + 2, "R" + best[to][1],
                                [("user" if to == "u" else "assistant") + ":" + text] + best[to][2]))
            now[s] = min(options, key=lambda o: o[:2])
        best = close(now)
    return best[0]


def plain_result(rows):
    found = []
    for conv_id, held in plain_damage(rows).items():
        seen, kinds, illegal = set(), [], 0
        for i, (turn, role, text) in enumerate(held):
            left = text.rstrip(SPACES)
            kinds.append("blank" if not left else "duplicate" if (role, text) in seen else
                         "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
            illegal += i > 0 and held[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = plain_audit(held, kinds)
        found.append((conv_id, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def result(spark, df):
    judged = conversations.judge_conversations(conversations.damage(df))
    hashed = conversations.repair_conversations(conversations.damage(df), judged, digest=True)
    return sorted(((*r[:8], r.repaired_sha256) for r in judged.join(
        hashed, judged["conv_id"].eqNullSafe(hashed["conv_id"])).collect()), key=repr)


def random_rows(n, seed):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rnd.choice(["Yes.", "No!", "cut off", " \t", "", None, "Why?\n", "a\nb.", f"text {turn}.", "ok. \x0b"])
            rows.append((c if c else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_random_conversations_equal_the_plain_version(spark):
    rows = random_rows(400, 7)
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "conv_id long, turn long, role string, text string, digest string, copies int")
    assert result(spark, df) == plain_result(rows)


def test_the_query_equals_the_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, sf_dir).collect()), key=repr) == plain_result(rows)


def test_long_conversations_and_extreme_turns(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(5, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "cut", f"{t}!"])) for t in range(3000)]
    rows += [(6, -(1 << 63), "user", "Hi."), (6, (1 << 63) - 1, "assistant", "Ho."), (7, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(spark, df)
    want = [(r[0], min(r[1], (1 << 63) - 1), *r[2:]) for r in plain_result(rows)]
    assert got == want
    codes = [[rnd.randrange(12) for _ in range(n)] for n in (0, 1, 2, 40, 41, 399, 400, 1000)]
    whole = conversations.audits([bytes(c) for c in codes])
    monkeypatch.setattr(conversations, "_BLOCK", 40)
    assert conversations.audits([bytes(c) for c in codes]) == whole


@pytest.mark.parametrize("seed", range(3))
def test_audits_are_least(seed):
    rnd = random.Random(seed)
    codes = [[rnd.randrange(12) for _ in range(rnd.randint(0, 9))] for _ in range(500)]
    kinds = {0: "", 1: "truncated", 2: "blank"}
    for c, got in zip(codes, conversations.audits([bytes(c) for c in codes])):
        rows = [(i, {0: "system", 1: "user", 2: "assistant", 3: "tool"}[x // 3], "x") for i, x in enumerate(c)]
        assert got == plain_audit(rows, [kinds[x % 3] for x in c])[:2]


def test_repaired_rows_read_as_a_conversation(spark, sf_dir):
    rows = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    judged = conversations.judge_conversations(rows)
    repaired = conversations.repair_conversations(rows, judged)
    assert repaired.columns == ["conv_id", "place", "role", "text"]
    read = (repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("r"))
            .select(F.array_join(F.transform("r", lambda x: F.left(x["role"], F.lit(1))), "").alias("roles")))
    assert read.where("NOT roles RLIKE '^s?(ua)+$'").isEmpty()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert result(spark, df) == []
