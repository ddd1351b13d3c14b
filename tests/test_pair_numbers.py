"""The most frequent pairs are found among numbers that rise with the names."""

import random
from collections import Counter

from shelfspark.operators import insights as I


def test_top_pairs_with_ties_null_items_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(f"u{rng.randrange(5)}", rng.choice(["a", "b", "Z", "é", "", "a b", None]), rng.randrange(25)) for _ in range(300)]
    rows += [("u1", "b", 7)] * 3 + [(None, "a", 1)]
    want = Counter()
    for u in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == u]
        cells = Counter((o, i) for _, i, o in own)
        for (o1, i1), c1 in cells.items():
            for (o2, i2), c2 in cells.items():
                if o1 < o2:
                    want[i1, i2] += c1 * c2
        for (_, i), c in cells.items():
            if c > 1:
                want[i, i] += c * (c - 1) // 2
    key = lambda x: (x is not None, (x or "").encode())
    best = sorted(((n, a, b) for (a, b), n in want.items()), key=lambda r: (-r[0], key(r[1]), key(r[2])))[:12]
    kinds, plain = [], I.ordered_pairs

    def seen(df, user, item, order):
        kinds.append(dict(df.dtypes)[item])
        return plain(df, user, item, order)

    monkeypatch.setattr(I, "ordered_pairs", seen)
    df = spark.createDataFrame(rows, "u string, i string, o int")
    got = [(r["count"], r["item_a"], r["item_b"]) for r in I.bundle_pairs(df, 12, "u", "i", ["o"]).collect()]
    assert got == best and kinds == ["bigint"]
