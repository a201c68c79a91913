import re

import numpy as np
from pyspark.sql import functions as F

from quire.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by sharing the excess again and again."""
    w = [weights[i % 3] for i in range(len(sizes))]
    total, fixed = sum(sizes), {}
    while True:
        left, weight = total - sum(fixed.values()), sum(x for i, x in enumerate(w) if i not in fixed)
        over = {i: cap * sizes[i] for i in range(len(sizes)) if i not in fixed and left * w[i] / weight > cap * sizes[i] + 1e-9}
        if not over:
            return [fixed.get(i, left * w[i] / weight if weight else 0.0) for i in range(len(sizes))]
        fixed |= over


def greedy(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_highest_quotients(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, (n, seats) in enumerate([(1, 7), (2, 1), (5, 100), (30, 17), (40, 1000), (3, 0), (4, 9)]):
        votes = (rng.pareto(1.0, n) * 100).round(3).tolist() if g != 6 else [0.0, 0.0, 5.0, 5.0]
        want |= {(g, i): q for i, q in enumerate(greedy(votes, seats))}
        rows += [(g, i, float(v), seats) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, party int, votes double, seats long")
    got = {(r.g, r.party): r.quota for r in mixing.sainte_lague(df, ["g"], "party").collect()}
    assert got == want


def test_targets(spark):
    for sizes in ([10, 1000, 5, 700, 3], [1], [0, 0, 9], [4, 4, 4, 4], [1, 1, 1, 10000]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert np.allclose([got[n] for n in names], fill(sizes)), sizes


def test_mix_cases(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "big" if i % 3 == 0 else None if i % 3 == 1 else f"s{i % 7}", " ".join(["w"] * int(rng.integers(0, 300)))) for i in range(600)]
    docs += [(5, "big", "w " * 40000), (6, "big", None), (6, "big", ""), (6, "big", "same text"), (6, "big", "same text"), (None, "s1", "a b")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("taken", F.lit("x")).withColumn("size", F.lit("y")).withColumn("target", F.lit("t")).withColumn("n_blocks", F.lit("z"))
    rows = df.select("doc_id", "source", mixing.words_of(F.col("text")).alias("size"))
    got = mixing.mix(rows, shard_words=2000).toPandas()
    assert len(got) == len(docs) and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for _, g in got.groupby("source_id"):
        shards = g.shard.nunique()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= mixing.BLOCK_WORDS * (1 + 1.5 * shards)
    again = mixing.mix(rows.repartition(7), shard_words=2000).toPandas()
    key = ["doc_id", "source_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    made = mixing.mixed_documents(df, shard_words=2000)
    assert made.columns == df.columns
    count = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in made.collect())
    assert count == got.taken.sum()
    assert mixing.mix(rows.limit(0)).count() == 0


def down_the_tree(votes, seats, bits):
    """The seats by highest quotients from node to node; votes: {id: votes}."""
    level = 0
    while max(votes) >> (bits * (level + 1)):
        level += 1
    above = {0: seats}
    while level >= 0:
        nodes = {}
        for i, v in votes.items():
            nodes[i >> (bits * level)] = nodes.get(i >> (bits * level), 0) + v
        below = {}
        for parent, n in above.items():
            mine = sorted(x for x in nodes if x >> bits == parent)
            below |= dict(zip(mine, greedy([nodes[x] for x in mine], n)))
        above, level = below, level - 1
    return above


def test_many_sources_go_down_a_tree(spark, monkeypatch):
    """All of the mix again in plain Python: targets, quotas of sources and shards, and the blocks that quotas take."""
    monkeypatch.setattr(mixing, "FAN_BITS", 2)
    rng = np.random.default_rng(8)
    docs = [(i, f"h{int(rng.pareto(0.6)) % 23:02d}", int(rng.integers(1, 400))) for i in range(900)] + [(900 + i, "h00", 0) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    got = mixing.mix(df, shard_words=1500).toPandas()
    names = sorted({d[1] for d in docs})
    assert len(names) > 16 and got.shard.max() > 16
    sizes = [sum(d[2] for d in docs if d[1] == name) for name in names]
    targets = fill(sizes)
    ids = got.drop_duplicates("source_id").set_index("source_id")
    assert np.allclose([ids.target[i + 1] for i in range(len(names))], targets)
    quotas = down_the_tree({i + 1: t for i, t in enumerate(targets)}, round(sum(sizes) / mixing.BLOCK_WORDS), 2)
    for i, mine in got[got["size"] > 0].groupby("source_id"):
        by_shard = down_the_tree(mine.groupby("shard")["size"].sum().to_dict(), quotas[i], 2)
        for shard, rows in mine.groupby("shard"):
            words = int(rows["size"].sum())
            blocks = -(-words // mixing.BLOCK_WORDS)
            quota = min(by_shard[shard], 3 * blocks)
            assert (rows.quota == quota).all() and (rows.n_blocks == blocks).all()
            shift = int(rows.shift_.iloc[0])
            taken = np.repeat([quota // blocks + ((b * mixing.STEP + shift) % blocks < quota % blocks) for b in range(blocks)], mixing.BLOCK_WORDS)[:words]
            at = 0
            for r in rows.sort_values(["order_", "doc_id", "size"]).itertuples():
                assert r.taken == taken[at : at + r.size].sum()
                at += r.size
    assert (got[got["size"] == 0].taken == 0).all()


def test_running_sums_cross_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    got = mixing.running(df.repartition(5), {"o_": F.col("k")}, {"total": F.col("k"), "place": F.lit(1)}, "test").collect()
    assert all(r.total == r.k * (r.k + 1) // 2 and r.place == r.k + 1 for r in got) and len(got) == 1000
