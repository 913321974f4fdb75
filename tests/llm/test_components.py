"""Components of links, by rounds, by one task, and by both."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.llm import simhash


def made(rng):
    """Links of chains, a star, a clique and pairs, with repeated ones, both ways round, and of a node with itself."""
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(2000, k) for k in range(2001, 2080)]
    clique = [(a, b) for a in range(3000, 3012) for b in range(3000, a)]
    pairs = [(k, -k) for k in range(4000, 4040)]
    links = chain + star + clique + pairs + chain[:5] + [(5000, 5000), (1001, 1001)]
    names = {x: rng.randrange(-(2**63), 2**63) for link in links for x in link}
    links = [(names[a], names[b]) if rng.random() < 0.5 else (names[b], names[a]) for a, b in links]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("few", [0, 60, 1 << 16])
@pytest.mark.parametrize("kind", ["long", "struct"])
def test_components_equal_plain(spark, monkeypatch, few, kind):
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    links = made(random.Random(few))
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    if kind == "struct":
        df = df.select(*[F.struct(F.col(c).alias("sig"), (F.col(c) % 7).alias("sig2")).alias(c) for c in "ab"])
    found = simhash.components(df)
    rows = [(r.node, r.root) if kind == "long" else (r.node.sig, r.root.sig) for r in found.collect()]
    groups: dict[int, set[int]] = {}
    for node, root in rows:
        groups.setdefault(root, set()).add(node)
    want = {x: {x} for a, b in links if a != b for x in (a, b)}
    for a, b in links:
        if a != b and want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    assert len(rows) == len(want) and sorted(map(sorted, groups.values())) == sorted({tuple(sorted(x)): sorted(x) for x in want.values()}.values())
    assert all(root in group for root, group in groups.items())


def test_few_links_take_few_jobs(spark):
    """The driver's work for a small graph is that of two tables, whatever its shape."""
    links = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1300)], "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert simhash.components(links).count() == 601
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("few")) <= 6
    none = simhash.components(links.where("a < 0"))
    assert none.columns == ["node", "root"] and none.count() == 0
