"""The shard store: versions, conflicts, tiers, nothing lost."""

import pytest
from pyspark.sql import functions as F

from ravel.llm.sharding import Conflict, ShardStore, StoreOptions


def rows(df):
    return sorted(map(repr, df.collect()))


def test_appends_and_compaction_keep_every_row(spark, clashing, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), StoreOptions(target_bytes=1 << 20, least_bytes=1 << 10, fan_in=3))
    for k in range(4):
        store.append(clashing.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == k))
    before = store.manifest()
    assert before["version"] == 4 and len(before["shards"]) > 4
    after = store.compact()
    assert after["version"] > 4 and len(after["shards"]) < len(before["shards"])
    assert not store.runs(after["shards"])
    assert rows(store.read()) == rows(clashing) == rows(store.read(4))
    assert sum(s["rows"] for s in after["shards"]) == clashing.count()
    assert store.vacuum() > 0 and rows(store.read()) == rows(clashing)


def test_the_second_writer_of_a_version_fails(spark, odd, tmp_path):
    a, b = (ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    base = a.manifest()
    a.append(odd)
    with pytest.raises(Conflict):
        b.commit(base, [], None)
    assert a.versions() == [1] and b.read().count() == odd.count()


def test_empty_arrivals_and_other_schemas(spark, odd, nothing, tmp_path):
    s = ShardStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        s.read()
    s.append(nothing)
    assert s.read().count() == 0 and s.compact()["version"] >= 1
    s.append(odd)
    assert s.read().count() == odd.count()
    with pytest.raises(ValueError):
        s.append(odd.drop("lang"))


def test_tiers_group_like_sizes(spark, tmp_path):
    s = ShardStore(spark, str(tmp_path / "s"), StoreOptions(target_bytes=1 << 20, least_bytes=1000, ratio=4, fan_in=2))
    sizes = [900, 1100, 3900, 4100, 9000, 70_000, 600_000]
    assert [s.tier(x) for x in sizes] == [0, 0, 0, 1, 1, 3, 4]
    assert [[x["bytes"] for x in r] for r in s.runs([{"path": str(x), "bytes": x} for x in sizes])] == [[900, 1100, 3900], [4100, 9000]]


def test_deltas_and_snapshots_give_the_same_versions(spark, odd, tmp_path):
    s = ShardStore(spark, str(tmp_path / "s"), StoreOptions(snapshot=3, fan_in=2))
    want = {0: []}
    for k in range(5):
        m = s.append(odd.filter(F.coalesce("doc_id", F.lit(0)) % 5 == k))
        want[m["version"]] = m["shards"]
    m = s.compact()
    want[m["version"]] = m["shards"]
    assert [s.manifest(v)["shards"] for v in sorted(want)] == [want[v] for v in sorted(want)]
    assert ["shards" in s._load(v) for v in (1, 2, 3)] == [False, False, True]
    assert len(s._load(m["version"])["remove"]) > 0 and rows(s.read()) == rows(odd)


def test_the_query_shows_whether_anything_was_merged(spark, sf_dir, monkeypatch):
    from ravel.llm import queries as Q

    assert Q.op10_sharding(spark, sf_dir).select("merged").distinct().collect() == [(True,)]
    monkeypatch.setattr(ShardStore, "compact", lambda self: self.manifest())
    assert Q.op10_sharding(spark, sf_dir).select("merged").distinct().collect() == [(False,)]
