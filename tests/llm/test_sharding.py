"""Sharding by virtual slots against a plain greedy version, and the edits of the map."""

import random
import zlib

from paperloom.llm import sharding
from paperloom.llm.queries import op5_sharding
from tests.conftest import SF


def data():
    rng = random.Random(3)
    out = [(i, "é" * int(min(5000, rng.paretovariate(0.7)))) for i in range(2000)]
    return out + [(None, "x"), (None, None), (7, None), (8, ""), (9, "dup"), (9, "dup"), (9, "dup")]


def frame(spark):
    return spark.createDataFrame([(i, t, 5, "s") for i, t in data()], "doc_id long, text string, shard int, slot string").repartition(6)


def test_place(spark):
    rows = sharding.place(frame(spark), 24, slots=512).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data())
    by_shard, loads = {}, {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        loads[r.virtual_slot] = loads.get(r.virtual_slot, 0) + r.size
        assert 0 <= r.shard < 24
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    # the plain greedy version
    load, want = [0] * 24, {}
    for v in sorted(range(512), key=lambda v: (loads.get(v, 0), sum(r.virtual_slot == v for r in rows), v), reverse=True):
        want[v] = load.index(min(load))
        load[want[v]] += loads.get(v, 0) + 1
    assert all(want[r.virtual_slot] == r.shard for r in rows)
    again = sharding.place(frame(spark).repartition(2), 24, slots=512).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_grow_and_store(spark, tmp_path):
    loads = sharding.slot_loads(sharding.packets(sharding.records(frame(spark)), 512), 512)
    one = sharding.build_map(loads, 5)
    sharding.save_map(one, str(tmp_path / "map"))
    two = sharding.grow_map(sharding.load_map(spark, str(tmp_path / "map")), loads, 5, 2)
    sharding.save_map(two, str(tmp_path / "map"))
    a = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    b = sharding.load_map(spark, str(tmp_path / "map")).collect()
    assert {r.version for r in b} == {2} and len(b) == 512 == len(a)
    moved = [r for r in b if a[r.virtual_slot] != r.shard]
    assert moved and {r.shard for r in moved} == {5, 6}
    total = {}
    for r in b:
        total[r.shard] = total.get(r.shard, 0) + r.bytes
    assert max(total.values()) < 1.35 * sum(total.values()) / 7


def test_shard_docs_and_empty(spark):
    docs = frame(spark)
    out = sharding.shard_docs(docs, 24)
    assert out.columns == ["doc_id", "text", "slot", "virtual_slot", "shard", "map_version"] and out.count() == docs.count()
    empty = docs.limit(0)
    assert sharding.place(empty, 24).count() == 0 and sharding.shard_docs(empty, 24).count() == 0


def test_query_grows_the_stored_map(spark):
    rows = op5_sharding(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and {r.map_version for r in rows} == {1}
    assert all(0 <= r.shard < 24 and (r.next_shard == r.shard or 24 <= r.next_shard < 32) for r in rows)
    assert any(r.next_shard >= 24 for r in rows) and {r.grown_shard for r in rows} == {None} and {r.law for r in rows} == {"bytes"}


def test_equal_records_are_spread(spark):
    """Many rows without an id and with one text don't fall to one shard; all places are taken once."""
    docs = spark.createDataFrame([(None, "same text")] * 6000 + [(i, "x" * 9) for i in range(50)], "doc_id long, text string").repartition(5)
    rows = sharding.place(docs, 4).collect()
    assert len(rows) == 6050 and all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(4))
    assert max(sum(r.size for r in rows if r.shard == k) for k in range(4)) < 0.4 * sum(r.size for r in rows)


def test_edit_for_changed_loads(spark, tmp_path):
    """A stored map is edited when loads change: balance comes back, and only slots of overloaded shards move."""
    path, docs = str(tmp_path / "map"), frame(spark)
    first = {r.virtual_slot: r.shard for r in sharding.place(docs, 6, slots=512, path=path).collect()}
    grown = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, "y" * 40_000) for i in range(40)], "doc_id long, text string"))
    rows = sharding.place(grown, 6, slots=512, path=path).collect()
    assert {r.map_version for r in rows} == {2} and len(rows) == grown.count()
    total, before = [0] * 6, [0] * 6
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    for r in rows:
        total[r.shard] += r.size
        before[old[r.virtual_slot]] += r.size
    assert set(first.items()) <= set(old.items()) and max(total) < max(before) and max(total) < 1.1 * sum(total) / 6
    mean = sum(total) / 6
    assert {old[v] for v in old if old[v] != new[v]} <= {k for k in range(6) if before[k] > mean}
