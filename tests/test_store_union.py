"""Stores are compared by digests: what is shared is not read, and equal stores are not read at all."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.settings import checkpoint_root
from ledgerlens.sources import digests
from ledgerlens.sources.objects import ObjectStore, union_stores


def ids(numbers):
    """Ids of 16 prefixes."""
    return ["0" + hashlib.sha256(str(k).encode()).hexdigest()[1:] for k in numbers]


def stored(spark, *appends):
    store = ObjectStore(spark, f"{checkpoint_root(spark)}/u-{uuid.uuid4().hex}")
    for numbers in appends:
        rows = spark.createDataFrame([(i, "{}", i[:2]) for i in ids(numbers)], "object_id string, doc string, prefix string")
        store._append("record", rows)
    return store


def test_missing_ids_are_those_of_the_sets(spark):
    here, there = stored(spark, range(0, 900), range(5)), stored(spark, range(20, 905))
    prefixes, pull, push = digests.missing_ids(here, there, "record")
    assert {r.object_id for r in pull.collect()} == set(ids(range(900, 905)))
    assert {r.object_id for r in push.collect()} == set(ids(range(20)))
    assert set(prefixes) == {i[:2] for i in ids([*range(20), *range(900, 905)])}


def test_only_prefixes_that_differ_are_read_and_equal_stores_not_at_all(spark, monkeypatch):
    here, there = stored(spark, range(600)), stored(spark, range(597))
    first = union_stores(here, there).collect()
    assert sorted((r.direction, r.object_id, r.status) for r in first) == sorted(("push", i, "added") for i in ids(range(597, 600)))
    assert there.objects("record").select("object_id").distinct().count() == 600

    def refuse(self, kind):
        raise AssertionError("an object was read")

    with monkeypatch.context() as m:
        m.setattr(ObjectStore, "objects", refuse)
        again = union_stores(here, there)
        assert again.count() == 0 and again.columns == ["direction", "kind", "object_id", "status", "errors"]
    # After one more object only its prefix is read for a digest.
    new = ids([9999])[0]
    here._append("record", spark.createDataFrame([(new, "{}", new[:2])], "object_id string, doc string, prefix string"))
    read = []

    def noting(self, kind, plain=ObjectStore.objects):
        rows = plain(self, kind)

        class Noted:
            def where(self, condition):
                read.append(str(condition))
                return rows.where(condition)
        return Noted()

    monkeypatch.setattr(ObjectStore, "objects", noting)
    prefixes, _, push = digests.missing_ids(here, there, "record")
    assert prefixes == [new[:2]] and [r.object_id for r in push.collect()] == [new]
    assert len(read) == 3 and all(new[:2] in condition for condition in read)


def test_repeated_rows_are_no_difference_and_empty_stores_are_equal(spark):
    here, there = stored(spark, range(50), range(50)), stored(spark, range(50))
    assert digests.missing_ids(here, there, "record")[0] == []
    assert union_stores(stored(spark), stored(spark)).count() == 0


@pytest.mark.parametrize("digits", [2, 4])
def test_digests_follow_the_set_alone(spark, digits):
    frame = lambda numbers: spark.createDataFrame([(i,) for i in ids(numbers)], "object_id string")
    one = {r.node: r.digest for r in digests.node_digests(frame(range(300)), digits).collect()}
    two = {r.node: r.digest for r in digests.node_digests(frame([*range(299, -1, -1), 4, 4]).repartition(7), digits).collect()}
    assert one == two and set(one) == {i[:digits] for i in ids(range(300))}
    less = {r.node: r.digest for r in digests.node_digests(frame(range(1, 300)), digits).collect()}
    assert {n for n in one if one.get(n) != less.get(n)} == {ids([0])[0][:digits]}


def test_texts_of_one_id_are_all_put_to_the_gate(spark):
    here, there = stored(spark), stored(spark, [1])
    i = ids([1])[0]
    there._append("record", spark.createDataFrame([(i, "[]", i[:2])], "object_id string, doc string, prefix string"))
    got = union_stores(here, there).where(F.col("direction") == "pull").collect()
    assert [r.status for r in got] == ["refused", "refused"]
