"""Numbered records and what rests on them: commits of tables, marks."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tableflow.records import IN_A_FOLDER, Conflict, Records
from tableflow.sinks import tables
from tableflow.sinks.tables import VersionedTable
from tableflow.sources.incremental import MarkStore


def test_each_number_is_given_once(spark, folder):
    records = Records(spark, f"{folder}/r")
    assert records.latest() is None and records.newest(3) == []
    with ThreadPoolExecutor(8) as pool:
        given = list(pool.map(lambda i: Records(spark, f"{folder}/r").add(1, {"writer": i}), range(8)))
    assert sum(given) == 1 and records.latest() == (1, {"writer": given.index(True)})


def test_the_newest_is_found_in_two_listings(spark, folder, monkeypatch):
    records = Records(spark, f"{folder}/r")
    for number in (IN_A_FOLDER - 1, IN_A_FOLDER, 3 * IN_A_FOLDER + 2):
        assert records.add(number, {"n": number})
    opened, read = [], Records._read
    monkeypatch.setattr(Records, "_read", lambda self, path: (opened.append(path), read(self, path))[1])
    assert records.latest() == (3 * IN_A_FOLDER + 2, {"n": 3 * IN_A_FOLDER + 2}) and len(opened) == 1
    assert [n for n, _ in records.newest(9)] == [3 * IN_A_FOLDER + 2, IN_A_FOLDER, IN_A_FOLDER - 1]


def test_a_half_written_draft_is_no_record(spark, folder):
    records = Records(spark, f"{folder}/r")
    records.add(1, {"n": 1})
    with open(f"{folder}/r/.draft-x", "w") as draft:
        draft.write('{"n"')
    assert records.latest() == (1, {"n": 1})


def interrupted(target: VersionedTable, other):
    """``target``, before whose first record ``other()`` commits."""
    record, done = target._record, []

    def late(*arguments):
        if not done:
            done.append(other())
        return record(*arguments)

    target._record = late
    return target


def content(table):
    return sorted(map(tuple, table.read().collect()))


@pytest.mark.parametrize("buckets", [0, 3])
def test_a_slower_upsert_merges_again(spark, rows, folder, buckets):
    shape = (["k"], buckets) if buckets else ((), 0)
    new = lambda: VersionedTable(spark, f"{folder}/t", *shape)
    new().replace(rows([(1, "a"), (2, "a")], "k int, v string"))
    other = lambda: new().upsert(rows([(2, "b"), (3, "b")], "k int, v string"), ["k"], unique_keys=True)
    done = interrupted(new(), other).upsert(rows([(3, "c"), (4, "c")], "k int, v string"), ["k"], unique_keys=True)
    assert done.version == 3 and content(new()) == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    assert len(new().vacuum(keep=3)) == 0  # the lost attempt has left no data


def test_the_first_batches_of_two_writers_are_both_there(spark, rows, folder):
    new = lambda: VersionedTable(spark, f"{folder}/t")
    other = lambda: new().upsert(rows([(2, "b")], "k int, v string"), ["k"], unique_keys=True)
    interrupted(new(), other).upsert(rows([(1, "a")], "k int, v string"), ["k"], unique_keys=True)
    assert content(new()) == [(1, "a"), (2, "b")]


def test_of_two_replacements_the_slower_one_stays(spark, rows, folder):
    new = lambda: VersionedTable(spark, f"{folder}/t")
    first, second = rows([(1, "a")], "k int, v string"), rows([(2, "b")], "k int, v string")
    done = interrupted(new(), lambda: new().replace(second)).replace(first, note="mine")
    assert done.version == 2 and content(new()) == [(1, "a")] and [c.note for c in new().commits(5)] == ["mine", None]


def test_a_writer_that_always_loses_says_so(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(tables, "ATTEMPTS", 2)
    target = VersionedTable(spark, f"{folder}/t")
    target.replace(rows([(1, "a")], "k int, v string"))
    monkeypatch.setattr(Records, "add", lambda *_: False)
    with pytest.raises(Conflict, match="faster"):
        target.upsert(rows([(2, "b")], "k int, v string"), ["k"], unique_keys=True)
    with pytest.raises(Conflict):
        target.replace(rows([(2, "b")], "k int, v string"))
    assert content(target) == [(1, "a")] and target.vacuum(keep=1) == []


def test_bucketed_upserts_match_plain_ones(spark, rows, folder):
    """Null keys, odd names, partial and whole batches, keys only, and a key that is not the buckets'."""
    base = rows([(1, "a", 1.0), (2, "a", None), (None, "n", 0.0), (4, "d", 4.0)], "`the k` int, v string, `w,x` double")
    batches = [
        (rows([(2, "b", 1), (2, "c", 2), (None, "m", 3), (7, None, 1)], "`the k` int, v string, step int"), {"order_by": ["step"]}),
        (rows([(1, "z", 9.0), (9, "y", 8.0)], "`THE K` int, v string, `w,x` double"), {"unique_keys": True}),
        (rows([(11,), (1,), (None,)], "`the k` int"), {"unique_keys": True}),
    ]
    plain, located = VersionedTable(spark, f"{folder}/p"), VersionedTable(spark, f"{folder}/l'q", ["the k"], 4)
    for target in (plain, located):
        target.replace(base)
        for batch, choice in batches:
            target.upsert(batch, ["the k"], **choice)
        target.upsert(rows([("d", 5.0)], "v string, `w,x` double"), ["v"], unique_keys=True)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, plain.read().collect()), key=key) == sorted(map(tuple, located.read().collect()), key=key)
    # Another session, or this one after the catalog has forgotten it, reads the buckets again.
    spark.sql(f"DROP TABLE {tables._catalog_name(located.latest().folder)}")
    assert located.read().count() == plain.read().count() and located.latest().buckets == 4


def test_marks_of_two_runs(spark, folder):
    marks = MarkStore(spark, f"{folder}/m")
    began = marks.state("s/1")
    assert (began.value, began.version) == (None, 0)
    marks.advance("s/1", "f", "10", began.version)
    with pytest.raises(Conflict, match="another run"):
        marks.advance("s/1", "f", "7", began.version)
    assert marks.read("s/1") == "10" and marks.read("s") is None
    marks.advance("s/1", "f", "12")
    assert marks.state("s/1").version == 2
