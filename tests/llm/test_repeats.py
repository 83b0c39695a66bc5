"""Passages of earlier documents (words), and byte strings that occur twice, against plain Python."""

import dataclasses
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plain_python import ODD, PASSAGE, TWINS, blank_separated, same, sha
from tableflow.llm import queries, repeats, substring_dedup, suffix_dedup
from tableflow.llm.batches import NOT_BLANK, Words, byte_hashes


def earlier(rows):
    first = {}
    for key, text in rows:
        words = blank_separated(text)
        for i in range(len(words) - 12):
            window = tuple(words[i : i + 13])
            first[window] = min(first.get(window, np.inf), np.inf if key is None else key)
    out = []
    for key, text in rows:
        words, gone = blank_separated(text), set()
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < (np.inf if key is None else key):
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), sha(kept.encode())))
    return out


def anywhere(rows, length=200, whole=False):
    """With ``whole``, a character goes if one of its bytes does."""
    counts = {}
    texts = [(key, (text or "").encode()) for key, text in rows]
    for _, data in texts:
        for i in range(len(data) - length + 1):
            counts[data[i : i + length]] = counts.get(data[i : i + length], 0) + 1
    out = []
    for key, data in texts:
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if counts[data[i : i + length]] > 1:
                gone[i : i + length] = True
        heads = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
        for a, b in zip(heads, heads[1:]) if whole else ():
            gone[a:b] = gone[a:b].any()
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(data) else 0))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((key, len(data), int(gone.sum()), spans, sha(kept)))
    return out


@pytest.mark.parametrize("hot", [1, 512])
def test_words(odd, hot):
    found = substring_dedup.remove_earlier(odd, "doc_id", "text", ["doc_id"], hot=hot)
    same(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), earlier(ODD))


@pytest.mark.parametrize("hot", [1, 512])
def test_bytes(odd, hot):
    found = suffix_dedup.remove_repeats(odd, "doc_id", "text", ["doc_id"], hot=hot)
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), anywhere(ODD))


def one_hash(items):
    """All windows have one hash."""
    return lambda column: dataclasses.replace(items(column), window=lambda at: np.zeros(len(at), np.uint64))


def test_windows_of_common_anchors_are_compared_as_bytes(odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "items", one_hash(substring_dedup.items))
    found = substring_dedup.remove_earlier(odd, "doc_id", "text", ["doc_id"], hot=1)
    same(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), earlier(ODD))
    plain = suffix_dedup.items_of
    monkeypatch.setattr(suffix_dedup, "items_of", lambda gram: one_hash(plain(gram)))
    found = suffix_dedup.remove_repeats(odd, "doc_id", "text", ["doc_id"], hot=1)
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), anywhere(ODD))


def test_only_common_anchors_are_hot(spark):
    """However full the slots of the table are: here all anchors share two."""
    common = " ".join(f"again{i}" for i in range(13))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(40)) + (f" {common}" if i < 12 else "")) for i in range(60)]
    source = repeats._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    items, hashes = substring_dedup.items, lambda column: repeats.anchors_of(substring_dedup.items(column), 13, 5).hashes
    texts = source.select("text").toArrow()["text"].combine_chunks()
    names, counts = np.unique(hashes(texts), return_counts=True)
    table = repeats._table(source, hashes, 1)
    assert len(table) == 2 and table.sum() == counts.sum() and table.min() >= 12
    found = repeats.common_anchors(source, items, 13, 5, table, 64, 12)
    assert found.tolist() == names[counts >= 12].tolist() and len(found) > 0


@pytest.mark.parametrize("hot", [2, 512])
def test_equal_rows_have_each_anchor_once(spark, hot):
    """Not once for each of them, as each of them gets the list."""
    text = " ".join(f"same{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text)] * 20, "doc_id long, text string")
    source = repeats._rows(rows, "doc_id", "text")
    items = substring_dedup.items
    table = repeats._table(source, lambda column: repeats.anchors_of(items(column), 13, 5).hashes, 22)
    common = repeats.common_anchors(source, items, 13, 5, table, 64, hot)
    shared = spark.sparkContext.broadcast((table > 1, common, None))
    (found,) = repeats._repeated(source, items, 13, 5, shared, 64).collect()
    anchors = np.frombuffer(b"".join(found["anchors"]), np.uint64)
    assert len(anchors) == len(set(anchors.tolist())) > 2
    cut = suffix_dedup.remove_repeats(rows, "doc_id", "text", ["doc_id"], hot=hot)
    assert [r["n_removed"] for r in cut.collect()] == [len(text)] * 20


def test_empty_tables(empty):
    assert substring_dedup.remove_earlier(empty, "doc_id", "text", ["doc_id"]).collect() == []
    assert suffix_dedup.remove_repeats(empty, "doc_id", "text", ["doc_id"]).collect() == []


def test_texts_without_repeats_keep_their_columns(odd):
    found = suffix_dedup.without_repeats(odd, "doc_id", "text")
    assert found.columns == odd.columns and found.count() == len(ODD)
    texts = {r["row"]: r["text"] for r in found.collect()}
    assert texts[5] is None and texts[6] == "" and texts[8] == "one two"
    assert texts[3].startswith("before") and "Word30" not in texts[3] and texts[17] == ""


def test_queries_over_whole_tables(spark, tables):
    documents = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    words = queries.QUERIES["op2_suffix_automata"](spark, tables)
    same(words.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), earlier(documents))
    cut = queries.QUERIES["op3_suffix_sort"](spark, tables)
    same(cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), anywhere(documents))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=4), st.text("ab", max_size=14))
def test_automaton_gives_matching_statistics(added, asked):
    automaton = substring_dedup.SuffixAutomaton()
    for text in added:
        automaton.add(list(text))
    expected = [
        max((n for n in range(end + 1) if any(asked[end - n : end] in t for t in added)), default=0) for end in range(1, len(asked) + 1)
    ]
    assert automaton.statistics(list(asked)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=12))
def test_suffix_sort_is_lexicographic(texts):
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in data])
    begin = ends - np.array([len(t) for t in data])
    suffixes = suffix_dedup.Suffixes(np.frombuffer(b"".join(data), np.uint8), begin, ends)
    groups = np.zeros(len(data), np.int64)
    order = suffixes.sort(groups)
    assert [data[i] for i in order] == sorted(data)
    common = suffixes.verified(order, groups)
    for at in range(1, len(order)):
        a, b = data[order[at - 1]], data[order[at]]
        assert common[at] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


# --- strings that have one hash, long texts, equal units ------------------------------------------


def test_the_twins_have_one_polynomial_hash_and_two_word_hashes():
    buffer = np.frombuffer("".join(TWINS).encode(), np.uint8)
    one, two = byte_hashes(buffer)(np.array([0, 1024]), np.array([1024, 2048]))
    assert one == two
    buffer = np.frombuffer(" ".join(TWINS).encode(), np.uint8)
    first, second = Words(buffer, np.array([0, len(buffer)]), NOT_BLANK).hashes(buffer)
    assert first != second


def test_texts_that_have_one_hash(spark):
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, "x " + TWINS[0]), (4, TWINS[1] + " " + " ".join(f"w{i}" for i in range(20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(found, anywhere(rows))
    found = substring_dedup.remove_earlier(df, "doc_id", "text", ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(found, earlier(rows))


def long_rows():
    """Texts of more than a slice (1 MB), one of them twice, and a passage that all share."""
    pick = random.Random(9)
    words = [f"{pick.randrange(10**6):x}é" for _ in range(120_000)]
    passage = " ".join(f"passage{i}" for i in range(60))
    long = " ".join(words) + " " + passage
    return [(1, long), (2, "start " + long[:700_000] + passage), (3, passage), (4, long), (5, None)]


def test_long_texts(spark):
    rows = long_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(found, anywhere(rows))
    found = substring_dedup.remove_earlier(df, "doc_id", "text", ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(found, earlier(rows))


def test_units_are_sent_once_and_found_again(spark, monkeypatch):
    """The same results whether a task remembers what it has sent or forgets it at once."""
    rows = [(i, f"own{i} " * (i % 3) + PASSAGE + f" end{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for limit in (repeats.SENT, 0):
        monkeypatch.setattr(repeats, "SENT", limit)
        found = suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        same(found, anywhere(rows))


def test_cuts_at_whole_characters(spark):
    rows = [(1, "aé" + "ü" * 150), (2, "bè" + "ü" * 150 + "ê"), (3, "c" * 250), (4, "€" * 100), (5, "c" * 250), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row in suffix_dedup.without_repeats(df, "doc_id", "text").collect():
        text = dict(rows)[row.doc_id]
        assert (row.text is None) == (text is None) and "�" not in (row.text or "")
        assert (row.text or "") == "" or set(row.text) <= set(text)


def test_equal_units_are_settled_without_their_bytes(spark, monkeypatch):
    """No bytes travel for anchors whose units are all equal, and a range that only one of them lies in stays."""

    def none(*_):
        raise AssertionError("bytes of a unit are sent")

    rows = [(i, PASSAGE) for i in range(40)] + [(40, "short"), (41, None), (None, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    with monkeypatch.context() as patch:
        patch.setattr(repeats, "_digests", none)
        same(suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"]).select(columns).collect(), anywhere(rows))
    rows += [(50 + i, f"own{i} " * (i % 7) + PASSAGE[i:] + f" end{i % 4}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"]).select(columns).collect(), anywhere(rows))


def test_slots_are_counted(spark, monkeypatch):
    """As bits, those that reach a number by their counts, however many tasks and sends the hashes come in."""
    monkeypatch.setattr(repeats, "COUNTED", 200)
    pick = random.Random(4)
    texts = [" ".join(f"w{pick.randrange(2)}" for _ in range(300)) for _ in range(30)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    hashes = lambda column: repeats.anchors_of(substring_dedup.items(column), 13, 5).hashes
    for bits in (9, 20):
        table = np.bincount(repeats._slot(hashes(rows.toArrow()["text"].combine_chunks()), bits), minlength=1 << bits)
        several, full, times, total = repeats._slots(rows, hashes, bits, 20)
        assert total == table.sum() > 0 and len(several) == 1 << bits
        assert several[np.arange(1 << bits)].tolist() == (table > 1).tolist()
        assert dict(zip(full.tolist(), times.tolist())) == {i: table[i] for i in np.flatnonzero(table >= 20).tolist()} != {}
        reached = repeats.Slots.of(full, 1 << bits)
        assert np.flatnonzero(reached[np.arange(1 << bits)]).tolist() == sorted(full.tolist()) and reached.any()
    assert not repeats.Slots.of(np.zeros(0, np.int64), 512).any()


def test_units_that_fit_a_shard_do_not_travel_as_windows(spark, monkeypatch):
    """A passage in 600 texts: of each text's units bytes are sent once, not those of each window in them."""

    def none(*_):
        raise AssertionError("windows are sent one by one")

    monkeypatch.setattr(repeats, "alike", none)
    rows = [(i, f"{i * 7919} own{i} " * (1 + i % 3) + PASSAGE + f" end{i * 31}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffix_dedup.remove_repeats(df, "doc_id", "text", ["doc_id"])
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), anywhere(rows))
