"""Near copies, nearest vectors, archives, shards and the pipeline."""

import base64
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plain_python import ODD, TWINS, blank_separated, lower, same
from test_repeats import anywhere
from test_texts import coded, hits
from tableflow import workspace
from tableflow.llm import jaccard_join, queries, sharding, topk, warc
from compare import differences, open_tables


def shingles(text, size):
    words = blank_separated(lower(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def linked(rows, size=4, percent=85):
    """For each row: set size and the smallest key in its component."""
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, own in enumerate(sets):
        counts = {}
        for s in own:
            for j in holders.setdefault(s, []):
                counts[j] = counts.get(j, 0) + 1
            holders[s].append(i)
        for j, shared in counts.items():
            if 100 * shared >= percent * (len(own) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if key is None else key)
    shown = lambda v: None if v == math.inf else v
    return [(key, len(s), shown(least[find(i)]) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("options", [{}, {"short": 1, "hot": 1, "bits": 16}])
def test_components(odd, options):
    found = jaccard_join.set_components(odd, "doc_id", "text", **options)
    same(found.select("doc_id", "n_shingles", "component").collect(), linked(ODD))


def test_components_of_chains(spark):
    """Copies that change step by step: neighbours are linked, the ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 80])) for i in range(30)] + [(100 + i, "same words in each of these " * 3) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"short": 1}):
        found = jaccard_join.set_components(df, "doc_id", "text", **options)
        same(found.select("doc_id", "n_shingles", "component").collect(), linked(rows))


def test_components_of_texts_that_have_one_hash(spark):
    """Words whose polynomial hashes are equal: two documents, no link; with a real copy, one."""
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, f"a b c {TWINS[0]}"), (4, f"a b c {TWINS[1]}"), (5, f"A b c {TWINS[1]}"), (6, TWINS[0].upper())]
    found = jaccard_join.set_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    same(found.select("doc_id", "n_shingles", "component").collect(), linked(rows))


def test_components_of_long_texts(spark):
    """Sets of texts longer than a slice: a copy with a few words changed is linked, one of half the text is not."""
    words = [f"w{i % 60_000}x{i // 7}" for i in range(110_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000] + ["new"] * 3 + words[50_003:])), (3, " ".join(words[:55_000])), (4, "w1 w2")]
    found = jaccard_join.set_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    same(found.select("doc_id", "n_shingles", "component").collect(), linked(rows))


def test_jaccard_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.QUERIES["op10_jaccard_tiles"](spark, tables).collect(), linked(rows))


def test_one_of_each_group_stays(odd, empty):
    left = jaccard_join.keep_first(odd, "doc_id", "text")
    assert left.columns == odd.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert (1, ODD[0][1]) in kept and not {2, 13} & {k for k, _ in kept}
    assert sum(not (t or "").split() for _, t in kept) == sum(not (t or "").split() for _, t in ODD)
    assert jaccard_join.keep_first(empty, "doc_id", "text").collect() == []


# --- nearest vectors -----------------------------------------------------------------------------

VECTORS = [
    (0, [0.5, -0.25, 0.1]), (1, [0.5, -0.25, 0.1]), (2, [0.5, -0.25, 0.1]), (50, [-1.0, 2.0, 0.0]), (3, None), (4, [0.1, None, 0.2]),
    (5, [math.nan, 0.0, 0.0]), (6, [math.inf, 0.0, 0.0]), (7, [1.0]), (100, [2.0]), (None, [1.0, 1.0, 1.0]), (8, [0.0, 0.0, 0.0]),
    (9, [3.0, 3.0, 3.0]), (10, [1e12, 0.0, 0.0]), (11, [4e6, 4e6, 0.0]),
]


def test_nearest_of_odd_vectors(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    found = topk.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 3).collect()
    good = {}
    for key, vector in VECTORS:
        if key is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good[key] = [math.floor(256 * x) for x in vector]
    expected = []
    for query in (k for k in good if k % 50 == 0):
        scores = [(-sum(a * b for a, b in zip(good[query], v)), k) for k, v in good.items() if k != query and len(v) == len(good[query])]
        expected += [(query, rank, k, -s) for rank, (s, k) in enumerate(sorted(scores)[:3], 1)]
    same(found, expected)
    assert topk.search(df.where("false"), "vec_id", "embedding", F.lit(True), 3).collect() == []


def test_bounds_stop_early_and_stay_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.floor(256 * rng.normal(size=(3000, 8))).astype(np.int64)
    values[::7] = values[0]
    found = topk.nearest(values, np.arange(3000), values[:40], np.arange(40), 5)
    for query in range(40):
        scores = values @ values[query]
        best = sorted((i for i in range(3000) if i != query), key=lambda i: (-scores[i], i))[:5]
        assert [f[1:] for f in found if f[0] == query] == [(i, scores[i]) for i in best]


def test_scores_of_blocks_before_close_later_ones(monkeypatch):
    """The k-th score is kept from block to block: of clustered candidates only a part is scored in full, and results stay exact."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    values = np.floor(256 * (centres[rng.integers(0, 40, 20000)] + 0.05 * rng.normal(size=(20000, 16)))).astype(np.int64)
    ids, asked = rng.permutation(20000), np.arange(0, 20000, 100)
    met, plain = [], topk.Best
    monkeypatch.setattr(topk, "Best", lambda *a: met.append(plain(*a)) or met[-1])
    found = topk.nearest(values, ids, values[asked], ids[asked], 5)
    scores = values[asked] @ values.T
    scores[np.arange(200), asked] = -(2**62)
    for query in range(200):
        best = sorted(range(20000), key=lambda i: (-scores[query, i], ids[i]))[:5]
        assert [f[1:] for f in found if f[0] == query] == [(ids[i], scores[query, i]) for i in best]
    assert sum(best.computed for best in met) < 200 * 20000 / 2


def test_nearest_sends_no_pair_of_blocks(spark, monkeypatch):
    """A query travels once per group of candidates, however many blocks that has, and a candidate once per strip of queries."""
    rows = [(i, [math.sin(i * 7 + j) * (1e13 if i == 30 and j == 1 else 1) for j in range(3 + (i % 11 == 0))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for setting, value in (("CANDIDATES", 16 * 16), ("QUERIES", 16 * 4), ("GROUPS", 3), ("GROUP", 16 * 300), ("ROWS", (40, 5)), ("FIRST", 10)):
        monkeypatch.setattr(topk, setting, value)
    found = topk.search(df, "vec_id", "embedding", F.col("vec_id") % 2 == 0, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan and "hashpartitioning(width" in plan and ", 8)" in plan
    scaled = [[math.floor(256 * x) for x in v] for _, v in rows]
    expected = []
    for query in range(0, 1200, 2):
        scores = [(-sum(a * b for a, b in zip(scaled[query], v)), i) for i, v in enumerate(scaled) if i != query and len(v) == len(scaled[query])]
        expected += [(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:4], 1)]
    same(found.collect(), expected)


# --- archives ------------------------------------------------------------------------------------


def test_archives_of_odd_pages(spark):
    pages = [(3, "http://a\r\nX: y", "same"), (1, "http://b", "same"), (2, None, None), (4, "u", ""), (4, "u", "other"), (None, "v", "same"), (5, "w", "é" * 70000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = workspace.new_folder(spark, "warc")
    index = warc.write_archives(df, "page_id", "url", "html", folder)
    found = warc.read_records(index).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    expected = []
    for key, _, html in pages:
        revisit = first[html or ""] != key
        expected.append((str(key) if key is not None else None, len((html or "").encode()), digest(html), "revisit" if revisit else "response", str(first[html or ""]) if revisit else None))
    same([(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], expected)
    assert {r["payload"] for r in found if r["key"] == "5"} == {("é" * 70000).encode()}
    chosen = warc.read_records(index.where("url = 'http://b'")).collect()
    assert [r["key"] for r in chosen] == ["1"]
    apart = warc.write_archives(df, "page_id", "url", "html", workspace.new_folder(spark, "warc"), least_bytes=5)
    assert apart.where("record_type = 'revisit'").count() == 0
    nothing = warc.write_archives(df.where("false"), "page_id", "url", "html", workspace.new_folder(spark, "warc"))
    assert warc.read_records(nothing).collect() == []


def test_ranges_are_joined():
    rows = [{"path": "p", "offset": o, "length": 10} for o in (0, 10, 100, 10 << 20)] + [{"path": "q", "offset": 5, "length": 10}]
    assert [len(r) for r in warc._ranges(rows)] == [3, 1, 1]


# --- shards --------------------------------------------------------------------------------------


def test_shards_of_odd_rows(odd, empty):
    found = sharding.shard_documents(odd, "doc_id", "text", sharding.tree(40), sharding.tree(41)).collect()
    assert len(found) == len(ODD)
    for row in found:
        assert row["grown_shard"] in (row["shard"], 40) and row["law"] == "key"
    sizes = [(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in ODD]
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], sizes)
    slots = {}
    for row in found:
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, "doc_id", "text", sharding.tree(3)).collect() == []


def plain_descent(key, leaves):
    """Region, rack and shard of a key, by the least draw on each level."""
    found, below = [], list(leaves)
    for level in ("region", "rack", "shard"):
        weights = {}
        for leaf in below:
            weights[getattr(leaf, level)] = weights.get(getattr(leaf, level), 0) + leaf.weight
        unit = lambda n: (int(hashlib.md5(f"{key}/{level}/{n}".encode()).hexdigest()[:13], 16) + 1) / 2**52  # noqa: E731, B023
        found.append(min(weights, key=lambda n: (-math.log(unit(n)) / weights[n], n)))
        below = [leaf for leaf in below if getattr(leaf, level) == found[-1]]
    return tuple(found)


def test_descent(spark):
    """As in plain Python, and not what one draw per shard would give."""
    leaves = [sharding.Leaf(s // 6, s // 2, s, 1.0 + s % 3) for s in range(13)] + [sharding.Leaf(9, 9, 99, 0.0)]
    rows = spark.range(3000).select("id", sharding.descend(F.col("id").cast("string"), leaves).alias("s")).collect()
    positive = [leaf for leaf in leaves if leaf.weight > 0]
    assert all(r["s"] == plain_descent(r["id"], positive)[2] for r in rows)
    flat = lambda k: min(positive, key=lambda f: -math.log((int(hashlib.md5(f"{k}/shard/{f.shard}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / f.weight)
    assert sum(flat(r["id"]).shard != r["s"] for r in rows) > 500
    assert spark.range(1).select(sharding.descend(F.lit("a"), [])).first()[0] is None


def test_weights_confine_movement(spark):
    """Shard 7 (rack 1, region 0) gets three times its weight."""
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    before = sharding.tree(40)
    after = [sharding.Leaf(s.region, s.rack, s.shard, 3.0 if s.shard == 7 else 1.0) for s in before]
    rows = keys.select(sharding.descend(F.col("k"), before).alias("a"), sharding.descend(F.col("k"), after).alias("b")).collect()
    place = {s.shard: s for s in before}
    moved = [(place[a], place[b]) for a, b in rows if a != b]
    assert moved and all(b.region == 0 for _, b in moved)
    assert all(b.rack == 1 for a, b in moved if a.region == 0)
    assert all(b.shard == 7 for a, b in moved if a.rack == 1)
    share = sum(b == 7 for _, b in rows) / 20000
    assert 0.06 < share < 0.085  # 3 of 42
    counts = [sum(a == s for a, _ in rows) for s in range(40)]
    assert max(counts) < 1.35 * 500 and min(counts) > 0.7 * 500


def test_a_new_shard_takes_rows_into_itself_only(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    for shards in (1, 7, 39, 40):
        before = sharding.tree(shards)
        rows = keys.select(sharding.descend(F.col("k"), before).alias("a"), sharding.descend(F.col("k"), sharding.grown(before)).alias("b")).collect()
        assert {b for a, b in rows if a != b} == {shards}
        assert abs(sum(b == shards for _, b in rows) / 20000 - 1 / (shards + 1)) < 0.2 / (shards + 1)


def test_shard_query(spark, tables):
    found = queries.QUERIES["op9_hash_tree"](spark, tables).collect()
    slots = {}
    for row in found:
        before = plain_descent(row["doc_id"], sharding.tree(40))[2]
        assert row["shard"] == before and row["grown_shard"] == plain_descent(row["doc_id"], sharding.grown(sharding.tree(40)))[2]
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_nearest_of_large_and_repeated_vectors(spark):
    """Components far beyond 32 bits are scored exactly, repeated ids and rows count each; what is no 64-bit score fails."""
    rows = [(50, [3.0, -1.0]), (50, [3.0, -1.0]), (1, [1e13, 0.5]), (2, [-(2.0**31), 1.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0]), (100, [-0.5, 4.0]), (4, [float("inf"), 1.0])]
    schema = "vec_id long, embedding array<double>"
    ask = lambda data: topk.search(spark.createDataFrame(data, schema), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    scaled = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if math.isfinite(v[0])]
    expected = []
    for query, q in scaled:
        if query % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), k) for k, v in scaled if k != query)
            expected.append([(query, k, -s) for s, k in scores])
    found = {(r.query_id, r.vec_id, r.score) for r in ask(rows)}
    assert {r for r in found if r[0] == 100} == set(expected[2][:5]) and {r for r in found if r[0] == 50} <= set(expected[0])
    with pytest.raises(Exception, match="64 bits"):
        ask([(50, [1e300]), (1, [1.0])])
    with pytest.raises(Exception):
        ask([(50, [1e13]), (1, [1e13])])


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, tables, name):
    assert differences(queries.QUERIES[name](spark, tables), open_tables(tables), queries.SQL[name]) is None


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = workspace.new_folder(spark, name)
        stage(spark, docs, tables).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        left[name] = (before, docs)
        assert docs.columns == columns or name == "tokens"
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    before, after = left["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    asked = [i for i, _ in pairs(before) if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in asked) >= 0.97 * len(asked)
    before, after = left["near_copies"]
    same([(i,) for i, _ in pairs(after)], [(k,) for k, _, c in linked(pairs(before), 5, 80) if k == c])
    before, after = left["repeats"]
    expected = {k: d for k, _, _, _, d in anywhere(pairs(before), whole=True)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(after)} == expected
    before, after = left["benchmark"]
    same([(i,) for i, _ in pairs(after)], [(h[0],) for h in hits(pairs(before), benchmark) if not h[-1]])
    before, after = left["tokens"]
    same(after.collect(), coded(pairs(before)))


def test_pipeline_of_odd_rows(spark, odd, tables):
    docs = odd.withColumn("n_chars", F.lit(1).cast("bigint"))
    text = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = workspace.new_folder(spark, name)
        stage(spark, docs, tables).write.parquet(path)
        before, docs = text(docs), spark.read.parquet(path)
        if name == "quality":
            assert len(text(docs)) <= len(before)
            docs = docs.union(spark.createDataFrame([(i, t, "e", 0, 1.5, 1) for i, t in ODD], docs.schema))  # whatever it thinks of them
        elif name == "near_copies":
            # Of equal rows, and of texts without words, which are linked with nothing, all or one stay.
            assert {k for k, n, c in linked(before, 5, 80) if k == c and n} == {k for k, t in text(docs) if blank_separated(t)}
        elif name == "repeats":
            expected = {(k, d) for k, _, _, _, d in anywhere(before, whole=True)}
            assert {(k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in text(docs)} == expected
        elif name == "tokens":
            same(docs.collect(), coded(before))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false").withColumn("n_chars", F.lit(1).cast("bigint")), tables).collect() == []
