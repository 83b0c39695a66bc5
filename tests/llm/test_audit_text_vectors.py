"""Main text of pages, whitened vectors, and the overlap of filters."""

import html
import re
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plain_python import ODD, blank_separated, same
from tableflow.llm import filter_audit, main_text, queries, whitening
from tableflow.llm.labelled_pages import labelled_pages

# --- filters -------------------------------------------------------------------------------------


def plain_masks(rows):
    """(id, text, part) rows; the failing filters of each row."""
    firsts = {}
    for key, text, _ in rows:
        if key is not None:
            firsts[text or ""] = min(key, firsts.get(text or "", key))
    for key, text, part in rows:
        text = text or ""
        words = blank_separated(text)
        mask = {"A"} if len(words) < 200 else set()
        mask |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        mask |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        mask |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        mask |= {"E"} if key is not None and firsts[text] < key else set()
        yield key, part or "", mask


def plain_audit(rows, labels):
    masks = list(plain_masks(rows))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out = []
    for part in {p for _, p, _ in masks}:
        own = [(k, m) for k, p, m in masks if p == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for i, letter in enumerate(order):
                removed = [k for k, m in own if letter in m and not m & set(order[:i])]
                shapley[letter] += len(removed)
                kept = sum(not m & set(order[: i + 1]) for _, m in own)
                redundant = sum(letter in m and bool(m & set(order[:i])) for _, m in own)
                alone = sum(m == {letter} for _, m in own)
                steps.append((part, order, i + 1, kept, len(removed), redundant, alone, sum(k in good for k in removed), sum(k in toxic for k in removed)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"w{i}" for i in range(250))
MORE = [
    (20, LONG, "en"), (21, LONG, None), (22, LONG, ""), (19, LONG, "en"), (19, LONG, "fr"), (23, LONG + " $", "en"), (24, "A" + LONG.upper(), "fr"),
    (25, LONG[:700], "fr"), (26, LONG[:700] + "x", "fr"), (27, "", "en"), (28, "y" * 2_500_000, "en"), (29, "y" * 2_500_000, "en"),
]
ROWS = [(k, t, ["en", "fr", None][i % 3]) for i, (k, t) in enumerate(ODD)] + MORE
LABELS = [(20, 1, 0), (21, 0, 1), (21, 1, 1), (2, 1, None), (13, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("held, pieces", [(filter_audit.HELD, 4), (300, 4), (300, 1000)])
def test_audit_of_odd_rows(spark, monkeypatch, held, pieces):
    """Small tries are emptied all the time; with many pieces, heads are heavy and their rows are dealt twice."""
    monkeypatch.setattr(filter_audit, "HELD", held)
    found_heavy = filter_audit._heavy_prefixes
    monkeypatch.setattr(filter_audit, "_heavy_prefixes", lambda texts, _: found_heavy(texts, pieces))
    docs = spark.createDataFrame([(*r, 1, "m") for r in ROWS], "doc_id long, text string, lang string, n int, mask string").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    same(filter_audit.audit(docs, "doc_id", "text", "lang", labels).select(*AUDIT).collect(), plain_audit(ROWS, LABELS))


def test_audit_of_hot_copies(spark):
    """A third of the rows is one text, a third shares one long opening."""
    rows = [(i, LONG if i % 3 == 0 else LONG + str(i % 40) if i % 3 == 1 else f"{i} {LONG}", "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    assert filter_audit._heavy_prefixes(texts, 32)[1]
    same(filter_audit.audit(docs, "doc_id", "text", "lang", labels).select(*AUDIT).collect(), plain_audit(rows, LABELS))


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, "doc_id", "text", "lang", labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert filter_audit.audit(one, "doc_id", "text", "lang", labels).count() == 600


def test_trie_compares_whole_texts():
    trie = filter_audit.Trie()
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 300, b"b" * 299 + b"c", "é".encode(), "è".encode()]
    nodes = [trie.terminal(t) for t in texts]
    for node in nodes:
        node.rows = {}
    assert len({id(n) for n in nodes}) == len(texts)
    assert [trie.terminal(t) for t in texts] == nodes
    assert sorted(t for t, _ in trie.terminals()) == sorted(texts)


# --- vectors -------------------------------------------------------------------------------------


def plain_whitening(rows, count=32):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    centred = away / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    deviations = [sum(int(a) ** 2 for a in row) for row in away]
    return [k for k, _ in kept], deviations, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(found, rows, count):
    keys, deviations, whitened, explained = plain_whitening(rows, count)
    table = found.toPandas()
    assert sorted(zip(table.vec_id, table.component)) == sorted((k, c + 1) for k in keys for c in range(count))
    assert set(table.n) == {len(keys)} and table.identity_error.max() <= 1e-9 and table.identity_error.nunique() == 1
    assert all(dict(zip(table.vec_id, table.deviation))[k] == d for k, d in zip(keys, deviations))
    got = table.pivot(index="vec_id", columns="component", values="whitened").loc[keys].to_numpy()
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-7
    shares = table.groupby("component").explained.first().to_numpy()
    assert np.abs(shares / explained - 1).max() < 1e-9


def test_whitening_of_a_spectrum(spark):
    """Variances over six orders of magnitude, far from the origin, with rows to leave out and clashing names."""
    made = np.random.default_rng(3).standard_normal((400, 12)) * np.logspace(3, 0, 12) + 1000
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(k, v, 7) for k, v in rows + odd], "vec_id long, embedding array<double>, component int")
    check_whitening(whitening.whiten(df.repartition(5), "vec_id", "embedding", 8), rows, 8)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema), "vec_id", "embedding").count() == 0


def test_whitening_of_fewer_directions_than_dimensions(spark):
    """Repeated rows and equal variances: two components in four dimensions, each vector counted as often as it is there."""
    rows = [(1, [1.0, 0.0, 0.0, 5.0]), (1, [1.0, 0.0, 0.0, 5.0]), (2, [-1.0, 0.0, 0.0, 5.0]), (None, [-1.0, 0.0, 0.0, 5.0]), (3, [0.0, 1.0, 1.0, 5.0]), (4, [0.0, -1.0, -1.0, 5.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").toPandas()
    assert len(found) == 12 and found.identity_error.max() < 1e-9 and found.vec_id.isna().sum() == 2
    assert found.explained.groupby(found.component).first().round(9).tolist() == [0.5, 0.5]


def test_whitening_of_equal_variances(spark):
    rows = [(i, [2.0 * ((i >> b) & 1) for b in range(4)]) for i in range(16)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").toPandas()
    assert len(found) == 64 and found.identity_error.max() < 1e-9
    assert np.allclose(found.groupby("vec_id").whitened.apply(lambda w: (w**2).sum()), 4)


def test_large_entries_are_exact_or_fail(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [0.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="deviation"):
        whitening.whiten(spark.createDataFrame(rows, schema), "vec_id", "embedding").collect()
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0])], schema), "vec_id", "embedding").collect()


def test_whitening_query(spark, tables):
    data = pq.read_table(f"{tables}/embeddings.parquet").to_pydict()
    rows = list(zip(data["vec_id"], data["embedding"]))
    check_whitening(queries.QUERIES["op12_lanczos"](spark, tables), rows, 32)


# --- pages ---------------------------------------------------------------------------------------


def plain_article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


def test_main_text_query(spark, tables):
    """The pages of the table have their main text in an article element."""
    data = pq.read_table(f"{tables}/pages.parquet").to_pydict()
    expected = [(i, u, plain_article(h), len(plain_article(h))) for i, u, h in zip(data["page_id"], data["url"], data["html"])]
    same(queries.QUERIES["op11_block_crf"](spark, tables).collect(), expected)


def test_held_out_pages():
    """Pages of other seeds: nearly every block, and most pages whole."""
    model, wrong, blocks, pages = main_text.fitted(), 0, 0, 0
    for page in labelled_pages(200, seed=5):
        found, labels = main_text.labelled_blocks(page)
        errors = sum(a != bool(b) for a, b in zip(model.labels(found), labels))
        wrong, blocks, pages = wrong + errors, blocks + len(labels), pages + (errors > 0)
    assert wrong <= 0.005 * blocks and pages <= 10


PROSE = "Main text runs over several words, and it ends here."


def test_layouts_of_other_sites():
    body = f"<h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    wanted = " ".join(["A title", PROSE, PROSE])
    extras = [
        "<nav><a href=/>Home</a> <a href=/x>News</a></nav>", "<div class='sidebarLeft'><p>Other stories that people read today.</p></div>",
        "<div id=cookieBanner><p>We use cookies to make this site work for you.</p><button>Accept</button></div>",
        "<footer><p>All rights are reserved by the owners of this site.</p></footer>", "<form><label>Mail</label><input><p>Get the news by mail.</p></form>",
        "<section class='comments-area'><p>I do not think that this is right at all.</p></section>", "<div class='ad-box'>Buy two shoes for the price of one.</div>",
        "<script>if (a < b) document.write('<p>no</p>')</script>", "<style>p > a {color: red}</style>", "<!-- <p>no</p> -->",
    ]
    model = main_text.fitted()
    for container in ("article", "main", "div class='post-content'"):
        page = f"<{container}>{body}</{container.split()[0]}>"
        for extra in extras:
            for made in (extra + page, page + extra, extra + page + extra):
                assert model.main_text(f"<body>{made}</body>") == wanted, made
    assert model.main_text(f"<body>{extras[0]}<article>{body}{extras[5]}</article>{extras[3]}") == wanted


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []), (" \n ", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a&amp;b&lt;&eacute;&#233;&nope;&am", ["a&b<éé&nope;&am"]),
        ("<p>a \n\t b<br>c<i>d</i></p>", ["a b", "cd"]), ("<p>x</p><scr", ["x"]), ("a < b and 3<4", ["a < b and 3<4"]), ("<!-- a --><p>b<!-- c", ["b"]),
        ('<p title="a>b">c</p>', ["c"]), ('<p title="a>b', ["b"]), ("<SCRIPT>a</script >b", ["b"]), ("<script>a", []), ("<title>t</title>b", ["b"]),
        ("</div></p>a</b>", ["a"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<![CDATA[x]]>y", ["y"]), ("<p\nclass=x>a</p\n>b", ["a", "b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>" + "x " * 400_000, [("x " * 400_000).strip()]),
    ],
)
def test_blocks(page, blocks):
    assert [b.text for b in main_text.blocks_of(page)] == blocks


def test_left_out_end_tags():
    found = main_text.blocks_of("<article><p>a<div>b</div><nav><ul><li>c<li>d</ul></nav>e</article>f")
    assert [(b.text, [t for t, _ in b.path]) for b in found] == [
        ("a", ["article", "p"]), ("b", ["article", "div"]), ("c", ["article", "nav", "ul", "li"]), ("d", ["article", "nav", "ul", "li"]), ("e", ["article"]), ("f", []),
    ]


def test_viterbi_is_the_best_of_all_paths():
    random = np.random.default_rng(1)
    for n in range(1, 7):
        odds, steps = random.standard_normal(n) * 2, random.standard_normal((2, 2))
        model = main_text.Model({}, steps.tolist())
        model.evidence = lambda _, odds=odds: odds.tolist()
        score = lambda path: sum(o for o, p in zip(odds, path) if p) + sum(steps[a, b] for a, b in zip(path, path[1:]))
        paths = [tuple((i >> b) & 1 for b in range(n)) for i in range(1 << n)]
        assert tuple(map(int, model.labels([None] * n))) == max(paths, key=score)


def test_extract_of_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, f"<article><p>{PROSE}</p></article>", None), (2, "<nav><a>x</a></nav>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = main_text.extract(pages, "html").select("page_id", "text", "n_chars").collect()
    same(found, [(1, "", 0), (1, "", 0), (None, PROSE, len(PROSE)), (2, "", 0)])
    assert main_text.extract(pages.limit(0), "html").count() == 0
