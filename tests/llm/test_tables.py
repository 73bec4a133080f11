"""Operators on embeddings, pages and the pipeline against brute force, and their edge cases."""

import collections
import html
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import components, embedding_forest, fixity, queries, wrapper_html

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_links(rows, limit=0.95):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = unit @ unit.T >= limit
    least = np.array([i for i, _ in good])
    while True:
        new = np.array([least[link[k]].min() for k in range(len(good))])
        if (new == least).all():
            break
        least = new
    out = collections.Counter((i, int(link[k].sum()) - 1, int(least[k])) for k, (i, _) in enumerate(good))
    names = [i for i, _ in good]
    return out + collections.Counter((i, 0, i) for i, _ in rows if i not in names)


@pytest.mark.parametrize("rows_cap", [4_000, 40])
def test_embedding_forest(spark, monkeypatch, rows_cap):
    """Also with leaves cut into blocks."""
    monkeypatch.setattr(embedding_forest, "LEAF_ROWS", rows_cap)
    monkeypatch.setattr(embedding_forest, "BLOCK_ROWS", max(rows_cap // 2, 10))
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 8)))]
    hot = rng.normal(size=8)
    rows += [(1000 + k, (hot + rng.normal(scale=0.02, size=8)).tolist()) for k in range(90)] + [(2000 + k, rows[3][1]) for k in range(30)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [1.0] * 7 + [None]), (3003, [1.0] * 7 + [float("nan")]), (3004, [1.0, 2.0]), (3005, [float("inf")] * 8), (3006, [])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, class string").repartition(3)
    got = embedding_forest.near_duplicates(frame, leaf=50)
    found = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect())
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_links(rounded)
    assert {i for i, _, _ in found} == {i for i, _, _ in want}
    assert sum(k[1] for k in found) >= 0.9 * sum(k[1] for k in want) and all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert len(set(found) & set(want)) >= 0.95 * len(want)
    assert embedding_forest.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_any_norm_and_length(spark):
    v = lambda *x: list(map(float, x))
    rows = [(1, v(1e200, 1e200, 0)), (2, v(1, 1, 0)), (3, v(1e-200, 1e-200, 1e-203)), (4, v(1, 2)), (5, v(2, 4)), (6, v(1, 2, 0)), (7, v(2, -1)), (8, v(5)), (9, v(7)), (None, v(3, 6))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_forest.near_duplicates(frame).collect()}
    assert {k: got[k] for k in range(1, 10)} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (2, 4), 5: (2, 4), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8)} and got[None][0] == 2


@pytest.mark.parametrize("sample", [30_000, 1_500])
def test_embedding_recall_beyond_the_sample(spark, monkeypatch, sample):
    """Recall of links at 0.95 and a little more, of ids divisible by 50 against all rows, with trees fitted on a part."""
    monkeypatch.setattr(embedding_forest, "MAX_SAMPLE", sample)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(6_000, 32))
    other -= (other * base[:6_000]).sum(1, keepdims=True) * base[:6_000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.99, (6_000, 1))
    x = np.concatenate([base, cosine * base[:6_000] + np.sqrt(1 - cosine**2) * other])
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_forest.near_duplicates(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, len(x), 50)
    links = (unit[asked] @ unit.T >= 0.95).sum(1) - 1
    assert links.sum() > 200 and all(got[k] <= n for k, n in zip(asked, links)) and sum(got[k] for k in asked) >= 0.9 * links.sum()


def test_embeddings_of_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    unit = np.array(t["embedding"].to_pylist(), dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = dict(zip(t["vec_id"].to_pylist(), (unit @ unit.T >= 0.95).sum(1) - 1))
    assert {r.vec_id: r.n_links for r in queries.op1_embedding_forest(spark, SF).collect()} == links


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(3, 3), (5, None), (9, 8), (8, 9), (160, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 7 for k in [7, *range(100, 161), *range(200, 240)]} | {8: 8, 9: 8}


PAGES = [
    (1, "http://a.example/1", "<html><body><nav><a>Home</a></nav><div class='text'><p>One &amp; two<p>three\n <b>fo</b>ur</div><div class=comments><p>Bad!</p></div><footer>c</footer></body>"),
    (2, "http://a.example/2", "<html><body><nav><a>Home</a></nav><div class='text'><p>Other words stand here<p>in this page</div><div class=comments><p>Good!</p></div><footer>c</footer></body>"),
    (3, "http://a.example/3", "<html><body><nav><a>Home</a></nav><div class='text'><p>Third page with prose<p>of its own &lt;kind&gt;</div><div class=comments><p>So so</p></div><footer>c</footer></body>"),
    (4, None, None), (5, "not a url", ""), (6, "http://b.example", "plain &eacute; text"), (6, "http://b.example", "plain &eacute; text"),
    (7, "http://b.example/x", "<article><header><h1>Title</h1></header><p>Body<aside>no</aside> text<script>if (a</p>b) x</script></p><form>q<input></form></article><p>outside"),
    (None, "http://c.example", "<main><ul><li>a<li>b</ul><!-- no --><style>p{}</style></main>"),
    (8, "http://d.example", "<div>" * 400 + "deep" + "</div>" * 400), (9, "http://e.example", "<p>" + "long words " * 40_000),
]


def test_wrapper_text_on_edge_cases(spark):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, text string, host int").repartition(3)
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in wrapper_html.extract(frame).collect())
    text = {1: "One & two three four", 2: "Other words stand here in this page", 3: "Third page with prose of its own <kind>", 4: "", 5: "", 6: "plain é text", 7: "Title Body text", None: "a b", 8: "deep", 9: ("long words " * 40_000).strip()}
    assert got == collections.Counter((i, text[i], len(text[i])) for i, *_ in PAGES)
    assert wrapper_html.extract(frame.limit(0)).count() == 0


def test_constants_of_a_host_are_template(spark):
    page = lambda k, body: (k, f"http://h.example/{k}", f"<body><div id=top>Welcome to our pages</div><div id=x>{body}<p>Written by our staff</div></body>")
    bodies = {k: f"<p>long prose, with many words, that only page {k} has" + "<p>and more of its prose" * (k % 3) for k in range(12)}
    frame = spark.createDataFrame([page(k, x) for k, x in bodies.items()], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrapper_html.extract(frame).collect()}
    assert got == {k: f"long prose, with many words, that only page {k} has" + " and more of its prose" * (k % 3) + " Written by our staff" for k in bodies}
    told = {k: (lambda p: (p[0], p[1], p[2].replace("<p>Written", "<div>Written")))(page(k, x)) for k, x in bodies.items()}
    frame = spark.createDataFrame(list(told.values()), "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in wrapper_html.extract(frame).collect()} == {k: f"long prose, with many words, that only page {k} has" + " and more of its prose" * (k % 3) for k in bodies}


def test_simple_tree_matching():
    tree = lambda *nodes: wrapper_html.Tree([x for x, _ in nodes], [p for _, p in nodes], [0] * len(nodes), [0] * len(nodes))
    pairs = wrapper_html.simple_tree_matching(tree(("a", -1), ("b", 0), ("c", 0)), tree(("a", -1), ("c", 0), ("b", 0), ("c", 0)))
    assert sorted(pairs) == [(0, 0), (1, 2), (2, 3)]
    assert wrapper_html.simple_tree_matching(tree(("a", -1)), tree(("b", -1))) == []


def test_pages_are_read_in_linear_time():
    import time

    for page in ("<a " * 350_000, "<a href='" * 120_000, "<!--" * 250_000, '<p class="' * 100_000 + ">", "<" * 1_000_000, "<div>" * 3_000 + "x"):
        began = time.thread_time()
        wrapper_html.main_text(wrapper_html.parse(page), None)
        assert time.thread_time() - began < 5


def test_wrappers_are_joined_where_they_are_many(spark, monkeypatch):
    want = sorted(map(tuple, wrapper_html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()))
    monkeypatch.setattr(wrapper_html, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wrapper_html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect())) == want


def article_texts(sf):
    import duckdb

    want = {}
    for i, page in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1]))
        want[i] = " ".join(html.unescape(inner).split())
    return want


@pytest.mark.parametrize("sf,least", [("0.001", 1.0), ("0.01", 0.95), ("0.1", 1.0)])
def test_wrapper_text_without_article_elements(spark, sf, least):
    want = article_texts(f"/root/testdata/sf{sf}")
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: r.text for r in wrapper_html.extract(renamed).collect()}
    assert sum(got[k] == want[k] for k in want) >= least * len(want)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_wrapper_text_on_the_table(spark, sf):
    assert {r.page_id: r.text for r in queries.op6_wrapper_text(spark, f"/root/testdata/sf{sf}").collect()} == article_texts(f"/root/testdata/sf{sf}")


def test_fixity_against_sql(spark):
    assert oracle.compare(queries.op7_merkle_audit(spark, SF), queries.OP7_SQL, SF) == ""


def test_fixity_on_edge_cases(spark):
    rows = [(k, f"http://x/{k}", f"page {k}") for k in [*range(-3, 200), 5_000]] + [(None, None, None), (7, "http://x/7", "page 7"), (8, None, ""), (8, None, None)]
    frame = lambda r: fixity.records(spark.createDataFrame([(*x, 0) for x in r], "page_id long, url string, html string, digest int"))
    told = lambda a, b: sorted((str(r.number), r.n_primary, r.n_replica) for r in fixity.audit(frame(a), frame(b)).collect())
    assert told(rows, rows[::-1]) == []
    assert told(rows, [r for r in rows if r[0] != 5]) == [("5", 1, 0)]
    assert told(rows, [*rows, (9_999_999, "http://y", "new")]) == [("9999999", 0, 1)]
    assert told(rows, [(k, u, "x" if k == 100 else h) for k, u, h in rows]) == [("100", 0, 1), ("100", 1, 0)]
    swapped = [(k, u, {50: "page 51", 51: "page 50"}.get(k, h)) for k, u, h in rows]
    assert told(rows, swapped) == [("50", 0, 1), ("50", 1, 0), ("51", 0, 1), ("51", 1, 0)]
    assert len(told(rows, [])) == len(set(rows)) and told([], []) == []


def test_fixity_offsets_against_a_plain_loop(spark):
    """Offsets stand in order of number and digest, also where a number or null holds most rows, and go into the leaves' hashes."""
    rows = [(k, "u", "x" * (k % 7)) for k in range(70)] + [(5, "u", f"of five {k % 90}") for k in range(200)] + [(None, "u", f"of none {k}") for k in range(150)] + [(-2, None, None)]
    found = fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    want, begin = set(), collections.Counter()
    copies = collections.Counter((r.leaf, r.number, r.digest, r.size) for r in found.collect())
    for leaf, number, digest, size in sorted(copies, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        n = copies[leaf, number, digest, size]
        want.add((leaf, number, digest, size, n, begin[leaf]))
        begin[leaf] += size * n
    got = [(r.leaf, r.number, r.digest, r.size, r.copies, r.offset) for r in fixity.placed(found).collect()]
    assert len(got) == len(want) and set(got) == want
    leaves = {r.node: (r.records, r.bytes) for r in fixity.tree(found, 1)[0].collect()}
    assert leaves == {k: (sum(n for x, n in copies.items() if x[0] == k), begin[k]) for k in begin}


def masked(text):
    """The text with every secret replaced, by a plain loop over matches of the three kinds."""
    spans = []
    for pattern, group, least in ((r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)):
        spans += [m.span() for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return None if text is None else out + text[at:]


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from tidemark.llm import bpe, secrets
    from test_text_operators import brute_components, brute_contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "near_duplicates":
            assert sorted(i for i, _ in after) == sorted(i for i, n, c in brute_components(before, 5, 80, 100) if i == c)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {i for i, _ in after} == {i for i, n, hit, _ in brute_contamination(before, items) if not (hit and 20 * hit >= n)}
        if name == "secrets":
            assert len(after) == len(before)
            assert sum("[SECRET]" in (t or "") for _, t in after) == secrets.findings(kept, secrets.extend_ledger(kept)).where("size(spans) > 0").count()
            assert sorted(after, key=str) == sorted(((i, masked(t)) for i, t in before), key=str)
        kept = out
    coder = bpe.ByteBPE(bpe.read_vocabulary(queries.vocabulary_path()))
    assert {(r.doc_id, r.n_tokens) for r in p.tokens(spark, kept, SF).collect()} == {(r.doc_id, len(coder.encode(r.text))) for r in kept.collect()}


def test_pipeline_bears_edge_rows(spark):
    import corpus_pipeline as p

    rows = [(1, None), (1, None), (2, ""), (3, "same text of several words here"), (3, "same text of several words here"), (4, "same text of several words here"), (None, "no id"), (5, "token=abcdefghijk")]
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = collections.Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, SF).collect())
    assert one == collections.Counter([(1, None), (1, None), (2, ""), (3, rows[3][1]), (None, "no id"), (5, rows[7][1])])
    twins = spark.createDataFrame([(7, "words that stand here twice over", lang, "s", 3) for lang in ("fr", "de", "en")], docs.schema)
    for parts in (1, 3):
        assert [r.lang for r in p.near_duplicates(spark, twins.repartition(parts), SF).collect()] == ["de"]
    long = "very long text of many words " * 60_000
    clash = spark.createDataFrame([(k, t, "en", "s", 3, "r", 1) for k, t in ((1, long), (2, None), (3, "secret: abcdefgh123"))], "doc_id long, text string, lang string, source string, n_chars long, row string, version int")
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns and (name == "quality" or got.count() == 3)
    assert {r.doc_id: r.text for r in p.secret_scan(spark, clash, SF).collect()} == {1: long, 2: None, 3: "[SECRET]"}
    for _, stage in p.STAGES[2:]:
        assert stage(spark, docs, SF).count() == len(rows) and stage(spark, docs.limit(0), SF).count() == 0
    assert p.near_duplicates(spark, docs.limit(0), SF).count() == 0 and p.quality(spark, docs.limit(0), SF).count() == 0


STORY = [f"word{k} of the story that page {{0}} tells at some length" for k in range(25)]


@pytest.mark.parametrize("around", ["<div class=story>{0}</div><article>Teaser {1}</article>", "<div class='content with-sidebar'>{0}</div>", "<div id='search-results-main'>{0}</div>", "<div class='post share-enabled'>{0}</div>", "<div class=wrap><div class='post share-enabled'>{0}</div><div class=comments><p>Bad {1}</p></div></div>", "<main><article>{0}</article></main><div class=comments>{0}{0}</div>"])
def test_tags_and_words_of_class_are_evidence_only(spark, around):
    story = lambda k: "".join(f"<p>{x.format(k)}" for x in STORY)
    pages = [(k, f"http://h.example/{k}", f"<body><nav>Menu</nav>{around.format(story(k), k)}<footer>by us</footer></body>") for k in range(8)]
    got = {r.page_id: r.text for r in wrapper_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    want = {k: " ".join(x.format(k) for x in STORY) for k in range(8)}
    assert got == {k: want[k] for k in want}


def test_long_and_deep_pages_are_aligned_in_linear_time():
    import time

    for page in ("<body><article>" + "<h2>head</h2><p>some words here of a text</p>" * 23_000 + "</article>", "<div>" * 20_000 + "x" + "</div>" * 20_000, "".join(f"<div id=n{k}>w</div>" for k in range(10_000)), "<script>" + "</script " * 100_000, "<div>" * 3_000 + "</x>" * 200_000, "".join(f"<div class=n{k % 9}><div>a<div>b{k}</div></div></div>" for k in range(10_000))):
        began = time.thread_time()
        root = wrapper_html.parse(page)
        tree = wrapper_html.skeleton(root)
        pairs = wrapper_html.simple_tree_matching(tree, tree)
        wrapper_html.main_text(root, wrapper_html.induce(tree, 5, {i: 5 for i, _ in pairs}, {}))
        assert time.thread_time() - began < 8 and len(pairs) == len(tree.label)


def test_tree_matching_is_the_largest():
    import functools
    import random

    rng = random.Random(6)

    def tree(n):
        parent, labels, path = [-1], ["r"], [0]
        for k in range(1, n):
            del path[rng.randrange(1, len(path) + 1) :]
            parent.append(path[-1])
            labels.append(rng.choice("abc"))
            path.append(k)
        return wrapper_html.Tree(labels, parent, [0] * n, [0] * n)

    def largest(a, b):
        p, q = a.children(), b.children()

        @functools.cache
        def size(i, j):
            if a.label[i] != b.label[j]:
                return 0
            best = [[0] * (len(q[j]) + 1) for _ in range(len(p[i]) + 1)]
            for u, x in enumerate(p[i]):
                for v, y in enumerate(q[j]):
                    best[u + 1][v + 1] = max(best[u][v + 1], best[u + 1][v], best[u][v] + size(x, y))
            return 1 + best[-1][-1]

        return size(0, 0)

    for _ in range(300):
        a, b = tree(rng.randrange(1, 25)), tree(rng.randrange(1, 25))
        pairs = wrapper_html.simple_tree_matching(a, b)
        assert len(pairs) == largest(a, b) and all(a.label[i] == b.label[j] for i, j in pairs)
        assert all((a.parent[i], b.parent[j]) in pairs for i, j in pairs if i)
