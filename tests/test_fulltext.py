"""The MATCH language over the stored index, against SQLite's FTS5 where that is built in."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from tidemark.operators import fulltext, retrieve
from tidemark.operators.commits import Tables

WORDS = "alpha beta gamma delta alphabet Élan one two three under the".split()


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(n)))
    return [(k, text(12), text(30)) for k in range(300)] + [(300, "alpha one", "two beta"), (301, "", "gamma " * 500), (302, "alpha", None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    tables = Tables(spark, str(tmp_path_factory.mktemp("index")))
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    fulltext.write(tables, frame.where("id < 150"), "id", {"a": F.col("a"), "b": F.col("b")})
    return fulltext.write(tables, frame.where("id >= 150"), "id", {"a": F.col("a"), "b": F.col("b")}, anew=False)


QUERIES = [
    "alpha", "alpha beta", '"alpha beta"', "alpha + beta", "alp*", '"one alp" *', "alpha OR gamma beta", "alpha NOT beta", "alpha NOT beta NOT one", "alpha AND beta NOT gamma OR two", "(alpha OR beta) AND (one OR two) NOT the", "a : alpha", "a : alpha beta", "{a b} : under + the",
    "- a : alpha", "a : (alpha OR b : beta)", "^alpha", "b : ^under", "NEAR(alpha beta)", "NEAR(alpha beta, 0)", 'NEAR("under the" one two, 3)', "NEAR(alpha beta gamma, 2) OR elan", 'a : NEAR(alpha "one two", 4)', "élan", "one two", '"one two"', "NEAR(one two, 0)", "alpha alpha", "a*",
]


@pytest.mark.parametrize("query", QUERIES)
def test_match_equals_sqlite(index, rows, query):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(a, b, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("insert into t (rowid, a, b) values (?, ?, ?)", rows)
    want = {i: round(r, 6) for i, r in con.execute("select rowid, bm25(t) from t where t match ?", (query,))}
    got = {r.doc: round(r.bm25, 6) for r in fulltext.search(index, query).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-4 for k in got)


@pytest.mark.parametrize("query", ["", "  ", '""', "alpha AND", "(alpha", "alpha )", "NEAR(alpha", "nocolumn : alpha", "OR alpha", "alpha ! beta", "- alpha", 'alpha "beta'])
def test_what_is_no_query_is_an_error(index, query):
    with pytest.raises(ValueError):
        fulltext.search(index, query)


def test_phrases_end_with_their_column(spark, index, rows):
    assert 300 not in [r.doc for q in ('"one two"', "NEAR(one two, 0)") for r in fulltext.search(index, q).collect()]
    docs = spark.createDataFrame([(1, "alpha one", "two beta"), (2, "x", "one two")], "id int, a string, b string")
    columns = {"a": F.col("a"), "b": F.col("b")}
    assert [r.id for r in retrieve.search(docs, "id", columns, [[("one", "two")]]).collect()] == [2]
    assert [r.id for r in retrieve.search(docs, "id", columns, [["one"]], near=[("one", "two", 0)]).collect()] == [2]


def test_a_search_reads_the_buckets_of_its_words(spark, index):
    every = index.read("postings")
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    one = index.read("postings", sorted({r[0] for r in every.where("term = 'gamma'").select(fulltext.bucket("lead")).distinct().collect()}))
    assert 0 < files(one) < files(every) and {"gamma"} <= {r.term for r in one.select("term").distinct().collect()} < set(map(str.lower, WORDS)) | {"elan"}
    told = fulltext._asked(one, [fulltext.Phrase(("gamma",))])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in told or "PartitionFilters: [isnotnull(bucket" in told
    assert "PushedFilters" in told and "gamma" in told


def test_empty_tables_and_documents_without_words(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    columns = {"a": F.col("a")}
    empty = spark.createDataFrame([], "id long, a string")
    assert fulltext.search(fulltext.write(tables, empty, "id", columns), "x").count() == 0
    some = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (4, "x")], "id long, a string")
    assert sorted((r.doc or 0) for r in fulltext.search(fulltext.write(tables, some, "id", columns), "x").collect()) == [0, 4]
