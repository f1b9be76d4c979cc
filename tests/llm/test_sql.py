"""The queries that have SQL give the rows of their SQL."""

import duckdb
import pytest

from lodestone.llm import queries

TEXTS = [
    None, "", "   ", "one", "Ünï 3<4 & #tag\nx\n\nx\n" * 3, " ".join(f"w{i}" for i in range(40)), " ".join(f"W{i}" for i in range(40)) + " end",
    " ".join(f"w{i}" for i in range(25)) + " and " + " ".join(f"w{i}" for i in range(22)), "a b c\td e\n" * 30, "Four words are here", "four words ARE here",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sql"))
    docs = [(i, t, "en", [None, "s0", "s1"][i % 3], len(t or "")) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    pages = [(i, None, h) for i, h in enumerate(["<p>ä</p>", None, "", "<p>ä</p>", "x", ""])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(f"{d}/pages.parquet")
    vectors = [(i * 10, [((i * k) % 7 - 3) / 4 for k in range(1, 6)] if i % 9 else [None] * 5, 0) for i in range(40)]
    spark.createDataFrame([*vectors, (1000, None, 0), (1050, [float("nan")] * 5, 0)], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    found = queries.queries()[name](spark, tables)
    cols = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(*cols).collect()), key=str) == sorted(want, key=str)
