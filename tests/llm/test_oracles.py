"""The SQL of the corpus queries against plain versions and against the queries."""

import duckdb
import pandas as pd
import pytest

from tests import check
from tests.conftest import SF_DIR
from tests.llm import brute
from tests.llm.test_operators import untidy_rows
from tripleweft.llm import oracles
from tripleweft.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_minhash_near_dedup", "op6_warc", "op10_decontamination"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert check.compare(QUERIES[name](spark, SF_DIR), check.connect(SF_DIR), ORACLES[name]) is None


def test_sql_on_untidy_texts():
    rows = untidy_rows()
    items = [(0, rows[3][1]), (1, None), (2, ""), (3, "One two three four"), (4, "x x x")]
    pages = [(k, t * 20 if t else t) for k, t in rows]
    con = duckdb.connect()
    tables = {"documents": (rows, "doc_id", "text"), "benchmark": (items, "item_id", "text"), "pages": (pages, "page_id", "html")}
    for name, (content, *columns) in tables.items():
        con.register(name, pd.DataFrame(content, columns=columns))

    def by_id(sql: str) -> dict:
        return {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}

    assert by_id(oracles.SUBSTRING_DEDUP) == brute.substring_dedup(rows)
    assert by_id(oracles.NEAR_DUPLICATES) == brute.near_duplicates(rows)
    assert by_id(oracles.WARC) == brute.warc(pages)
    assert {r[:2] for r in con.execute(oracles.CONTAMINATION).fetchall()} == brute.contained(rows, items)
