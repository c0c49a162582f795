"""Queries on pages against their SQL twins, on pages made for it."""

import duckdb
import pandas as pd
import pytest

from quillsift.plans import catalog

from test_catalog import rows


def page(quotes, chars):
    """A page whose confirmation begins near character ``chars``, after quotation marks written as references."""
    filler = "&quot;a&quot; &amp; &amp;quot; &copy; " * quotes
    filler += "x" * (chars - len(filler.replace("&amp;", "&")))
    return f'<html><body><nav><a href="/Sports">s</a></nav><ul><li>{filler}</ul><footer>&copy; us</footer></body></html>'


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    made = [(1000 * q + n, f"https://www.a.example.org/x/{n}", page(q, n)) for q in (0, 1, 5) for n in range(5930, 6010)]
    made += [(7, "https://a.example.org/1", page(0, 9)), (7, "https://a.example.com/2", page(0, 9)), (8, None, page(0, 9)), (9, "https://a.example.org/3", None), (10, "https://a.example.org/4", "<html><body>&am")]
    pd.DataFrame(made, columns=["page_id", "url", "html"]).to_parquet(d / "pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["form_pages", "done_gate", "confirmation_pages"])
def test_twin_on_odd_pages(spark, odd_pages, name):
    """References before the 6000th character, ids that repeat, no url and no page."""
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{odd_pages}/pages.parquet'")
    mine = rows(catalog.QUERIES[name](spark, odd_pages).toPandas())
    assert mine == rows(duck.sql(catalog.ORACLES[name]).df())
