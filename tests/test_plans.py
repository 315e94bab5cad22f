"""Plans that would not grow well must not appear."""

import contextlib
import io

import pytest

from quillgraph.plans import registry

#: A table of one row is a nested loop on purpose.
NESTED = {"lex_bm25"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_products(spark, sf_small, name):
    text = plan(registry.QUERIES[name](spark, sf_small))
    assert "CartesianProduct" not in text
    assert name in NESTED or "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_pushdown_and_pruning(spark, sf_small):
    text = plan(registry.QUERIES["row_value_in"](spark, sf_small))
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    text = plan(registry.QUERIES["exact_dup_docs"](spark, sf_small))
    assert "n_chars" not in text
