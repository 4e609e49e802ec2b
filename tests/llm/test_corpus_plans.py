"""What the plans read, and that the native operators stay out of Python."""

import os
import re

import pytest

from cohortspark.llm import queries

from helpers import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op1_source_mixing", "op8_url_filter", "op10_secret_scan"])
def test_native_plans_have_no_python(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name, columns", [("op1_source_mixing", {"doc_id", "source"}), ("op6_license_scan", {"doc_id", "text"}), ("op8_url_filter", {"page_id", "url"})])
def test_only_needed_columns_are_read(spark, name, columns):
    text = plan(queries.queries()[name](spark, SF))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",") if c}
    assert read <= columns
