"""What the plans must and must not hold."""

import re

import pytest

from threadloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().toString()


NATIVE = [n for n in registry.QUERIES if re.match(r"r2_(2|3|4|5|6|7|9|12)_", n) and n not in ("r2_3_31_packed_evidence",)]


@pytest.mark.parametrize("name", NATIVE[::4])
def test_no_python_and_no_cross_product(spark, sf, name):
    p = plan(registry.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", p)


def test_scans_read_what_they_need(spark, sf):
    p = plan(registry.QUERIES["r2_6_2_participants"](spark, sf))
    assert set(re.findall(r"ReadSchema: (\S+)", p)) == {"struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>"}


def test_filters_reach_the_scan(spark, sf):
    p = plan(registry.QUERIES["r2_13_17_merge_sections"](spark, sf))
    assert "EqualTo(o_orderstatus,O)" in p


def test_top_k_is_cut_on_every_task(spark, sf):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["r2_8_1_timeline_page"](spark, sf))
