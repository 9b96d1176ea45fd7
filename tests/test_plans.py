"""What the executed plans of the text queries hold: each pattern is tried once a row."""

import re

import pytest

from leadmill.functions import ownership
from leadmill.plans import catalogue, entity_catalogue, site_catalogue  # noqa: F401


def plan(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_ownership_tries_each_pattern_once(spark, sf_dir):
    # One more than the patterns: parameters that only track are told by a pattern too; hosts by another.
    assert len(re.findall("RLIKE", plan(spark, sf_dir, "website_ownership"))) <= len(ownership.PATHS) + len(ownership.TEXTS) + 2


@pytest.mark.parametrize(("name", "replaced", "exchanges"), [("repeated_runs", 3, 0), ("repeated_sentences", 3, 1), ("fact_candidates", 8, 0)])
def test_texts_are_split_once(spark, sf_dir, name, replaced, exchanges):
    held = plan(spark, sf_dir, name)
    assert len(re.findall("regexp_replace", held)) <= replaced
    assert len(re.findall(r"Exchange ", held)) <= exchanges


@pytest.mark.parametrize("name", ["similar_sections", "grouped_sections"])
def test_written_sections_are_not_broadcast(spark, sf_dir, name):
    held = plan(spark, sf_dir, name)
    assert "SortMergeJoin" in held and "Broadcast" not in held


def test_sections_of_sites_are_dealt_once(spark, sf_dir):
    assert len(re.findall(r"Exchange ", plan(spark, sf_dir, "dynamic_sections"))) == 1
