"""Checks that never refuse prove nothing: each query here has rows on every side of its rule, corrupted ones by construction."""

import os

import pytest

from quarry import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SIDES = {
    ("bind_cells", "status"): {"bound", "no_identity", "no_date", "not_on_page"},
    ("select_cells", "status"): {"bound", "missing"},
    ("reviewed_operands", "outcome"): {"accepted", "not approved", "source text changed", "unsupported unit"},
    ("row_extraction_agreement", "outcome"): {"accepted", "readers disagree"},
    ("segments_to_group", "reconciled"): {True, False},
    ("accounting_identities", "holds"): {True, False},
    ("reconcile_identities", "holds"): {True, False},
    ("cell_select_identity", "status"): {"conflicting"},
    ("draft_checks", "outcome"): {"schema", "citation", "quote", "whole_row", "number", "accepted"},
    ("row_scores", "all_match"): {True, False},
    ("metamorphic_signature", "same"): {True, False},
    ("wording_families", "same"): {True, False},
    ("evidence_relevance", "reason"): {"other_subject", "related_party", "footnote", "allowed"},
    ("repaired_drafts", "outcome"): {"accepted", "accepted_after_repair", "fallback"},
    ("operation_plan", "kind"): {"unsupported", "profit_gap", "year_difference", "change", "none"},
    ("report_vintage", "cba_restriction"): {None, "part_year", "other_month"},
    ("plan_behaviour", "behaviour"): {"answer", "abstain:outside_corpus", "abstain:personal", "abstain:future", "clarify:basis", "clarify:entity"},
}


@pytest.mark.parametrize(("name", "column"), sorted(SIDES))
def test_all_sides_are_met(spark, name, column):
    got = {r[0] for r in catalog.QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert SIDES[name, column] <= got, got


def test_every_constraint_breaks_somewhere(spark):
    from quarry.catalog.drafts import ALONE

    got = {r.broken for r in catalog.QUERIES["chunk_integrity"](spark, SF).select("broken").distinct().collect()}
    planted = {"version", "byte_size", "span_begins", "span_ends", "kind", "source_page", "unique_id", "dangling_parent", "parent_kind", "coverage"}
    assert planted <= got and got <= set(ALONE) | planted | {"literal", "no_parent"}


def test_follow_ups_take_over_one_thing(spark):
    from quarry.catalog.planning import QUESTIONS

    got = {r.turn: r.resolved for r in catalog.QUERIES["followup_rules"](spark, SF).filter("conv_id = -1 and inherits").collect()}
    at = {q: i for i, q in enumerate(QUESTIONS)}
    assert got[at["And NAB?"]] == "What was NAB cash profit in FY2025?"
    assert got[at["What about FY2024?"]] == "What was CBA total assets in FY2024?"
    assert got[at["And the weather?"]] == "And the weather?"
