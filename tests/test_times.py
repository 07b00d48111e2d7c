"""The grammar of times and the writings of names, case by case."""

import pytest

from tidemark.functions.times import times
from tidemark.operators import text

CASES = {
    "On 2024-03-11 it": ["DATE:2024-03-11"],
    "at 2024-03-11T10:20:30Z sharp": ["DATE:2024-03-11T10:20:30Z"],
    "at 2024-03-11 10:20:30.123+01:00": ["DATE:2024-03-11 10:20:30.123+01:00"],
    "3/11/24 and 03-11-2024": ["DATE:3/11/24", "DATE:03-11-2024"],
    "11.3.2024 but version 1.2.3": ["DATE:11.3.2024"],
    "20240311 20241399 20240311102030": ["DATE:20240311", "DATE:20240311102030"],
    "March 11, 2024; Mar. 3rd; april 2023; 11th of March, 2024": ["DATE:March 11, 2024", "DATE:Mar. 3rd", "DATE:april 2023", "DATE:11th of March, 2024"],
    "Q1 2024, q3, 1Q24, H1 '24, 2H FY2025, Q5": ["PERIOD:Q1 2024", "PERIOD:q3", "PERIOD:1Q24", "PERIOD:H1 '24", "PERIOD:2H FY2025"],
    "the second fiscal quarter of fiscal 2024": ["PERIOD:second fiscal quarter of fiscal 2024"],
    "fiscal year ended 2024, FY'24, CY2023, calendar 2022": ["PERIOD:fiscal year ended 2024", "PERIOD:FY'24", "PERIOD:CY2023", "PERIOD:calendar 2022"],
    "last year, prior-year, the coming fiscal quarters, trailing twelve months": ["RELATIVE:last year", "RELATIVE:prior-year", "RELATIVE:coming fiscal quarters", "RELATIVE:trailing twelve months"],
    "year-over-year and quarter on quarter, year to date, two years ago, today": ["RELATIVE:year-over-year", "RELATIVE:quarter on quarter", "RELATIVE:year to date", "RELATIVE:two years ago", "RELATIVE:today"],
    "at 10:30 p.m. or 23:59:59, not 25:00": ["TIME:10:30 p.m.", "TIME:23:59:59"],
    "in 2019 with $2020 and 2021 shares, 1,2022 or 2023.": ["YEAR:2019", "YEAR:2023"],
    "x2019 2019x 20190 1819": [],
    "In March we march; May may": ["MONTH:March"],
    "": [],
}


@pytest.mark.parametrize("said", CASES)
def test_phrases(said):
    assert [f"{k}:{said[a:b]}" for a, b, k in text.spans(said, [times])] == CASES[said]


@pytest.mark.parametrize(
    "kind,name,said,want",
    [
        ("COMPANY", "Acme Widgets, Inc.", "ACME Widgets and Acme Widgets Inc. by Acme; acmes", ["ACME Widgets", "Acme Widgets Inc.", "Acme"]),
        ("COMPANY", "First Bank Corp", "First of all, First Bank", ["First Bank"]),
        ("PERSON", "Jane Q. Public", "Jane Public, Public Jane, J. Public, Jane Q Public; the public", ["Jane Public", "Public Jane", "J. Public", "Jane Q Public"]),
        ("PERSON", "Ada Lovelace", "Lovelace, Ada met Lovelace", ["Lovelace, Ada", "Lovelace"]),
        ("TICKER", "ACME", "ACME Acme acme XACME", ["ACME", "Acme"]),
        ("IDENTIFIER", "0000320193", "320193 0000320193 00320193 1320193", ["320193", "0000320193", "00320193"]),
    ],
)
def test_writings(kind, name, said, want):
    assert [said[a:b] for a, b, _ in text.spans(said, text.entity_rules([(kind, name)]))] == want
