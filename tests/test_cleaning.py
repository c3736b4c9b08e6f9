from decimal import Decimal

import pytest

from skumetry.operators import cleaning
from skumetry.policy import Policy

SQL, SCRIPT = Policy(), Policy(semantics="script")


@pytest.mark.parametrize("changes, kept", [
    ({"invoice_no": "C536379"}, False),
    ({"invoice_no": "c536380"}, True),
    ({"quantity": 0}, False),
    ({"quantity": -1}, False),
    ({"unit_price": "0.00"}, False),
    ({"unit_price": "-1.00"}, False),
    ({"stock_code": "POST"}, False),
    ({"stock_code": "DOT"}, False),
    ({"stock_code": "M"}, False),
    ({"stock_code": "85123a"}, False),
    ({"stock_code": "1234567"}, False),
    ({"stock_code": "85123\n"}, False),
    ({"stock_code": None}, False),
    ({"stock_code": "85123A"}, True),
    ({"stock_code": "22423"}, True),
    ({"stock_code": "ABCDEF"}, True),
    ({"customer_id": None}, True),
])
def test_cleaning_rules(lines, changes, kept):
    for policy in (SQL, SCRIPT):
        assert cleaning.clean_transactions(lines(changes), policy).count() == int(kept)


def test_line_without_invoice_number(lines):
    nameless = lines({"invoice_no": None})
    assert cleaning.clean_transactions(nameless, SQL).count() == 0
    assert cleaning.clean_transactions(nameless, SCRIPT).count() == 1


def test_line_revenue_is_exact(lines):
    row = cleaning.clean_transactions(lines({"quantity": 3, "unit_price": "0.10"}), SQL).first()
    assert row.revenue == Decimal("0.30")


def test_profile_counts_each_rule(lines):
    data = lines({}, {"invoice_no": "C1"}, {"quantity": -2, "unit_price": "0.00"}, {"stock_code": "POST"},
                 {"stock_code": None})
    row = cleaning.clean_profile(data, SQL).first().asDict()
    assert row == {
        "raw_lines": 5, "cancelled_lines": 1, "nonpositive_quantity_lines": 1,
        "nonpositive_price_lines": 1, "malformed_code_lines": 2, "clean_lines": 1,
    }


def test_dataset_profile(lines):
    data = lines({}, {"customer_id": None, "stock_code": "22423"}, {"customer_id": "1", "quantity": 2})
    row = cleaning.dataset_profile(cleaning.clean_transactions(data, SQL)).first()
    assert (row.clean_lines, row.n_skus, row.n_customers, row.total_revenue) == (3, 2, 2, Decimal("4.00"))
    assert str(row.first_date) == str(row.last_date) == "2011-03-01"


def test_null_violations(lines):
    data = lines({}, {"invoice_no": None}, {"invoice_no": None, "unit_price": None})
    found = {r.column_name: r.violations for r in
             cleaning.null_violations(data, ["invoice_no", "unit_price", "quantity"]).collect()}
    assert found == {"invoice_no": 2, "unit_price": 1, "quantity": 0}


def test_duplicate_keys(lines):
    data = lines({"invoice_no": "1"}, {"invoice_no": "1"}, {"invoice_no": "2"})
    assert [tuple(r) for r in cleaning.duplicate_keys(data, ["invoice_no"]).collect()] == [("1", 2)]
    assert tuple(cleaning.key_check(data, "t", ["invoice_no"]).first()) == ("t", 2, 1)
