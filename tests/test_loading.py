"""The exports of the loaders' queries give each rule a row that no earlier rule takes."""

import duckdb
import pytest

from provender.plans import loading
from provender.registry import ORACLES
from tests.test_oracles import SF


@pytest.mark.parametrize("name, rules", [("load_vendor_rules", loading.BERKELEY_RULES), ("load_ordered_units", loading.SANTA_CRUZ_RULES), ("load_purchase_units", loading.RIVERSIDE_RULES)])
def test_each_rule_has_rows(name, rules):
    sql = ORACLES[name]
    view = sql.rstrip().rsplit(" ", 1)[-1]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    first = "CASE " + " ".join(f"WHEN ({w}) IS NOT NULL THEN {i}" for i, (w, _) in enumerate(rules)) + " ELSE -1 END"
    found = {r for (r,) in con.execute(f"{sql[: sql.rindex('SELECT ord, title AS raw_name')]} SELECT DISTINCT {first} FROM {view}").fetchall()}
    assert found == {-1, *range(len(rules))}
