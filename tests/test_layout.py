from tallyforge.plans.layout import laid_out


def test_layout():
    sql = "select a,  b from t where x = 'from  here' and y in (1, 2) group by a -- note  kept"
    out = laid_out(sql)
    assert out.split("\n")[:3] == ["SELECT a, b", "FROM t", "WHERE x = 'from  here' AND y IN (1, 2)"]
    assert "-- note  kept" in out and laid_out(out) == out
