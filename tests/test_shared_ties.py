"""More queries on suppliers that share tickers: as their SQL, once its ties have an order."""

import pytest

import __spark_entry__ as entry
from test_shared_tickers import _in_order, _rows, shared  # noqa: F401

CHOSEN = {
    "PARTITION BY ticker, date ORDER BY abs(d)": "PARTITION BY ticker, CAST(date AS DATE) ORDER BY abs(d)",
    "CAST(date AS DATE) ORDER BY v DESC, date": "CAST(date AS DATE) ORDER BY v DESC, date DESC",
}


@pytest.mark.parametrize("name", ["candidates", "clean_bars", "ema_cross", "equity_curve", "ewm_halflife"])
def test_rows_of_shared_tickers_are_those_of_the_ordered_sql(spark, shared, name):  # noqa: F811
    folder, con = shared
    frame = entry.queries()[name](spark, folder).toPandas()
    sql = _in_order(entry.oracle_sql()[name])
    for tied, ordered in CHOSEN.items():
        sql = sql.replace(tied, ordered)
    wanted = con.execute(sql).df()[list(frame.columns)]
    if name == "ema_cross":  # further on its SQL's weights of bars, 11/9 to the power of their number, leave the range of doubles
        frame, wanted = (f[f.date.astype(str) < "2000-04-01"] for f in (frame, wanted))
    key = lambda r: tuple(map(str, r))
    assert len(frame) and sorted(map(key, _rows(frame))) == sorted(map(key, _rows(wanted)))
    if name in ("candidates", "clean_bars"):
        assert not frame.duplicated(["ticker", "date"]).any()
