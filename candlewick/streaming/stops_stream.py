"""L6 + K3: trailing stops that persist from poll to poll.

A stop only ever gets tighter, and how tight a quote makes it depends on its price alone: rounding
keeps order, and a stored stop is a price of the symbol's grid. So the stop that polls one after
the other leave is the one that K3 gives at the best price seen so far, the highest bid for a BUY
and the lowest ask for a SELL. The state between polls is these two numbers per symbol, whatever the
number of open tickets. A maximum and a minimum do not depend on the order of quotes or files, are
pre-aggregated before the shuffle (hot symbols), and a closed ticket leaves nothing behind.

The positions are the book before the first quote. Null and NaN quotes are no quotes; a symbol
without any, or without point and digits, moves no stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators import risk as RK


def _price(name: str):
    return F.when(~F.isnan(name), F.col(name))


def best_quotes(ticks: DataFrame) -> DataFrame:
    """Highest bid and lowest ask per symbol: state that a stream in update mode keeps over its polls."""
    return ticks.groupBy("symbol").agg(F.max(_price("bid")).alias("bid"), F.min(_price("ask")).alias("ask"))


def trailed_stops(positions: DataFrame, polls: DataFrame, info: DataFrame, distance: float) -> DataFrame:
    """Every ticket's stop after the given polls (rows of ``best_quotes``, any number per symbol): the stored one,
    or where K3 moved it; null if none is set."""
    rows = RK.trailing_points(positions, best_quotes(polls), info, distance, keep=("sl",))
    stop = F.when(F.col("move_sl"), F.col("new_sl")).when(F.col("sl") != 0, F.col("sl"))
    return rows.select("account_id", "ticket", "symbol", "type", stop.alias("stop"), "move_sl")
