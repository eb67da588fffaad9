"""Every branch of the decision columns occurs in the checked queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
BRANCHES = {
    ("order_intents", "action"): {"buy", "sell", "close_all"},
    ("grid_intents", "action"): {"buy", "sell"},
    ("grid_trigger", "open_grid"): {True, False},
    ("peak_profit", "reason"): {"", "profit", "pullback"},
    ("reversal_intents", "action"): {"close", "open"},
    ("reversal_intents", "current_side"): {-1, 0, 1},
    ("close_all", "close_all"): {True, False},
    ("model_signal_gates", "ai_signal"): {"BULLISH", "BEARISH", "NEUTRAL"},
    ("signals_walk", "decision"): {"BULLISH", "BEARISH", "NEUTRAL"},
    ("signals_walk", "sideways"): {True, False},
    ("signals_walk", "bb_signal"): {"BULLISH", "BEARISH", "NEUTRAL"},
    ("close_rules_walk", "reason"): {"", "take_profit", "stop_loss", "signal_reversal"},
    ("atr_trailing_walk", "move_sl"): {True, False},
    ("atr_stop_path", "moved"): {True, False},
}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = E.queries()[name](spark, SF).cache()
        return made[name]

    yield get
    for df in made.values():
        df.unpersist()


@pytest.mark.parametrize(("name", "column"), list(BRANCHES))
def test_all_classes_occur(results, name, column):
    assert {r[0] for r in results(name).select(column).distinct().collect()} >= BRANCHES[name, column]


def test_steps_of_reversals(results):
    steps = results("reversal_intents").groupBy("account_id", "symbol").agg(F.sort_array(F.collect_list("action")).alias("a"))
    assert {tuple(r.a) for r in steps.collect()} == {("open",), ("close", "open")}


def test_streaks_and_lots_vary(results):
    lots = {r[0] for r in results("lot_size_by_supplier").select("lot").distinct().collect()}
    assert len(lots) >= 3
    assert results("loss_streaks_by_supplier").filter("loss_streak > 0").count() > 0
