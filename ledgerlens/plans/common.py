"""Shared plan pieces: the transaction source of the registered queries and
the output rounding that makes two engines' float results comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ledgerlens.functions.numeric import round_half_up
from ledgerlens.operators.clean import tx_clean
from ledgerlens.operators.visits import ORDER
from ledgerlens.sources.tables import input_state, read_table, transactions
from ledgerlens.session import session_key


def rnd(c: Column | str, digits: int) -> Column:
    return round_half_up(c, digits)


def rounded(df: DataFrame, money=(), ratio=(), digits_money: int = 2, digits_ratio: int = 6) -> DataFrame:
    for c in money:
        df = df.withColumn(c, rnd(c, digits_money))
    for c in ratio:
        df = df.withColumn(c, rnd(c, digits_ratio))
    return df


def raw_tx(spark: SparkSession, sf_dir: str, with_country: bool = False, dirty: bool = False) -> DataFrame:
    """Invoice lines of the given tables. ``dirty=True``, for the queries whose
    feature is cleaning, perturbs the mapping so that every cleaning rule has
    work to do (see sources.tables)."""
    return transactions(spark, sf_dir, dirty=dirty, with_country=with_country)


def clean_tx(spark: SparkSession, sf_dir: str, with_country: bool = False, dirty: bool = False,
             with_order: bool = False) -> DataFrame:
    """The clean lines. They carry the order key while copies are dropped, so
    that copies meet where the join on that key has put them, without a second
    shuffle of all columns; ``with_order`` keeps it for the visits."""
    clean = tx_clean(transactions(spark, sf_dir, dirty=dirty, with_country=with_country, with_order=True))
    return clean if with_order else clean.drop(ORDER)


class InputCache:
    """Results by application, input folder and further key, each valid only
    for the state its input files had: a rewritten table replaces the entry."""

    def __init__(self):
        self._held: dict = {}

    def get(self, spark: SparkSession, sf_dir: str, key: tuple, compute):
        place, state = (session_key(spark), sf_dir, key), input_state(spark, sf_dir)
        held = self._held.get(place)
        if held is None or held[0] != state:
            held = self._held[place] = (state, compute())
        return held[1]


_PLANS = InputCache()


def customer_plan(spark: SparkSession, sf_dir: str, cfg=None, params: str = "fixed"):
    """The customer table of ``sf_dir``, built once per Spark application
    and configuration (its base and ranks are checkpointed, the table too),
    like the reference's cached customer table, keyed by what produced it."""
    from ledgerlens.config import DEFAULT
    from ledgerlens.plans.customer_plan import build_customer_plan
    from ledgerlens.session import cut_lineage, partitions_for

    cfg = cfg or DEFAULT

    def build():
        if params == "fit":  # the same customers, scored with the fitted parameters
            return customer_plan(spark, sf_dir, cfg).scored(*fitted_params(spark, sf_dir, cfg))
        with partitions_for(read_table(spark, sf_dir, "lineitem")):
            return build_customer_plan(clean_tx(spark, sf_dir, with_order=True), cfg, params, keep=cut_lineage)

    return _PLANS.get(spark, sf_dir, (cfg, params), build)


_FITS = InputCache()


def fitted_params(spark: SparkSession, sf_dir: str, cfg=None):
    """BG/NBD and Gamma-Gamma parameters fitted on the repeat-purchase
    summary of ``sf_dir``, once per application and configuration."""
    from ledgerlens.config import DEFAULT
    from ledgerlens.operators.bgnbd import bgnbd_fit
    from ledgerlens.operators.gammagamma import gg_fit

    cfg = cfg or DEFAULT

    def fit():
        summ = customer_plan(spark, sf_dir, cfg).summary
        return bgnbd_fit(summ, cfg), gg_fit(summ, cfg)

    return _FITS.get(spark, sf_dir, (cfg,), fit)
