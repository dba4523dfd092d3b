"""ledgerlens: customer-value analytics as Spark DataFrame plans.

From invoice lines it cleans and deduplicates transactions, scores recency,
frequency and monetary value, segments customers, summarises repeat purchases,
scores BG/NBD and Gamma-Gamma models for purchase rate, probability of being
active and discounted lifetime value, engineers features for a boosted-tree
predictor, and answers segment, driver-bin, concentration and scenario
questions. Every operator is a ``DataFrame -> DataFrame`` transform.

Typical use::

    from ledgerlens import load_transactions, tx_clean, build_customer_plan, views

    clean = tx_clean(load_transactions(spark, "s3://bucket/invoice_lines/"))
    plan = build_customer_plan(clean)            # or params="fit"
    views.segment_value_share(plan.customers).show()
"""

from ledgerlens.config import Config, BGNBDParams, GammaGammaParams, FIXED_BGNBD, FIXED_GAMMA_GAMMA  # noqa: F401
from ledgerlens.operators import views, scenario, eda  # noqa: F401
from ledgerlens.operators.clean import tx_clean, tx_normalized, cleaning_audit  # noqa: F401
from ledgerlens.operators.rfm import rfm_metrics, rfm_scores, rfm_segments  # noqa: F401
from ledgerlens.operators.drivers import driver_metrics  # noqa: F401
from ledgerlens.operators.summary import purchase_summary  # noqa: F401
from ledgerlens.operators.bgnbd import bgnbd_fit, prob_alive, expected_purchases  # noqa: F401
from ledgerlens.operators.gammagamma import gg_fit, expected_average_value  # noqa: F401
from ledgerlens.operators.clv import predict_clv, clv_scores, customer_table  # noqa: F401
from ledgerlens.plans.customer_plan import build_customer_plan  # noqa: F401
from ledgerlens.sources.files import load_transactions, save_customer_table, load_customer_table  # noqa: F401
from ledgerlens.sources.tables import transactions  # noqa: F401

__version__ = "0.1.0"
