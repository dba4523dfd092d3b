from ledgerlens.sources.tables import read_table, transactions, event_transactions  # noqa: F401
from ledgerlens.sources.files import (  # noqa: F401
    load_transactions, save_customer_table, load_customer_table, rfm_projection, schema_info,
)
