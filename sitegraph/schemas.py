"""Row shapes shared by all operators, as Spark DDL."""

# markup node: ``post`` is the ``pre`` of the last descendant, so a subtree is
# the interval [pre, post]; row 0 of a page is the root ``[document]``
ATTRS = "ARRAY<STRUCT<k: STRING, v: STRING>>"
NODE_FIELDS = (
    "pre INT, post INT, depth INT, parent_pre INT, sib_no INT, kind STRING, name STRING, "
    f"attrs {ATTRS}, attr MAP<STRING, STRING>, text STRING"
)
ROOT_NAME = "[document]"

TASK = (
    "url STRING, revisit_interval BIGINT, fetcher STRING, seekers ARRAY<STRING>, "
    "miners ARRAY<STRING>, hop INT"
)
TASK_COLUMNS = ("url", "revisit_interval", "fetcher", "seekers", "miners", "hop")

RULE = (
    "rule_set STRING, rule_no INT, regex STRING, max_hop INT, revisit_interval BIGINT, "
    "next_fetcher STRING, next_seekers ARRAY<STRING>, next_miners ARRAY<STRING>, "
    "stop_if_matched BOOLEAN"
)

LINK_STATE = (
    "url STRING, last_start_ts TIMESTAMP, last_end_ts TIMESTAMP, "
    "last_status_code STRING, failed_cnt INT"
)
FETCH_EVENT = "url STRING, ts TIMESTAMP, kind STRING, status_code STRING"

PRODUCT_FIELDS = (
    "prod_name", "prod_sku", "prod_brand", "prod_aution_type", "prod_type",
    "prod_market_price", "prod_price", "shipping_cost", "sold_amount", "size", "sku_url",
)
DETAILS = "ARRAY<STRUCT<attr_name: STRING, attr_value: STRING>>"
IMAGES = "ARRAY<STRUCT<no: INT, kind: STRING, src: STRING>>"
PRODUCT = (
    "url STRING, site STRING, error STRING, "
    + ", ".join(f"{name} STRING" for name in PRODUCT_FIELDS)
    + f", prod_details {DETAILS}, images {IMAGES}"
)
