"""Specifications that the named queries share."""

from tabloom.spec import TableSpec

SEED = 42
STATUSES, STATUS_PROBS = ["F", "O", "P"], [0.5, 0.3, 0.2]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS, SEGMENT_PROBS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], [0.3, 0.25, 0.2, 0.15, 0.1]

ORDERS_RULES = TableSpec.from_dict({
    "name": "orders",
    "fields": [
        {"name": "o_orderkey", "type": "int", "unique": True, "min": 0, "max": 10_000_000_000},
        {"name": "o_custkey", "type": "int", "unique": True, "min": 0, "max": 1000},
        {"name": "o_orderstatus", "type": "category", "categories": STATUSES},
        {"name": "price_text", "type": "float", "min": 5000, "max": 400000, "nullable": 0.01},
        {"name": "start_date", "type": "datetime"},
        {"name": "label", "type": "bool"},
        {"name": "wrong", "type": "decimal128"},
        {"name": "absent", "type": "string"},
        {"name": "junk", "type": "int"},
    ],
    "class_balance": {"1": 0.25},
}, strict=False)

SYNTHETIC_ORDERS = TableSpec.from_dict({
    "name": "synthetic_orders",
    "fields": [
        {"name": "o_custkey", "type": "int", "min": 0, "max": 1600},
        {"name": "o_totalprice", "type": "float", "min": 1000, "max": 480000},
        {"name": "o_orderstatus", "type": "category", "categories": STATUSES, "probs": STATUS_PROBS},
        {"name": "o_orderpriority", "type": "category", "categories": PRIORITIES},
    ],
})

SYNTHETIC_CUSTOMER = TableSpec.from_dict({
    "name": "synthetic_customer",
    "fields": [
        {"name": "c_acctbal", "type": "float", "min": -900, "max": 9500},
        {"name": "c_nationkey", "type": "int", "min": 0, "max": 24},
        {"name": "c_mktsegment", "type": "category", "categories": SEGMENTS, "probs": SEGMENT_PROBS},
    ],
})

ORDER_LEARNING = TableSpec.from_dict({
    "name": "orders",
    "fields": [
        {"name": "o_orderstatus", "type": "category"},
        {"name": "o_orderpriority", "type": "category"},
        {"name": "o_totalprice", "type": "float", "min": 0, "max": 1_000_000},
        {"name": "o_custkey", "type": "int", "min": 0, "max": 10_000_000_000},
    ],
    "metadata": {"dependency_graph": [
        {"parent": "o_orderstatus", "child": "o_orderpriority"}, {"parent": "o_orderpriority", "child": "o_totalprice"}]},
})

LINE_LEARNING = TableSpec.from_dict({
    "name": "lineitem",
    "fields": [
        {"name": "l_returnflag", "type": "category"},
        {"name": "l_linestatus", "type": "category"},
        {"name": "l_quantity", "type": "float", "min": 0, "max": 100},
        {"name": "l_extendedprice", "type": "float", "min": 0, "max": 1_000_000},
        {"name": "l_discount", "type": "float", "min": 0, "max": 1},
    ],
    "metadata": {"dependency_graph": [
        {"parent": "l_returnflag", "child": "l_linestatus"}, {"parent": "l_returnflag", "child": "l_discount"}]},
})
