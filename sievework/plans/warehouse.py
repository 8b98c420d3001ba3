"""Layered loads: the silver layer is a vault, the gold layer dimensions and facts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import vault

LAYERS = ("silver", "gold")


def silver(tables: dict[str, DataFrame], load_date: str, record_source: str = "tpch") -> dict[str, DataFrame]:
    """Hubs, links and satellites of the order model, by entity name."""

    def source(name: str, *keys: str) -> vault.Source:
        return vault.Source(tables[name], list(keys), f"{record_source}.{name}", load_date)

    def sat(name: str, hk: str, key: str, attributes: list[str]) -> DataFrame:
        return vault.satellite(
            tables[name], hk, [key], F.lit(load_date), attributes, f"{record_source}.{name}", attributes,
            chunk=None,  # one load date
        )

    return {
        vault.entity_name("hub", "customer"): vault.hub(
            "customer", [source("customer", "c_custkey"), source("orders", "o_custkey")], ["c_custkey"]
        ),
        vault.entity_name("hub", "order"): vault.hub(
            "order", [source("orders", "o_orderkey"), source("lineitem", "l_orderkey")], ["o_orderkey"]
        ),
        vault.entity_name("link", "order", "customer"): vault.link(
            "order_customer",
            [source("orders", "o_orderkey", "o_custkey")],
            {"order": ["o_orderkey"], "customer": ["c_custkey"]},
        ),
        vault.entity_name("satellite", "customer", "details"): sat(
            "customer", "customer_hk", "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]
        ),
    }


def gold(vaults: dict[str, DataFrame], measures_of: DataFrame, measures: dict[str, str]) -> dict[str, DataFrame]:
    """Dimension from the satellites' current rows, fact by customer from order rows."""
    customer = vault.dimension(
        vaults["HUB_CUSTOMER"], [vaults["SAT_CUSTOMER_DETAILS"]], "customer_hk"
    )
    sales = vault.fact(measures_of, {"customer": ["o_custkey"]}, measures)
    return {vault.entity_name("dim", "customer"): customer, vault.entity_name("fact", "sales"): sales}


def build(layer: str, *args, **kwargs) -> dict[str, DataFrame]:
    """The chosen layer."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer '{layer}', choose from {list(LAYERS)}")
    return silver(*args, **kwargs) if layer == "silver" else gold(*args, **kwargs)
