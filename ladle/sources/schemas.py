"""Schemas of the thirteen source tables, and how they refer to each other."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Table and column names and types as the source files have them.
MONEY, QUANTITY = "decimal(12,2)", "decimal(12,3)"
TABLES = {
    "Restaurants": "location_id string, name string, city string, region string, address string, location_type string, seating_capacity int, opening_date date, latitude decimal(9,6), longitude decimal(9,6)",
    "Menu_Categories": "category_id string, category_name string, description string",
    "Menu_Items": f"item_id string, item_name string, category_id string, base_price {MONEY}, base_cost {MONEY}, description string, is_active boolean, launch_date date, is_seasonal boolean, season string",
    "Pricing_History": f"price_id string, item_id string, location_id string, price {MONEY}, cost {MONEY}, effective_start_date date, effective_end_date date, change_reason string",
    "Customers": "customer_id string, signup_date date, age_group string, gender string, home_location_id string, preferred_channel string, loyalty_member boolean",
    "Promotions": f"promotion_id string, promotion_name string, promotion_type string, discount_value {MONEY}, start_date date, end_date date, min_order_value {MONEY}",
    "Promotion_Items": "promotion_id string, item_id string",
    "Promotion_Locations": "promotion_id string, location_id string",
    "Orders": f"order_id string, customer_id string, location_id string, order_datetime timestamp, order_channel string, order_status string, promotion_id string, subtotal {MONEY}, discount_amount {MONEY}, tax_amount {MONEY}, total_amount {MONEY}, payment_method string",
    "Order_Items": f"order_item_id string, order_id string, item_id string, quantity int, unit_price {MONEY}, unit_cost {MONEY}, discount_amount {MONEY}, line_total {MONEY}",
    "Ratings": "rating_id string, customer_id string, item_id string, location_id string, order_id string, rating_value int, rating_date date, review_text string",
    "Inventory": f"inventory_id string, item_id string, location_id string, date date, opening_stock {QUANTITY}, received_stock {QUANTITY}, prepared_quantity {QUANTITY}, consumed_stock {QUANTITY}, closing_stock {QUANTITY}, unit string",
    "Wastage": f"wastage_id string, item_id string, location_id string, date date, quantity_wasted {QUANTITY}, unit string, cost_of_waste {MONEY}, reason string",
}
#: (child table, its column, parent table, its column). As the source files refer to each other.
REFERENCES = (
    ("Orders", "customer_id", "Customers", "customer_id"),
    ("Orders", "location_id", "Restaurants", "location_id"),
    ("Orders", "promotion_id", "Promotions", "promotion_id"),
    ("Order_Items", "order_id", "Orders", "order_id"),
    ("Order_Items", "item_id", "Menu_Items", "item_id"),
    ("Menu_Items", "category_id", "Menu_Categories", "category_id"),
    ("Ratings", "customer_id", "Customers", "customer_id"),
    ("Ratings", "item_id", "Menu_Items", "item_id"),
    ("Ratings", "location_id", "Restaurants", "location_id"),
    ("Ratings", "order_id", "Orders", "order_id"),
    ("Inventory", "item_id", "Menu_Items", "item_id"),
    ("Inventory", "location_id", "Restaurants", "location_id"),
    ("Wastage", "item_id", "Menu_Items", "item_id"),
    ("Wastage", "location_id", "Restaurants", "location_id"),
    ("Pricing_History", "item_id", "Menu_Items", "item_id"),
    ("Pricing_History", "location_id", "Restaurants", "location_id"),
    ("Customers", "home_location_id", "Restaurants", "location_id"),
)
#: Spellings of units and what they stand for.
UNITS = {
    "pcs": "pcs", "pieces": "pcs", "piece": "pcs", "pc": "pcs", "Pcs": "pcs", "PCS": "pcs",
    "kg": "kg", "kgs": "kg", "KG": "kg", "Kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "liters": "liters", "litre": "liters", "litres": "liters", "ltr": "liters", "L": "liters", "l": "liters", "Liters": "liters", "liter": "liters",
}
CANONICAL_UNITS = ("pcs", "kg", "liters")
DATE_FORMAT, TIMESTAMP_FORMAT = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def as_strings(typed: StructType) -> StructType:
    """The same columns, all strings."""
    return StructType([StructField(f.name, StringType()) for f in typed.fields])
