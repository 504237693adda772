"""The 11-table wholesale model: raw headers, keys, relations and check columns.

Fixed values throughout; they name the columns of the source files.
"""

from __future__ import annotations

from assayer.config import Checks, CleaningPolicy, Relation

RAW_COLUMNS = {
    "customers": [
        "CustomerID",
        "CustomerName",
        "Region",
        "Country",
        "PriceCategory",
        "CustomerClass",
        "LeadSource",
        "Discontinued",
    ],
    "employees": ["EmployeeID", "EmployeeName"],
    "inventory_transactions": [
        "TransactionID",
        "ProductID",
        "PurchaseOrderID",
        "MissingID",
        "TransactionDate",
        "UnitPurchasePrice",
        "QuantityOrdered",
        "QuantityReceived",
        "QuantityMissing",
    ],
    "order_details": ["OrderDetailID", "OrderID", "ProductID", "QuantitySold", "UnitSalesPrice"],
    "orders": [
        "OrderID",
        "CustomerID",
        "EmployeeID",
        "ShippingMethodID",
        "OrderDate",
        "ShipDate",
        "FreightCharge",
    ],
    "payment_methods": ["PaymentMethodID", "PaymentMethod"],
    "payments": ["PaymentID", "OrderID", "PaymentMethodID", "PaymentDate", "PaymentAmount"],
    "products": [
        "ProductID",
        "ProductName",
        "Color",
        "ModelDescription",
        "FabricDescription",
        "Category",
        "Gender",
        "ProductLine",
        "Weight",
        "Size",
        "PackSize",
        "Status",
        "InventoryDate",
        "PurchasePrice",
    ],
    "purchase_orders": [
        "PurchaseOrderID",
        "SupplierID",
        "EmployeeID",
        "ShippingMethodID",
        "OrderDate",
    ],
    "shipping_methods": ["ShippingMethodID", "ShippingMethod"],
    "suppliers": ["SupplierID", "SupplierName"],
}

# Files that are not UTF-8.
RAW_ENCODINGS = {"customers": "UTF-16", "employees": "UTF-16"}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "employees": "employee_id",
    "inventory_transactions": "transaction_id",
    "order_details": "order_detail_id",
    "orders": "order_id",
    "payment_methods": "payment_method_id",
    "payments": "payment_id",
    "products": "product_id",
    "purchase_orders": "purchase_order_id",
    "shipping_methods": "shipping_method_id",
    "suppliers": "supplier_id",
}

DATE_COLUMNS = {
    "inventory_transactions": ["transaction_date"],
    "orders": ["order_date", "ship_date"],
    "payments": ["payment_date"],
    "products": ["inventory_date"],
    "purchase_orders": ["order_date"],
}

NUMBER_COLUMNS = {
    "inventory_transactions": [
        "unit_purchase_price",
        "quantity_ordered",
        "quantity_received",
        "quantity_missing",
    ],
    "order_details": ["quantity_sold", "unit_sales_price"],
    "orders": ["freight_charge"],
    "payments": ["payment_amount"],
    "products": ["purchase_price", "weight"],
}

# child -> tables it points to; in this model a foreign key has the name of the key
# it points to.
PARENTS = {
    "inventory_transactions": ["products", "purchase_orders"],
    "order_details": ["orders", "products"],
    "orders": ["customers", "employees", "shipping_methods"],
    "payments": ["orders", "payment_methods"],
    "purchase_orders": ["employees", "shipping_methods", "suppliers"],
}

RELATIONS = tuple(
    Relation(child, PRIMARY_KEYS[parent], parent, PRIMARY_KEYS[parent])
    for child, parents in PARENTS.items()
    for parent in parents
)

CHECKS = Checks(
    primary_keys=PRIMARY_KEYS,
    dates=DATE_COLUMNS,
    numbers=NUMBER_COLUMNS,
    relations=RELATIONS,
)

POLICY = CleaningPolicy(
    money={
        "orders": ["freight_charge"],
        "payments": ["payment_amount"],
        "order_details": ["unit_sales_price"],
        "inventory_transactions": ["unit_purchase_price"],
        "products": ["purchase_price"],
    },
    integers={
        "customers": ["discontinued"],
        "order_details": ["quantity_sold"],
        "inventory_transactions": ["quantity_ordered", "quantity_received", "quantity_missing"],
    },
)
