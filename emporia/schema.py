"""Canonical purchase columns and the names they carry in the French purchase file."""

from __future__ import annotations

# Header names of the purchase file and our column for each.
SOURCE_TO_CANONICAL = {
    "client_id": "client_id",
    "date_dachat": "purchase_date",
    "produit_acheté": "product_id",
    "nom_produit": "product_name",
    "marque": "brand",
    "categorie": "category",
    "délégation": "delegation",
    "localité": "locality",
    "quantité_achetée": "quantity",
    "prix_unitaire": "unit_price",
    "prix_total": "total_price",
}

PURCHASE_COLUMNS = list(SOURCE_TO_CANONICAL.values())
TEXT_COLUMNS = ["product_name", "brand", "category"]
NUMBER_COLUMNS = ["quantity", "unit_price", "total_price"]

# A basket is what one client bought on one calendar day.
BASKET_KEYS = ["client_id", "purchase_date"]
