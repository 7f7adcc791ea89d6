"""Schemas of the ledger's tables."""

from __future__ import annotations

ITEM = "struct<product_id: string, sent_qty: bigint, received_qty: bigint, status: string, flag_note: string, resolved_by: string, resolved_action: string>"

SCHEMAS = {
    "product_types": "id string, name string",
    "categories": "id string, name string, product_type_id string",
    "products": "id string, name string, category_id string, active boolean",
    "stores": "id string, name string, type string, active boolean",
    "users": "id string, username string, name string, role string, store_ids array<string>",
    "thresholds": "product_id string, store_id string, min_qty bigint, optimum_qty bigint, lead_days bigint",
    "transactions": "txn_id string, type string, product_id string, qty bigint, store_id string, transfer_id string, date date, staff_name string, reason string, created_at timestamp, device_id string, synced boolean, target_txn_id string",
    "deleted_transactions": "txn_id string, type string, product_id string, qty bigint, store_id string, transfer_id string, date date, staff_name string, reason string, created_at timestamp, device_id string, synced boolean, target_txn_id string",
    "transfers": f"id string, version bigint, date timestamp, created_at timestamp, from_store string, to_store string, created_by string, status string, return_reason string, return_note string, items array<{ITEM}>, received_by string, received_date timestamp, completed_date timestamp, notes string",
    "cost_history": "id string, product_id string, date date",
    "stock_takes": "id string, store_id string, date date, lines array<struct<product_id: string, counted: bigint>>",
    "deliveries": "id string, store_id string, date date",
    "meta": "key string, value string",
    "stock_changes": "store_id string, product_id string, moved bigint, n bigint",
    "stock_known": "id string, store_id string, product_id string, moved bigint, gone boolean",
}

#: A transaction as it is sent and received.
WIRE = "TransactionId string, Date string, StoreId string, ProductId string, Type string, Qty string, StaffName string, Reason string, DeviceId string, Timestamp bigint, TransferId string, TargetTransactionId string, SyncTimestamp timestamp"
