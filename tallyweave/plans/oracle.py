"""The queries of plans.queries in DuckDB's SQL, over the driver's tables."""

from __future__ import annotations

_VIEWS = {
    "ledger": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS txn_id,
               (['in','out','transfer_in','transfer_out','return_in','wastage','adjustment_in','adjustment_out','deleted'])[CAST((l_orderkey + l_linenumber) % 9 + 1 AS INT)] AS type,
               l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty, l_suppkey AS store_id, l_orderkey AS transfer_id, CAST(l_shipdate AS DATE) AS date, l_shipdate AS created_at,
               CASE (l_orderkey + l_linenumber) % 9 WHEN 8 THEN 0 ELSE CASE ((l_orderkey + l_linenumber) % 9) % 2 WHEN 0 THEN 1 ELSE -1 END END * CAST(l_quantity AS BIGINT) AS delta, l_linestatus, l_returnflag
        FROM lineitem""",
    "stock": "SELECT store_id, product_id, CAST(sum(delta) AS BIGINT) AS on_hand FROM ledger GROUP BY ALL",
    "pairs": "SELECT DISTINCT store_id, product_id FROM ledger",
    "common": "SELECT p_partkey AS product_id, CAST(p_size AS BIGINT) AS min_qty, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 * CAST(p_size AS BIGINT) END AS optimum_qty FROM part",
    "resolved": """
        SELECT s.store_id, s.product_id, CASE WHEN (s.store_id + s.product_id) % 4 = 0 THEN 5 ELSE c.min_qty END AS min_qty, CASE WHEN (s.store_id + s.product_id) % 4 = 0 THEN 60 ELSE c.optimum_qty END AS optimum_qty
        FROM pairs s LEFT JOIN common c ON s.product_id = c.product_id""",
    "best": "SELECT store_id, product_id, min_qty, coalesce(nullif(optimum_qty, 0), nullif(min_qty, 0), 0) AS optimum FROM resolved",
    "sums": "SELECT l_orderkey AS transfer_id, l_partkey AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sent_qty FROM lineitem GROUP BY ALL",
    "t": """
        SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey % n AS from_store, (o_custkey + 1 + o_orderkey % (n - 1)) % n AS to_store,
               (['draft','in_transit','received','flagged','completed','cancelled'])[CAST(o_orderkey % 6 + 1 AS INT)] AS status, CASE WHEN o_orderpriority = '5-LOW' THEN 'Excess' END AS return_reason,
               'user-' || (o_custkey % 5) AS created_by, CASE WHEN o_orderkey % 6 IN (2, 3, 4) THEN 'user-' || (o_custkey % 7) END AS received_by, CASE WHEN o_orderkey % 6 IN (4, 5) THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 45) END AS completed_date
        FROM orders, (SELECT count(*) AS n FROM supplier)""",
    "came": "SELECT *, CASE WHEN product_id % 4 <> 0 THEN sent_qty WHEN product_id % 8 = 0 THEN sent_qty - 1 ELSE sent_qty + 1 END AS came FROM sums",
    "items": """
        SELECT transfer_id, product_id, from_store, to_store, status AS transfer_status, sent_qty, CASE WHEN status IN ('received','flagged','completed') THEN came END AS received_qty,
               CASE WHEN status IN ('received','flagged','completed') THEN CASE WHEN came = sent_qty THEN 'accepted' WHEN status = 'completed' THEN 'resolved' ELSE 'flagged' END
                    WHEN status = 'draft' AND product_id % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status
        FROM came JOIN t ON transfer_id = id""",
    "hub": """
        SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, status, from_store, to_store, CAST(count(product_id) AS BIGINT) AS item_count, CAST(coalesce(sum(sent_qty), 0) AS BIGINT) AS total_units
        FROM t LEFT JOIN sums ON id = transfer_id GROUP BY id, created_at, status, from_store, to_store""",
    "mine": "SELECT s_suppkey AS store_id FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_custkey = 2",
    "wrong": """
        SELECT id, CASE WHEN id % 13 = 1 OR id NOT IN (SELECT transfer_id FROM sums) THEN 'missing fields' WHEN id % 13 = 2 THEN 'same store' WHEN id % 13 = 3 AND return_reason IS NULL THEN 'no return reason' END AS violation FROM t""",
    "acts": """
        SELECT *, CASE product_id % 3 WHEN 0 THEN received_qty WHEN 1 THEN sent_qty // 2 END AS kept FROM items WHERE status = 'flagged' AND transfer_status = 'received'""",
    "settled": """
        SELECT transfer_id, product_id, to_store AS store_id, 'transfer_in' AS type, kept AS qty FROM acts WHERE kept IS NOT NULL
        UNION ALL SELECT transfer_id, product_id, from_store, 'transfer_in', sent_qty - coalesce(kept, 0) FROM acts WHERE kept IS NULL OR sent_qty - kept > 0""",
    "log": """
        SELECT CAST(event_id AS VARCHAR) AS txn_id, ts, CAST(user_id AS VARCHAR) AS device, CASE WHEN event_type = 'error' THEN 'deleted' ELSE event_type END AS type,
               CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS target, user_id % 7 AS store, value
        FROM events""",
    "answers": """
        SELECT event_id AS batch_no, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'SUCCESS' WHEN 'error' THEN 'error' WHEN 'signup' THEN '' END AS status,
               CAST(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 = 0 THEN 49 ELSE 50 END END AS BIGINT) AS processed FROM events""",
    "unsynced": "SELECT txn_id, n // 50 AS batch_no FROM (SELECT txn_id, row_number() OVER (ORDER BY txn_id) - 1 AS n FROM ledger WHERE transfer_id % 3 <> 0)",
    "acks": "SELECT * FROM (SELECT batch_no, count(*) AS sent FROM unsynced GROUP BY batch_no) LEFT JOIN answers USING (batch_no)",
    "push_acks": """
        SELECT * FROM (SELECT n // 50 AS batch_no, count(*) AS sent FROM (
            SELECT row_number() OVER (ORDER BY txn_id) - 1 AS n FROM (SELECT txn_id FROM unsynced UNION ALL SELECT 'del_' || txn_id FROM ledger WHERE transfer_id % 17 = 0)) GROUP BY 1) LEFT JOIN answers USING (batch_no)""",
    "commands": """
        SELECT transfer_id AS k, row_number() OVER (PARTITION BY transfer_id ORDER BY seq) AS n, step, product_id AS p, action, qty, lines FROM (
            SELECT transfer_id, seq, step, CASE seq WHEN 1 THEN low WHEN 2 THEN high END AS product_id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS qty, CASE seq WHEN 0 THEN every WHEN 3 THEN edits WHEN 5 THEN came END AS lines
            FROM (SELECT transfer_id, min(product_id) AS low, max(product_id) AS high, list({'p': product_id, 'q': sent_qty} ORDER BY product_id) AS every, list({'p': product_id, 'q': edited} ORDER BY product_id) AS edits,
                      list({'p': product_id, 'q': CASE WHEN product_id % 4 = 0 THEN sent_qty - 1 ELSE edited END} ORDER BY product_id) FILTER (product_id % 11 <> 0) AS came
                  FROM (SELECT *, CASE WHEN transfer_id % 2 = 0 AND product_id % 3 = 0 THEN sent_qty + 2 ELSE sent_qty END AS edited FROM sums) GROUP BY transfer_id),
                 (VALUES (0, 'create'), (1, 'confirm'), (2, 'confirm'), (3, 'submit'), (4, 'cancel'), (5, 'receive'), (1000000000, 'submit')) AS c(seq, step)
            WHERE (seq <> 2 OR transfer_id % 3 = 0) AND (seq <> 4 OR transfer_id % 7 = 0)
            UNION ALL SELECT transfer_id, product_id + 10, 'resolve', product_id, (['accept_as_is','adjust','reject'])[CAST(product_id % 3 + 1 AS INT)], sent_qty // 2, NULL FROM sums WHERE product_id % 4 = 0 OR product_id % 11 = 0)""",
    "judged": """
        SELECT f.k, c.n, step, p, action, qty, lines, status, items, CASE
            WHEN step = 'create' THEN CASE WHEN f.k % 29 = 0 THEN 'same store' END
            WHEN step IN ('confirm', 'submit') AND status IS DISTINCT FROM 'draft' THEN 'not a draft'
            WHEN step = 'confirm' AND NOT list_contains([i.p FOR i IN items], p) THEN 'item not found'
            WHEN step = 'submit' AND len([i FOR i IN items IF i.s = 'confirmed']) = 0 THEN 'no confirmed items'
            WHEN step = 'receive' AND status IS DISTINCT FROM 'in_transit' THEN 'not in transit'
            WHEN step = 'cancel' AND (status IS NULL OR status NOT IN ('draft', 'in_transit')) THEN 'cannot cancel'
            WHEN step = 'resolve' AND (status IS NULL OR status NOT IN ('received', 'in_transit')) THEN 'invalid transfer'
            WHEN step = 'resolve' AND len([i FOR i IN items IF i.p = p AND i.s = 'flagged']) = 0 THEN 'flagged item not found' END AS error
        FROM (SELECT k, n, status, items FROM fold) f JOIN commands c ON c.k = f.k AND c.n = f.n + 1""",
    "fold": """
        SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST([] AS STRUCT(p BIGINT, sent BIGINT, got BIGINT, s VARCHAR)[]) AS items, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS units_out, CAST(0 AS BIGINT) AS units_in FROM commands WHERE commands.n = 1
        UNION ALL SELECT k, n, CASE WHEN error IS NOT NULL THEN status WHEN step = 'create' THEN CASE WHEN k % 2 = 0 THEN 'draft' ELSE 'in_transit' END WHEN step = 'confirm' THEN status WHEN step = 'submit' THEN 'in_transit' WHEN step = 'cancel' THEN 'cancelled'
                WHEN step = 'receive' THEN CASE WHEN list_contains([i.s FOR i IN after], 'flagged') THEN 'received' ELSE 'completed' END WHEN len([i FOR i IN after IF i.s NOT IN ('accepted', 'resolved')]) = 0 THEN 'completed' ELSE status END,
            after, step, error,
            CAST(CASE WHEN error IS NULL AND (step = 'submit' OR step = 'create' AND k % 2 = 1) THEN coalesce(list_sum([i.sent FOR i IN after]), 0) ELSE 0 END AS BIGINT),
            CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN step = 'cancel' AND status = 'in_transit' THEN coalesce(list_sum([i.sent FOR i IN after]), 0) WHEN step = 'receive' THEN coalesce(list_sum([i.got FOR i IN after IF i.s = 'accepted']), 0)
                 WHEN step = 'resolve' THEN list_sum([CASE action WHEN 'reject' THEN i.sent WHEN 'adjust' THEN greatest(qty, i.sent) ELSE greatest(i.got, i.sent) END FOR i IN items IF i.p = p]) ELSE 0 END AS BIGINT)
        FROM (SELECT *, CASE WHEN error IS NOT NULL THEN items WHEN step = 'create' THEN [{'p': x.p, 'sent': x.q, 'got': CAST(NULL AS BIGINT), 's': 'pending'} FOR x IN lines]
                WHEN step = 'confirm' THEN [{'p': i.p, 'sent': i.sent, 'got': i.got, 's': CASE WHEN i.p <> p THEN i.s WHEN i.s = 'confirmed' THEN 'pending' ELSE 'confirmed' END} FOR i IN items]
                WHEN step = 'submit' THEN [{'p': i.p, 'sent': coalesce(list_extract([x.q FOR x IN lines IF x.p = i.p], 1), i.sent), 'got': CAST(NULL AS BIGINT), 's': 'pending'} FOR i IN items IF i.s = 'confirmed']
                WHEN step = 'receive' THEN [{'p': i.p, 'sent': i.sent, 'got': coalesce(list_extract([x.q FOR x IN lines IF x.p = i.p], 1), 0), 's': CASE WHEN coalesce(list_extract([x.q FOR x IN lines IF x.p = i.p], 1), 0) = i.sent THEN 'accepted' ELSE 'flagged' END} FOR i IN items]
                WHEN step = 'resolve' THEN [{'p': i.p, 'sent': i.sent, 'got': i.got, 's': CASE WHEN i.p = p THEN 'resolved' ELSE i.s END} FOR i IN items] ELSE items END AS after FROM (JUDGED))""",
    "local_rows": "SELECT txn_id FROM log WHERE ts <= TIMESTAMP '2024-01-15' AND type <> 'deleted'",
    "pull": "SELECT * FROM log WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 10 SECOND AND ts <= TIMESTAMP '2024-01-20'",
    "boot": "SELECT * FROM log WHERE ts <= TIMESTAMP '2024-01-20'",
}


def sql(body: str) -> str:
    """body, with the views that it and they use."""
    import re

    used: set[str] = set()
    todo = [body]
    while todo:
        for name in re.findall(r"\b[a-z_]+\b", todo.pop()):
            if name in _VIEWS and name not in used:
                used.add(name)
                todo.append(_VIEWS[name])
    named = [f"{n} AS ({v})" for n, v in _VIEWS.items() if n in used]
    recursive = "RECURSIVE " if "fold" in used else ""
    return (f"WITH {recursive}{', '.join(named)} " if named else "") + body


_VIEWS["fold"] = _VIEWS["fold"].replace("JUDGED", _VIEWS.pop("judged"))

_HUB = "SELECT * FROM hub"
_ROLES = "(['director','head_office','franchisee','store_manager','staff'])[CAST(c_custkey % 5 + 1 AS INT)]"
_BODIES = {
    "hub_all": _HUB,
    "hub_in_transit": f"{_HUB} WHERE status = 'in_transit'",
    "hub_needs_receiving": f"{_HUB} WHERE status = 'in_transit' AND to_store IN (SELECT store_id FROM mine)",
    "hub_flagged": f"{_HUB} WHERE status IN ('flagged', 'received')",
    "hub_completed": f"{_HUB} WHERE status = 'completed'",
    "hub_drafts": f"{_HUB} WHERE status = 'draft'",
    "hub_page": f"{_HUB} WHERE status = 'in_transit' ORDER BY created_at DESC, id LIMIT 15 OFFSET 15",
    "hub_last_page": f"{_HUB} WHERE status = 'draft' ORDER BY created_at DESC, id LIMIT 15 OFFSET (SELECT 15 * (greatest(1, CAST(ceil(count(*) / 15.0) AS BIGINT)) - 1) FROM t WHERE status = 'draft')",
    "hub_page_count": "SELECT CAST(greatest(1, ceil(count(*) / 15.0)) AS BIGINT) AS pages FROM t WHERE status = 'completed'",
    "hub_visibility": "SELECT id, from_store, to_store FROM t WHERE from_store IN (SELECT store_id FROM mine) OR to_store IN (SELECT store_id FROM mine)",
    "transfer_list": "SELECT id, strftime(created_at, '%Y-%m-%d') AS date, from_store, to_store FROM t WHERE status = 'received' AND (from_store = 3 OR to_store = 3)",
    "on_hand": "SELECT * FROM stock",
    "running_balance": "SELECT txn_id, CAST(sum(delta) OVER (PARTITION BY store_id, product_id ORDER BY date, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ledger",
    "on_hand_after_delete": "SELECT store_id, product_id, CAST(sum(delta) AS BIGINT) AS on_hand FROM ledger WHERE transfer_id % 17 <> 0 GROUP BY ALL",
    "deleted_archive": "SELECT txn_id, type, store_id, product_id, qty FROM ledger WHERE transfer_id % 17 = 0",
    "tombstones": "SELECT 'del_' || txn_id AS txn_id, 'deleted' AS type, store_id, product_id, CAST(0 AS BIGINT) AS qty, txn_id AS target_txn_id FROM ledger WHERE transfer_id % 17 = 0",
    "txn_type_summary": "SELECT type, count(*) AS n, CAST(sum(qty) AS BIGINT) AS units, CAST(sum(delta) AS BIGINT) AS signed_units FROM ledger GROUP BY type",
    "ledger_lineage": "SELECT transfer_id, status, count(*) AS n, CAST(sum(delta) AS BIGINT) AS net FROM ledger JOIN t ON transfer_id = id GROUP BY ALL",
    "threshold_resolved": "SELECT store_id, product_id, CAST(min_qty AS BIGINT) AS min_qty, CAST(optimum_qty AS BIGINT) AS optimum_qty FROM resolved",
    "shortfall_by_store": "SELECT store_id, product_id, on_hand, CAST(optimum AS BIGINT) AS optimum, CAST(greatest(0, optimum - on_hand) AS BIGINT) AS shortfall FROM stock JOIN best USING (store_id, product_id)",
    "low_stock": "SELECT store_id, product_id, on_hand, CAST(min_qty AS BIGINT) AS min_qty FROM stock JOIN best USING (store_id, product_id) WHERE on_hand < min_qty",
    "threshold_upsert": """
        SELECT coalesce(o.k, e.k) AS store_key, coalesce(o.product_id, e.product_id) AS product_id, CAST(coalesce(e.min_qty, o.min_qty) AS BIGINT) AS min_qty, CAST(coalesce(e.optimum_qty, o.optimum_qty) AS BIGINT) AS optimum_qty
        FROM (SELECT '*' AS k, * FROM common UNION ALL SELECT CAST(store_id AS VARCHAR), product_id, 5, 60 FROM pairs WHERE (store_id + product_id) % 4 = 0) o
        FULL JOIN (SELECT '*' AS k, p_partkey AS product_id, CASE WHEN p_partkey % 9 <> 0 THEN 7 END AS min_qty, 70 AS optimum_qty FROM part WHERE p_partkey % 3 = 0) e ON o.k = e.k AND o.product_id = e.product_id""",
    "stocktake_draft": "SELECT store_id, product_id, CAST(optimum - greatest(0, on_hand) AS BIGINT) AS qty FROM stock JOIN best USING (store_id, product_id) WHERE optimum <> 0 AND greatest(0, on_hand) < optimum",
    "product_picker": """
        SELECT id, at_origin, at_destination, optimum, CAST(greatest(0, optimum - at_destination) AS BIGINT) AS shortfall FROM (
            SELECT c.product_id AS id, CAST(coalesce(o.on_hand, 0) AS BIGINT) AS at_origin, CAST(coalesce(d.on_hand, 0) AS BIGINT) AS at_destination,
                   CAST(CASE WHEN d.on_hand IS NOT NULL AND (c.product_id + 1) % 4 = 0 THEN 60 ELSE coalesce(nullif(c.optimum_qty, 0), nullif(c.min_qty, 0), 0) END AS BIGINT) AS optimum
            FROM common c LEFT JOIN stock o ON o.product_id = c.product_id AND o.store_id = 0 LEFT JOIN stock d ON d.product_id = c.product_id AND d.store_id = 1 WHERE c.product_id % 10 <> 1)""",
    "product_search": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 10 <> 1 AND (contains(lower(p_name), 'red') OR contains(CAST(p_partkey AS VARCHAR), 'red'))",
    "transfer_units": """
        SELECT id AS transfer_id, item_count, item_count AS selected, total_units,
               item_count || CASE item_count WHEN 1 THEN ' item' ELSE ' items' END || ', ' || total_units || CASE total_units WHEN 1 THEN ' unit' ELSE ' units' END AS text FROM hub""",
    "transfer_names": "SELECT id AS transfer_id, a.s_name AS from_name, b.s_name AS to_name, replace(status, '_', ' ') AS label FROM t LEFT JOIN supplier a ON a.s_suppkey = from_store LEFT JOIN supplier b ON b.s_suppkey = to_store",
    "transfer_item_names": "SELECT transfer_id, product_id, p_name AS product, sent_qty AS sent, coalesce(CAST(received_qty AS VARCHAR), '-') AS received FROM items LEFT JOIN part ON product_id = p_partkey",
    "notification_payload": """
        SELECT h.id AS transfer_id, CASE h.status WHEN 'completed' THEN 'transfer_completed' ELSE 'transfer_created' END AS type, a.s_name AS from_name, b.s_name AS to_name,
               CASE WHEN h.status <> 'completed' THEN item_count END AS total_items, CASE WHEN h.status <> 'completed' THEN total_units END AS total_units,
               p_name AS first_product, strftime(CASE h.status WHEN 'completed' THEN completed_date ELSE t.created_at END, '%Y-%m-%d') AS date, CASE h.status WHEN 'completed' THEN received_by ELSE created_by END AS person,
               CASE h.status WHEN 'completed' THEN coalesce(n_resolved, 0) END AS n_flagged, CASE WHEN h.status = 'completed' AND n_resolved > 0 THEN 'accept_as_is' END AS first_action
        FROM hub h JOIN t ON t.id = h.id LEFT JOIN (SELECT transfer_id, min(product_id) AS low, count(*) FILTER (status = 'resolved') AS n_resolved FROM items GROUP BY 1) f ON f.transfer_id = h.id LEFT JOIN part ON p_partkey = f.low LEFT JOIN supplier a ON a.s_suppkey = h.from_store LEFT JOIN supplier b ON b.s_suppkey = h.to_store WHERE h.status IN ('in_transit', 'completed')""",
    "capability_matrix": f"""
        SELECT c_custkey AS id, capability, list_contains(roles, {_ROLES}) AS allowed FROM customer, (VALUES ('create', ['director','head_office','franchisee','store_manager']),
            ('receive', ['director','head_office','franchisee','store_manager','staff']), ('resolve', ['director','head_office','franchisee']), ('set_thresholds', ['director','head_office']),
            ('cancel', ['director','head_office']), ('view_history', ['director','head_office','franchisee','store_manager'])) AS c(capability, roles)""",
    "flag_diff": """
        SELECT transfer_id, product_id, sent_qty, received_qty, received_qty - sent_qty AS diff, CASE WHEN received_qty > sent_qty THEN '+' ELSE '' END || (received_qty - sent_qty) AS diff_text,
               CASE WHEN received_qty IS NULL THEN 'unmatched' WHEN received_qty = sent_qty THEN 'matched' ELSE 'mismatch' END AS state FROM items""",
    "transfer_create": "SELECT s.transfer_id, s.product_id, t.from_store AS store_id, 'transfer_out' AS type, s.sent_qty AS qty FROM sums s JOIN t ON s.transfer_id = t.id JOIN wrong w ON w.id = t.id WHERE t.status <> 'draft' AND w.violation IS NULL",
    "transfer_validate": "SELECT id, violation FROM wrong WHERE violation IS NOT NULL",
    "transfer_draft_confirm": "SELECT transfer_id, product_id, CASE WHEN product_id % 5 <> 0 THEN status WHEN status = 'confirmed' THEN 'pending' ELSE 'confirmed' END AS status FROM items WHERE transfer_status = 'draft'",
    "transfer_draft_submit": "SELECT transfer_id, product_id, from_store AS store_id, 'transfer_out' AS type, CASE WHEN product_id % 3 = 0 THEN sent_qty + 2 ELSE sent_qty END AS qty FROM items WHERE transfer_status = 'draft' AND status = 'confirmed'",
    "transfer_receive": """
        SELECT transfer_id, product_id, sent_qty, received_qty, CASE WHEN received_qty = sent_qty THEN 'accepted' ELSE 'flagged' END AS item_status,
               CASE WHEN bool_and(received_qty = sent_qty) OVER (PARTITION BY transfer_id) THEN 'completed' ELSE 'received' END AS transfer_status,
               'user-9' AS received_by, '2000-01-01' AS received_date, CASE WHEN bool_and(received_qty = sent_qty) OVER (PARTITION BY transfer_id) THEN '2000-01-01' END AS completed_date
        FROM (SELECT c.transfer_id, c.product_id, c.sent_qty, CASE WHEN c.product_id % 11 = 0 THEN 0 ELSE came END AS received_qty FROM came c JOIN t ON transfer_id = id WHERE status = 'in_transit')""",
    "transfer_receive_entries": "SELECT transfer_id, product_id, to_store AS store_id, 'transfer_in' AS type, sent_qty AS qty FROM came JOIN t ON transfer_id = id WHERE status = 'in_transit' AND CASE WHEN product_id % 11 = 0 THEN 0 ELSE came END = sent_qty",
    "transfer_resolve_flags": "SELECT transfer_id, product_id, store_id, type, CAST(qty AS BIGINT) AS qty FROM settled",
    "transfer_resolved_status": """SELECT id, CASE WHEN bool_or(i.status = 'flagged' AND product_id % 16 <> 0) AND NOT bool_or(i.status = 'flagged' AND product_id % 16 = 0) THEN 'completed' ELSE 'received' END AS status,
            CASE WHEN bool_or(i.status = 'flagged' AND product_id % 16 <> 0) AND NOT bool_or(i.status = 'flagged' AND product_id % 16 = 0) THEN '2000-01-01' END AS completed_date,
            max(CASE WHEN i.status = 'flagged' AND product_id % 16 <> 0 THEN (['accept_as_is','adjust','reject'])[CAST(product_id % 3 + 1 AS INT)] END) AS resolved_action,
            max(CASE WHEN i.status = 'flagged' AND product_id % 16 <> 0 AND product_id % 3 = 2 THEN 'broken' WHEN product_id IS NOT NULL THEN '' END) AS flag_note,
            count(*) FILTER (i.status = 'flagged' AND product_id % 16 <> 0) AS n_resolved FROM t LEFT JOIN items i ON id = transfer_id WHERE t.status = 'received' GROUP BY id""",
    "transfer_cancel": "SELECT transfer_id, product_id, from_store AS store_id, 'transfer_in' AS type, sent_qty AS qty FROM items WHERE transfer_status = 'in_transit'",
    "transfer_cancelled": "SELECT id, 'cancelled' AS status, '2000-01-01' AS completed_date FROM t WHERE status IN ('draft', 'in_transit')",
    "transfer_conservation": """
        SELECT i.transfer_id, i.product_id, sent_qty, CAST(coalesce(c.qty, 0) AS BIGINT) AS credited_qty, CAST(coalesce(c.qty, 0) - sent_qty AS BIGINT) AS imbalance FROM items i LEFT JOIN
            (SELECT transfer_id, product_id, sum(qty) AS qty FROM (SELECT transfer_id, product_id, qty FROM settled UNION ALL SELECT transfer_id, product_id, received_qty FROM items WHERE status = 'accepted' AND transfer_status = 'received') GROUP BY ALL) c
            ON i.transfer_id = c.transfer_id AND i.product_id = c.product_id WHERE transfer_status = 'received'""",
    "transfer_prune": "SELECT id, status, strftime(completed_date, '%Y-%m-%d') AS completed_date FROM t WHERE status NOT IN ('completed', 'cancelled') OR completed_date > TIMESTAMP '2000-01-01' - INTERVAL 30 DAY",
    "prune_count": "SELECT count(*) AS pruned FROM t WHERE status IN ('completed', 'cancelled') AND completed_date <= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY",
    "transfer_by_id": "SELECT id, status, strftime(created_at, '%Y-%m-%d') AS date FROM t WHERE id = 7",
    "transfer_ledger": """
        SELECT concat_ws('_', 'txn', e.transfer_id, step, e.product_id, e.store_id) AS txn_id, e.transfer_id, e.product_id, e.store_id, 'transfer_in' AS type, qty, '2000-01-01' AS date, 'user-9' AS staff_name, reason FROM (
            SELECT i.transfer_id, i.product_id, i.to_store AS store_id, 'received' AS step, i.sent_qty AS qty, 'Received from ' || s_name AS reason FROM items i JOIN came c ON i.transfer_id = c.transfer_id AND i.product_id = c.product_id JOIN supplier ON s_suppkey = i.from_store
                WHERE transfer_status = 'in_transit' AND CASE WHEN i.product_id % 11 = 0 THEN 0 ELSE came END = i.sent_qty
            UNION ALL SELECT transfer_id, product_id, from_store, 'cancelled', sent_qty, 'Transfer cancelled — stock returned' FROM items WHERE transfer_status = 'in_transit'
            UNION ALL SELECT transfer_id, product_id, to_store, 'resolved', kept, CASE product_id % 3 WHEN 0 THEN 'Flag resolved — accepted as-is from ' ELSE 'Flag resolved — adjusted qty from ' END || s_name FROM acts JOIN supplier ON s_suppkey = from_store WHERE kept IS NOT NULL
            UNION ALL SELECT transfer_id, product_id, from_store, 'resolved', sent_qty - coalesce(kept, 0), CASE product_id % 3 WHEN 2 THEN 'Rejected — full qty returned to ' || s_name WHEN 0 THEN 'Shortfall returned — ' || (sent_qty - kept) || ' units' ELSE 'Adjustment remainder returned — ' || (sent_qty - kept) || ' units' END
                FROM acts JOIN supplier ON s_suppkey = from_store WHERE kept IS NULL OR sent_qty - kept > 0) e
        UNION ALL SELECT concat_ws('_', 'txn', transfer_id, 'sent', product_id, from_store), transfer_id, product_id, from_store, 'transfer_out', sent_qty, '2000-01-01', 'user-9', 'Transfer to ' || s_name FROM items JOIN supplier ON s_suppkey = to_store WHERE transfer_status = 'in_transit'""",
    "stocktake_transfer": """
        SELECT 'draft_' || store_id AS id, CAST(0 AS BIGINT) AS from_store, store_id AS to_store, 'draft' AS status, 'user-9' AS created_by, 'Auto-generated from stock take' AS notes, count(*) AS n_items, CAST(sum(optimum - greatest(0, on_hand)) AS BIGINT) AS units
        FROM stock JOIN best USING (store_id, product_id) WHERE optimum <> 0 AND greatest(0, on_hand) < optimum AND store_id <> 0 GROUP BY store_id""",
    "stocktake_errors": """
        SELECT store_id, 'No shortfalls detected' AS error FROM stock JOIN best USING (store_id, product_id) WHERE store_id % 3 IN (0, 1) GROUP BY store_id HAVING NOT bool_or(optimum <> 0 AND CASE WHEN store_id % 3 = 0 THEN 1000 ELSE 0 END < optimum)""",
    "threshold_saved": "SELECT count(*) AS saved FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 1",
    "sync_merged_rows": """
        SELECT txn_id, type, CAST(CAST(txn_id AS BIGINT) % 50 AS VARCHAR) AS product_id, CAST(trunc(value) AS BIGINT) AS qty, true AS synced FROM log WHERE txn_id NOT IN (SELECT coalesce(target, txn_id) FROM pull WHERE type = 'deleted')
            AND (txn_id IN (SELECT txn_id FROM local_rows) OR txn_id IN (SELECT txn_id FROM pull WHERE type <> 'deleted' AND device <> '7'))""",
    "sync_leader": "SELECT user_id AS tab_id FROM events ORDER BY date_trunc('hour', ts), user_id LIMIT 1",
    "migration_wire": """
        SELECT txn_id AS "TransactionId", strftime(date, '%Y-%m-%d') AS "Date", CAST(store_id AS VARCHAR) AS "StoreId", CAST(product_id AS VARCHAR) AS "ProductId", type AS "Type", qty AS "Qty", l_linestatus AS "StaffName", l_returnflag AS "Reason",
               'migration_v2' AS "DeviceId", epoch_ms(created_at) AS "Timestamp", CAST(transfer_id AS VARCHAR) AS "TransferId", CAST(NULL AS VARCHAR) AS "TargetTransactionId" FROM ledger""",
    "push_totals": "SELECT count(*) AS batches, CAST(coalesce(sum(sent) FILTER (processed = sent), 0) AS BIGINT) AS sent, CAST(coalesce(sum(sent) FILTER (processed IS DISTINCT FROM sent), 0) AS BIGINT) AS failed FROM push_acks",
    "sync_confirmed": """
        SELECT synced, count(*) AS n FROM (SELECT transfer_id % 3 = 0 OR coalesce(processed = sent, false) AS synced FROM ledger LEFT JOIN unsynced USING (txn_id) LEFT JOIN acks USING (batch_no)) GROUP BY synced""",
    "map_items": "SELECT l_orderkey AS id, l_partkey AS product_id, CAST(sum(CAST(l_quantity AS BIGINT) - 10) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2 HAVING sum(CAST(l_quantity AS BIGINT) - 10) > 0",
    "value_rules_more": """
        SELECT p_partkey, lpad(lower(to_hex(CAST(p_size AS BIGINT))), 4, '0') AS hex, CAST(p_size AS BIGINT) AS unhex, CAST(p_size * p_size AS BIGINT) AS squared, replace(p_name, ' ', '|') AS joined, TRY_CAST(p_brand AS DOUBLE) IS NULL AS not_a_number,
               'key,size' AS keys, CAST(p_size + p_partkey AS BIGINT) AS total, CAST(1 AS BIGINT) AS more FROM part""",
    "sync_push_batch": """
        SELECT txn_id AS "TransactionId", strftime(date, '%Y-%m-%d') AS "Date", CAST(store_id AS VARCHAR) AS "StoreId", CAST(product_id AS VARCHAR) AS "ProductId", type AS "Type", qty AS "Qty", l_linestatus AS "StaffName", l_returnflag AS "Reason",
               CAST(transfer_id % 10 AS VARCHAR) AS "DeviceId", epoch_ms(created_at) AS "Timestamp", CAST(transfer_id AS VARCHAR) AS "TransferId", CAST(NULL AS VARCHAR) AS "TargetTransactionId" FROM ledger WHERE transfer_id % 3 <> 0
        UNION ALL SELECT 'del_' || txn_id, '', CAST(store_id AS VARCHAR), CAST(product_id AS VARCHAR), 'deleted', 0, '', 'Transaction deleted: ' || txn_id, 'dev', NULL, '', txn_id FROM ledger WHERE transfer_id % 17 = 0""",
    "wire_round_trip": """
        SELECT txn_id, type, CAST(product_id AS VARCHAR) AS product_id, qty, CAST(store_id AS VARCHAR) AS store_id, CAST(transfer_id AS VARCHAR) AS transfer_id, l_returnflag AS reason, CAST(transfer_id % 10 AS VARCHAR) AS device_id, true AS synced, CAST(NULL AS VARCHAR) AS target_txn_id
        FROM ledger WHERE transfer_id % 3 <> 0
        UNION ALL SELECT 'del_' || txn_id, 'deleted', CAST(product_id AS VARCHAR), 0, CAST(store_id AS VARCHAR), NULL, 'Transaction deleted: ' || txn_id, 'dev', true, txn_id FROM ledger WHERE transfer_id % 17 = 0""",
    "sync_ack_matrix": "SELECT status, processed, count(*) AS n, coalesce(processed = 50, false) AS synced FROM answers GROUP BY status, processed",
    "transfer_replay": """
        SELECT k AS transfer_id, max_by(status, n) FILTER (n > 0) AS status, count(*) FILTER (n > 0 AND error IS NULL) AS accepted, count(error) AS refused, CAST(sum(units_out) AS BIGINT) AS units_out, CAST(sum(units_in) AS BIGINT) AS units_in FROM fold GROUP BY k""",
    "transfer_replay_refused": "SELECT step, error, count(*) AS n FROM fold WHERE error IS NOT NULL GROUP BY step, error",
    "sync_mark_synced": "SELECT transfer_id % 2 = 0 OR transfer_id % 3 = 0 AS synced, count(*) AS n FROM ledger GROUP BY 1",
    "sync_pull_merge": """
        SELECT txn_id FROM (SELECT txn_id FROM local_rows UNION SELECT txn_id FROM pull WHERE type <> 'deleted' AND device <> '7') WHERE txn_id NOT IN (SELECT coalesce(target, txn_id) FROM pull WHERE type = 'deleted')""",
    "sync_bootstrap": "SELECT txn_id FROM boot WHERE type <> 'deleted' AND txn_id NOT IN (SELECT coalesce(target, txn_id) FROM boot WHERE type = 'deleted')",
    "sync_bootstrap_in_order": "SELECT txn_id FROM boot WHERE type <> 'deleted'",
    "sync_replay": "SELECT CAST(store AS VARCHAR) AS store_id, count(*) AS n, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS qty FROM boot WHERE type <> 'deleted' GROUP BY 1",
    "sync_tombstones": "SELECT DISTINCT coalesce(target, txn_id) AS txn_id FROM boot WHERE type = 'deleted'",
    "sync_overlap": "SELECT count(*) AS overlap FROM log WHERE ts > TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-20' AND type <> 'deleted' AND txn_id IN (SELECT txn_id FROM local_rows)",
    "stale_devices": "SELECT device AS device_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_sync_s FROM log GROUP BY device HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00'",
    "migration_batches": "SELECT n // 50 AS batch_no, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY txn_id) - 1 AS n FROM ledger) GROUP BY 1",
    "latest_versions": "SELECT transfer_id, product_id, txn_id, qty FROM ledger QUALIFY row_number() OVER (PARTITION BY transfer_id, product_id ORDER BY qty DESC, txn_id DESC) = 1",
    "table_counts": "SELECT 'stores' AS table_name, count(*) AS n_rows FROM supplier UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'users', count(*) FROM customer UNION ALL SELECT 'transactions', count(*) FROM lineitem UNION ALL SELECT 'transfers', count(*) FROM orders",
    "store_upsert": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey - 5 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT s_suppkey + 5, CASE WHEN s_suppkey % 4 = 0 THEN lower(s_name) ELSE upper(s_name) END FROM supplier WHERE s_suppkey % 2 = 0",
    "json_props": "SELECT event_type, CAST(sum(k) AS BIGINT) AS k_sum, count(*) FILTER (k > 50) AS k_high, CAST(max(length(props)) AS BIGINT) AS longest FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "loose_json": """
        SELECT CASE event_id % 7 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'k is not bigint' END AS problem, event_type, count(*) AS n,
               CAST(sum(CASE WHEN event_id % 7 IN (3, 5, 6) THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2""",
    "loose_conversations": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role",
    "value_rules": """
        SELECT p_partkey, CAST(coalesce(nullif(p_size % 5, 0), nullif(p_size % 3, 0), -1) AS BIGINT) AS truthy, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS parsed, CAST(0 AS BIGINT) AS no_number,
               replace(lower(p_name), '_', ' ') AS lowered, lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 5, '0') AS padded FROM part""",
}
ORACLE = {name: sql(body) for name, body in _BODIES.items()}
