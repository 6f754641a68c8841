"""Schemas of the tables and of landed pages."""

from __future__ import annotations

MONEY = "decimal(18,4)"

DOCUMENTS = "doc_id string, context_id int, doc_number long, issue_date date, customer_id string, modified long"
LINES = f"item_id long, doc_id string, quantity {MONEY}, price {MONEY}"
STATE = "lastSync long, lastFullSync long, documentCount long, itemDocumentCount long, accountName string, schemaVersion int"

STORED_LINES = f"item_id string, doc_id string, quantity {MONEY}, price {MONEY}"
STORED_DOCUMENTS = f"{DOCUMENTS}, n_lines int, gone boolean"

LINE_JSON = "struct<item_id:string,quantity:double,price:double>"
DOCUMENT_JSON = f"struct<id:string,context_id:int,document_number:long,customer_id:string,issue_date:string,modified:string,document_items:array<{LINE_JSON}>>"
DOCUMENT_PAGE = f"count long, page long, pages string, documents array<array<{DOCUMENT_JSON}>>"
ITEM_JSON = "struct<id:long,name:string,description:string,sku:string,category_id:string,quantity:double,cost:double,price:double,modified:string>"
ITEM_PAGE = f"count long, page long, pages string, items array<{ITEM_JSON}>"
CUSTOMER_JSON = "struct<id:string,context_id:int,name:string,office_email:string,modified:string>"
CUSTOMER_PAGE = f"count long, page long, pages string, customers array<{CUSTOMER_JSON}>"
CATEGORY_PAGE = "count long, page long, pages string, categories array<array<struct<id:string,name:string,parent_id:string,item_count:long>>>"
LOCATION_PAGE = "count long, page long, pages string, locations array<array<struct<id:long,name:string,short_name:string,zones:array<string>>>>"

ESTIMATE, INVOICE, PURCHASE = 4, 5, 11
DOCUMENT_CONTEXTS, ACCOUNT_CONTEXTS = (4, 5, 11), (2, 8, 10)
