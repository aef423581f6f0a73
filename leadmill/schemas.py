"""Schemas of the engine's tables and of their nested values, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVIDENCE = "url string, page_type string, quote string"
EMAIL = "email string, evidence array<struct<url:string,page_type:string,quote:string>>"
CONTACT = "name string, role string, evidence array<struct<url:string,page_type:string,quote:string>>"
SELECTED_EMAIL = "email string, score double, page_type string"
SELECTED_COMPANY = "name string, score double, page_type string"

TABLES: dict[str, str] = {
    "htr_results": "request_id string, job_id string, domain string, organization string, location string, headcount string, query string",
    "gmaps_results": "request_id string, job_id string, domain string, organization string, location string, query string",
    "mstr_results": "request_id string, job_id string, sheet_id string, organization string, source string, domain string, crawl_status string, extraction_status string, enrichment_status string, mail_write_status string, mail_send_status string, crawl_processing_started_at timestamp",
    "crawl_results": "request_id string, job_id string, domain string, url string, page_type string, contact_case string, cleaned_html string, markdown string, status string, error string, created_at timestamp",
    "det_ext_results": "id string, request_id string, job_id string, domain string, url string, page_type string, emails_json string, created_at timestamp",
    "llm_ext_results": "id string, request_id string, job_id string, domain string, url string, page_type string, company_json string, description_json string, emails_json string, contacts_json string, status string, error string, created_at timestamp",
    "enrichment_results": "id string, request_id string, job_id string, sheet_id string, organization string, domain string, company_json string, description_json string, emails_json string, det_emails_json string, contacts_json string, company string, email string, emails string, description string, contacts string, status string, error string, created_at timestamp, updated_at timestamp",
    "mail_content": "request_id string, job_id string, spreadsheet_id string, organisation string, domain string, company string, email string, contacts string, description string, verification_link string, subject string, content string, send_status string, comments string, updated_at timestamp_ntz",
    "mail_tracker": "request_id string, thread_id string, company string, domain string, contacts string, email string, subject string, content string, send_status string, sent_at timestamp, reply_status string, received_at timestamp, comments string, created_at timestamp, updated_at timestamp",
    "jobs": "job_id string, tool string, request_id string, state string, progress struct<phase:string,current:int,total:int,message:string,metrics:map<string,string>>, created_at timestamp, started_at timestamp, updated_at timestamp, finished_at timestamp, meta map<string,string>, error string",
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones are null, others go, types are cast."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))
