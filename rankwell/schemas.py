"""Column lists of the raw and the canonical record."""

from __future__ import annotations

RAW_TYPES = {
    "external_id": "string",
    "source_url": "string",
    "apply_url": "string",
    "company_name": "string",
    "company_domain": "string",
    "title": "string",
    "description_text": "string",
    "description_html": "string",
    "location_raw": "string",
    "work_mode": "string",
    "employment_type": "string",
    "seniority": "string",
    "salary_raw": "string",
    "salary_min": "double",
    "salary_max": "double",
    "salary_currency": "string",
    "salary_period": "string",
    "skills": "array<string>",
    "posted_at": "timestamp",
    "raw": "string",
}
PAYLOAD_SCHEMA = "value string, kind string, token string"
