"""Schemas, kinds and fixed values of the graph."""

from __future__ import annotations

ENTITY = (
    "uid string, kind string, name string, canonical_name string, attributes map<string,string>, source string, "
    "confidence double, created_at string, updated_at string"
)
RELATION = (
    "id string, source_uid string, target_uid string, kind string, confidence double, source string, "
    "attributes map<string,string>, valid_from string, valid_to string, created_at string"
)
HISTORY = "uid string, snapshot string, changed_by string, changed_at string, seq bigint"
CODE_ENTITY = (
    "id string, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, "
    "signature string, docstring string, language string, extra map<string,string>"
)
CODE_RELATION = "id string, source_id string, target_id string, kind string, file_path string, line int, weight double, extra map<string,string>"

#: Node kinds and their uid prefixes.
PREFIXES = {
    "company": "CMP", "tender": "TEN", "person": "PER", "address": "ADR", "phone": "PHN", "email": "EML", "website": "WEB",
    "license": "LIC", "project": "PRJ", "organization": "ORG", "document": "DOC", "province": "PRV", "city": "CTY",
    "industry": "IND", "naics": "NAI", "equipment": "EQP", "contract": "CON", "permit": "PRM", "company_alias": "ALI",
}

#: Edge kinds.
RELATION_KINDS = (
    "owns", "owned_by", "parent_of", "subsidiary_of", "member_of", "employs", "employed_by", "managed_by", "manages",
    "contact_for", "works_with", "awarded_to", "submitted_bid", "awarded_by", "licensed_by", "licenses", "located_at",
    "has_address", "in_city", "in_province", "references", "related_to", "depends_on", "uses", "has_phone", "has_email",
    "has_website", "has_document", "has_permit", "has_contract", "has_license", "in_industry", "has_naics",
    "owns_equipment", "issued_by", "issues", "applied_for", "contracted_for", "participated_in", "alias_of", "same_as",
    "code_references",
)

#: Edges by which a company takes part in a tender.
BIDS = ("awarded_to", "submitted_bid", "participated_in")

#: Weight of an edge kind as evidence of a relationship; others weigh DEFAULT_WEIGHT.
WEIGHTS = {
    "awarded_to": 1.0, "submitted_bid": 0.7, "participated_in": 0.6, "works_with": 0.9, "contracted_for": 0.8,
    "applied_for": 0.5, "issued_by": 0.7, "issues": 0.7, "in_industry": 0.4, "in_city": 0.3, "in_province": 0.2,
    "employs": 0.6, "employed_by": 0.6, "owns": 0.8, "owned_by": 0.8, "parent_of": 0.8, "subsidiary_of": 0.8,
    "member_of": 0.5, "related_to": 0.4, "licensed_by": 0.5,
}
DEFAULT_WEIGHT = 0.3

#: Attribute keys that hold identifiers of other registers.
EXTERNAL_ID_KEYS = (
    "id_bc_registry", "id_business_number", "id_gst_number", "id_cra_number", "id_pspc_vendor", "id_duns", "id_lei",
    "id_website", "id_domain", "id_linkedin_company", "id_twitter", "id_facebook", "scraper_id", "canonical_company_id",
)

#: Attribute keys of a tender in order of precedence.
VALUE_KEYS = ("value", "contract_value", "estimated_value", "budget", "award_value", "amount")
DATE_KEYS = ("valid_from", "date", "issue_date", "posted_date", "closing_date", "deadline")
DEADLINE_KEYS = ("closing_date", "deadline", "due_date", "submission_deadline", "valid_to")

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
