"""Record types of the lead pipeline."""

from __future__ import annotations

PERSON = "struct<name:string,designation:string,linkedin:string,decision_maker_score:int>"
LEAD = (
    "company_name string, website string, linkedin string, industry string, location string, contact_page string, about_page string, team_page string, "
    f"emails array<string>, phones array<string>, social_links map<string,string>, people array<{PERSON}>, source string, confidence_score int, lead_quality string, "
    "company_type string, relevance_score int, relevance_tier string"
)
SEARCH_RESULT = "url string, title string, snippet string, provider string, source string, rank int, provider_rank int, query string, page int, timestamp double"
#: The one fixed type: what the master table holds, in order.
MASTER = ("domain", "company_name", "website", "industry", "location", "contact_page", "about_page", "emails", "phones", "social_links", "people", "source")
ONTOLOGY = "domain string, channel string, term string, ordinal int"
OUTCOMES = "entity string, ord long, ts timestamp, outcome string, latency_ms double"
