"""Record types as Spark schemas. Null means never measured; an empty list means measured and none found."""

from __future__ import annotations

INTERVAL = "struct<mean: double, lower_bound: double, upper_bound: double>"
FACT = "struct<value: string, fact_class: string, origin: string>"
REGION = "struct<x: double, y: double, w: double, h: double>"
FIELD = "struct<value: string, original: string, method: string, confidence: double, region: string>"

#: Column lists by record, for createDataFrame, from_json and readers.
SCHEMAS = {
    "search_intent": "search_id string, created_at timestamp, text string, tags array<string>, constraints map<string, string>, budget map<string, bigint>",
    "listing_image": "image_id string, url string, role string, sha256 string, phash string, family_id string, width int, height int",
    "listing_candidate": f"search_id string, candidate_id string, source_id string, canonical_url string, listing_id string, title string, description string, brand string, model string, price decimal(18,4), currency string, size_marked string, size_system string, availability string, last_checked_at timestamp, images array<struct<image_id: string, url: string, sha256: string, family_id: string>>, facts array<{FACT}>, field_records map<string, {FIELD}>",
    "match_evidence": f"search_id string, candidate_id string, item_match {INTERVAL}, support array<string>, contradictions array<string>, hard_contradictions array<string>, missing array<string>",
    "authenticity_evidence": f"search_id string, candidate_id string, authenticity {INTERVAL}, calibrated boolean, hard_contradictions array<string>, missing array<string>, label string",
    "listing_utility": "search_id string, candidate_id string, utility double, size_match double, region_match double, coverage double, verified boolean",
    "bucket_decision": "search_id string, candidate_id string, bucket string, reasons array<string>, vetoes array<string>, policy_version string",
    "item_hypothesis": "search_id string, hypothesis_id string, brand string, model string, category string, year int, posterior double, status string",
    "query_variant": "search_id string, query_id string, text string, language string, family string, round int, gain double, cost double, novelty double",
    "fetch_attempt": "search_id string, source_id string, url string, status int, outcome string, bytes bigint, at timestamp",
    "campaign_event": "search_id string, seq bigint, event_id string, predecessor string, kind string, at timestamp, payload string",
    "index_listing": "listing_key string, canonical_url string, title string, adapter_version string, model_version string, parameters string, schema_version string, policy_version string, first_seen_at timestamp, updated_at timestamp",
    "index_term": "listing_key string, field string, term string, tf bigint",
    "index_descriptor": "listing_key string, kind string, dim int, descriptor array<float>",
    "evidence_record": f"record_id string, search_id string, family_id string, content_digest string, polarity string, weight double, interval {INTERVAL}",
    "source_health": "source_id string, state string, consecutive_failures int, opened_until timestamp",
    "frontier_entry": "run_id string, work_key string, source_id string, url string, kind string, depth int, priority double, state string, created_at timestamp, claimed_at timestamp",
    "reference_crop": f"crop_id string, image_id string, view string, region {REGION}, quality double",
}

# fixed values of the closed lists
OUTCOMES = ["SEARCHED_MATCHES_FOUND", "SEARCHED_NO_MATCH", "BLOCKED_BY_ACCESS", "BLOCKED_BY_POLICY", "AUTH_REQUIRED", "RATE_LIMITED", "FAILED", "UNMEASURABLE", "NOT_ATTEMPTED", "DISABLED", "CANCELLED"]
BUCKETS = ["REAL", "POSSIBLY_REAL", "REPLICA", "HIDDEN"]
