"""Column lists of the tables the jobs exchange."""

SIGNAL_RECORD = (
    "signal_type string, source string, external_id string, apn string, source_url string, "
    "event_date date, status string, owner_name string, situs_address string, raw string"
)
SIGNAL_COLUMNS = [c.strip().split(" ")[0] for c in SIGNAL_RECORD.split(",")]

SIGNALS = (
    SIGNAL_RECORD + ", match_confidence string, resolved boolean, resolution struct<method:string,"
    "count:bigint,candidates:array<string>>, observed_date date, created_at timestamp, "
    "updated_at timestamp"
)

PROPERTIES = (
    "apn string, situs_address string, situs_city string, situs_zip string, owner_name string, "
    "owner_name_norm string, owner_name_sorted string, situs_norm string, mailing_address string, "
    "absentee boolean, building_type string, legal_class string, year_built int, living_sqft int, "
    "last_sale_date date, last_sale_price double, assessed_value double, updated_at timestamp"
)

SCRAPE_RUNS = (
    "id string, source string, started_at timestamp, finished_at timestamp, rows_found int, "
    "rows_new int, status string, error string, source_max_date date"
)

PROSPECTS = (
    "id bigint, rank int, company string, contact_name string, segment string, email string, "
    "phone string, url string, notes string, status string, zips string, cities string, "
    "subject_variant string, link_code string"
)

PAGE_EVENTS = (
    "id bigint, vid string, prospect_id bigint, session_id string, path string, event string, "
    "meta string, ms double, created_at timestamp"
)

OUTREACH_EVENTS = (
    "id bigint, prospect_id bigint, campaign_id bigint, variant string, event string, meta string, "
    "created_at timestamp"
)
