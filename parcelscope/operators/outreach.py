"""Prospects, campaigns and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import display as X
from ..functions.text import strip
from .topk import first_rows, numbered_rows


def select_prospects(prospects: DataFrame, segment: str | None = None, ids=None) -> DataFrame:
    if segment:
        prospects = prospects.where(F.col("segment") == segment)
    if ids:
        prospects = prospects.where(F.col("id").isin(list(ids)))
    return prospects.orderBy(F.col("rank").asc_nulls_first(), "id")


def populate_prospect_geo(prospects: DataFrame) -> DataFrame:
    """Zip and city from an explicit 'City, AZ 12345' in the notes; others keep theirs."""
    # Fixed value: how a city, state and zip are written in notes.
    pattern = r",\s*([A-Za-z][A-Za-z .]+?),\s*([A-Z]{2})\s+(\d{5})\b"
    part = lambda i: F.regexp_extract("notes", pattern, i)
    found = F.coalesce(part(2) == "AZ", F.lit(False))
    return prospects.withColumns(
        {
            "zips": F.when(found, part(3)).otherwise(F.col("zips")),
            "cities": F.when(found, F.trim(part(1))).otherwise(F.col("cities")),
        }
    )


def assign_variants(prospects: DataFrame) -> DataFrame:
    """Give every prospect a variant: round-robin by rank within its segment, missing ranks first.

    The sequence goes on from the number already assigned in the segment; a missing segment is a
    segment of its own.
    """
    assigned = prospects.groupBy(F.col("segment").alias("__seg")).agg(
        F.count("subject_variant").alias("__taken")
    )
    todo = prospects.where(F.col("subject_variant").isNull()).select("id", "segment", "rank")
    numbered = numbered_rows(todo, "segment", "rank", "id")
    place = (F.col("__taken") + F.col("rn") - 1) % len(K.VARIANTS)
    fresh = numbered.join(assigned, F.col("segment").eqNullSafe(F.col("__seg"))).select(
        "id",
        F.element_at(F.array(*[F.lit(v) for v in K.VARIANTS]), (place + 1).cast("int")).alias("__v"),
    )
    return (
        prospects.join(fresh, "id", "left")
        .withColumn("subject_variant", F.coalesce("subject_variant", "__v"))
        .select(*prospects.columns)
    )


# Fixed value: the alphabet of link codes.
LINK_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _code(seed: Column) -> Column:
    """Eight characters from the first eight bytes of a digest."""
    digest = F.md5(seed)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    chars = [
        F.substring(F.lit(LINK_ALPHABET), byte(i) % len(LINK_ALPHABET) + 1, F.lit(1))
        for i in range(8)
    ]
    return F.concat(*chars)


def ensure_link_codes(prospects: DataFrame, salt: str, tries: int = 4) -> DataFrame:
    """A unique code for every prospect without one; existing codes stay.

    Each prospect proposes a few codes. A code goes to one proposer and never to one that exists,
    so the codes are unique whatever the digest does. A prospect that gets none of its codes fails
    the job; it is never left without.
    """
    seed = F.concat_ws("|", F.lit(salt), F.col("id"), F.col("try"))
    proposed = (
        prospects.where(F.col("link_code").isNull())
        .select("id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
        .withColumn("code", _code(seed))
        .join(prospects.select(F.col("link_code").alias("code")), "code", "left_anti")
    )
    owners = proposed.groupBy("code").agg(F.min(F.struct("try", "id")).alias("owner"))
    given = owners.groupBy("owner.id").agg(F.min_by("code", "owner.try").alias("__code"))
    return (
        prospects.join(given, "id", "left")
        .withColumn("link_code", F.coalesce("link_code", "__code", F.raise_error(
            F.concat(F.lit(f"no code in {tries} tries for prospect "), F.col("id").cast("string")))))
        .select(*prospects.columns)
    )


def prospects_with_email(prospects: DataFrame) -> DataFrame:
    return prospects.agg(F.count_if(F.col("email") != "").alias("n"))


def latest_campaign(campaigns: DataFrame) -> DataFrame:
    return campaigns.orderBy(F.col("id").desc()).limit(1)


def trial_clicks_named(clicks: DataFrame, prospects: DataFrame) -> DataFrame:
    who = prospects.select(F.col("id").alias("prospect_id"), "company", "contact_name")
    return clicks.join(who, "prospect_id", "left")


def access_requests_dedupe(requests: DataFrame) -> DataFrame:
    """First valid request of each e-mail; a filled trap field `company` marks a bot."""
    email = F.lower(strip(F.coalesce("email", F.lit(""))))
    # The e-mail pattern and its longest length.
    valid = requests.withColumn("email", email).where(
        (F.coalesce("company", F.lit("")) == "")
        & F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")
        & (F.length("email") <= 254)
    )
    first = first_rows(valid, ["email"], [F.col("id").asc()])
    return first.select(
        "id", "email",
        F.when(F.col("segment").isin(K.REQUEST_SEGMENTS), F.col("segment")).alias("segment"),
        F.substring("source", 1, 64).alias("source"),
    )


# --- campaign figures ------------------------------------------------------------------------


def _people_per_event(events: DataFrame, *by: str) -> DataFrame:
    """One row per (by..., event, prospect): distinct counts become plain counts after it."""
    return events.where(F.col("prospect_id").isNotNull()).select(
        *by, "event", "prospect_id"
    ).distinct()


def _stage_counts(names=K.FUNNEL_EVENTS) -> list[Column]:
    return [F.count_if(F.col("event") == e).alias(e) for e in names]


def campaign_funnel(events: DataFrame, prospects: DataFrame, campaign: int) -> DataFrame:
    """One row: assigned prospects and distinct prospects per stage."""
    people = _people_per_event(events.where(F.col("campaign_id") == campaign))
    assigned = prospects.agg(F.count("subject_variant")).scalar()
    return people.agg(*_stage_counts()).withColumn("assigned", assigned)


def pct(n: Column, base: Column) -> Column:
    """Share in percent with one decimal; NULL without a base."""
    return F.when(base > 0, F.floor(n / base * 1000 + 0.5) / 10)


def variant_stats(events: DataFrame, prospects: DataFrame, campaign: int) -> DataFrame:
    """Per variant A-D: assigned and distinct prospects per stage, zero-filled, and rates."""
    stages = ["sent", "opened", "clicked", "replied", "trial"]
    people = _people_per_event(events.where(F.col("campaign_id") == campaign), "variant")
    counts = people.groupBy("variant").agg(*_stage_counts(stages))
    assigned = prospects.groupBy(F.col("subject_variant").alias("variant")).agg(
        F.count("*").alias("assigned")
    )
    variants = events.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in K.VARIANTS])).alias("variant")
    )
    zero = F.lit(0).cast("bigint")
    rows = variants.join(assigned, "variant", "left").join(counts, "variant", "left").select(
        "variant", *[F.coalesce(F.col(c), zero).alias(c) for c in ["assigned", *stages]]
    )
    return rows.withColumns(
        {f"{c}_pct": pct(F.col(c), F.col("sent")) for c in ("opened", "clicked", "replied", "trial")}
    )


def outreach_health(events: DataFrame, as_of) -> DataFrame:
    """One row of sender facts: send days, sent today, trouble since the previous send day."""
    today = D.phoenix_date(D.as_of_col(as_of))
    facts = (
        events.where(F.col("event").isin("sent", "stop", "bounced"))
        .groupBy(D.phoenix_date("created_at").alias("day"), "event", "prospect_id")
        .agg(F.count("*").alias("n"))
    )
    sent = F.col("event") == "sent"
    before = facts.where(sent & (F.col("day") < today)).agg(F.max("day")).scalar()
    # A previous send day starts at Phoenix midnight, so comparing Phoenix days is exact.
    since = F.coalesce(F.col("day") >= F.col("prev_day"), F.lit(False))
    trouble = lambda e: F.coalesce(
        F.sum(F.when((F.col("event") == e) & since, F.col("n"))), F.lit(0)
    )
    who = lambda cond: F.count_distinct(F.when(cond, F.col("prospect_id")))
    return facts.withColumn("prev_day", before).agg(
        F.count_distinct(F.when(sent, F.col("day"))).alias("send_days"),
        who(sent & (F.col("day") == today)).alias("sent_today"),
        F.first("prev_day").alias("prev_send_day"),
        trouble("stop").alias("stops_since"),
        trouble("bounced").alias("bounces_since"),
        who(sent).alias("sent_total"),
        who(F.col("event") == "bounced").alias("bounced_total"),
    )


def ramp_and_halt(health: DataFrame, override: int | None = None) -> DataFrame:
    """Daily target, what remains of it, and whether sending must stop."""
    cap = K.HARD_DAILY_CAP
    forced = override is not None and override > 0
    if forced:
        target = F.lit(min(int(override), cap))
    else:
        target = F.when(F.col("send_days") < K.RAMP_DAYS, K.RAMP_START).otherwise(K.RAMP_LATER)
    left = F.lit(cap) - F.col("sent_today")
    by_target = target if forced else target - F.col("sent_today")
    rate = F.col("bounced_total") / F.nullif(F.col("sent_total"), F.lit(0))
    reason = (
        F.when(
            F.col("stops_since") > 0,
            F.concat("stops_since", F.lit(" stop event(s) since the previous send day")),
        )
        .when(
            F.col("bounces_since") > 0,
            F.concat("bounces_since", F.lit(" bounce(s) since the previous send day")),
        )
        .when(
            rate > K.MAX_BOUNCE_RATE,
            F.concat(
                F.lit("bounce rate "), F.format_string("%.1f", rate * 100),
                F.lit(f"% exceeds {K.MAX_BOUNCE_RATE * 100:.0f}%"),
            ),
        )
    )
    return health.withColumns(
        {
            "target": target.cast("bigint"),
            "remaining": F.greatest(F.lit(0), F.least(by_target, left)).cast("bigint"),
            "halt_reason": reason,
            "halt": reason.isNotNull(),
        }
    )


# --- choosing whom to write --------------------------------------------------------------------


def with_candidate_columns(
    prospects: DataFrame, matches: DataFrame, events: DataFrame, campaign: int
) -> DataFrame:
    """Prospects plus inbox_flag, near (a zip or city match exists) and already_sent."""
    near = matches.where(F.col("match_tier").isin("zip", "city")).select(
        F.col("prospect_id").alias("id")
    ).distinct().withColumn("near", F.lit(True))
    sent = events.where((F.col("campaign_id") == campaign) & (F.col("event") == "sent")).select(
        F.col("prospect_id").alias("id")
    ).distinct().withColumn("already_sent", F.lit(True))
    return (
        prospects.join(near, "id", "left").join(sent, "id", "left")
        .withColumns(
            {
                "near": F.coalesce("near", F.lit(False)),
                "already_sent": F.coalesce("already_sent", F.lit(False)),
                "inbox_flag": X.classify_inbox("email", "url"),
            }
        )
    )


def eligible_prospects(cands: DataFrame) -> DataFrame:
    return cands.where(
        (F.col("status") == "new") & (F.coalesce("email", F.lit("")) != "")
        & F.col("inbox_flag").isNull()
        & (F.coalesce("segment", F.lit("")) != "community_leader")
        & (F.coalesce("subject_variant", F.lit("")) != "") & ~F.col("already_sent")
    )


def select_batch(cands: DataFrame, n: int) -> DataFrame:
    """First n eligible prospects: those with a local match, then lenders, then the rest."""
    tier = F.when(F.col("near"), 0).when(F.col("segment") == "lender", 1).otherwise(2)
    return (
        eligible_prospects(cands).withColumn("tier", tier)
        .orderBy("tier", "rank", "id").limit(max(0, n))
    )


def next_batch(
    prospects: DataFrame, matches: DataFrame, events: DataFrame, campaigns: DataFrame,
    numbers: DataFrame, campaign: int, n: int,
) -> DataFrame:
    """The next prospects to write to, with their subject line. Nothing is sent."""
    cands = with_candidate_columns(prospects, matches, events, campaign)
    chosen = select_batch(cands, n).where(F.coalesce("link_code", F.lit("")) != "")
    n7 = numbers.select(F.col("n7").cast("string")).scalar()
    return chosen.withColumn("n7", n7).select(
        F.col("id").alias("prospect_id"),
        campaigns.agg(F.max("id")).scalar().alias("campaign_id"),
        F.col("subject_variant").alias("variant"), F.col("email").alias("to"),
        F.col("contact_name").alias("to_name"),
        X.subject_for("subject_variant", "company", "n7").alias("subject"),
    )


def send_sheet(
    prospects: DataFrame, latest_matches: DataFrame, numbers: DataFrame,
    segment: str | None = None,
) -> DataFrame:
    """Prospects that did not opt out, with all subjects, inbox flag and two matches or none."""
    rows = prospects.where(F.col("status") != "stop")
    if segment:
        rows = rows.where(F.col("segment") == segment)
    both = latest_matches.where(F.size("matches") >= 2).select(
        F.col("prospect_id").alias("id"), "match_date",
        F.slice("matches", 1, 2).alias("matches"),
    )
    n7 = numbers.select(F.col("n7").cast("string")).scalar()
    return rows.join(both, "id", "left").withColumn("n7", n7).select(
        "id", "rank", "company", "contact_name", "segment", "email", "phone", "url", "status",
        F.col("subject_variant").alias("variant"), X.first_name("contact_name").alias("first_name"),
        *[
            X.subject_for(F.lit(v), "company", "n7").alias(f"subject_{v.lower()}")
            for v in K.VARIANTS
        ],
        "match_date", "matches", X.classify_inbox("email", "url").alias("inbox_flag"),
    )


SHEET_KEYS = ["segment_rank", "segment_first", "flagged"]


def send_sheet_keys(sheet: DataFrame) -> DataFrame:
    """Adds what the sheet is sorted by: its segment's best prospect, and flagged or not."""
    key = F.coalesce("segment", F.lit(""))
    place = F.coalesce("rank", F.lit(0)).alias("rank")  # a missing rank counts as 0
    best = sheet.groupBy(key.alias("__k")).agg(F.min(F.struct(place, "id")).alias("__best"))
    return sheet.join(best, key == F.col("__k")).select(
        *sheet.columns, F.col("__best.rank").alias("segment_rank"),
        F.col("__best.id").alias("segment_first"),
        F.col("inbox_flag").isNotNull().alias("flagged"),
    )


def send_sheet_order(sheet: DataFrame) -> DataFrame:
    """Segments by their best rank, flagged inboxes last in a segment, then rank."""
    return (
        send_sheet_keys(sheet)
        .orderBy(*SHEET_KEYS, F.coalesce("rank", F.lit(0)), "id")
        .drop(*SHEET_KEYS)
    )


# --- engagement ----------------------------------------------------------------------------------


def _is_bot_click(meta: Column) -> Column:
    """A click's recorded bot mark: any value but false, 0, "" and null. Meta that is not JSON as a
    whole counts as a person."""
    parsed = F.try_parse_json(F.nullif(strip(meta), F.lit("")))
    mark = F.try_variant_get(parsed, "$.bot", "string")
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.bot", "variant"))
    no = (
        F.when(kind == "BOOLEAN", mark == "false")
        .when(kind == "STRING", mark == "")
        .when(kind.isin("VOID") | mark.isNull(), True)
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), mark.try_cast("double") == 0)
        .otherwise(False)
    )
    return F.coalesce(~no, F.lit(False))


def engagement_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Clicks and page events of known prospects as one table."""
    clicks = events.where((F.col("event") == "clicked") & F.col("prospect_id").isNotNull()).select(
        "prospect_id", F.col("created_at").alias("at"), F.lit("click").alias("kind"), "event",
        F.lit(None).cast("string").alias("path"), _is_bot_click(F.col("meta")).alias("bot"),
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("double").alias("ms"),
    )
    seen = pages.where(F.col("prospect_id").isNotNull()).select(
        "prospect_id", F.col("created_at").alias("at"), F.lit("page").alias("kind"), "event", "path",
        F.lit(None).cast("boolean").alias("bot"),
        F.nullif("session_id", F.lit("")).alias("session_id"), F.col("ms").cast("double").alias("ms"),
    )
    return clicks.unionByName(seen)


def engagement_rollup(events: DataFrame, pages: DataFrame, prospects: DataFrame) -> DataFrame:
    """One row per prospect with any click or page event.

    Events are folded to (prospect, session, path) first, so sessions and pages are counted without
    copying the events for each distinct count.
    """
    click, page = F.col("kind") == "click", F.col("kind") == "page"
    of = lambda e: page & (F.col("event") == e)
    path = F.nullif("path", F.lit(""))
    on_report = of("engaged_time") & F.startswith(path, F.lit("/report"))
    sums = {
        "human_clicks": F.count_if(click & ~F.col("bot")), "bot_clicks": F.count_if(click & F.col("bot")),
        "engaged_ms": F.coalesce(F.sum(F.when(on_report, F.col("ms"))), F.lit(0.0)),
        "rows_expanded": F.count_if(of("row_expand")), "export_clicks": F.count_if(of("export_click")),
        "cta_clicks": F.count_if(of("cta_click")),
    }
    times = {"first_click_at": F.min(F.when(click, F.col("at"))), "last_seen": F.max("at")}
    viewed = F.when(of("pageview"), path)

    def again(more: dict) -> list[Column]:
        return [
            F.min("first_click_at").alias("first_click_at"), F.max("last_seen").alias("last_seen"),
            *[F.sum(c).alias(c) for c in sums], *[v.alias(k) for k, v in more.items()],
        ]

    fine = engagement_events(events, pages).groupBy("prospect_id", "session_id", viewed.alias("viewed")).agg(
        *[v.alias(k) for k, v in {**times, **sums}.items()]
    )
    by_page = fine.groupBy("prospect_id", "viewed").agg(
        *again({})
    ).groupBy("prospect_id").agg(*again({"pages_visited": F.count("viewed")}))
    sessions = fine.where(F.col("session_id").isNotNull()).select("prospect_id", "session_id").distinct().groupBy(
        "prospect_id").agg(F.count("*").alias("sessions"))
    rolled = by_page.join(sessions, "prospect_id", "left").select(
        "prospect_id", "first_click_at", "last_seen", "human_clicks", "bot_clicks",
        F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"), "engaged_ms", "pages_visited",
        "rows_expanded", "export_clicks", "cta_clicks",
    )
    who = prospects.select(
        F.col("id").alias("prospect_id"), F.nullif("company", F.lit("")).alias("company"),
        "contact_name", "segment", F.col("subject_variant").alias("variant"),
    )
    return rolled.join(who, "prospect_id", "left").withColumn(
        "company", F.coalesce("company", F.concat(F.lit("#"), F.col("prospect_id")))
    )


def engagement_timeline(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Every event of the rollup as a row, newest first per prospect.

    Rows rather than an array per prospect; the range-partitioned sort also splits a busy prospect.
    """
    return engagement_events(events, pages).select(
        "prospect_id", "at", "kind", "event", "path", "bot"
    ).orderBy("prospect_id", F.col("at").desc(), "kind", "event", "path")


def engagement_pages(pages: DataFrame) -> DataFrame:
    """Distinct pages each prospect viewed."""
    return pages.where(
        F.col("prospect_id").isNotNull() & (F.col("event") == "pageview")
        & (F.coalesce("path", F.lit("")) != "")
    ).select("prospect_id", "path").distinct()


def engagement_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count_if(F.col("human_clicks") > 0).alias("clicked_human"),
        F.count_if(F.col("engaged_ms") >= 30000).alias("engaged_over_30s"),
    )


# --- trials and customers --------------------------------------------------------------------------


def first_trial(trials: DataFrame) -> DataFrame:
    """The first trial of each prospect, or of each visitor when there is no prospect."""
    key = (
        F.when(F.col("prospect_id").isNotNull(), F.concat(F.lit("p"), F.col("prospect_id")))
        .when(F.col("vid").isNotNull(), F.concat(F.lit("v"), F.col("vid")))
        .otherwise(F.concat(F.lit("t"), F.col("id")))
    )
    return first_rows(
        trials.withColumn("trial_key", key), ["trial_key"], [F.col("id").asc()]
    )


def trial_windows(trials: DataFrame, as_of, days: int = K.TRIAL_DAYS) -> DataFrame:
    """End, activity and whole days left of every first trial."""
    ends = F.col("started_at") + F.make_dt_interval(days=F.lit(days))
    return first_trial(trials).withColumn("ends_at", ends).withColumns(
        {
            "active": D.as_of_col(as_of) < F.col("ends_at"),
            "days_left": D.days_left("ends_at", as_of),
        }
    )
