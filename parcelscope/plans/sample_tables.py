"""The engine's tables derived from the generic benchmark tables (customer, events, supplier ...).

Every column is arithmetic on a source column, so the same table can be written down in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

SURNAMES = ["ADAMS", "BAKER", "CLARK", "DAVIS", "EVANS", "FOSTER", "GARCIA", "HARRIS", "IRWIN",
            "JONES", "KELLY", "LOPEZ", "MILLER"]
FORENAMES = ["ANN", "BEN", "CARA", "DAN", "EVE", "FRED", "GINA", "HANK", "IVY", "JACK", "KAREN"]
STREETS = ["MAIN", "OAK", "VALLEY VW", "GLENDALE", "PASADENA", "WHITE HORSE", "46TH"]
DIRECTIONS = ["N", "S", "E", "W"]
TYPES = ["AVE", "ST", "DR", "RD", "LN"]
CITIES = ["PHOENIX", "MESA", "GLENDALE", "TEMPE", "SCOTTSDALE", "PEORIA", "SUN CITY"]
LOG_SOURCES = {"error": "recorder_nots", "click": "recorder_lp", "view": "phoenix_code",
               "purchase": "treasurer_delinquent", "signup": "court_probate"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Event times are stored without a zone and mean UTC.
    return table.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else table


def pick(values: list[str], n: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"element_at(array({quoted}), cast(({n}) % {len(values)} + 1 as int))"


def letter(n: str) -> str:
    return f"char(65 + ({n}) % 26)"


def surname(k: str) -> str:
    return (f"concat({pick(SURNAMES, k)}, {letter(f'{k} div 13')}, {letter(f'{k} div 338')}, "
            f"{letter(f'{k} div 8788')})")


def forename(k: str) -> str:
    return pick(FORENAMES, f"{k} div 2")


def spouse(k: str) -> str:
    return pick(FORENAMES, f"{k} div 11 + 3")


def middle(k: str) -> str:
    return letter(f"{k} div 3")


def fill(template: str, k: str, ln: str, fn: str) -> str:
    """Put names into a template: l surname, n next surname, f forename, s spouse, m initial."""
    out = template
    for mark, value in (("l", ln), ("n", surname(f"({k} + 1)")), ("f", fn), ("s", spouse(k)),
                        ("m", middle(k))):
        out = f"replace({out}, '{mark}', {value})"
    return out


OWNER_FORMS = ["l f m", "l f/s", "l f m/n s", "l HOLDINGS LLC", "l f & s", "l FAMILY TRUST",
               "UNKNOWN", "l f JR", "THE l BANK, N.A."]


def owner_form(k: str) -> str:
    """Every third owner is a SMITH JOHN with some initial; the others vary in form."""
    form = f"{k} div 3 % 9"
    return f"""case when {k} % 18 = 0 then 'SMITH JOHN m/MARY' when {k} % 3 = 0 then 'SMITH JOHN m'
      when {form} = 6 and {k} % 2 = 1 then null else {pick(OWNER_FORMS, form)} end"""


def owner_name(k: str) -> str:
    return fill(owner_form(k), k, surname(k), forename(k))


def house(k: str) -> str:
    """Street line; every tenth parcel shares the line of the one before it."""
    j = f"({k} - if({k} % 10 = 3, 1, 0))"
    return (f"concat_ws(' ', {j} + 100, {pick(DIRECTIONS, j)}, {pick(STREETS, f'{j} div 4')}, "
            f"{pick(TYPES, j)})")


def apn(k: str) -> str:
    return f"lpad(cast({k} as string), 10, '0')"


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel per customer."""
    k = "c_custkey"
    situs = f"if({k} % 17 != 0, {house(k)}, null)"
    return read(spark, sf_dir, "customer").selectExpr(
        f"{apn(k)} as apn",
        f"if({k} % 6 = 5, concat_ws(' ', {situs}, {k} % 50, {k} % 50), {situs}) as situs_address",
        f"if({k} % 23 != 0, {pick(CITIES, 'c_nationkey')}, null) as situs_city",
        f"cast(85000 + {k} % 300 as string) as situs_zip",
        f"{owner_name(k)} as owner_name",
        f"if({k} % 13 != 0, concat({house(f'({k} + {k} % 2)')}, ', ', {pick(CITIES, k)}, ', AZ, ', "
        f"85000 + {k} % 300), null) as mailing_address",
        f"if({k} % 29 != 0, {k} % 5 != 0, null) as absentee",
        f"if({k} % 4 = 0, 'COMMERCIAL', 'RESIDENTIAL') as building_type",
        f"if({k} % 19 != 0, date_add(date'1994-01-01', cast(({k} * 37) % 10900 as int)), null) "
        "as last_sale_date",
        f"if({k} % 7 != 0, cast(({k} * 911) % 900000 + 1000 as double), null) as last_sale_price",
        "if(c_acctbal > 0, c_acctbal * 100, null) as assessed_value",
    )


K_PROP = "cast(get_json_object(props, '$.k') as int)"


def _event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as e", "user_id as u", "event_type as kind", "ts", "value", "props",
        f"{K_PROP} as k",
        # One busy parcel, the others spread over all customers.
        "if(event_id % 6 = 1, 7L, user_id * 10 + event_id % 10) as parcel",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per event; a third has no parcel number yet."""
    p = "parcel"
    source = f"""case kind when 'error' then 'recorder_nots'
      when 'click' then case e % 5 when 0 then 'recorder_ml' when 1 then 'recorder_nl' else 'recorder_lp' end
      when 'view' then {pick(["code_glendale", "code_tempe", "phoenix_code", "code_county"], 'e')}
      when 'purchase' then 'treasurer_delinquent'
      else if(e % 2 = 0, 'court_probate', 'court_divorce') end"""
    form = f"""case e % 5 when 0 then 'f m l' when 1 then {owner_form(p)} when 2 then 'l, f m.'
      when 3 then 'l f AND s l'
      else if({p} % 4 = 0, 'SMITH JOHN & SMITH MARY', 'l HOLDINGS LLC') end"""
    owner = fill(form, p, f"if({p} % 3 = 0, 'SMITH', {surname(p)})",
                 f"if({p} % 3 = 0, 'JOHN', {forename(p)})")
    return _event_columns(spark, sf_dir).selectExpr(
        """case kind when 'error' then 'trustee_sale'
          when 'click' then case e % 5 when 0 then 'mechanics_lien' when 1 then 'lien' else 'lis_pendens' end
          when 'view' then 'code_violation' when 'purchase' then 'tax_delinquent'
          else if(e % 2 = 0, 'probate', 'divorce') end as signal_type""",
        f"{source} as source",
        "cast(e as string) as external_id",
        f"if(e % 3 != 0, {apn(p)}, null) as apn",
        f"if(e % 31 != 0, concat('https://records.example/', {source}, '/', e div 4), null) as source_url",
        "if(k % 13 != 0, date_sub(to_date(ts), k % 40), null) as event_date",
        "if(e % 2 = 0, 'open', 'closed') as status",
        f"if(kind in ('error', 'click', 'signup') and e % 29 != 0, initcap({owner}), null) as owner_name",
        f"if(kind = 'view', concat({house(p)}, case e % 4 when 0 then ' GLENDALE' "
        "when 1 then ', TEMPE, AZ, 85283' else '' end), null) as situs_address",
        "props as raw", "cast(null as string) as match_confidence", "false as resolved",
        "cast(null as struct<method:string,count:bigint,candidates:array<string>>) as resolution",
        "to_date(ts) as observed_date", "ts as created_at", "ts as updated_at",
    )


def scrape_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day and source; the rows found are that day's events of the source."""
    arms = " ".join(f"when '{kind}' then '{name}'" for kind, name in LOG_SOURCES.items())
    daily = read(spark, sf_dir, "events").groupBy(
        F.to_date("ts").alias("day"), F.expr(f"case event_type {arms} end").alias("source")
    ).agg(F.count("*").cast("int").alias("n"), F.count_if(F.expr("event_id % 7 = 0")).alias("n7"))
    return daily.selectExpr(
        "*", "(dayofmonth(day) + length(source)) % 11 as mark",
        "cast(day as timestamp) + interval 13 hours 23 minutes as started_at",
    ).selectExpr(
        "concat_ws('/', day, source) as id", "source", "started_at",
        "started_at + interval 40 minutes as finished_at",
        "if(mark = 5, 0, n) as rows_found", "cast(n7 as int) as rows_new",
        "case mark when 3 then 'warn' when 7 then 'error' else 'ok' end as status",
        "case mark when 7 then 'timeout' when 9 then 'busy-stop' end as error",
        "day as source_max_date",
    )


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prospect per supplier."""
    s = "s_suppkey"
    domain = f"concat('firm', {s}, '.example')"
    zip_ = lambda k: f"cast(85000 + ({k}) % 300 as string)"
    return read(spark, sf_dir, "supplier").selectExpr(
        f"{s} as id",
        f"if({s} % 41 != 0, cast(({s} * 37) % 1009 + 1 as int), null) as rank",
        f"""concat(initcap({surname(s)}),
          {pick([" LLC", " – Homes", ", Inc.", " (West)", " Group", "s"], s)}) as company""",
        f"if({s} % 9 != 0, initcap(concat({forename(s)}, ' ', {surname(s)})), null) as contact_name",
        f"""if({s} % 13 != 0, {pick(["lender", "flipper", "wholesaler", "community_leader", "lender"],
                                    's_nationkey')}, null) as segment""",
        f"""if({s} % 8 != 0, concat(case {s} % 6 when 0 then 'info' when 1 then 'Sales+west'
          else lower(concat({forename(s)}, '.', {surname(s)})) end, '@',
          if({s} % 7 = 0, 'forms.example', {domain})), null) as email""",
        f"concat('555-', lpad(cast({s} as string), 4, '0')) as phone",
        f"""case when {s} % 11 = 0 then '' when {s} % 2 = 0 then concat('https://www.', {domain}, '/about')
          else {domain} end as url""",
        f"""case {s} % 3 when 0 then concat('Office: ', {house(s)}, ', ', initcap({pick(CITIES, s)}),
          ', AZ ', {zip_(s)}) when 1 then 'HQ: 1 High St, Columbus, OH 43220' end as notes""",
        f"{pick(['new', 'new', 'new', 'sent', 'replied', 'stop', 'trial'], s)} as status",
        f"if({s} % 4 = 0, concat({zip_(s)}, ' , ', {zip_(f'{s} + 1')}), null) as zips",
        f"if({s} % 5 < 2, concat_ws(',', initcap({pick(CITIES, s)}), {pick(CITIES, f'{s} + 2')}), null)"
        " as cities",
        f"if({s} % 2 = 0, {pick(['A', 'B', 'C', 'D'], f'{s} div 2')}, null) as subject_variant",
        f"if({s} % 10 = 0, concat('code', lpad(cast({s} as string), 4, '0')), null) as link_code",
    )


def outreach_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(spark, sf_dir).selectExpr(
        "e as id", "if(e % 37 != 0, u, null) as prospect_id", "e % 2 + 1 as campaign_id",
        f"if(u % 5 < 4, {pick(['A', 'B', 'C', 'D'], 'u')}, null) as variant",
        f"""case kind when 'signup' then 'sent' when 'view' then 'opened' when 'click' then 'clicked'
          when 'purchase' then {pick(["replied", "trial", "paid"], 'e div 5')}
          else case when e % 9 = 0 then 'stop' when e % 9 < 3 then 'bounced' else 'sent' end
          end as event""",
        """if(kind = 'click', if(k % 9 = 0, 'not json', concat('{"userAgent":"UA ', k, '","bot":',
          if(k % 4 = 0, 'true', 'false'), '}')), null) as meta""",
        "ts as created_at",
    )


def raw_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["/report", "/report?window=7d", "/admin/x", "/", "/pricing", "/dossier"]
    return _event_columns(spark, sf_dir).selectExpr(
        "e as id", "concat('v', u) as vid", "if(e % 7 != 0, u, null) as prospect_id",
        "concat('s', u, '-', to_date(ts)) as session_id",
        f"if(e % 19 != 0, {pick(paths, 'e div 3')}, null) as path",
        f"""case kind when 'purchase' then 'engaged_time'
          when 'click' then {pick(["row_expand", "export_click", "cta_click"], 'k')}
          when 'error' then if(e % 2 = 0, '   ', 'pageview') else ' pageview ' end as event""",
        "props as meta", "if(kind = 'purchase', value * 1000, null) as ms", "ts as created_at",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(spark, sf_dir).where("kind = 'purchase'").selectExpr(
        "e as id", "if(e % 3 != 0, u, null) as prospect_id", "concat('v', u) as vid",
        "ts as started_at",
    )


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ["active", "trialing", "past_due", "incomplete", "canceled", "unpaid",
              "incomplete_expired", "paused"]
    return _event_columns(spark, sf_dir).selectExpr(
        "u as customer_id",
        """case when kind = 'purchase' and e % 4 = 0 then 'checkout.session.completed'
          when kind = 'signup' then 'customer.subscription.updated'
          when kind = 'error' and e % 3 = 0 then 'invoice.payment_failed'
          when kind = 'click' and e % 6 = 0 then 'customer.subscription.deleted'
          else 'charge.updated' end as type""",
        f"if(kind = 'signup', {pick(states, 'e div 5')}, null) as raw_status", "ts", "e as id",
    )


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(spark, sf_dir).where("kind = 'signup'").selectExpr(
        "e as id",
        """case e % 6 when 0 then concat(' User', u, '@Mail.example ') when 1 then concat('user', u)
          else concat('user', u, '@mail.example') end as email""",
        f"{pick(['wholesaler', 'lender', 'attorney', 'other'], 'e')} as segment",
        "concat('src', e) as source", "if(e % 5 = 0, 'Acme', '') as company",
    )


def lead_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pairs: some parcels saved, some hidden."""
    return read(spark, sf_dir, "customer").where("c_custkey % 5 < 2").selectExpr(
        f"{apn('c_custkey')} as apn", "if(c_custkey % 5 = 0, 'saved', 'hidden') as action"
    )


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(spark, sf_dir).where("kind = 'click'").selectExpr(
        f"{apn('parcel')} as apn", "if(e % 3 = 0, 'hidden', 'saved') as action", "e % 4 != 0 as on",
        "e as seq",
    )
