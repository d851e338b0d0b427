"""Fixed values the results depend on: word lists, weights, patterns, labels.

Everything in this module is data. The lists are kept in plain reading order and
must not be edited without changing the results of the jobs that use them. Patterns
are lists of their alternatives, because Spark expressions and SQL are both built from them.
"""

# --- fixed values: owner-name normalisation -------------------------------------------------
OWNER_NOISE_WORDS = [
    "LLC", "L L C", "INC", "CORP", "CO", "TRUST", "TR", "REVOCABLE", "LP", "LLP", "LTD",
    "ESTATE", "ET AL",
]

# --- fixed values: cities recognised at the end of a street line ------------------------------
CITIES = [
    "PARADISE VALLEY", "FOUNTAIN HILLS", "CAVE CREEK", "QUEEN CREEK", "SUN CITY", "EL MIRAGE",
    "GLENDALE", "TEMPE", "PHOENIX", "MESA", "SCOTTSDALE", "CHANDLER", "AVONDALE", "PEORIA",
    "SURPRISE", "GILBERT", "BUCKEYE", "GOODYEAR", "TOLLESON", "LAVEEN", "YOUNGTOWN", "GUADALUPE",
    "ANTHEM",
]

# --- fixed values: street-line vocabulary -----------------------------------------------------
DIRECTIONALS = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]
STREET_TYPES = [
    "AVE", "AV", "ST", "DR", "RD", "LN", "CT", "PL", "WAY", "WY", "CIR", "BLVD", "PKWY", "TRL",
    "TER", "HWY",
]
UNIT_MARKERS = ["APT", "UNIT", "STE", "LOT", "#"]
STREET_WORD_ALIASES = {"VW": "VIEW"}

# --- fixed values: words that make an owner an organisation when resolving names ---------------
NAME_ENTITY_PATTERNS = [
    "LLC", r"L\.?L\.?C", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LP", "LLP", "LTD", "BANK",
    r"N\.?A", "ASSOCIATION", "ASSN", "HOA", "CONDOMINIUM", "PROPERTIES", "HOLDINGS", "INVESTMENTS",
    "ENTERPRISES", "GROUP", "PARTNERS", "PARTNERSHIP", "VENTURES", "CAPITAL", "FUND", "MORTGAGE",
    "LOAN", "LENDING", "SERVICES", "CHURCH", "MINISTRIES", "CITY OF", "COUNTY OF", "STATE OF",
    "UNITED STATES", "USA", "DEPT", "DEPARTMENT", "SCHOOL", "DISTRICT", "HOSPITAL", "UNIVERSITY",
    "REALTY", "HOMES", "DEVELOPMENT", "CONSTRUCTION", "BUILDERS", "TRUSTEE FOR", "AS TRUSTEE",
    "COM",
]

# --- fixed values: name words that carry no identity -------------------------------------------
NAME_NOISE_WORDS = [
    "JR", "SR", "II", "III", "IV", "TR", "TRS", "TRUST", "TRUSTEE", "TRUSTEES", "LIVING", "FAMILY",
    "REVOCABLE", "IRREVOCABLE", "REV", "ESTATE", "OF", "THE", "ETAL", "ET", "AL", "DECEASED",
    "DEC", "HUSBAND", "WIFE", "H/W", "JT", "JTWROS", "ETUX", "UX", "SURVIVING", "SUCCESSOR",
    "DATED", "DTD", "AKA", "FKA", "NKA", "MR", "MRS", "MS", "DR",
]

# --- fixed values: words that make an owner a non-homeowner in reports --------------------------
REPORT_ENTITY_WORDS = [
    "LLC", "L L C", "INC", "CORP", "CORPORATION", "BANK", "N A", "ASSOCIATION", "ASSN", "ASSOC",
    "HOA", "CONDOMINIUM", "COMMUNITY", "PROPERTIES", "HOLDINGS", "INVESTMENTS", "ENTERPRISES",
    "COMPANY", "CO", "LP", "LLP", "LTD", "PARTNERS", "PARTNERSHIP", "VENTURES", "CAPITAL", "FUND",
    "MORTGAGE", "LENDING", "SERVICES", "CHURCH", "CITY OF", "COUNTY", "STATE OF", "SCHOOL",
    "DISTRICT", "REALTY", "HOMES", "DEVELOPMENT", "CONSTRUCTION",
]
PLACEHOLDER_OWNERS = ["TO ?FOLLOW", "UNKNOWN", "N/?A", "OWNER UNKNOWN"]

# --- fixed values: institutions among the parties of a recorded document ------------------------
INSTITUTION_PATTERNS = [
    "BANK", "MORTGAGE", "FINANCIAL", "LOAN", "SERVICES?", "TRUSTEE", "CORPS?", "INC", "LLC", "LLP",
    "LP", "FUND", "CAPITAL", "LENDING", "CREDIT", "LENDER", "NA", "FSB", "LAW", "ATTORNEY",
    "TITLE", "ESCROW", "GROUP", "ASSOCIATES?", "ASSOCIATION", "HOA", "CONDOMINIUM", "COMMUNITY",
    "FEDERAL", "NATIONAL", "INVESTMENT", "PROPERTIES", "REALTY", "HOLDINGS?", "RECON",
    "RECONVEYANCE", "ZBS", "MTC", "PENNYMAC",
]

# --- fixed values: scoring ----------------------------------------------------------------------
TYPE_WEIGHTS = {
    "trustee_sale": 50, "probate": 35, "divorce": 30, "code_violation": 25, "lis_pendens": 25,
    "tax_delinquent": 20, "mechanics_lien": 15, "lien": 15,
}
HALF_LIFE_DAYS = {
    "trustee_sale": 45, "lis_pendens": 90, "divorce": 180, "probate": 180, "code_violation": 120,
    "mechanics_lien": 180, "lien": 180, "tax_delinquent": 365,
}
DEFAULT_HALF_LIFE = 180
MODIFIER_POINTS = {"absentee": 10, "high_equity": 10, "long_tenure": 5}
STACK_POINTS = 15
FRESH_POINTS = 10
MAX_AGE_DAYS = 730
LIVE_SHARE = 0.25
FRESH_DAYS = 7
AUCTION_NOTICE_DAYS = 90
PASSED_AUCTION_SHARE = 0.25
HOT_SCORE = 60

# The older, undecayed explanation shown beside a lead.
STATIC_TYPE_POINTS = {
    "trustee_sale": ("Trustee Sale", 50), "probate": ("Probate", 35),
    "code_violation": ("Code Violation", 25), "tax_delinquent": ("Tax Delinquent", 20),
}
STATIC_MODIFIER_POINTS = {
    "absentee": ("Absentee", 10), "high_equity": ("High Equity", 10),
    "long_tenure": ("Long Tenure", 5),
}

# --- fixed values: reports ----------------------------------------------------------------------
FILED_WINDOW_DAYS = 14
WINDOW_HOURS = {"24h": 24, "48": 48, "7d": 168}
DEFAULT_WINDOW = "7d"
FILED_DAYS = {"any": None, "24": 1, "48": 2, "14d": 14}
DEFAULT_FILED = "14d"

# --- fixed values: signal-type dimension ---------------------------------------------------------
PITCH_LABELS = {
    "trustee_sale": "notice of trustee sale", "code_violation": "code violation",
    "tax_delinquent": "tax delinquent", "probate": "probate", "divorce": "divorce filing",
    "lis_pendens": "lis pendens", "mechanics_lien": "lien", "lien": "lien",
}
DISPLAY_LABELS = {
    "trustee_sale": "Trustee sale", "probate": "Probate", "divorce": "Divorce",
    "code_violation": "Code violation", "lis_pendens": "Lis pendens",
    "mechanics_lien": "Mechanic\u2019s lien", "lien": "Lien", "tax_delinquent": "Tax delinquent",
}
PLURAL_LABELS = {
    "trustee_sale": "trustee sales", "probate": "probate filings", "divorce": "divorce filings",
    "code_violation": "code violations", "lis_pendens": "lis pendens",
    "mechanics_lien": "mechanic\u2019s liens", "lien": "liens",
    "tax_delinquent": "tax delinquencies",
}
URGENT_TYPES = ["trustee_sale", "lis_pendens", "probate", "divorce"]
PROVENANCE_VERBS = {"probate": "Opened", "divorce": "Filed", "code_violation": "Filed"}
RECORDER_TYPES = ["trustee_sale", "lis_pendens", "mechanics_lien", "lien"]
COURT_TYPES = ["probate", "divorce"]
KEEP_UPPER = ["LLC", "LP", "LLP", "INC", "II", "III", "IV", "TR", "PO", "AZ", "NA"]

# --- fixed values: sources -----------------------------------------------------------------------
NAME_SOURCES = [
    "recorder_nots", "court_probate", "court_divorce", "recorder_lp", "recorder_ml", "recorder_nl",
]
ADDRESS_SOURCES = ["code_glendale", "code_tempe"]
CRITICAL_SOURCES = [
    "recorder_nots", "court_probate", "court_divorce", "phoenix_code", "treasurer_delinquent",
]
SOURCE_URLS = {
    "treasurer_delinquent": "https://treasurer.maricopa.gov/",
    "code_county": "https://www.maricopa.gov/1603/Code-Enforcement",
    "code_glendale": "https://glendaleone.glendaleaz.com/",
    "code_tempe":
        "https://www.tempe.gov/government/community-development/code-compliance",
    "code_scottsdale": "https://www.scottsdaleaz.gov/codes/code-enforcement",
    "code_mesa": "https://data.mesaaz.gov/resource/hgf6-yenu",
    "phoenix_code": "https://nsdonline.phoenix.gov/CodeEnforcement/Details?caseNum=",
    "recorder": "https://legacy.recorder.maricopa.gov/recdocdata/GetRecDataDetail.aspx?rec=",
    "court_probate":
        "https://www.superiorcourt.maricopa.gov/docket/ProbateCourtCases/caseInfo.asp?caseNumber=",
    "court_divorce":
        "https://www.superiorcourt.maricopa.gov/docket/FamilyCourtCases/caseInfo.asp?caseNumber=",
}

# --- fixed values: outreach ----------------------------------------------------------------------
VARIANTS = ["A", "B", "C", "D"]
FUNNEL_EVENTS = ["sent", "opened", "clicked", "replied", "trial", "paid", "stop", "bounced"]
ROLE_LOCAL_PARTS = [
    "info", "contact", "support", "loans", "sales", "getquotes", "hello", "office", "admin",
]
BOT_PATTERNS = [
    "barracuda", "proofpoint", "mimecast", "microsoft.?defender", "safelinks", "googleimageproxy",
    "headless", "bot|crawler|spider|preview",
]
COMPANY_SUFFIXES = [
    "LLC", r"L\.L\.C\.", "Inc", "Incorporated", "Corp", "Corporation", "Co", "Company", "Group",
]
ABORT_CODES = [
    "EAUTH", "ECONNECTION", "ETIMEDOUT", "ESOCKET", "EDNS", "ECONNRESET", "ECONNREFUSED", "ETLS",
]
ABORT_RESPONSES = [530, 534, 535, 538]
HARD_DAILY_CAP = 20
RAMP_START = 10
RAMP_LATER = 15
RAMP_DAYS = 5
MAX_BOUNCE_RATE = 0.03
TRIAL_DAYS = 7
REQUEST_SEGMENTS = ["wholesaler", "lender", "attorney"]

# --- fixed values: map ---------------------------------------------------------------------------
CITY_CENTROIDS = {
    "phoenix": (33.448, -112.074), "mesa": (33.415, -111.831), "glendale": (33.539, -112.186),
    "scottsdale": (33.494, -111.926), "tempe": (33.425, -111.940), "chandler": (33.306, -111.841),
    "gilbert": (33.353, -111.789), "goodyear": (33.435, -112.358), "tolleson": (33.450, -112.259),
    "avondale": (33.436, -112.349), "peoria": (33.580, -112.237), "surprise": (33.629, -112.368),
}
DEFAULT_CENTROID = (33.448, -112.074)
