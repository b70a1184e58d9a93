"""Every literal that decides a result, in one place."""

from __future__ import annotations

# --- Fixed values: enums -----------------------------------------------------
APPLICATION_STATUSES = ("saved", "applied", "interviewing", "offer", "rejected", "dismissed")
NEGATIVE_STATUSES = ("dismissed", "rejected")
ARTIFACT_TYPES = ("cover_letter", "tailoring_suggestions")

# --- Fixed values: lifecycle -------------------------------------------------
STALE_AFTER_RUNS = {"adzuna": 48, "arbeitnow": 24, "dou": 24, "justjoinit": 2, "djinni": 12}
REMOVED_AFTER_RUNS = {"adzuna": 144, "arbeitnow": 72, "dou": 72, "justjoinit": 5, "djinni": 30}
DEFAULT_STALE_AFTER = 1
DEFAULT_REMOVED_AFTER = 3
FRESH_DAYS = 5
CLEANUP_MIN_AGE_DAYS = 90
ERROR_TEXT_LIMIT = 2000
PROMPT_DESCRIPTION_LIMIT = 3000

# --- Fixed values: feedback --------------------------------------------------
FEEDBACK_MIN_SAMPLES = 3
FEEDBACK_MARGIN = 0.3
FEEDBACK_DELTA = 10
FEEDBACK_TOTAL_LIMIT = 20
SENIORITY_LEVELS = (
    "intern", "junior", "mid", "middle", "senior", "lead", "staff", "principal", "head",
)

# --- Fixed values: ranking ---------------------------------------------------
MAX_TOP_K = 100
MAX_SHORTLIST = 10
SCORE_HIGH = 70
SCORE_MID = 40

# --- Fixed values: salary ----------------------------------------------------
HOURS_PER_DAY = 5.5
DAYS_PER_MONTH = 21
COUNTRY_CURRENCY = {
    "at": "EUR", "au": "AUD", "br": "BRL", "ca": "CAD", "de": "EUR",
    "fr": "EUR", "gb": "GBP", "in": "INR", "it": "EUR", "mx": "MXN",
    "nl": "EUR", "nz": "NZD", "pl": "PLN", "sg": "SGD", "us": "USD",
    "za": "ZAR", "es": "EUR", "se": "SEK", "ch": "CHF",
}
UNIT_PERIOD = {"MONTH": "month", "YEAR": "year", "HOUR": "hour"}

# --- Fixed values: headings that open the requirements part of a posting ------
REQUIREMENT_MARKERS = (
    # English
    "your profile", "your responsibilities", "requirements", "qualifications",
    "what you'll bring", "what you bring",
    "what we're looking for", "what we are looking for", "must have", "nice to have",
    # German
    "dein profil", "deine aufgaben", "deine verantwortung", "das wünschen wir uns",
    "das bringst du mit", "was du mitbringst", "anforderungen",
    # Polish
    "wymagania", "oczekiwania", "twoje zadania", "twoje obowiązki",
    "kogo szukamy", "nasze wymagania", "profil kandydata",
)

# --- Fixed values: HTML ------------------------------------------------------
BLOCK_TAGS = (
    "p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6",
    "tr", "table", "td", "th",
)
HIDDEN_TAGS = ("script", "style", "template", "head")
JSON_LD_PATTERN = r"""(?s)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""

# --- Fixed values: board texts and URL shapes --------------------------------
FOOTER_MULTI = r"Find(?: more [A-Za-z]+ Speaking)? Jobs in [A-Za-z ]+ on Arbeitnow\.?"
FOOTER_FIXED = r"Відгукнутись на вакансію\.?"
TITLE_SEPARATOR = " в "
TITLE_SEPARATOR_PATTERN = r"(?U:[\s\x{001C}-\x{001F}])+в(?U:[\s\x{001C}-\x{001F}])+"
REMOTE_WORD = "віддалено"
SALARY_RANGE_PATTERN = r"\A\$([\d,]+)[–-]([\d,]+)\z"
SALARY_FROM_PATTERN = r"\Aвід(?U:[\s\x{001C}-\x{001F}])+\$([\d,]+)\z"
SALARY_TO_PATTERN = r"\Aдо(?U:[\s\x{001C}-\x{001F}])+\$([\d,]+)\z"
SALARY_EXACT_PATTERN = r"\A\$([\d,]+)\z"
FEED_ID_PATTERN = r"/vacancies/(\d+)/"
LISTING_LINK_PATTERN = r'href="(/jobs/\d+-[^"]*/)"'
LISTING_ID_PATTERN = r"/jobs/(\d+)-"
LISTING_BASE_URL = "https://djinni.co"
NEXT_PAGE_HOST = "www.arbeitnow.com"
FENCE_PATTERN = r"(?s)```(?:json)?\s*(.*?)\s*```"

# --- Fixed values: text formats of the scorer and writer inputs ---------------
SCORING_PROMPT = (
    "CANDIDATE PROFILE\n"
    "Summary: %s\n"
    "Skills: %s\n"
    "Experience:\n%s\n\n"
    "JOB POSTING\n"
    "Title: %s\n"
    "Company: %s\n"
    "Location: %s (remote=%s)\n"
    "Description: %s\n"
)
WRITING_CONTEXT = (
    "CANDIDATE PROFILE\n"
    "Name: %s\n"
    "Email: %s\n"
    "Phone: %s\n"
    "Summary: %s\n"
    "Skills: %s\n"
    "Experience:\n%s\n\n"
    "JOB POSTING\n"
    "Title: %s\n"
    "Company: %s\n"
    "Description: %s\n\n"
    "If any contact details are included in your response, use only the Email\n"
    "and Phone given above - not any other contact info you may know from\n"
    "elsewhere.\n"
)

# --- Fixed values: metrics ---------------------------------------------------
DURATION_BOUNDS = (1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0)
QUANTILE = 0.95

# --- Fixed values: character classes (Java regex) -------------------------------
# Everything Python's str.strip()/split() calls white space.
WS = r"(?U:[\s\x{001C}-\x{001F}])"
# What str.isalnum() says no to.
NOT_ALNUM = r"[^\p{L}\p{N}]"
