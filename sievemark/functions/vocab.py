"""Closed vocabularies of the extraction target. Fixed values, as they must equal those of existing data sets."""

SENIORITY = {
    "trainee": "intern", "stażysta": "intern", "praktykant": "intern", "intern": "intern",
    "junior": "junior", "młodszy": "junior", "assistant": "junior",
    "mid": "mid", "regular": "mid", "middle": "mid",
    "senior": "senior", "starszy": "senior",
    "expert": "expert", "lead": "lead", "principal": "principal", "manager": "manager",
}
SENIORITY_LEVELS = ("intern", "junior", "mid", "senior", "expert", "lead", "principal", "manager")
WORK_MODE = {
    "remote": "remote", "home-office": "remote", "hybrid": "hybrid", "office": "office", "full-office": "office",
    "stationary": "office", "mobile": "mobile",
}
WORK_MODES = ("remote", "hybrid", "office", "mobile")
CURRENCY = {"zł": "PLN", "zl": "PLN", "pln": "PLN", "€": "EUR", "eur": "EUR", "$": "USD", "usd": "USD", "£": "GBP", "gbp": "GBP"}
SALARY_KINDS = ("b2b", "employment")
CONTRACT_KIND = {"gross": "employment", "netto (+ vat)": "b2b"}
#: Titles of sections that repeat the structured technologies.
LEAKY_TITLES = (
    "technologies", "technologies we use", "technology stack", "tech stack", "technologie", "nasze technologie",
    "wymagania techniczne", "expected", "optional",
)
FUZZY_THRESHOLD = 88.0
FAILURES = ("empty_output", "no_json_object", "json_decode_error", "schema_invalid", "unrecorded")

SALARY = "struct<kind:string,currency:string,amount_from:double,amount_to:double,period:string>"
_LISTS = "seniority:array<string>,work_mode:array<string>,tech_expected:array<string>,tech_optional:array<string>"
GOLD = f"struct<title:string,{_LISTS},contract_types:array<string>,salary:{SALARY}>"
POSTING = f"struct<title:string,{_LISTS},responsibilities:array<string>,requirements:array<string>,contract_types:array<string>,salary:{SALARY}>"
SET_FIELDS = ("seniority", "work_mode", "tech_expected", "tech_optional")
HEADLINE_FIELDS = ("seniority", "work_mode", "tech_expected")
LABEL_FIELDS = ("title", "seniority", "work_mode", "tech_expected", "tech_optional", "salary")
