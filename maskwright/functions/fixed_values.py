"""Categories, word lists, patterns and formats the results depend on.

Everything in this module is data.  The strings below have to be exactly these
for the detections to come out right, so they are kept as plain text in one
place.  Patterns are written without ``\\b`` anchors; ``patterns.py`` adds the
word boundaries and turns them into the regex dialect of the engine in use.
"""

# --- categories, in report order -------------------------------------------------
CATEGORIES = (
    "FULL_NAME", "EMAIL", "PHONE", "COMPANY", "ADDRESS",
    "SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS",
)

# --- detection rules, in the order that breaks ties between equal spans ------------
RULES = (
    ("email", "EMAIL"),
    ("ssn", "SSN"),
    ("card", "CREDIT_CARD"),
    ("ipv4", "IP_ADDRESS"),
    ("dob", "DOB"),
    ("phone_context", "PHONE"),
    ("phone_standalone", "PHONE"),
    ("address_context", "ADDRESS"),
    ("address_pattern", "ADDRESS"),
    ("company_suffix", "COMPANY"),
    ("company_known", "COMPANY"),
    ("name_salutation", "FULL_NAME"),
    ("name_role", "FULL_NAME"),
    ("name_phrase", "FULL_NAME"),
    ("name_promoters", "FULL_NAME"),
    ("name_known", "FULL_NAME"),
)

# --- stop lists --------------------------------------------------------------------
COMPANY_STOPS = (
    "Red Herring Prospectus", "Draft Red Herring Prospectus", "Companies Act",
    "Companies Act, 2013", "Companies Act, 1956", "Securities and Exchange Board of India",
    "Summary of the Offer", "Summary of the Issue", "Risk Factors", "Financial Statements",
    "Board of Directors", "Audit Committee", "Nomination and Remuneration Committee",
    "Stakeholders Relationship Committee", "Corporate Social Responsibility Committee",
    "Table of Contents", "General Information", "Capital Structure", "Objects of the Offer",
    "Basis for Offer Price", "Statement of Possible Tax Benefits", "Industry Overview",
    "Our Business", "Key Industry Regulations", "History and Certain Corporate Matters",
    "Our Management", "Our Promoters and Promoter Group", "Dividend Policy",
    "Financial Information", "Management's Discussion and Analysis", "Financial Indebtedness",
    "Legal and Other Information", "Outstanding Litigation", "Government and Other Approvals",
    "Other Regulatory and Statutory Disclosures", "Offering Information", "Terms of the Offer",
    "Offer Structure", "Offer Procedure", "Restrictions on Foreign Ownership",
    "Description of Equity Shares", "Material Contracts and Documents for Inspection",
    "Declaration", "Statutory Auditors", "Book Running Lead Managers", "Registrar to the Offer",
    "Syndicate Members", "Bankers to the Offer", "Refund Bank", "Share Escrow Agent",
    "National Stock Exchange of India", "Stock Exchange", "Stock Exchanges",
    "Limited", "Ltd", "Private Limited", "Pvt Ltd", "Pvt. Ltd.", "LLP", "Inc", "Corp",
    "LIMITED", "LTD", "PRIVATE LIMITED", "PVT LTD", "PVT. LTD.", "INC", "CORP",
)

NAME_STOPS = (
    "Red Herring Prospectus", "Draft Red Herring Prospectus", "Companies Act",
    "Summary of the Offer", "Summary of the Issue", "Risk Factors", "Financial Statements",
    "Board of Directors", "Audit Committee", "Identification Number", "Corporate Identity Number",
    "Permanent Account Number", "Director Identification Number", "General Information",
    "Capital Structure", "Objects of the Offer", "Basis for Offer Price",
    "Industry Overview", "Our Business", "Our Management", "Dividend Policy",
    "Terms of the Offer", "Offer Structure", "Offer Procedure", "Declaration",
    "Book Running Lead Manager", "Book Running Lead Managers", "Registrar to the Offer",
    "Banker to the Offer", "Refund Bank", "Statutory Auditor", "Statutory Auditors",
    "Table of Contents", "Contact Person", "Managing Director", "Chief Executive Officer",
    "Chief Financial Officer", "Company Secretary", "Compliance Officer", "Whole-Time Director",
    "Independent Director", "Executive Director", "Non-Executive Director", "Promoter",
    "Promoters", "Promoter Group", "Equity Shares", "Offer Price", "Face Value",
    "Issue Price", "Bid Lot", "Fresh Issue", "Offer for Sale", "Floor Price",
    "Cap Price", "Retail Individual Bidders", "Non-Institutional Bidders",
    "Qualified Institutional Buyers", "Anchor Investor", "Anchor Investors",
    "Mutual Funds", "Alternative Investment Funds", "Foreign Portfolio Investors",
    "Venture Capital Funds", "Scheduled Commercial Banks", "State Industrial Development",
    "Public Financial Institution", "Insurance Companies", "Systemically Important",
    "Gross Proceeds", "Net Proceeds", "Working Capital Requirements", "General Corporate Purposes",
    "Fiscal Year", "Fiscals", "Quarter Ended", "Year Ended", "As of Date",
    "Audited Financial Statements", "Restated Financial Statements", "Materiality Policy",
    "Key Performance Indicators", "Key Management Personnel", "Senior Management Personnel",
    "Listing Regulations", "ICDR Regulations", "SEBI ICDR Regulations", "FEMA Regulations",
    "Indian Accounting Standards", "Ind AS", "Generally Accepted Accounting Principles",
    "Securities Act", "Regulation S", "Rule 144A", "Stock Exchange", "BSE Limited", "NSE Limited",
    "and Compliance Officer", "Company Secretary and Compliance Officer",
    "dated August", "dated September", "dated October", "dated November", "dated December",
    "Family Trust", "DHAULAGIRI FAMILY TRUST", "EVEREST FAMILY TRUST", "ANNAPURNA FAMILY TRUST",
    "KANCHENJUNGA FAMILY TRUST", "MAKALU FAMILY TRUST", "BROAD FAMILY TRUST",
    "SELLING SHAREHOLDER", "SELLING SHAREHOLDERS", "PROMOTER SELLING SHAREHOLDER",
    "PROMOTER SELLING SHAREHOLDERS", "Selling Shareholder", "Selling Shareholders",
    "made pursuant to Regulation", "made pursuant to", "pursuant to Regulation",
    "the Promoter Selling Shareholders",
)

NON_NAME_FIRST_WORDS = (
    "made", "held", "issued", "conducted", "prepared", "calculated", "derived",
    "obtained", "commissioned", "shifted", "transferred", "converted", "appointed",
    "passed", "approved", "incorporated", "registered", "presented", "disclosed",
)

# --- guard tokens --------------------------------------------------------------------
CURRENCY_TOKENS = ("₹", "Rs.", "INR", "USD", "$", "Rs", "shares", "Shares")
NAME_LEGAL_TOKENS = ("Limited", "Ltd", "LLP")
COMPANY_BAD_PREFIXES = ("Companies Act", "Section ")
CONTACT_TERMS = (
    "Telephone:", "Telephone", "Tel:", "Tel", "Email:", "Email",
    "Website:", "Website", "Contact Person:", "Contact",
)
TRAILING_PUNCTUATION = ";,.\n\r "

# --- patterns ------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}"
SSN = r"(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
CARD_GROUPED = r"(?:\d{4}[-\s]?){3}\d{1,7}"
CARD_PLAIN = r"\d{13,19}"
IPV4 = (
    r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
)
DOB = (
    r"(?:(?:DOB|Date\s+of\s+Birth|Birth\s*Date|Born|D\.O\.B\.)[\s:]+)"
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
    r"|\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*,?\s*\d{2,4}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{2,4})"
)
PHONE_CONTEXT = (
    r"(?:Tel|Telephone|Phone|Mob|Mobile|Fax|Contact)[\s.:#]*(?:No\.?|Number)?\s*[:\-]?\s*"
    r"(\+?[\d\s\-()]{8,20})"
)
PHONE_MOBILE = r"(?:\+[\s]?91[\s-]?)?[6-9]\d{9}"
PHONE_INTERNATIONAL = r"\+91[\s\d\-()]{8,18}"
PHONE_LANDLINE = r"0\d{2,4}[\s-]\d{6,8}"
COMPANY_TOKEN = r"[A-Za-z0-9&.,'\-]*"
COMPANY_EXTRA_TOKENS = 7
COMPANY_SUFFIX = (
    r"(?:Limited|LIMITED|Ltd\.?|LTD\.?|Private\s+Limited|PRIVATE\s+LIMITED"
    r"|Pvt\.?\s*Ltd\.?|PVT\.?\s*LTD\.?|LLP|Inc\.?|INC\.?|Corporation|CORPORATION|Corp\.?|CORP\.?)"
)
ADDRESS_CONTEXT = (
    r"(?:Registered\s+Office|Corporate\s+Office|Address|Residential\s+Address|Mailing\s+Address"
    r"|Regd\.\s+Office|Branch\s+Office|Office\s+Address)[\s:]+"
    r"([^\n;.]+(?:Maharashtra|India|Pune|Mumbai|Delhi|Bengaluru|Bangalore|Hyderabad|Chennai|Kolkata"
    r"|Ahmedabad|Gurugram|Noida|Chandigarh|Jaipur|Surat|\d{6}|\d{3}\s\d{3})[^\n;.]*)"
)
ADDRESS_LEAD_NUMBER = r"[0-9]+[/,\-A-Za-z0-9\s]+"
ADDRESS_LEAD_BUILDING = (
    r"[A-Za-z0-9\s,\-()]+(?:Centre|Center|House|Building|Campus|Estate|Park|Tower|Towers|Plaza"
    r"|Chambers|Embassy|BKC)"
)
ADDRESS_FREE = r"[A-Za-z0-9\s,\-()]"
ADDRESS_THOROUGHFARE = (
    r"(?:Road|Street|Marg|Lane|Avenue|Nagar|Colony|Sector|Phase|Industrial Area|MIDC|Enclave|Complex"
    r"|Towers?|Bhavan|House|Plaza|Chambers|Park|Estate|Village|Taluka|Floor|Plot|Centre|Center|Campus)"
)
ADDRESS_MIDDLE = r"[A-Za-z\s0-9,\-/–—().&]"
ADDRESS_PIN_SOLID = r"\d{6}"
ADDRESS_PIN_SPLIT = r"\d{3}\s\d{3}"
ADDRESS_TAIL = r"[A-Za-z\s,().]"
NAME_WORDS = r"([A-Za-z]+(?:\s+[A-Za-z]+){1,3})"
NAME_SALUTATION = r"(?:Mr\.|Ms\.|Mrs\.|Dr\.|Prof\.|Shri|Smt\.)\s+"
NAME_ROLE = (
    r"(?:Contact\s+Person"
    r"|Chairman\s+and\s+(?:Managing|Independent|Executive|Non-Executive)\s+Director"
    r"|Chairman\s*&\s*(?:Managing|Independent|Executive|Non-Executive)\s+Director"
    r"|Chairman|Managing\s+Director|Chief\s+Executive\s+Officer|Chief\s+Financial\s+Officer"
    r"|Company\s+Secretary\s+and\s+Compliance\s+Officer|Company\s+Secretary|Compliance\s+Officer"
    r"|Whole-time\s+Director|Independent\s+Director|Executive\s+Director|Non-Executive\s+Director"
    r"|Promoter|Director|Partner)[\s:]+"
)
NAME_PHRASE = (
    r"(?:namely|being|appointed\s+as|designated\s+as|signed\s+by|son\s+of|daughter\s+of|wife\s+of)\s+"
)
PROMOTER_LIST = r"OUR\s+PROMOTERS?[\s:]+([A-Za-z\s,]+)"
MATCH_SEPARATORS = r"[\s,–\-\n\r\.–—().]+"

# --- limits ----------------------------------------------------------------------------
PHONE_CONTEXT_DIGITS = (7, 15)
PHONE_STANDALONE_DIGITS = (10, 15)
PHONE_KEY_MIN_DIGITS = 8
ADDRESS_CONTEXT_MIN_LENGTH = 15
ADDRESS_PATTERN_MIN_LENGTH = 20
PROMOTER_WORDS = (2, 4)
CURRENCY_WINDOW = 10
VERSION_WINDOW = 8
CARD_DIGITS = (13, 19)
MATCH_TOKEN_SHARE = 0.5

# --- replacement formats -----------------------------------------------------------------
COMPANY_FORMS = (
    "Private Limited", "Pvt. Ltd.", "Pvt Ltd", "Limited", "Ltd", "LLP", "Inc.", "Corporation",
)
COMPANY_DEFAULT_FORM = "Limited"
EMAIL_DOMAIN = "example.com"
TEST_CARDS = ("4111 1111 1111 1111", "5105 1051 0510 5100", "3782 8224 6310 005")
DOB_AGE_YEARS = (25, 70)
FALLBACK_REPLACEMENT = "[REDACTED]"
MAPPING_NOTICE = (
    "INTERNAL AUDIT ARTIFACT: Contains synthetic-to-original mappings for verification."
)
