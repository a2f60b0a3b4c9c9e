"""Values that results depend on: word lists, patterns, weights and tables.

All of these are fixed values: they must equal the specification's for right results.
"""

# Prices.
CURRENCY = {"s$": "SGD", "sgd": "SGD", "rm": "MYR", "myr": "MYR", "us$": "USD", "usd": "USD", "$": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "rp": "IDR", "idr": "IDR", "฿": "THB", "thb": "THB", "₫": "VND", "vnd": "VND", "₱": "PHP", "php": "PHP"}
CURRENCY_TOKEN = r"(?:S\$|US\$|RM|Rp|SGD|MYR|USD|EUR|GBP|IDR|THB|VND|PHP|[$€£฿₫₱])"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
PRICE = rf"({CURRENCY_TOKEN})\s?({NUMBER})"
PRICE_RANGE = rf"{CURRENCY_TOKEN}\s?{NUMBER}\s?(?:-|–|to)\s?(?:{CURRENCY_TOKEN}\s?)?{NUMBER}"
UNIT = r"(?:per|/)\s?(unit|month|year|piece|pcs|pax|person|hour|hr|sqft|sq ft|sqm|day|seat|user|item|kg|ton)"
STARTING = r"\b(from|starting (?:from|at)|as low as|starts? at)\b"
RATE_CARD_PRICE = r"\b(rate card|price list|pricing (?:sheet|pdf|guide)|download[^.]*pric)"
QUOTE_PHRASE = r"\b(request (?:a )?(?:quote|quotation)|get (?:a )?quote|ask for (?:a )?quote|rfq|enquire (?:now|for pricing)|request pricing)\b"
CONTACT_PRICE = r"\b(contact (?:us |our )?(?:sales |team )?for pric|call for pric|contact for pric|price on request|p\.?o\.?a)"

# Quote channels and contacts.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?){2,4}\d{2,4}"
RFQ_LINK = r"(rfq|request[-_]?(?:a[-_]?)?quot|get[-_]?(?:a[-_]?)?quot|quotation|enquir)"
CONTACT_LINK = r"(contact|reach[-_]?us|get[-_]?in[-_]?touch|enquir)"
RATE_CARD = r"(rate[-_ ]?card|price[-_ ]?list)"
PORTAL = r"(login to view|member login|supplier portal|sign in to (?:view|request)|portal login|register to view pric)"
CHANNEL_PRIORITY = {"rfq_form": 6, "contact_email": 5, "contact_page": 4, "phone": 3, "rate_card": 2, "portal_login_required": 1}
ROLE_LOCALPARTS = ("sales", "info", "contact", "enquiry", "enquiries", "inquiry", "support", "admin", "hello", "hi", "team", "general", "marketing", "service", "ask")
NAMED_PERSON = r"^[a-z]+\.[a-z]+$"

# Service match and vendor metadata.
SERVICE_STOPWORDS = ("find", "for", "the", "a", "an", "in", "and", "with", "of", "to", "near", "me", "service", "services", "vendor", "vendors", "supplier", "suppliers", "company", "companies", "best", "top", "looking", "need", "want", "get")
SUFFIX_COUNTRY = {"pte ltd": "Singapore", "pte. ltd": "Singapore", "sdn bhd": "Malaysia", "pt ": "Indonesia"}
TLD_COUNTRY = {".sg": "Singapore", ".my": "Malaysia", ".id": "Indonesia", ".th": "Thailand", ".vn": "Vietnam", ".ph": "Philippines", ".bn": "Brunei", ".kh": "Cambodia", ".la": "Laos", ".mm": "Myanmar"}
COUNTRIES = ("Singapore", "Malaysia", "Indonesia", "Thailand", "Vietnam", "Philippines", "Brunei", "Cambodia", "Laos", "Myanmar")
COUNTRY_CODE = {"Singapore": "SG", "Malaysia": "MY", "Indonesia": "ID", "Thailand": "TH", "Vietnam": "VN", "Philippines": "PH", "Brunei": "BN", "Cambodia": "KH", "Laos": "LA", "Myanmar": "MM"}

# Geography scores.
GEO_EXACT, GEO_REGION, GEO_SERVES, GEO_UNKNOWN, GEO_CONFLICT = 20.0, 12.0, 6.0, 0.0, -10.0

# Query modes.
SERVICE_TERMS = ("cleaning", "maintenance", "security guard", "guard service", "cctv", "installation", "pest control", "managed it", "it support", "fire alarm", "landscaping", "renovation", "catering", "facility management", "facilities", "repair", "servicing", "consultancy", "consulting", "audit", "training", "manpower", "courier", "logistics service", "disposal", "moving service")
SERVICE_INTENT = ("quote", "quotation", "rfq", "request a quote", "contact sales", "tender")
PRODUCT_TERMS = ("chairs", "chair", "paper", "keyboard", "keyboards", "monitor", "monitors", "laptop", "laptops", "desk", "desks", "printer", "printers", "cartridge", "units", "supplier", "suppliers", "wholesale", "bulk", "moq", "pieces", "pcs")
PRICE_INTENT = ("price", "pricing", "public pricing", "cost", "per unit", "unit price", "$")
CONTACT_INTENT = ("contact", "contacts", "email", "phone number", "get in touch", "reach out", "enrich", "contact details", "find the email", "decision maker")
REVALIDATION_INTENT = ("revalidate", "re-validate", "refresh", "verify again", "is it still", "still valid")
ELECTRONICS_TERMS = ("ic", "mosfet", "mcu", "microcontroller", "capacitor", "resistor", "transistor", "connector", "op-amp", "opamp", "diode", "regulator", "datasheet", "semiconductor", "integrated circuit", "fpga", "eeprom", "voltage regulator")
SUBSTITUTE_INTENT = ("substitute", "replacement", "cross reference", "cross-reference", "equivalent", "alternative part", "drop-in", "drop in", "pin compatible", "pin-compatible", "fff")
OBSOLESCENCE_INTENT = ("obsolete", "eol", "end of life", "end-of-life", "nrnd", "nla", "ltb", "last time buy", "last-time-buy", "superseded", "discontinued", "pcn")
QUERY_MPN = r"\b[a-z]{1,6}-?\d{2,}[a-z0-9\-]*\b"
QUANTITY = r"\b\d{2,}\b"

# Sources and their reliability.
MANUFACTURERS = ("ti.com", "analog.com", "st.com", "nxp.com", "infineon.com", "microchip.com", "onsemi.com", "renesas.com", "rohm.com", "vishay.com", "diodes.com", "hirose.com", "molex.com", "te.com", "amphenol.com", "samtec.com", "murata.com", "tdk.com", "bourns.com")
DISTRIBUTORS = ("digikey.com", "digikey.sg", "mouser.com", "mouser.sg", "arrow.com", "avnet.com", "farnell.com", "newark.com", "element14.com", "rs-online.com", "rsdelivers.com", "future.com", "verical.com")
AGGREGATORS = ("octopart.com", "oemsecrets.com", "findchips.com", "alldatasheet.com", "datasheets.com", "componentsearchengine.com")
BROKERS = ("rochester", "lansdale", "brokerforum", "netcomponents", "icsource")
MARKETPLACES = ("alibaba", "aliexpress", "made-in-china", "ebay", "amazon", "indiamart", "tradeindia", "dhgate")
BUSINESS_SIGNALS = ("quote", "quotation", "rfq", "vendor", "supplier", "price", "pricing", "contact", "sales", "catalog", "catalogue", "datasheet", "stock", "moq", "pte ltd", "we supply", "we provide", "request a quote")
RELIABILITY = {"manufacturer": 0.99, "distributor": 0.95, "government": 0.9, "aggregator": 0.85, "business": 0.6, "broker": 0.5, "unknown": 0.4, "marketplace": 0.2}
AUTHORITY = {"manufacturer": 0.95, "distributor": 0.85, "government": 0.8, "aggregator": 0.6, "business": 0.55, "broker": 0.45, "unknown": 0.4, "marketplace": 0.2}

# Relevance of pages.
CONTENT_STOPWORDS = ("the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "by", "is", "are", "be", "this", "that", "from", "as", "at", "we", "you", "our", "used", "use", "need", "needed", "looking", "find", "want", "deliver", "delivery", "within", "days", "day", "new", "old")
GENERIC_TERMS = ("request", "quotation", "quote", "rfq", "price", "pricing", "prices", "supplier", "suppliers", "vendor", "vendors", "contact", "sales", "buy", "purchase", "order", "service", "services", "company", "pte", "ltd")
GEO_TERMS = ("singapore", "malaysia", "indonesia", "thailand", "vietnam", "philippines", "brunei", "cambodia", "laos", "myanmar", "southeast", "asia", "sea", "global", "region")
PROCUREMENT_SIGNALS = ("quote", "quotation", "rfq", "vendor", "supplier", "price", "pricing", "contact", "sales", "catalog", "catalogue", "datasheet", "stock", "moq")

# Regions that query templates leave open.
REGION_WORDS = ("singapore", "malaysia", "vietnam", "thailand", "indonesia", "philippines", "cambodia", "myanmar", "laos", "brunei", "china", "india", "japan", "taiwan")

# Lifecycle, most severe first.
LIFECYCLE = (("eol", ("end of life", "end-of-life", "obsolete", "discontinued", "eol")), ("ltb", ("last time buy", "last-time-buy", "ltb")), ("nrnd", ("not recommended for new design", "nrnd")), ("preliminary", ("preliminary", "advance information")), ("active", ("active", "in production", "recommended for new design")))
LIFECYCLE_SEVERITY = {"unknown": 0, "active": 0, "preliminary": 1, "nrnd": 2, "ltb": 2, "eol": 3}
LIFECYCLE_LABEL = {"eol": "high", "ltb": "medium", "nrnd": "medium", "preliminary": "low"}
PCN_PHRASE = r"\b(?:product change notification|product discontinuation(?: notice)?)\b"
PCN_ID = r"\b(?:pcn|pdn)\b[\s#:.-]*\d"
SUBSTITUTE_RELS = ("CROSS_REFERENCE", "SUPERSEDED_BY", "PIN_COMPATIBLE_WITH", "SAME_DIE_AS", "RENAMED_TO")
FUNCTIONAL_RELS = ("MANUFACTURED_BY", "ACQUIRED_BY", "RENAMED_TO", "SUPERSEDED_BY")
PROSE_MPN = r"\b[A-Za-z][A-Za-z0-9]{2,}\b"
NUMERIC_CLAIM = r"(?:S\$|US\$|RM|Rp|\$|SGD|USD|MYR|IDR|VND|THB|PHP)\s?[\d][\d.,]*|\b\d+(?:\.\d+)?\s?%|\b\d+\s+(?:business\s+)?(?:days?|weeks?|months?)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
RISK_TOKENS = ("nrnd", "eol", "obsolete", "last-time-buy", "ltb", "nla", "discontinued", "counterfeit")

# Scores.
PRICE_QUALITY = {"EXACT_PRICE": 1.0, "PRICE_RANGE": 0.8, "STARTING_FROM": 0.6, "RATE_CARD_FOUND": 0.5, "CONTACT_FOR_PRICING": 0.2, "QUOTE_REQUIRED": 0.2, "CONFLICTING": 0.1, "NOT_FOUND": 0.0}
CHANNEL_QUALITY = {"rfq_form": 1.0, "contact_email": 0.9, "contact_page": 0.6, "phone": 0.5, "rate_card": 0.4, "portal_login_required": 0.2}
SERVICE_WEIGHTS = {"service_match": 0.25, "quote_channel": 0.25, "geo": 0.20, "contact_reliability": 0.15, "checklist": 0.10, "evidence_diversity": 0.05}
ELECTRONICS_WEIGHTS = {"fff_similarity": 0.30, "lifecycle_safety": 0.20, "authorized_source": 0.15, "stock": 0.15, "datasheet_evidence": 0.10, "risk": 0.10}
GRADE_TIERS = ("very_low", "low", "moderate", "high")
DECISION_SEVERITY = {"proceed": 0, "regenerate": 1, "replan": 2}
TRACKING_PREFIXES = ("utm_", "gclid", "fbclid", "mc_", "ref")
MAX_RELIABILITY, YAGER_CONFLICT = 0.99, 0.8
HALF_LIFE_DAYS, STALE_DAYS, REINFORCE_GROWTH = 90.0, 180.0, 0.5

# Relation phrases in order of preference, and names in prose.
REL_PHRASES = (("cross-references", "CROSS_REFERENCE"), ("cross references", "CROSS_REFERENCE"), ("cross-reference for", "CROSS_REFERENCE"), ("is superseded by", "SUPERSEDED_BY"), ("superseded by", "SUPERSEDED_BY"), ("replaced by", "SUPERSEDED_BY"), ("pin-compatible with", "PIN_COMPATIBLE_WITH"), ("pin compatible with", "PIN_COMPATIBLE_WITH"), ("same die as", "SAME_DIE_AS"), ("renamed to", "RENAMED_TO"), ("was acquired by", "ACQUIRED_BY"), ("acquired by", "ACQUIRED_BY"), ("affected by", "AFFECTED_BY"), ("franchise for", "FRANCHISE_FOR"), ("authorized distributor for", "FRANCHISE_FOR"), ("is manufactured by", "MANUFACTURED_BY"), ("manufactured by", "MANUFACTURED_BY"), ("stocked at", "STOCKED_AT"))
MAKER_KEYS = {"atmel": "mfr:atmel", "microchip technology": "mfr:microchip", "microchip": "mfr:microchip", "texas instruments": "mfr:ti", "stmicroelectronics": "mfr:st", "analog devices": "mfr:analog", "nxp": "mfr:nxp", "infineon": "mfr:infineon", "onsemi": "mfr:onsemi", "renesas": "mfr:renesas"}
SELLER_KEYS = {"digikey": "dist:digikey", "digi-key": "dist:digikey", "mouser": "dist:mouser", "arrow": "dist:arrow", "farnell": "dist:farnell"}

# The ladder for obsolete parts, gaps and their repair queries, words that are no part of a vendor's name.
DMSMS_LADDER = ("existing_stock", "reclamation", "substitute", "alternate_source", "redesign", "emulation")
NON_PRICED = ("NOT_FOUND", "QUOTE_REQUIRED", "CONTACT_FOR_PRICING", "CONFLICTING")
REPAIR_QUERIES = {"quote_channel": "{q} request a quote contact sales RFQ", "checklist": "{q} service scope pricing requirements FAQ", "geo": "{q} location address office", "fff_conflict": "{q} datasheet pinout package equivalent", "datasheet": "{q} datasheet archive specification", "price_conflict": "{q} official latest price datasheet"}
VENDOR_STOPWORDS = ("pte", "ltd", "sdn", "bhd", "llc", "inc", "co", "company", "team")
PAGE_PRICE = r"(?:S\$|US\$|RM|SGD|USD|MYR|EUR|GBP|\$|£|€)\s?\d[\d,]*(?:\.\d+)?"
PREMISE_CURRENCY = r"(?:s\$|us\$|\$|£|€|(?<![a-z0-9])(?:rm|sgd|usd|myr|eur|gbp))\s?(?=\d)"

# Minimum order quantities, subjects of claims, phrases before a successor.
MOQ = r"(?:MOQ|minimum order(?: quantity)?)\D{0,15}([\d,]+)"
SUBJECT_STOP = ("pte", "ltd", "limited", "co", "company", "corp", "inc", "singapore", "sg", "the", "and", "of", "supply", "services", "trading", "enterprise", "group", "global", "international", "solutions", "systems")
CLAIM_TOKEN = r"[a-z0-9@.+]+"
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"
SUCCESSOR = r"(?:cross-references|cross references|cross-reference for|is superseded by|superseded by|replaced by|pin-compatible with|pin compatible with|same die as|renamed to)\s*$"

# Numbers that compete with a claimed one and what makes them prices or quantities; states of parts that are out.
COMPETING_NUMBER = r"\d+(?:[.,]\d+)*"
VALUE_CONTEXT = r"(?i)US\$|S\$|[$€£¥]|\b(?:usd|sgd|myr|eur|gbp|rm|jpy|cny|idr|thb|php|vnd|price[sd]?|pricing|cost[s]?|charge[sd]?|fee[s]?|rate[s]?|quote[sd]?|quotation[s]?|moq|per|unit[s]?|pc[s]?|piece[s]?)\b"
DEAD_LIFECYCLE = ("obsolete", "eol", "endoflife", "discontinued", "inactive")

# Search variants. Device classes by the words that name them, with families of parts; makers; brokers.
DEVICE_CLASSES = {"op-amp": ("operational amplifier", "LM358"), "op amp": ("operational amplifier", "LM358"), "opamp": ("operational amplifier", "LM358"), "operational amplifier": ("operational amplifier", "LM358"), "mcu": ("microcontroller", "ATmega328"), "microcontroller": ("microcontroller", "ATmega328"), "connector": ("connector", "DF13"), "transistor": ("transistor", "2N2222"), "regulator": ("voltage regulator", "LM7805"), "fpga": ("FPGA", "XC7A35T"), "adc": ("analog-to-digital converter", "ADS1115"), "dac": ("digital-to-analog converter", "MCP4725"), "diode": ("diode", "1N4148"), "capacitor": ("capacitor", "EEU-FR"), "relay": ("relay", "G5V-1")}
QUERY_MAKERS = ("ti", "texas instruments", "adi", "analog devices", "maxim", "nxp", "st", "stmicroelectronics", "microchip", "atmel", "infineon", "onsemi", "on semiconductor", "hirose", "molex", "te connectivity", "amphenol", "vishay", "rohm", "renesas")
BROKER_OPERATORS = ("rochester", "lansdale", "oemsecrets", "octopart", "avnet")
EXPLICIT_MPN = r"\b[A-Za-z]{1,5}\d{2,}[A-Za-z0-9\-/.]*\b"

# Strategies of a search by kind of request, with their queries; tiers of tasks; modes that reason.
SERVICE_STRATEGIES = ("official_site_first", "quote_channel_first", "directory_contact_first", "sea_local_phrasing_first", "category_pricing_first")
ELECTRONICS_STRATEGIES = ("authorized_distributor_first", "fff_substitute_first", "lifecycle_pcn_first", "broker_long_tail_first", "archived_datasheet_first")
STRATEGY_QUERIES = {"official_site_first": ["{q} official site"], "quote_channel_first": ["{q} request a quote", "{q} contact sales RFQ"], "directory_contact_first": ["{q} directory listing", "{q} contact"], "sea_local_phrasing_first": ["{q} Singapore Malaysia supplier pembekal"], "category_pricing_first": ["{q} price rate card"], "authorized_distributor_first": ["{q} authorized distributor", "{q} Mouser Digi-Key"], "fff_substitute_first": ["{q} substitute cross reference", "{q} equivalent replacement"], "lifecycle_pcn_first": ["{q} EOL PCN lifecycle NRND"], "broker_long_tail_first": ["{q} broker stock surplus obsolete"], "archived_datasheet_first": ["{q} datasheet archive"]}
SERVICE_MODES = ("service_quote_required", "contact_enrichment_only")
REASONING_MODES = ("service_quote_required", "product_exact_price", "revalidation", "electronics_substitution")
PLANNED_TASKS = ("planning", "reasoning")

# What a service vendor must be told.
SERVICE_INPUTS = ("service_scope", "service_location", "frequency_or_schedule", "site_size_or_headcount", "preferred_start_date", "contract_duration", "special_requirements")

# Topics of made-up pages on parts that are no longer made.
OBSOLETE_TOPIC = ("obsolete", "substitute", "replacement", "eol", "discontinued", "cross reference", "cross-reference", "alternate", "nrnd")
TOPIC_PART = r"\b(?=[a-z0-9]{4,})[a-z]+[0-9][a-z0-9]*\b"

# Actions that are never taken.
FORBIDDEN_ACTIONS = ("rfq_submitted", "rfq_sent", "form_submit", "form_submitted", "email_send", "email_sent", "browser_drive", "browser_navigate", "browser_action")

# The letter that asks a vendor for a quotation, and the sentence that a datasheet would begin with.
RFQ_LETTER = """Dear {vendor} Team,

We are sourcing quotations for: {query}.

Could you please provide a quotation covering scope of work, pricing basis, service frequency/schedule, and contract terms? We have outlined the inputs we can share in the attached checklist and would appreciate guidance on any additional details you require to quote.

Kindly include your standard lead time and any minimum contract conditions.

Thank you,
Procurement Team"""
DATASHEET_SENTENCE = "Datasheet: {device}. {query}. Specifications include package, pinout, operating temperature, supply voltage, and cross-reference / equivalent replacement parts for obsolete or EOL devices."

# A walk over variants of a query: its categories, the kinds of variants that they take, the words of the local one, and the lenses that verify a leaf.
WALK_CATEGORIES = ("synonym", "broader_class", "broker_operator", "sea_local_language", "mfr_alt_pn")
WALK_CATEGORY_OF = {"query2doc": "synonym", "hyde": "synonym", "step_back": "broader_class", "broker_operator": "broker_operator", "mpn_pattern": "mfr_alt_pn", "obsolescence": "mfr_alt_pn"}
WALK_LOCAL = "Singapore Malaysia distributor pembekal"
WALK_LENSES = ("refetch", "competing_vendor", "wayback")

# Templates of searches by region and mode ({q}: the query, {c}: a country), and the countries where none is named.
GLOBAL_TEMPLATES = {"product_exact_price": ("{q} price", "{q} public pricing", "{q} supplier price", "{q} MOQ price"), "contact": ("{q} official contact", "{q} email", "{q} phone", "{q} contact page"), "other": ("{q} vendor", "{q} request quotation", "{q} suppliers", "{q} pricing")}
LOCAL_TEMPLATES = {"product_exact_price": ("{q} {c} price", "{q} {c} public pricing", "{q} {c} bulk price", "{q} {c} MOQ price"), "contact": ("{q} {c} official contact", "{q} {c} email", "{q} {c} phone", "{q} {c} contact page"), "other": ("{q} {c} request quotation", "{q} {c} for quotation", "{q} {c} RFQ", "{q} {c} contact sales")}
REGIONAL_TEMPLATE = {"product_exact_price": "{q} Southeast Asia supplier price", "contact": "{q} Southeast Asia contact", "other": "{q} Southeast Asia vendor"}
CONTACT_MODES = ("contact_enrichment_only", "revalidation")
TEMPLATE_COUNTRIES = ("Singapore", "Malaysia")

# What a note is tagged with: words of countries, stages of fields, words of risk.
NOTE_GEO = {"Singapore": ("singapore", "sg "), "Malaysia": ("malaysia", "kuala lumpur", "pembekal"), "Indonesia": ("indonesia", "jakarta"), "Thailand": ("thailand", "bangkok"), "Vietnam": ("vietnam", "hanoi", "ho chi minh"), "Philippines": ("philippines", "manila")}
NOTE_STAGES = {"quote_channel": "sourcing", "price": "pricing", "moq": "pricing", "lead_time": "pricing", "lifecycle_status": "lifecycle"}
NOTE_RISKS = ("nrnd", "eol", "obsolete", "last-time-buy", "ltb", "nla", "discontinued", "counterfeit")

# What ends a page's title without being the vendor's name: a mark, then one of these.
TITLE_MARKS = "|-–—:"
TITLE_ENDINGS = ("home", "contact", "contact us", "about", "about us", "welcome", "official site")
UNKNOWN_VENDOR = "Unknown Vendor"
