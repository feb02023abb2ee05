"""Fixed values.

Word lists, patterns, defaults and prices that decide the results.  They are data, kept
together and in their natural order; the operators read them from here.  Patterns are
written in the Python dialect; ``functions.text`` turns them into Java ones.
"""

# --- cleaning -------------------------------------------------------------------------

EMAIL_ADDRESS = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"

CC_LINE = r"^Cc\s*:"
ADDRESS_LINE = r"^(From|To)\s*:"

# Case-sensitive: a paragraph that matches one of these is business content.
PROTECTED_PATTERNS = [
    r"\b(scheme|claim|invoice|bill|payment|fsn|sku|po\s*#?|order|cn|dn|debit|credit)\b",
    r"\btotal\s+amount\b",
    r"\bvendor\s+name\b",
    r"\b(product|model|brand|item|category)\b",
    r"\b(quantity|qty|units?|stock|pieces?|items?)\b",
    r"\b(price|amount|cost|value|rate|margin)\b",
    r"\b(discount|rebate|commission|incentive)\b",
    r"\b(date|effective|deadline|due|valid|expiry)\b",
    r"\b(warehouse|delivery|shipping|truck|transport|dispatch|location|address)\b",
    r"\b(submit|provide|attach|send|upload|confirm)\b",
    r"\b(document|file|report|screenshot|attachment)\b",
    r"\b(contact|phone|email|mobile)\b",
    r"\b(serial|batch|lot|tracking|id)\b",
    r"\b(specification|spec|features?|details?)\b",
    r"[₹€£¥\$]\s*\d",
    r"\d+\s*(units?|pieces?|kgs?|grams?|litres?|tons?)",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{1,2}:\d{2}\s*(?:AM|PM)",
    r"\d+\.?\d*\s*%",
    r"\b[A-Z]{2,4}-\d{3,}",
]

# Case-insensitive.  The second and third mark a thread start anywhere in a paragraph.
HEADER_PATTERNS = [
    r"^\s*(From|Sent|Date|To|Subject)\s*:.*",
    r"-+\s*Forwarded message\s*-+",
    r"On\s+.*wrote\s*:",
    r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b.*?(?:AM|PM|at|on)",
    r"""^\s*(?:["']?[\w\s.-]+["']?\s*)?<[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}>""",
    r"^\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)$",
]
METADATA_LINE = r"^\s*(From|To|Cc|Sent|Subject|Date)\s*:"

# Case-insensitive.
FOOTER_PATTERNS = [
    r"https?://mail\.google\.com/.*",
    r"\[Quoted text hidden\]",
    r"^\d+/\d+$",
    r"click here to unsubscribe",
    r"manage preferences",
]

DISCLAIMER_KEYWORDS = [
    "confidential", "legally protected", "intended solely", "disclosure",
    "dissemination", "distribution", "recipient", "notify the sender",
    "delete it permanently", "viruses", "malicious codes", "liability",
    "damages", "error", "transaction", "contract", "privilege",
    "prohibited", "reliance", "omissions", "disclaims", "attached files",
    "mutations", "defamatory", "infringement", "copyright",
    "electronic transmission", "not necessarily secure", "mutations in their transfer",
]
DISCLAIMER_KEYWORD_MINIMUM = 3

# Case-insensitive.
BOILERPLATE_PATTERNS = [
    r"intended solely for the addressee",
    r"intended solely for the use of the individual",
    r"confidentiality notice",
    r"delete this email",
    r"views or opinions presented",
    r"accepts no liability",
    r"do not reply to this email",
    r"system generated",
    r"this email and any files transmitted",
    r"disclosing, copying, distributing or taking any action",
    r"contrary to organizational policy",
    r"employee responsible will be personally liable",
    r"on behalf of the .* group",
]

# Case-insensitive, "." matches line breaks.  First in list order wins.
BLOCK_MARKERS = [
    r"This e-mail message may contain confidential",
    r"This email.*?confidential.*?legally protected",
    r"This email and any files transmitted.*?confidential",
    r"This message contains confidential information",
    r"Any views or opinions presented in this email",
    r"本电子邮件及其附件含有.*?保密信息",
]
BLOCK_ENDINGS = [
    r"confirmation of any transaction or contract",
    r"attachments are not intended as an offer",
    r"strictly prohibited",
    r"personally liable for any damages",
    r"actions taken on the basis of the information provided",
]
# The standalone disclaimer cleaner knows fewer of each.
STANDALONE_BLOCK_MARKERS = [
    r"This e-mail message may contain confidential",
    r"This email.*?confidential.*?legally protected",
    r"本电子邮件及其附件含有.*?保密信息",
]
STANDALONE_BLOCK_ENDINGS = [
    r"confirmation of any transaction or contract",
    r"attachments are not intended as an offer",
    r"strictly prohibited",
]
BLOCK_ROUNDS = 10
SENTENCE_REACH = 200

# --- layout and context ---------------------------------------------------------------

ZONED_OBJECT_TYPES = ["char", "line", "rect"]
PAGE_BAND = 50
MINIMUM_TEXT = 100
OVERSIZED_TEXT = "The text does not fit one cell"
SHEET_ROWS = 50
CONTEXT_LINES = 50
EVALUATION_LINES = {"email_text": 100, "table_data": 30, "xlsx_data": 30}
CONTEXT_SUFFIX = "... [TRUNCATED FOR TOKEN EFFICIENCY]"
EVALUATION_SUFFIX = "... [TRUNCATED]"
NO_TABLE_DATA = "No table data available"
NO_XLSX_DATA = "No XLSX data provided"

# --- prediction fields ----------------------------------------------------------------

# Field name -> value used when the prediction has none.
FIELD_DEFAULTS = {
    "scheme_type": "SELL_SIDE",
    "scheme_subtype": "PUC",
    "scheme_name": "Unnamed Scheme",
    "scheme_description": "Not specified",
    "vendor_name": "Unknown Vendor",
    "scheme_period": "Duration",
    "duration": "Not Specified",
    "discount_type": "Not Specified",
    "max_cap": "No Cap",
    "price_drop_date": "N/A",
    "start_date": "Not Specified",
    "end_date": "Not Specified",
    "fsn_file_config_file": "No",
    "min_actual_discount_or_agreed_claim": "FALSE",
    "remove_gst_from_final_claim": "Not Specified",
    "over_and_above": "FALSE",
    "scheme_document": "No",
    "discount_slab_type": "Not Applicable",
    "best_bet": "Not Applicable",
    "brand_support_absolute": "Not Applicable",
    "gst_rate": "Not Applicable",
    "config_brand_support": "Not specified in email",
    "config_vendor_split_ratio": "Not specified",
    "config_unit_slab_lower": "0",
    "config_unit_slab_upper": "999999",
    "config_max_support_value": "No Cap",
    "config_margin": "Not specified",
    "model_name": "Not Specified",
    "extracted_fsns": "None",
    "cities_locations": "National",
    "sub_periods": "Single Period",
}
DATE_FIELDS = ["price_drop_date", "start_date", "end_date"]

# Field name -> name of the reasoning that explains it.  The last four explain themselves.
REASONING_OF = {
    "scheme_type": "scheme_type_reasoning",
    "scheme_subtype": "scheme_subtype_reasoning",
    "scheme_name": "scheme_name_reasoning",
    "scheme_description": "scheme_description_reasoning",
    "scheme_period": "scheme_period_reasoning",
    "duration": "duration_reasoning",
    "discount_type": "discount_type_reasoning",
    "max_cap": "max_cap_reasoning",
    "vendor_name": "vendor_name_reasoning",
    "price_drop_date": "price_drop_date_reasoning",
    "start_date": "start_date_reasoning",
    "end_date": "end_date_reasoning",
    "fsn_file_config_file": "fsn_file_config_file_reasoning",
    "min_actual_discount_or_agreed_claim": "min_discount_reasoning",
    "remove_gst_from_final_claim": "remove_gst_reasoning",
    "over_and_above": "over_and_above_reasoning",
    "scheme_document": "scheme_document_reasoning",
    "discount_slab_type": "discount_slab_type_reasoning",
    "best_bet": "best_bet_reasoning",
    "brand_support_absolute": "brand_support_absolute_reasoning",
    "gst_rate": "gst_rate_reasoning",
    "config_brand_support": "config_brand_support_reasoning",
    "config_vendor_split_ratio": "config_vendor_split_reasoning",
    "config_unit_slab_lower": "config_slab_reasoning",
    "config_unit_slab_upper": "config_slab_reasoning",
    "config_max_support_value": "config_max_support_reasoning",
    "config_margin": "config_margin_reasoning",
    "model_name": "model_name",
    "extracted_fsns": "extracted_fsns",
    "cities_locations": "cities_locations",
    "sub_periods": "sub_periods",
}
NO_REASONING = "No reasoning provided"
NO_GLOBAL_REASONING = "No global reasoning"
SLAB_TYPE_REASON = "Fixed constant 'notApplicable' enforced for BUY_SIDE PERIODIC_CLAIM per business rules."
BEST_BET_REASON = "Fixed constant 'FALSE' enforced for BUY_SIDE PERIODIC_CLAIM per business rules."
CONVERTED_SUBTYPE_PREFIX = "(AUTO-CONVERTED FROM BOC) "

# Confidence is low when the value contains one of these, medium when the reasoning is short.
LOW_CONFIDENCE_WORDS = ["not specified", "not found", "n/a", "unknown"]
SHORT_REASONING = 50

# Override rules in order of priority: kind of test, words, resulting pair, reason.
BUY_SIDE_PATTERNS = [r"\bjbp\b", r"net\s+inwards"]
LIFESTYLE_VENDORS = [
    "aditya birla", "mgi distribution", "brand concepts", "timex", "titan",
    "metro brands", "sumitsu", "sea turtle",
    "beewakoof", "highlander", "leemboodi", "campus", "puma", "red tape", "high star",
]
LIFESTYLE_WORDS = [
    "sor", "sor pricing", "sor discounts", "monsoon sale", "monsoon", "fashion",
    "lifestyle", "clothing", "apparel",
]
ONE_OFF_WORDS = ["one-off sales support", "one-off", "sales support", "sell-out support"]
PRICE_DROP_WORDS = [
    "price drop", "permanent price drop", "nlc reduction", "cost reduction", "price protection",
]
EXCHANGE_WORDS = ["exchange", "prexo", "upgrade", "buyback", "bup", "prexo bumpup"]
OVERRIDE_REASONS = {
    "buy_side": "Strict Rule: JBP/Net Inwards keywords found.",
    "lifestyle": "Strict Rule: Lifestyle trigger (Keyword/Vendor).",
    "one_off": "Strict Rule: OFC keywords.",
    "price_drop": "Strict Rule: Price Drop keywords.",
    "exchange": "Strict Rule: Exchange keywords.",
}
SELL_SIDE_SUBTYPES = ["CP", "PUC", "PRX", "LS"]

# Output keys that are always present, in order.
ALWAYS_OUTPUT = [
    "scheme_type", "scheme_subtype", "scheme_name", "scheme_description", "scheme_period",
    "duration", "discount_type", "vendor_name", "start_date", "end_date",
]

NO_DATE = ["not specified", "n/a", "none", "not found"]
NO_DATE_IN_EVALUATION = ["not specified", "n/a", "none"]

# --- lookups and configuration records ------------------------------------------------

CODE_LENGTH = 10
NO_MODEL = ["not specified", "n/a", "none"]
NO_VENDOR = ["unknown vendor", "not specified", "unknown"]
DEFAULT_SITE = "National_Site"
NOT_SPECIFIED = "Not Specified"
PRODUCT_PLACEHOLDER = "Populate from FSN File"
EXCHANGE_PLACEHOLDER = "Populate from Exchange FSN File"
DMRP_PLACEHOLDER = "Manual - From DMRP File"
NO_CONFIG_NEEDED = "No FSN Config required for OFC"

# --- usage ----------------------------------------------------------------------------

# Model -> price per million input and output tokens.  The order decides partial matches.
PRICES = {
    "openai/gpt-4o": (2.50, 10.00),
    "openai/gpt-4o-mini": (0.15, 0.60),
    "openai/gpt-4-turbo": (10.00, 30.00),
    "anthropic/claude-3.5-sonnet": (3.00, 15.00),
    "anthropic/claude-3-opus": (15.00, 75.00),
    "anthropic/claude-3-haiku": (0.25, 1.25),
    "google/gemini-pro-1.5": (1.25, 5.00),
    "google/gemini-flash-1.5": (0.075, 0.30),
    "mistralai/mistral-large": (2.00, 6.00),
    "qwen/qwen-2.5-72b-instruct": (0.35, 0.40),
    "qwen/qwen-2.5-32b-instruct": (0.07, 0.13),
    "qwen/qwen-2.5-14b-instruct": (0.04, 0.08),
    "qwen/qwen-2.5-7b-instruct": (0.01, 0.01),
    "openrouter/qwen/qwen3-32b": (0.08, 0.24),
    "qwen/qwen3-32b": (0.08, 0.24),
}
DEFAULT_PRICED_MODEL = "openai/gpt-4o"
PRICED_PREFIXES = ["openrouter/", "openai/"]
CHARS_PER_TOKEN = 4

# --- evaluation -----------------------------------------------------------------------

# Label spelling -> field.
LABEL_KEYS = {
    "Scheme Type": "scheme_type",
    "Sub Type": "scheme_subtype",
    "Scheme Name": "scheme_name",
    "Description": "scheme_description",
    "Scheme Period": "scheme_period",
    "Duration": "duration",
    "DISCOUNT_TYPE": "discount_type",
    "BRAND_SUPPORT_ABSOLUTE": "brand_support_absolute",
    "GST Ratet": "gst_rate",
    "GST Rate": "gst_rate",
    "Max Cap (ï¿½) / GLOBAL_CAP_AMOUNT": "max_cap",
    "Max Cap": "max_cap",
    "DISCOUNT_SLAB_TYPE (Applicable for Buyside-Periodic)": "discount_slab_type",
    "DISCOUNT_SLAB_TYPE": "discount_slab_type",
    "BEST_BET ( Applicable for Buyside-Periodic)": "best_bet",
    "BEST_BET": "best_bet",
    "Minimum of actual discount OR agreed claim (whichever is lower)": "min_actual_discount_or_agreed_claim",
    "FSN File / Config File (If Any) (YES/NO/O/P FILE)": "fsn_file_config_file",
    "Over & Above (If selected this will override duplicity check)": "over_and_above",
    "Remove GST from final claim amount": "remove_gst_from_final_claim",
    "Scheme Document attached (Yes/No)": "scheme_document",
    "Start Date": "start_date",
    "End Date": "end_date",
    "Vendor": "vendor_name",
    "Vendor Name": "vendor_name",
    "Price Drop Date": "price_drop_date",
}
# Upper-cased label contains: all of one inner list.  First rule wins.
LABEL_KEY_RULES = [
    ([["MAX CAP"]], "max_cap"),
    ([["SLAB"]], "discount_slab_type"),
    ([["BEST BET"]], "best_bet"),
    ([["MINIMUM OF ACTUAL"]], "min_actual_discount_or_agreed_claim"),
    ([["FSN"], ["CONFIG"]], "fsn_file_config_file"),
    ([["OVER & ABOVE"]], "over_and_above"),
    ([["GST", "REMOVE"]], "remove_gst_from_final_claim"),
    ([["DOCUMENT", "ATTACHED"]], "scheme_document"),
    ([["VENDOR"]], "vendor_name"),
    ([["PRICE DROP"]], "price_drop_date"),
    ([["START", "DATE"]], "start_date"),
    ([["END", "DATE"]], "end_date"),
]

# Upper-cased spelling -> standard code.
TYPE_SYNONYMS = {
    "PDC": ["PDC", "PDC-PDC", "PRICE_DROP"],
    "BUY_SIDE": ["BUY_SIDE", "BS", "BUY SIDE"],
    "SELL_SIDE": ["SELL_SIDE", "SS", "SELL SIDE"],
    "OFC": ["OFC", "ONE_OFF", "ONE OFF", "OFC-OFC"],
}
SUBTYPE_SYNONYMS = {
    "PERIODIC_CLAIM": ["PERIODIC_CLAIM", "BS-PC", "PERIODIC CLAIM", "PC"],
    "PDC": ["PDC", "PDC-PDC"],
    "CP": ["CP", "COUPON", "SS-CP", "VPC"],
    "PUC": ["PUC", "PUC_FDC", "SS-PUC", "PRICE MATCH"],
    "PRX": ["PRX", "PREXO", "SS-PRX", "EXCHANGE"],
    "SC": ["SC", "SUPER_COIN", "SS-SC", "SUPER COIN"],
    "LS": ["LS", "LIFESTYLE", "SS-LS"],
    "OFC": ["OFC", "ONE_OFF", "ONE OFF", "OFC-OFC"],
}
NOT_APPLICABLE = [
    "not applicable", "n/a", "none", "no", "nofield", "nan", "", "notapplicable",
]

# Scored fields and weights (they add up to 16).
PAIR_WEIGHT = 3.0
DURATION_WEIGHT = 1.0
STRUCTURED_FIELDS = [
    "vendor_name", "discount_type", "max_cap", "over_and_above",
    "remove_gst_from_final_claim", "brand_support_absolute",
]
STRUCTURED_WEIGHT = 1.0
SCORED_DATES = ["start_date", "end_date"]
DATE_WEIGHT = 1.0
FREE_TEXT_FIELDS = ["scheme_name", "scheme_description"]
FREE_TEXT_WEIGHT = 0.5
FREE_TEXT_LENGTH = 3
TOTAL_WEIGHT = 16.0
REPORTED_FIELDS = [
    "scheme_type", "scheme_subtype", "vendor_name", "duration", "start_date", "end_date",
    "brand_support_absolute",
]
REPORTED_EXAMPLES = 3

# --- report sizes ---------------------------------------------------------------------

PREVIEW_CHARS = {"email_text": 3000, "table_data": 2000, "xlsx_data": 1000}
REPORTED_REMOVALS = 10
REPORTED_TABLES = 5
DEMO_INPUT_PREVIEW = 200
DEMO_REASONING_PREVIEW = 300
