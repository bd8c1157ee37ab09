"""Fixed values that must equal the archive's conventions.

Everything here is plain data: character tables, word lists, patterns, label maps
and limits. The code that uses them lives in the sibling modules.
"""

# --- fixed values: characters -------------------------------------------------
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
TATWEEL = "ـ"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
BIDI = r"[\u200E\u200F\u202A-\u202E\u2066-\u2069]"
BIDI_AND_BOM = r"[\u200E\u200F\u202A-\u202E\u2066-\u2069\uFEFF]"
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
WHITESPACE_NOT_BLANK = r"[\t-\r\x1C-\x1F\x85\p{Z}&&[^ ]]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
LINE_PUNCTUATION = " :-،؛"

# --- fixed values: visual-order repairs ---------------------------------------
VISUAL_ORDER_FIXES = [("احملكمة", "المحكمة"), ("احملاكم", "المحاكم"), ("اهلل", "الله")]
ARTICLE_SWAP = (
    r"(?:(?<![ء-غف-ي])|(?<=(?:^|[^ء-غف-ي])[وفبك]))ا([حجخمأ])ل(?=[ء-غف-ي])"
)

# --- fixed values: reference numbers ------------------------------------------
DEED = [
    r"(?:ر\s*ق\s*م\s*)?(?:ال)?صك\s*[:：\-]?\s*([0-9/\-]{5,30})",
    r"ر\s*ق\s*م\s*(?:ال)?ص\s*ك\s*[:：\-]?\s*([0-9/\-]{5,30})",
]
JUDGMENT = [r"(?:ر\s*ق\s*م\s*)?(?:ال)?حكم\s*[:：\-]?\s*([0-9/\-]{4,30})"]
LAWSUIT = [r"(?:ر\s*ق\s*م\s*)?(?:ال)?(?:دعوى|قضية)\s*[:：\-]?\s*([0-9/\-]{3,30})"]
HIJRI_DATE = [
    r"(?:تاريخ(?:ه)?|بتاريخ)\s*[:：\-]?\s*(1[34][0-9]{2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*[0-9]{1,2})",
    r"(?:تاريخ(?:ه)?|بتاريخ)\s*[:：\-]?\s*([0-9]{1,2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*1[34][0-9]{2})",
    r"(1[34][0-9]{2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*[0-9]{1,2})\s*هـ?",
    r"([0-9]{1,2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*1[34][0-9]{2})\s*هـ?",
]
LIBRARY_DEED = r"(?:رقم\s*(?:الصك|الحكم)\s*[:：-]?\s*)([0-9]{3,20})"
LIBRARY_CASE = r"(?:رقم\s*(?:الدعوى|القضية)\s*[:：-]?\s*)([0-9]{3,20})"
LIBRARY_CIRCULAR = r"(?:تعميم\s*(?:رقم)?\s*[:：-]?\s*)([0-9]{3,20})"
LIBRARY_DECISION = r"(?:قرار\s*(?:رقم)?\s*[:：-]?\s*)([0-9]{3,20})"

# --- fixed values: title and court evidence -----------------------------------
TITLE_REJECTS = [
    "رقم الصك", "رقم الحكم", "رقم الدعوى", "رقم القضية", "رقم قرار",
    "تاريخ", "تاريخه", "وزارة العدل", "المملكة العربية السعودية",
    "الحمد لله", "الحمد هلل", "فهرس", "الصفحة", "الفهارس",
    "مركز البحوث", "مجموعة الأحكام", "مجموعة األحكام",
]
TITLE_STOP_PREFIXES = ["1.", "2.", "3.", "ادعى", "الحمد"]
TITLE_DASHES = "[-–—]"
COURT_MARKERS = [
    "المحكمة العامة", "المحكمة الجزائية", "المحكمة التجارية",
    "المحكمة العمالية", "المحكمة الإدارية", "محكمة التنفيذ",
    "محكمة الاستئناف",
]
APPEAL_COURT = "محكمة الاستئناف"
APPEAL_CERTIFICATION = "قرار التصديق|صدق الحكم|مصادقة"
COURT_TAIL_STOP = (
    r"الحمد\s+لل?ه|وبناء|اء\s+على|وبعد|والصادر|والمقيد|للنظر|ما\s+ورد|من\s+فضيلة|"
    r"الدعوى|المقدمة|رقم|تاريخ|في يوم|افتتحت|فقد|حيث|،|؛|\."
)
LINE_EXCLUSIONS = ["رقم قرار التصديق", "مصادقة محكمة الاستئناف"]
LINE_STOP = r"تاريخه|بتاريخ|المتضمن|الصادر|رقم قرار"
COURT_LINE_MARKERS = [
    "المحكمة العامة", "احملكمة العامة", "المحكمة الجزائية", "احملكمة الجزائية",
    "المحكمة التجارية", "احملكمة التجارية", "المحكمة العمالية", "احملكمة العمالية",
    "محكمة الاستئناف", "محكمة االستئناف", "المحكمة الإدارية", "احملكمة اإلدارية",
    "محكمة التنفيذ", "احملكمة التنفيذ",
]
TRUSTED_COURT = r"(?:المحكمة|محكمة)\s+[^،؛]{3,100}"
TRUSTED_COURT_REJECT = "محكمة الاستئناف على"
TRUSTED_CIRCUIT = r"الدائرة\s+[^،؛]{2,70}"

# --- fixed values: index volumes ----------------------------------------------
INDEX_ALL = "الفهارس"
INDEX_ANY = ["فهرس الاسانيد", "فهرس الكلمات"]
INDEX_FRONT_PAGES = 15

# --- fixed values: page-header kinds, in order of precedence -------------------
HEADER_KINDS = [
    ("circular", "تعميم", r"(?:رقم\s*)?(?:التعميم)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{2,40})"),
    ("decision", "قرار", r"(?:رقم\s*)?(?:القرار)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{2,40})"),
    ("judgment", "حكم قضائي", r"(?:رقم\s*)?(?:الحكم)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{3,40})"),
    ("deed", "صك قضائي", r"(?:رقم\s*)?(?:الصك)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{3,40})"),
    ("principle", "مبدأ قضائي", r"(?:رقم\s*)?(?:المبدأ)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{1,40})"),
    ("precedent", "سابقة قضائية", r"(?:رقم\s*)?(?:السابقة)\s*(?:رقم\s*)?[:：\-]?\s*([0-9/\-]{1,40})"),
]
HEADER_CHARS = 1800
HEADER_DATE = (
    r"(?:بتاريخ|تاريخه|تاريخ)\s*[:：\-]?\s*"
    r"((?:1[34][0-9]{2}|20[0-9]{2})\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*[0-9]{1,2}"
    r"|[0-9]{1,2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*(?:1[34][0-9]{2}|20[0-9]{2}))"
)
HEADER_COURT = r"((?:المحكمة|محكمة)\s+[^\n]{3,160})"
WHOLE_FILE_KINDS = [
    ("judgment", "حكم قضائي"), ("deed", "صك قضائي"), ("circular", "تعميم"),
    ("decision", "قرار"), ("principle", "مبدأ قضائي"), ("precedent", "سابقة قضائية"),
]

# --- fixed values: fields and types of imported records -------------------------
IMPORT_PATTERNS = {
    "deed_number": [r"رقم\s*الصك\s*[:：\-]?\s*([0-9/\-]{3,30})"],
    "judgment_number": [r"رقم\s*الحكم\s*[:：\-]?\s*([0-9/\-]{3,30})"],
    "lawsuit_number": [r"رقم\s*(?:القضية|الدعوى)\s*[:：\-]?\s*([0-9/\-]{3,30})"],
    "circular_number": [r"تعميم\s*(?:رقم)?\s*[:：\-]?\s*([0-9/\-]{2,30})"],
    "decision_number": [r"قرار\s*(?:رقم)?\s*[:：\-]?\s*([0-9/\-]{2,30})"],
    "court": [r"((?:المحكمة|محكمة)\s+[^\n،؛]{3,120})"],
    "circuit": [r"(الدائرة\s+[^\n،؛]{2,100})"],
    "date": [r"(1[34][0-9]{2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*[0-9]{1,2})",
             r"([0-9]{1,2}\s*[/\-]\s*[0-9]{1,2}\s*[/\-]\s*1[34][0-9]{2})"],
}
DOCUMENT_TYPES = ["حكم قضائي", "حكم قضائي دولي", "تعميم", "قرار", "مبدأ قضائي", "سابقة قضائية", "نظام أو لائحة",
                  "مرجع قانوني", "بحث قانوني", "وثيقة قانونية"]

# --- fixed values: tags and shared links ---------------------------------------
SCRIPT_BLOCK = r"(?is)<(script|style|noscript).*?>.*?</\1>"
TAG = r"<[^>]+>"
SHARED_FILE = r"/file/d/([^/]+)"
SHARED_ID = r"[?&]id=([^&#]+)"
SHARED_DOCUMENT = r"/(document|spreadsheets|presentation)/d/([^/]+)"

# --- fixed values: hosts and limits -------------------------------------------
OFFICIAL_HOSTS = ["moj.gov.sa", "laws.moj.gov.sa", "bog.gov.sa", "saip.gov.sa"]
COLLECTOR_HOSTS = OFFICIAL_HOSTS + ["uqn.gov.sa"]
ITEM_LIMIT_BYTES = 262144000
CYCLE_BUDGET_BYTES = 1073741824
POSTS_PER_CYCLE = 25

# --- fixed values: identifier namespaces --------------------------------------
JUDGMENT_NAMESPACE = "d702a836-69be-486b-8c7f-cf6ee3a3b7f2"
CIRCULAR_NAMESPACE = "417bfc7f-99a6-4d57-8c42-f70d74024d08"
DECISION_NAMESPACE = "c5c9874e-2552-4a21-b3d4-d675b13d6bc2"

# --- fixed values: why the paging of a feed stops ------------------------------
STOP_KNOWN = "reached_existing_inventory_boundary"
STOP_EMPTY = "no_document_posts_returned"
STOP_REPEATED = "repeated_page_boundary"
STOP_NOT_FALLING = "non_decreasing_page_boundary"
STOP_NO_MORE = "max_pages_reached"
