"""Fixed values shared by the detectors and transforms.

Everything in this file is data, not logic: word lists, separators and cut-offs that have to be exactly these for the
results to be right.
"""

# ---- fixed values -------------------------------------------------------------------------------------------------

SEMANTIC_TYPES = (
    "boolean", "categorical", "ordinal", "multi_value_tags", "numeric_string", "date_string", "free_text",
    "identifier", "numeric", "datetime", "unknown",
)

TRUE_WORDS = ["yes", "y", "true", "t", "1", "si", "sí", "oui", "sim", "ja", "da", "tak", "yeah", "yep", "x"]
FALSE_WORDS = ["no", "n", "false", "f", "0", "não", "nao", "non", "nein", "nie", "nope", "nah", ""]

# Scales in order of precedence; each list runs from its first to its last level.
ORDINAL_SCALES = [
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
    ["very dissatisfied", "dissatisfied", "neutral", "satisfied", "very satisfied"],
    ["very poor", "poor", "average", "good", "excellent"],
    ["very low", "low", "medium", "high", "very high"],
    ["never", "rarely", "sometimes", "often", "always"],
    ["low", "medium", "high"],
    ["small", "medium", "large"],
    ["bad", "average", "good"],
    ["disagree", "neutral", "agree"],
    ["high school", "bachelor", "master", "phd"],
    ["high school", "bachelors", "masters", "doctorate"],
    ["poor", "fair", "good", "very good", "excellent"],
    ["daily", "weekly", "monthly", "yearly"],
    ["critical", "high", "medium", "low"],
    ["p0", "p1", "p2", "p3", "p4"],
    ["discordo totalmente", "discordo", "neutro", "concordo", "concordo totalmente"],
    ["muito insatisfeito", "insatisfeito", "neutro", "satisfeito", "muito satisfeito"],
    ["péssimo", "ruim", "regular", "bom", "excelente"],
    ["muito baixo", "baixo", "médio", "alto", "muito alto"],
    ["nunca", "raramente", "às vezes", "frequentemente", "sempre"],
    ["baixo", "médio", "alto"],
    ["pequeno", "médio", "grande"],
    ["ruim", "regular", "bom"],
    ["discordo", "neutro", "concordo"],
    ["ensino médio", "graduação", "mestrado", "doutorado"],
    ["ruim", "razoável", "bom", "muito bom", "excelente"],
    ["diário", "semanal", "mensal", "anual"],
    ["crítico", "alto", "médio", "baixo"],
]

# Tag separators in the order they are tried.
TAG_SEPARATORS = [",", ";", "|", " / ", " // "]

CURRENCY_CHARS = "€£¥₹$R"

# Unicode whitespace as Python's str.strip sees it.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

SAMPLE_SIZE = 20           # sample values kept per column
MAX_BOOLEAN_WORDS = 3      # distinct words a boolean column may use
MAX_ORDINAL_WORDS = 15     # distinct words an ordinal column may use
NUMERIC_SHARE = 0.6        # share of values that must read as numbers
DATE_SHARE = 0.5           # share of values that must read as dates
AFFIX_SHARE = 0.4          # share of values that must carry the affix
TAG_HIT_SHARE = 0.25       # share of values that must contain the separator
TAG_MEAN_PARTS = 1.3       # mean number of parts for a separator to count
TAG_MEAN_PARTS_CONFIRM = 1.2
PROSE_PART_LENGTH = 25     # mean part length above which the optional prose guard takes the text for sentences
IDENTIFIER_SHARE = 0.9     # distinct share above which a column is an identifier or prose
IDENTIFIER_TEXT_LENGTH = 50
CATEGORY_TEXT_LENGTH = 80

WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Names of the months, and words beside a date that do not change it, in lower case.
MONTH_WORDS = [
    ["january", "jan", "janeiro"],
    ["february", "feb", "fevereiro", "fev"],
    ["march", "mar", "março"],
    ["april", "apr", "abril", "abr"],
    ["may", "maio", "mai"],
    ["june", "jun", "junho"],
    ["july", "jul", "julho"],
    ["august", "aug", "agosto", "ago"],
    ["september", "sept", "sep", "setembro", "set"],
    ["october", "oct", "outubro", "out"],
    ["november", "nov", "novembro"],
    ["december", "dec", "dezembro", "dez"],
]
DATE_FILLERS = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
    "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo",
    "segunda", "terça", "quarta", "quinta", "sexta", "seg", "ter", "qua", "qui", "sex", "sáb", "dom",
    "the", "of", "at", "on", "de", "do", "em", "às", "st", "nd", "rd", "th", "º", "t", "年", "月", "日",
]

# How a date text starts -> its strftime-like pattern; the first that fits.
DATE_HINTS = [
    (r"^\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "%m/%d/%y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
    ("", "auto"),
]

# ---- end of fixed values ------------------------------------------------------------------------------------------
