"""Term lists, lookup tables, weights and thresholds.

Everything in this module is a fixed value that results depend on. Lists are in
their natural order because matched terms are reported in that order.
"""

from __future__ import annotations

import mimetypes
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
# Content terms (substring match on lower-cased text)
URGENT = [
    "urgent", "immediate", "asap", "emergency", "critical", "important",
    "act now", "limited time", "expires", "deadline", "hurry", "quick",
]
SUSPICIOUS = [
    "verify", "confirm", "update", "suspend", "locked", "security",
    "click here", "download", "install", "winner", "congratulations",
    "free", "prize", "lottery", "inheritance", "tax refund",
]
FINANCIAL = [
    "bank", "account", "credit card", "payment", "transaction",
    "wire transfer", "bitcoin", "cryptocurrency", "paypal", "amazon",
]
BRAND = [
    "microsoft", "google", "apple", "amazon", "paypal", "ebay",
    "facebook", "twitter", "linkedin", "netflix", "spotify",
]
POSITIVE = [
    "great", "excellent", "amazing", "wonderful", "fantastic",
    "congratulations", "winner", "success", "benefit", "reward",
]
NEGATIVE = [
    "urgent", "problem", "issue", "error", "suspended", "locked",
    "expired", "failed", "denied", "blocked", "warning", "alert",
]
SENTIMENT_POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic"]
SENTIMENT_NEGATIVE = ["bad", "terrible", "awful", "horrible", "disgusting", "hate"]

SUPPORTED_LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "zh", "ja", "ko"]
DEFAULT_LANGUAGE = "en"

MANIPULATION_CATEGORIES = ["urgency", "fear", "authority", "greed", "trust"]
MANIPULATION = {
    "en": {
        "urgency": ["urgent", "immediate", "expires today", "act now", "limited time", "deadline"],
        "fear": ["suspended", "blocked", "security alert", "unauthorized", "compromised", "hacked"],
        "authority": ["bank", "government", "irs", "police", "legal action", "court"],
        "greed": ["winner", "prize", "lottery", "inheritance", "free money", "cash prize"],
        "trust": ["verify", "confirm", "update", "secure", "protect", "safety"],
    },
    "es": {
        "urgency": ["urgente", "inmediato", "expira hoy", "actúa ahora", "tiempo limitado"],
        "fear": ["suspendido", "bloqueado", "alerta de seguridad", "no autorizado", "comprometido"],
        "authority": ["banco", "gobierno", "hacienda", "policía", "acción legal"],
        "greed": ["ganador", "premio", "lotería", "herencia", "dinero gratis"],
        "trust": ["verificar", "confirmar", "actualizar", "seguro", "proteger"],
    },
    "fr": {
        "urgency": ["urgent", "immédiat", "expire aujourd'hui", "agissez maintenant", "temps limité"],
        "fear": ["suspendu", "bloqué", "alerte sécurité", "non autorisé", "compromis"],
        "authority": ["banque", "gouvernement", "impôts", "police", "action légale"],
        "greed": ["gagnant", "prix", "loterie", "héritage", "argent gratuit"],
        "trust": ["vérifier", "confirmer", "mettre à jour", "sécurisé", "protéger"],
    },
}
MANIPULATION_SHORT = {
    "urgency": ["urgent", "immediate", "expires today", "act now", "limited time"],
    "fear": ["suspended", "blocked", "security alert", "unauthorized", "compromised"],
    "authority": ["bank", "government", "irs", "police", "legal action"],
    "greed": ["winner", "prize", "lottery", "inheritance", "free money"],
}
SCAM_TERMS = {
    "en": ["nigerian prince", "advance fee", "wire transfer", "western union", "money gram"],
    "es": ["príncipe nigeriano", "tarifa adelantada", "transferencia bancaria"],
    "fr": ["prince nigérian", "frais d'avance", "virement bancaire"],
}
MONEY_PATTERN = r"\$[\d,]+|€[\d,]+|£[\d,]+"
PHONE_PATTERN = r"\+?\d{1,3}[-.\s]?\(?\d{1,3}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}"

# URL tables
SUSPICIOUS_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".click", ".download", ".zip",
    ".exe", ".scr", ".bat", ".top", ".work", ".party",
]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly",
    "short.link", "tiny.cc", "is.gd", "buff.ly", "rebrand.ly",
]
LEGITIMATE_DOMAINS = [
    "microsoft.com", "google.com", "amazon.com", "paypal.com",
    "apple.com", "facebook.com", "twitter.com", "linkedin.com",
    "github.com", "stackoverflow.com", "wikipedia.org",
]
FEATURE_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly",
    "short.link", "tiny.cc", "is.gd", "buff.ly",
]
FEATURE_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".click", ".download",
    ".zip", ".exe", ".scr", ".bat",
]
FEATURE_DOMAINS = [
    "microsoft.com", "google.com", "amazon.com", "paypal.com",
    "apple.com", "facebook.com", "twitter.com", "linkedin.com",
]
PATH_WORDS = [
    "login", "signin", "verify", "update", "secure", "account",
    "banking", "paypal", "amazon", "microsoft", "google",
]
REDIRECT_PARAMS = ["redirect", "url", "link", "goto", "next"]
URL_BRANDS = ["paypal", "amazon", "microsoft"]

# Attachment tables
EXTENSION_SCORES = {
    ".exe": 0.9, ".scr": 0.9, ".bat": 0.8, ".cmd": 0.8,
    ".pif": 0.9, ".com": 0.8, ".msi": 0.7, ".vbs": 0.8,
    ".js": 0.6, ".jar": 0.7, ".zip": 0.4, ".rar": 0.4,
    ".7z": 0.4, ".ace": 0.5, ".cab": 0.5, ".iso": 0.6,
    ".img": 0.6, ".dmg": 0.5, ".pkg": 0.5, ".deb": 0.4,
    ".rpm": 0.4, ".tar.gz": 0.3, ".tar.bz2": 0.3,
}
EXECUTABLE_EXTENSIONS = [
    ".exe", ".scr", ".bat", ".cmd", ".pif", ".com", ".msi",
    ".app", ".deb", ".rpm", ".pkg", ".dmg",
]
DOCUMENT_EXTENSIONS = [
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".pdf", ".rtf", ".odt", ".ods", ".odp",
]
TWO_PART_EXTENSIONS = [".tar.gz", ".tar.bz2"]
FEATURE_SUSPICIOUS_EXTENSIONS = [
    ".exe", ".scr", ".bat", ".cmd", ".pif", ".vbs", ".js",
    ".jar", ".zip", ".rar", ".7z", ".ace",
]
FEATURE_EXECUTABLE_EXTENSIONS = [".exe", ".scr", ".bat", ".cmd", ".pif", ".com", ".msi"]
FILENAME_WORDS = [
    "invoice", "receipt", "document", "photo", "image",
    "urgent", "important", "confidential", "secure",
]
SUSPICIOUS_MIME_TYPES = [
    "application/x-executable", "application/x-msdownload", "application/x-msdos-program",
]
# Media types by extension come from the standard table of the Python library
EXPECTED_MIME = {
    **mimetypes.MimeTypes(filenames=()).types_map[True],
    ".tar.gz": "application/x-tar",
    ".tar.bz2": "application/x-tar",
}
LARGE_FILE_BYTES = 100 * 1024 * 1024
FEATURE_LARGE_BYTES = 10 * 1024 * 1024

# Header tables
HIGH_RISK_COUNTRIES = ["CN", "RU", "NG", "PK", "IN", "BD", "VN", "ID", "PH", "MY"]
FEATURE_HIGH_RISK_COUNTRIES = ["CN", "RU", "NG", "PK", "IN"]
DISPOSABLE_DOMAINS = [
    "tempmail", "guerrillamail", "10minutemail", "mailinator",
    "yopmail", "throwaway", "temp-mail", "fakeinbox",
]
KNOWN_IP_COUNTRIES = {"8.8.8.8": "US", "1.1.1.1": "US", "208.67.222.222": "US"}
UNKNOWN_COUNTRY = "XX"
# IPv4 blocks that are not globally reachable (network, prefix length)
NON_PUBLIC_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]

# Mail handling
WHITELIST_DOMAINS = [
    "microsoft.com", "office.com", "outlook.com",
    "google.com", "gmail.com", "github.com",
    "linkedin.com", "amazon.com", "apple.com",
]
VISUAL_BRANDS = [
    "microsoft", "google", "apple", "amazon", "paypal", "ebay",
    "facebook", "instagram", "twitter", "linkedin", "netflix",
    "spotify", "adobe", "dropbox", "zoom", "slack",
]
RESPONSE_ACTIONS = {
    "CRITICAL": ["quarantine", "block_sender", "alert_admin", "create_incident", "scan_similar"],
    "HIGH": ["quarantine", "alert_admin", "scan_similar"],
    "MEDIUM": ["quarantine", "alert_admin"],
    "LOW": ["alert_admin"],
}
SUSPICIOUS_AGENTS = ["bot", "crawler", "scanner", "exploit"]
SENSITIVE_COLUMNS = [
    "email_body", "email_content", "attachment_content",
    "personal_info", "credentials", "api_keys",
]
RATE_LIMITS = {"analyze": 10, "api": 100, "web": 200}
RATE_WINDOW_SECONDS = 3600
IOC_TTL_SECONDS = 3600
IOC_SOURCES = {
    "url": ["virustotal", "urlhaus", "phishtank", "custom_feeds"],
    "ip": ["abuseipdb", "virustotal_ip", "custom_feeds"],
    "domain": ["virustotal_domain", "custom_feeds"],
    "hash": ["virustotal_hash", "hybrid_analysis"],
}
MODEL_PRIORITY = ["random_forest", "svm", "deep_learning"]
MODEL_WEIGHTS = [0.3, 0.3, 0.4]
CONFIDENCE_THRESHOLD = 0.7
SEVERITY_SCORES = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}


@dataclass(frozen=True)
class Rule:
    """A detection rule: it matches when every group has at least one of its strings.

    ``pattern`` rules match instead when the regular expression occurs more than
    ``more_than`` times.
    """

    name: str
    category: str
    severity: str
    groups: tuple[tuple[str, ...], ...] = field(default=())
    pattern: str | None = None
    more_than: int = 0

    @property
    def score(self) -> float:
        return SEVERITY_SCORES.get(self.severity, 0.5)


RULES = [
    Rule("Phishing_Urgent_Action", "phishing", "high", (
        ("urgent", "immediate action", "act now", "expires today", "limited time"),
        ("click here", "verify account", "update payment", "confirm identity"),
    )),
    Rule("Phishing_Credential_Harvesting", "phishing", "critical", (
        ("login", "password", "username", "account suspended", "verify credentials"),
        ("microsoft", "google", "amazon", "paypal", "apple"),
    )),
    Rule("Phishing_Financial_Scam", "financial_scam", "high", (
        ("wire transfer", "bitcoin", "cryptocurrency", "gift card", "western union"),
        ("lottery winner", "inheritance", "tax refund", "prize money"),
    )),
    Rule("Suspicious_Attachment_Extensions", "malware", "medium", (
        (".exe", ".scr", ".bat", ".cmd", ".pif", ".vbs", ".js", ".jar"),
    )),
    Rule("Macro_Enabled_Documents", "malware", "medium", (
        ("enable macros", "enable content", "macro security"),
    )),
    Rule("URL_Shortener_Evasion", "evasion", "medium", (
        ("bit.ly", "tinyurl", "t.co", "goo.gl", "ow.ly"),
    )),
    Rule("Base64_Encoded_Content", "evasion", "low",
         pattern=r"[A-Za-z0-9+/]{20,}={0,2}", more_than=3),
]
# ------------------------------------------------------------ end fixed values

FEATURE_LEXICONS = {
    "urgent": URGENT,
    "suspicious": SUSPICIOUS,
    "financial": FINANCIAL,
    "brand": BRAND,
    "positive": POSITIVE,
    "negative": NEGATIVE,
}


def lexicon_rows() -> list[tuple[str, str, str, int, str]]:
    """All built-in terms as (lexicon, lang, category, position, term) rows."""
    rows = [
        ("feature", "any", name, i, term)
        for name, terms in FEATURE_LEXICONS.items()
        for i, term in enumerate(terms)
    ]
    rows += [
        ("sentiment", "any", name, i, term)
        for name, terms in (("positive", SENTIMENT_POSITIVE), ("negative", SENTIMENT_NEGATIVE))
        for i, term in enumerate(terms)
    ]
    rows += [
        ("manipulation", lang, category, i, term)
        for lang, categories in MANIPULATION.items()
        for category, terms in categories.items()
        for i, term in enumerate(terms)
    ]
    rows += [
        ("manipulation_short", "any", category, i, term)
        for category, terms in MANIPULATION_SHORT.items()
        for i, term in enumerate(terms)
    ]
    rows += [
        ("scam", lang, "scam", i, term)
        for lang, terms in SCAM_TERMS.items()
        for i, term in enumerate(terms)
    ]
    return rows


LEXICON_SCHEMA = "lexicon string, lang string, category string, position int, term string"


def lexicon_table(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """The lexicon as a DataFrame; ``extra`` rows add terms or whole languages."""
    return spark.createDataFrame(lexicon_rows() + list(extra or []), LEXICON_SCHEMA)


RULE_SCHEMA = (
    "rule_name string, category string, severity string, "
    "groups array<array<string>>, pattern string, more_than int"
)


def rule_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rules as a DataFrame."""
    return spark.createDataFrame(
        [(r.name, r.category, r.severity, [list(g) for g in r.groups], r.pattern, r.more_than)
         for r in (RULES if rules is None else rules)],
        RULE_SCHEMA,
    )


def rules_from(table: DataFrame, max_rules: int = 5000) -> list[Rule]:
    """Read a rule table into job parameters; refuses tables above ``max_rules``."""
    rows = table.limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"rule table has more than {max_rules} rows")
    return [
        Rule(r.rule_name, r.category, r.severity,
             tuple(tuple(g) for g in (r.groups or [])), r.pattern, r.more_than or 0)
        for r in rows
    ]
