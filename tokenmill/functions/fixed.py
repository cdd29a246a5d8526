"""Fixed values. Results depend on every entry, so they are kept as plain lists in natural order."""

# --- fixed values: prompt guardrail -------------------------------------------------------------
UNSAFE_PHRASES = [
    "ignore previous instructions",
    "system prompt",
    "jailbreak",
    "override settings",
    "you are now a",
    "bypass security",
]
GUARDRAIL_DISTANCE = 0.15

# --- fixed values: cache bypass phrases ---------------------------------------------------------
BYPASS_PHRASES = [
    "/nocache",
    "nicht vom cache",
    "cache prompt neu",
    "cache nicht berücksichtigen",
    "nicht aus dem cache",
    "kein cache",
    "cache ignorieren",
    "cache erneuern",
    "cache aktualisieren",
    "aktualisiere cache",
    "cache neu laden",
    "ohne cache",
    "cache umgehen",
    "bypass cache",
    "refresh cache",
    "force refresh",
]

# --- fixed values: code intent ------------------------------------------------------------------
CODE_WORDS = ["js", "git", "sql", "css", "php", "class", "script", "code", "function", "program", "develop"]
CODE_STEMS = [
    "html", "bootstrap", "python", "javascript", "programming", "algorithm", "database", "mysql",
    "mariadb", "postgres", "sqlite", "query", "docker", "codeblock", "syntax",
]
INTENTS = ["code", "creative", "support", "general"]

# --- fixed values: similarity rules -------------------------------------------------------------
TOGGLE_WORDS = [
    "enable", "disable", "activate", "deactivate", "on", "off", "true", "false", "not", "no", "never",
]
SCORE_GATE = 0.85
CACHE_TTL_SECONDS = {"code": 604800, "creative": 86400, "support": 14400, "general": 86400}
DEFAULT_TTL_SECONDS = 86400

# --- fixed values: prompt compression -----------------------------------------------------------
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
PROGRESS_BRACKET = r"\[[=#>-]+[ ]*\]\s*\d+%\s*"
PROGRESS_BLOCKS = r"\d+%\s*\|[█░ 🮆 ]*\|"
NOISE_PREFIXES = ["Resolved ", "Fetch ", "Downloading "]
PLEASANTRIES = [
    "hello", "hi", "hey", "please", "kindly", "thank you", "thanks", "could you", "would you", "can you",
    "i would like you to", "i need you to", "help me to", "help me",
]
ARTICLES = ["a", "an", "the"]
AUXILIARIES = ["is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had"]
PREPOSITIONS_PRONOUNS = [
    "to", "for", "of", "in", "on", "at", "with", "by",
    "i", "me", "you", "we", "us", "they", "him", "them", "he", "she", "it",
    "my", "your", "our", "their", "his", "her",
]
MIN_CHARS = 150
MIN_WORDS = 30
FORCED_TOKENS = ["\n", "?", "!", ".", ":", "-"]
DEFAULT_RATE = 0.70

# --- fixed values: prices, USD per token (listed order decides) ---------------------------------
DEFAULT_PRICES = [
    ("claude-3-5-sonnet-20240620", "0.000003", "0.000015"),
    ("claude-3-5-sonnet", "0.000003", "0.000015"),
    ("gpt-4o-mini", "0.00000015", "0.0000006"),
    ("gemini-1.5-flash", "0.000000075", "0.0000003"),
    ("semantic-cache", "0", "0"),
]
GENERIC_PRICE = ("0.000002", "0.00001")
FREE_PROVIDER = "ollama"
PRICE_ALIASES = [
    ("anthropic/claude-3.5-sonnet", ["claude-3-5-sonnet-20240620", "claude-3.5-sonnet", "claude-3-5-sonnet"]),
    ("openai/gpt-4o-mini", ["gpt-4o-mini"]),
    ("google/gemini-flash-1.5", ["gemini-1.5-flash", "gemini-flash-1.5"]),
    ("google/gemini-1.5-flash", ["gemini-1.5-flash", "gemini-flash-1.5"]),
    ("openai/gpt-4o", ["gpt-4o"]),
    ("anthropic/claude-3-opus", ["claude-3-opus", "claude-3-opus-20240229"]),
    ("anthropic/claude-3-haiku", ["claude-3-haiku", "claude-3-haiku-20240307"]),
]
DEFAULT_MODELS = ["gpt-4o-mini", "gemini-1.5-flash", "claude-3-5-sonnet-20240620"]

# --- fixed values: metering ---------------------------------------------------------------------
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60
LOW_BUDGET_SHARE = 0.10
ALERT_SILENCE_SECONDS = 3600
MEMO_SECONDS = 3600
QUEUE_BATCH = 100

# --- fixed values: dashboard --------------------------------------------------------------------
CACHED_INTENT = "cached"
CACHED_MODEL = "semantic-cache"
MAX_LOCAL_MODEL_GB = 16.0
MODEL_RENAMES = [
    ("claude-3-5-sonnet", "claude-3.5"),
    ("gemini-3.5-flash", "gemini-3.5-f"),
    ("gemini-1.5-flash", "gemini-1.5-f"),
    ("gemini-1.5-pro", "gemini-1.5-p"),
    ("gpt-4o-mini", "gpt-4o-m"),
]
THRESHOLD_BANDS = [
    (0.12, "Very strict (identical wording)"),
    (0.22, "Moderately strict (minor variations)"),
    (0.32, "Recommended / Tolerant (synonymous)"),
]
THRESHOLD_TOP_BAND = "Very tolerant (risk of false matches)"

# --- fixed values: default route when no rule exists --------------------------------------------
DEFAULT_RULE = {
    "provider": "openai",
    "model": "gpt-4o-mini",
    "url": "https://api.openai.com/v1/chat/completions",
    "api_key_env": "OPENAI_API_KEY",
    "weight": 100,
    "fallback_provider": "google",
    "fallback_model": "gemini-1.5-flash",
    "fallback_url": "https://generativelanguage.googleapis.com/v1beta/openai/chat/completions",
    "fallback_api_key_env": "GEMINI_API_KEY",
}
DEFAULT_MAX_TOKENS = 4096
DEFAULT_TEMPERATURE = 1.0
DEFAULT_WEIGHT = 100

# The wording of the alert messages, which is their output.
LOW_BUDGET_TEXT = (
    "⚠️ *%s Alert: Budget Threshold Warning* ⚠️\n"
    "• *API Key*: `%s`\n"
    "• *Remaining Balance*: `$%s`\n"
    "• *Total Allocated Budget*: `$%s`\n"
    "• *Status*: Remaining budget has dropped below 10%%. Please top up."
)
FAILOVER_TEXT = (
    "🚨 *%s Alert: Downstream Failover* 🚨\n"
    "• *Intent Category*: `%s`\n"
    "• *Failed Model*: `%s`\n"
    "• *Failover Target*: `%s`\n"
    "• *Error Trigger*: `%s`\n"
    "• *Status*: Request automatically routed to backup model."
)
